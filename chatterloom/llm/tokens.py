"""Token ids of every text by a public byte-level tokenizer.

The vocabulary is a rank file whose path is a parameter; every Python worker reads it once.
Long texts are cut, before encoding, at boundaries the tokenizer's own pre-splitting always
cuts at, so the pieces' ids joined are the ids of the whole text; ids are decoded through raw
bytes, because a single id need not be whole UTF-8.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from chatterloom.functions.plan import spread

#: Pre-splitting pattern of the byte-level vocabularies (fixed value of the tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text encoded at once.
CHUNK = 8192
#: A letter followed by one blank and an ASCII letter: the pattern always starts a piece at the blank.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])|(?<=[^\W\d_])(?=\n[A-Za-z])")


def default_ranks(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a rank file: ``$TOKENIZER_DIR``, the installed vocabulary package, or /opt/tokenizers."""
    home = os.environ.get("TOKENIZER_DIR")
    if not home:
        spec = importlib.util.find_spec("public_tokenizers")
        home = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(home, name)


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` in order, cut only where pre-splitting cuts; a text without such a place stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, path: str) -> list[int]:
    """Ids without special tokens; null and empty texts have none."""
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def encode_array(text: str, path: str) -> np.ndarray:
    """As :func:`encode`, as an array."""
    enc = encoder(path)
    if len(text) <= CHUNK:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)])


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id."""
    enc = encoder(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.max_token_value + 1)], dtype=np.int64)


def decode(ids: Iterable[int], path: str) -> str:
    return encoder(path).decode_bytes(list(ids)).decode("utf-8", errors="replace")


def ids_of(text: Column, path: str | None = None) -> Column:
    """Column of token ids; lone surrogates cannot occur in Spark strings."""
    where = path or default_ranks()

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: encode(v, where))

    return run(text)


def count_of(text: Column, path: str | None = None) -> Column:
    where = path or default_ranks()

    @F.pandas_udf(IntegerType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: len(encode_array(v, where)) if v else 0).astype("int32")

    return run.asNondeterministic()(text)  # or filters on the count would run it twice


def counts_of(texts: list[Column], path: str | None = None) -> Column:
    """Array of the numbers of tokens of several columns, in one pass."""
    where = path or default_ranks()

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([[len(encode_array(v, where)) if v else 0 for v in row] for row in zip(*columns)])

    return run.asNondeterministic()(*texts)  # or filters on the counts would run it twice


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids`` of every row: repeated rows and keys are kept, nulls give an empty list."""
    return spread(documents.select(key, text)).select(F.col(key), ids_of(F.col(text), path).alias("ids"))
