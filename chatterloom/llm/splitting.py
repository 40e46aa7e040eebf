"""Oversized texts cut into pieces at natural boundaries.

Recursive bisection over the token ids of a text: the cut is the strongest boundary in the
middle half, the nearest to the midpoint among equals; halves still larger than the limit less
the overlap are cut again; then every piece but the first is lengthened in front by the last
``overlap`` tokens of the text before it. Boundaries from strong to weak: paragraph, line,
sentence, clause, word, character. A piece never exceeds the limit and consecutive pieces
share exactly the stated number of tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from chatterloom.functions.plan import spread
from chatterloom.llm.tokens import byte_lengths, default_ranks, encode_array



def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SPACE, _STOP, _PAUSE = _flags(b"\t\n\x0b\x0c\r "), _flags(b".!?"), _flags(b",;:)")
#: Sentence ends and pauses of other scripts, by their three UTF-8 bytes as one number.
_WIDE_STOP = np.array(sorted(int.from_bytes(c.encode(), "big") for c in "。！？｡…"))
_WIDE_PAUSE = np.array(sorted(int.from_bytes(c.encode(), "big") for c in "，、；："))


def strengths(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Strength of the boundary in front of each byte offset: 5 paragraph, 4 line, 3 sentence,
    2 clause, 1 word, 0 character, -1 inside a character."""
    b = np.frombuffer(raw, dtype=np.uint8)
    prev, cur = b[np.maximum(at - 1, 0)], b[np.minimum(at, len(b) - 1)]
    prev2 = b[np.maximum(at - 2, 0)]
    blank = _SPACE[prev]
    gap = blank | _SPACE[cur]
    out = gap.astype(np.int8)
    last = np.where(blank, prev2, prev)
    out[gap & _PAUSE[last]] = 2
    out[gap & _STOP[last]] = 3
    wide = np.flatnonzero(prev >= 0x80)
    if len(wide):
        code = (b[np.maximum(at[wide] - 3, 0)].astype(np.int64) << 16) | (prev2[wide].astype(np.int64) << 8) | prev[wide]
        out[wide[np.isin(code, _WIDE_PAUSE)]] = 2
        out[wide[np.isin(code, _WIDE_STOP)]] = 3
    line = np.flatnonzero((prev == 10) | ((prev == 13) & (cur != 10)))
    out[line] = 4
    before = prev2[line]
    third = b[np.maximum(at[line] - 3, 0)]
    out[line[(prev[line] == 10) & ((before == 10) | ((before == 13) & (third == 10)))]] = 5
    out[(cur & 0xC0) == 0x80] = -1
    return out


def bisect(n: int, core: int, strength: np.ndarray) -> list[int]:
    """Cut positions, ascending, so that no stretch of ``n`` tokens exceeds ``core``."""
    cuts, stack = [], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= core:
            continue
        quarter = (b - a) // 4
        lo, hi = max(a + 1, a + quarter), min(b - 1, b - quarter)
        mid = (a + b) // 2
        s = strength[lo : hi + 1]
        # the strongest, then the nearest to the midpoint, then the earlier
        top = np.flatnonzero(s == s.max()) + lo
        best = top[np.abs(top - mid).argmin()]
        cuts.append(int(best))
        stack += [(a, int(best)), (int(best), b)]
    return sorted(cuts)


def split(text: str | None, limit: int, overlap: int, path: str) -> list[tuple[int, int, int, str]]:
    """``(piece, start, n_tokens, text)`` of a text over the limit; none for one within it.

    ``start`` counts tokens of the whole text. Where an overlap starts inside a character, the
    piece's text leaves that character out (its ids still share the full overlap).
    """
    return [p[1:] for p in split_all(text, [(0, limit, overlap)], path)]


def split_all(text: str | None, limits: list[tuple[int, int, int]], path: str) -> list[tuple[int, int, int, int, str]]:
    """``(limit_id, piece, start, n_tokens, text)`` for each limit; the text is encoded once."""
    if any(m < 1 for _, m, _ in limits):
        raise ValueError("a limit must be positive")
    if not text or not limits:
        return []
    ids = encode_array(text, path)
    n = len(ids)
    if n <= min(m for _, m, _ in limits):
        return []
    raw = text.encode("utf-8")
    offsets = np.concatenate([[0], np.cumsum(byte_lengths(path)[ids])])
    strength = strengths(raw, offsets[:-1])
    at, out = offsets.tolist(), []
    for i, limit, overlap in limits:
        if n <= limit:
            continue
        overlap = max(0, min(overlap, limit - 1))
        edges = [0, *bisect(n, limit - overlap, strength), n]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            start = max(0, a - overlap) if k else 0
            out.append((i, k, start, b - start, raw[at[start] : at[b]].decode("utf-8", errors="ignore")))
    return out


_PIECE = StructType([StructField("limit_id", IntegerType()), StructField("piece", IntegerType()), StructField("start", IntegerType()), StructField("n_tokens", IntegerType()), StructField("text", StringType())])


def split_corpus(documents: DataFrame, limits: list[tuple[int, int, int]], key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``limit_id, key, piece, start, n_tokens, text`` of every text over each limit.

    ``limits`` lists ``(limit_id, max_tokens, overlap_tokens)``. Null and empty texts and texts
    within a limit give no pieces.
    """
    where = path or default_ranks()

    # non-deterministic to the optimizer: else a filter on its result is pushed below and runs it twice
    @F.pandas_udf(ArrayType(_PIECE))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: split_all(v, limits, where))

    # a token is at least one byte: shorter texts cannot exceed the smallest limit
    least = min((m for _, m, _ in limits), default=0)
    slim = documents.select(key, text)
    big = slim.where(F.octet_length(F.col(text)) > least) if limits else slim.where("false")
    return spread(big).select(F.col(key), F.explode(run.asNondeterministic()(F.col(text))).alias("p")).select("p.limit_id", key, "p.piece", "p.start", "p.n_tokens", "p.text")
