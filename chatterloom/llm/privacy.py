"""Personal information in free text, found and replaced by typed placeholders.

Texts are first brought to one readable form (wrong encodings undone, look-alike characters
mapped), cut into tokens, and labelled by the skip-chain field of :mod:`crf`. Runs of one
label are spans; an exact check drops spans that cannot be what they are labelled as (an
address without a number, a phone number of three digits). The weights were fitted by
:mod:`fit_privacy` and lie beside this module.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from chatterloom.functions.plan import spread
from chatterloom.llm.crf import LABELS, TOKEN, Model, marginals
from chatterloom.llm.encoding import restore
from chatterloom.llm.lookalike import canonical

WEIGHTS = os.path.join(os.path.dirname(__file__), "privacy_weights.json")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|(?<!\bme)(?<!\bus)\sat\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_DIGIT = "zero|one|two|three|four|five|six|seven|eight|nine|oh|double|treble|triple"
_STREET = (
    r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|crescent|close|terrace|parade|court|ct|place|square|way|boulevard|blvd|row|gardens?|hill|weg|straße|strasse|platz|gasse"
)
#: Shapes an entity may have; the field weighs them with the words around. In order of precedence.
SHAPES = [
    ("email", re.compile(rf"(?i)(?:mailto:)?<?[\w+\-]+(?:{_DOT}[\w+\-]+)*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+>?")),
    ("address", re.compile(
        rf"(?i)\b(?:flat|apt|unit|suite)\s\d+[a-z]?,?\s\d+[a-z]?\s[^\W\d]+(?:\s[^\W\d]+)?\s(?:{_STREET})\b\.?|\bp\.?\s?o\.?\sbox\s\d+|\b\d+[a-z]?(?:/\d+)?(?:\s(?:bis|ter))?,?\s(?:[^\W\d]+\s){{1,3}}(?:{_STREET})\b\.?"
        rf"|\b\d+(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée)\s[^\n,.]{{2,40}}|(?:\bcalle|\bavda\.?|\bavenida|\bc/|\bplaza|\bpaseo)\s[^\d\n,]{{2,30}}\s\d+(?:,\s\d+\s?[oº]\s?[a-z])?|\b(?:am\s)?[^\W\d]+(?:weg|straße|strasse|gasse|platz|graben|allee)\s\d+(?:,\s\d{{5}}\s[^\W\d]+)?|\b[A-Z]{{2}}\d{{1,2}}\s\d[A-Z]{{2}}\b"
    )),
    ("id_number", re.compile(
        r"(?i)\b[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d]\b|\b\d{3}-\d{2}-\d{4}\b|\b\d{6}[-+]\d{4}\b|\b\d{8}\s?-?\s?[a-z]\b|\b[xyz]-?\d{7}-?[a-z]\b|\b[a-z]{4,5}\s?\d{6,7}\s?[a-z0-9]{1,3}\s?\d{0,2}[a-z]{2}\b|\b[a-z]\d{8}\b|\b\d{4}\s\d{4}\s\d{4}\b|\b\d{9}\b"
    )),
    ("phone", re.compile(
        rf"(?i)(?:tel:)?(?:\+|\b00|\(|\b)\d[\d\s().\-‑‐]{{5,20}}\d(?:\s?(?:ext|x)\.?\s?\d{{1,5}})?|\b(?:(?:plus\s)?(?:{_DIGIT})\s){{6,}}(?:{_DIGIT})\b"
    )),
]
#: What a text must hold for a shape to be in it.
_HINTS = [re.compile(r"(?i)@|at\W"), re.compile(r"\d"), re.compile(r"\d"), re.compile(rf"(?i)\d|\b(?:{_DIGIT})\b")]


def tokenize(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    hits = list(TOKEN.finditer(text.replace("’", "'")))
    return [m.group(0) for m in hits], [m.span() for m in hits]


def mark(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """For each token the shape it lies in, or ``""``."""
    out = [""] * len(spans)
    starts: list[int] | None = None
    for (kind, pattern), hint in zip(SHAPES, _HINTS):
        if hint.search(text) is None:
            continue
        for m in pattern.finditer(text):
            starts = starts or [s for s, _ in spans]
            i = bisect_left(starts, m.start())
            while i < len(spans) and spans[i][1] <= m.end():
                out[i] = out[i] or kind
                i += 1
    return out


def _plausible(kind: str, span: str) -> bool:
    digits = sum(c.isdigit() for c in span)
    if kind == "email":
        return "@" in span or re.search(r"(?i)\bat\b", span) is not None
    if kind == "phone":
        return digits >= 7 or len(re.findall(rf"(?i)\b(?:{_DIGIT})\b", span)) >= 6
    if kind == "id_number":
        return digits >= 6
    if kind == "address":
        return digits >= 1 and re.search(r"[^\W\d_]{2}", span) is not None
    return any(c.isalpha() for c in span) and not digits


def _exact(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """A span with its ends where they must be: an address for mail is as long as its shape, a
    street address holds the whole of its shape and no plain words before it, and no span
    starts or ends with a blank, comma or dash."""
    if kind in ("email", "address"):
        pattern = SHAPES[0 if kind == "email" else 1][1]
        for m in pattern.finditer(text, max(0, start - 200), end + 200):
            if m.start() < end and m.end() > start:
                if kind == "email":
                    return m.span()
                if not re.search(r"[\d,\n]", text[start : m.start()]):
                    start = m.start()
                end = max(end, m.end())
                break
    while start < end and (text[start].isspace() or text[start] in ",;:-–—!?." or text[start] == "(" and kind != "phone"):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in ",;:-–—!?"):
        end -= 1
    return start, end


@lru_cache(maxsize=4)
def model(path: str = WEIGHTS, skip: float = 1.0) -> Model:
    made = Model.load(path)
    return made if skip == 1.0 else made.with_skip(skip)


def find(texts: list[str], path: str = WEIGHTS, skip: float = 1.0) -> list[list[tuple[str, int, int]]]:
    """Spans ``(kind, start, end)`` of each text, in order; ``skip`` multiplies the skip potentials."""
    cut = [tokenize(t) for t in texts]
    docs = [c[0] for c in cut]
    marks = [mark(t, c[1]) for t, c in zip(texts, cut)]
    out = []
    for text, (doc, spans), p in zip(texts, cut, marginals(model(path, skip), docs, marks)):
        best, found = p.argmax(axis=1) if len(doc) else [], []
        i = 0
        while i < len(doc):
            k, j = best[i], i
            while j + 1 < len(doc) and best[j + 1] == k:
                j += 1
            if k:
                s, e = _exact(LABELS[k], text, spans[i][0], spans[j][1])
                if _plausible(LABELS[k], text[s:e]):
                    found.append((LABELS[k], s, e))
            i = j + 1
        out.append(found)
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in spans:
        tail = text[e - 1] if text[e - 1] in ".,\n" and kind != "name" else ""
        out += [text[at:s], PLACEHOLDER[kind], tail]
        at = e
    return "".join(out) + text[at:]


# non-deterministic to the optimizer: else a filter on its result is pushed below and runs it twice
@F.pandas_udf(StructType([StructField("clean", StringType()), StructField("kinds", ArrayType(StringType()))]))
def _scan_udf(values: pd.Series) -> pd.DataFrame:
    known = [v for v in dict.fromkeys(values) if v]
    forms = [canonical(restore(v)[0]) for v in known]
    spans = find(forms)
    done = {v: (redact(f, s), sorted({k for k, _, _ in s})) for v, f, s in zip(known, forms, spans)}
    return pd.DataFrame([done.get(v, (v, [])) for v in values], columns=["clean", "kinds"])


_scan_udf = _scan_udf.asNondeterministic()


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, clean, kinds``: each text with placeholders and the kinds found in it.

    Null and empty texts come back as they are with no kinds; repeated rows are kept; a text
    without personal information is returned in its readable form.
    """
    found = rows.select(F.col(key), _scan_udf(F.col(text)).alias("s"), F.col(text).alias("t"))
    return found.select(key, F.when(F.col("t").isNull(), None).otherwise(F.col("s.clean")).alias("clean"), "s.kinds")


def personal_found(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """``src, rec_id, kind``: every stored record and kind of personal data in it."""

    def one(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
        hit = scan(spread(df.select(key, text).where(F.col(text).isNotNull())), key, text)
        return hit.select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), F.explode("kinds").alias("kind"))

    return one(messages, "messages", "msg_id", "text").unionByName(one(pairs, "pairs", "pair_id", "reply"))


def redacted(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """``src, rec_id, clean``: every stored message and reply with placeholders, one row a record."""

    def one(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
        return scan(spread(df.select(key, text)), key, text).select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), "clean")

    return one(messages, "messages", "msg_id", "text").unionByName(one(pairs, "pairs", "pair_id", "reply"))
