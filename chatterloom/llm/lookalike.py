"""One form for text that looks the same but differs in characters.

Compatibility normalisation in composed form, white space mapped to blanks, removal of
default-ignorable characters, look-alike letters mapped, and full case folding where case is
not to count. The work is done once per distinct value; values in printable ASCII never
leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatterloom.sources.text_export import NOISE

#: Letters of other scripts and the Latin letters they look like (fixed values).
LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "h", "Ь": "b",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I", "ү": "y", "ց": "g", "ո": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k", "γ": "y",
    "օ": "o", "ս": "u", "հ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "ı", "ℓ": "l",
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "‘": "'", "’": "'", "ʼ": "'", "‛": "'", "“": '"', "”": '"',
}
_MAP = str.maketrans(LOOKALIKE)
#: Default-ignorable code points as ranges (fixed values of the Unicode property); the joiner
#: U+200D is handled apart because it also builds emoji.
IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200c\u200e\u200f\u202a-\u202e"
    "\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
_IGN = re.compile(f"[{IGNORABLE}]+")
_PICT = "\u2190-\u21ff\u2300-\u23ff\u25a0-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
_JOINER = re.compile(f"(?<![{_PICT}])\u200d|\u200d(?![{_PICT}])")
_BLANK = re.compile(r"[^\S\n]")
_LINE = re.compile("\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_ASCII = r"^[\x{0a}\x{20}-\x{7e}]*$"
_JVM_IGN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{2800}\x{fff0}-\x{fff8}\x{e0000}-\x{e0fff}]"
_JVM_WS = r"\x{0}-\x{20}\x{7f}-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Bodies that exporters write for what is not text, without brackets.
PLACEHOLDERS = [n.strip("<>") for n in NOISE]


def strip_invisible(text: str) -> str:
    return _JOINER.sub("", _IGN.sub("", text))


def _base(text: str) -> str:
    t = strip_invisible(_LINE.sub("\n", text))
    t = unicodedata.normalize("NFKC", _BLANK.sub(" ", t))
    return _BLANK.sub(" ", strip_invisible(t)).strip()


def skeleton(text: str | None, fold: bool = False) -> str | None:
    """Comparison key: equal for two texts exactly when they look the same to a reader.

    ``fold`` makes case not count. Null stays null; an invisible text becomes empty. Line
    breaks stay line breaks; runs of blanks are kept, outer white space goes.
    """
    if text is None:
        return None
    t = _base(text)
    if not t.isascii():
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(_MAP))
    return unicodedata.normalize("NFC", t.casefold()) if fold else t


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "other"


@lru_cache(maxsize=1)
def _reverse() -> dict[str, dict[int, str]]:
    out: dict[str, dict[int, str]] = {"greek": {}, "cyrillic": {}}
    for k, v in LOOKALIKE.items():
        if (s := _script(k)) in out and v.isalpha():
            out[s].setdefault(ord(v), k)
    return out


def _one_script(m: re.Match[str]) -> str:
    word = unicodedata.normalize("NFD", m.group(0))
    letters = [c for c in word if c.isalpha()]
    alien = {s: [c for c in letters if _script(c) == s] for s in ("greek", "cyrillic")}
    latin = [c for c in letters if _script(c) == "latin"]
    own = {s: sum(c not in LOOKALIKE for c in cs) for s, cs in alien.items()}
    best = max(own, key=lambda s: (own[s], len(alien[s])))
    if alien[best] and (own[best] or not latin) and all(ord(c) in _reverse()[best] for c in latin):
        return unicodedata.normalize("NFC", word.translate(_reverse()[best]))
    if latin:
        return unicodedata.normalize("NFC", word.translate(_MAP))
    return m.group(0)


def canonical(text: str | None) -> str | None:
    """Readable form: as :func:`skeleton`, but each word keeps the script it is written in;
    only letters that stray into a word of another script are replaced."""
    if text is None:
        return None
    t = _base(text)
    if t.isascii():
        return t
    t = _WORD.sub(_one_script, t)
    # words wholly of look-alikes go with the script of the rest of the text
    latin = sum(c < "\u0250" and c.isalpha() for c in t)
    alien = sum(_script(c) in ("greek", "cyrillic") and c not in LOOKALIKE for c in unicodedata.normalize("NFD", t))
    return _WORD.sub(_latinised, t) if latin > 2 * alien else t


def _latinised(m: re.Match[str]) -> str:
    word = unicodedata.normalize("NFD", m.group(0))
    letters = [c for c in word if c.isalpha()]
    if any(_script(c) in ("greek", "cyrillic") for c in letters) and all(c in LOOKALIKE or c < "\u0250" for c in letters):
        return unicodedata.normalize("NFC", word.translate(_MAP))
    return m.group(0)


def _vector(fn):
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        return values.map(lambda v: None if v is None else known[v] if v in known else known.setdefault(v, fn(v)))

    return run


_skeleton_udf, _folded_udf, _canonical_udf = _vector(skeleton), _vector(lambda v: skeleton(v, True)), _vector(canonical)


def with_form(df: DataFrame, value: str, out: str, form: str = "skeleton") -> DataFrame:
    """``df`` with ``out``: the ``form`` (``skeleton``, ``folded`` or ``canonical``) of ``value``."""
    udf = {"skeleton": _skeleton_udf, "folded": _folded_udf, "canonical": _canonical_udf}[form]
    plain = df[value].rlike(_ASCII) | df[value].isNull()
    ready = F.regexp_replace(df[value], "^[ \n]+|[ \n]+$", "")
    ready = F.lower(ready) if form == "folded" else ready
    # the UDF gets nulls for plain values, so they cost nothing in Python
    hard = udf(F.when(~plain, df[value]))
    return df.withColumn(out, F.coalesce(hard, ready))


def written(text: Column) -> Column:
    """True for text that is neither null, blank or invisible nor only an exporter's placeholder."""
    seen = F.regexp_replace(text, _JVM_IGN, "")
    seen = F.lower(F.regexp_replace(seen, f"^[{_JVM_WS}]+|[{_JVM_WS}]+$", ""))
    bare = F.regexp_replace(seen, r"^<\s*|\s*>$", "")
    return text.isNotNull() & (seen != "") & ~bare.isin(PLACEHOLDERS)


def same_look(rows: DataFrame, group: str, key: str, value: str, label: str) -> DataFrame:
    """Pairs of distinct stored values of a group that look the same: ``field, msg_a, msg_b``.

    Each distinct value of a group stands for the smallest key that holds it. Distinct
    values are found first (partial aggregation), so a repeated value costs one row.
    """
    one = rows.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.min(key).alias("id"))
    keyed = with_form(one, "v", "look").select("g", "look", "id")
    many = keyed.groupBy("g", "look").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    # a class is the variant spellings of one value in one file: bounded by spellings, not rows
    first = many.select("ids", F.posexplode("ids").alias("i", "msg_a"))
    pairs = first.select("msg_a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("msg_b"))
    return pairs.select(F.lit(label).alias("field"), "msg_a", "msg_b")


def same_look_found(messages: DataFrame) -> DataFrame:
    """``field, msg_a, msg_b`` over senders (null and empty left out) and written texts."""
    m = messages.select("file", "msg_id", "sender", "text").where("file is not null")
    texts = same_look(m.where(written(F.col("text"))), "file", "msg_id", "text", "text")
    senders = same_look(m.where("sender <> ''"), "file", "msg_id", "sender", "sender")
    return texts.unionByName(senders)
