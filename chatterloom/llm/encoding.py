"""Text that was decoded with the wrong character encoding, found and restored.

Each suspicious value starts a best-first search over operations (encode with one codec and
decode with another, or undo an escape). A state is a text; states already seen are skipped; the frontier is ordered by an implausibility cost of the characters, so the search
walks to the cheapest reachable text. A value is garbled when a cheaper text is reachable by
enough, or when it holds replacement characters, which nothing restores.

Whether a value is suspicious at all is decided in the JVM by one pattern that every
garbling must leave behind; the search runs once per distinct value of a batch.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from chatterloom.functions.plan import spread
from chatterloom.llm.lookalike import LOOKALIKE, strip_invisible

#: Any character outside ASCII, or an escape: what a garbled value must contain.
SUSPICIOUS = r"[^\x{0}-\x{7f}]|&#?[A-Za-z0-9]{2,8};|\\u[0-9A-Fa-f]{4}|%[89A-Fa-f][0-9A-Fa-f]|=[C-Fc-f][0-9A-Fa-f]=[89ABab]"
MARGIN = 1.0
STEP = 0.01
_ESCAPE = re.compile(r"&#?[A-Za-z0-9]{2,8};|\\u[0-9A-Fa-f]{4}|%[89A-Fa-f][0-9A-Fa-f]|=[C-Fc-f][0-9A-Fa-f]=[89ABab]")
#: Codecs a text may wrongly have been read with, and those it may have been written in.
READ_AS = ("latin-1", "cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp1254", "koi8_r", "cp866")
ALPHABETS = ("cp1251", "koi8_r", "cp866", "cp1253", "iso8859_5", "cp1255", "cp1256")
SYLLABARIES = ("shift_jis", "gbk", "big5", "euc_jp", "euc_kr")


def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for themselves, as browsers do."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_ENC = {c: _table(c) for c in READ_AS}
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: A complete UTF-8 sequence of two to four bytes.
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})")


def _utf8_runs(text: str, table: dict[str, int]) -> str:
    """Every UTF-8 sequence hidden in ``text`` decoded, the rest left as it is."""

    def run(m: re.Match[str]) -> str:
        out, chunk, part = [], bytearray(), []

        def flush() -> None:
            raw, at = bytes(chunk), 0
            for u in _UTF8.finditer(raw):
                out.extend(part[at : u.start()])
                try:
                    out.append(u.group(0).decode("utf-8"))
                except UnicodeDecodeError:
                    out.extend(part[u.start() : u.end()])
                at = u.end()
            out.extend(part[at:])
            chunk.clear()
            part.clear()

        for ch in m.group(0):
            b = table.get(ch)
            if b is None:
                flush()
                out.append(ch)
            else:
                chunk.append(b)
                part.append(ch)
        flush()
        return "".join(out)

    return _HIGH.sub(run, text)


def _legacy(text: str, table: dict[str, int], codec: str) -> str | None:
    try:
        return bytes(table[c] if c in table else _fail() for c in text).decode(codec)
    except (UnicodeDecodeError, KeyError):
        return None


def _fail() -> int:
    raise KeyError


def _legacy_words(text: str, table: dict[str, int], codec: str, letters: str = "\u00a3\u00a8\u00b3\u00b8\u00c0-\u00ff") -> str:
    """Words made wholly of high characters read again; for texts garbled in part."""

    def one(m: re.Match[str]) -> str:
        return _legacy(m.group(0), table, codec) or m.group(0)

    return re.sub(f"[{letters}]{{2,}}|(?<!\\S)[{letters}](?!\\S)", one, text)


def _unescape(text: str) -> str:
    t = html.unescape(text)
    t = re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m.group(1), 16)), t)
    return re.sub(r"(?:[%=][89A-Fa-f][0-9A-Fa-f])+", lambda m: _bytes(m.group(0)), t)


def _bytes(s: str) -> str:
    try:
        return bytes.fromhex(s.replace("%", "").replace("=", "")).decode("utf-8")
    except (UnicodeDecodeError, ValueError):
        return s


_CJK = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
_LATIN_HIGH = set(_ENC["latin-1"]) | set(_ENC["cp1252"])


def neighbours(text: str) -> list[str]:
    """Texts one operation away."""
    out = []
    high = {c for c in text if c > "\x7f"}
    for table in _ENC.values():
        if any(c in table for c in high):
            out.append(_utf8_runs(text, table))
    if high and high <= _LATIN_HIGH:
        dense = sum(c > "\x7f" for c in text) > 0.3 * sum(not c.isspace() for c in text)
        words = re.search("[\u00c0-\u00ff]{3}", text)
        for read in ("latin-1", "cp1252"):
            for codec in ALPHABETS if words else ():
                out.append(_legacy_words(text, _ENC[read], codec))
            for codec in SYLLABARIES if dense else ():
                t = _legacy(text, _ENC[read], codec)
                if t and len(_CJK.findall(t)) > 0.6 * sum(c > "\x7f" for c in t):
                    out.append(t)
    if any("\u4e00" <= c <= "\u9fff" for c in high):
        try:
            out.append(text.encode("gb18030").decode("utf-8"))
        except UnicodeDecodeError:
            pass
    if "&" in text or "\\u" in text or "%" in text or "=" in text:
        out.append(_unescape(text))
    return out


_ACC = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Leading bytes of UTF-8 sequences as the codecs of READ_AS show them, and trailing ones.
_LEAD = "\u00c2-\u00f4\u0413\u0420\u0421\u0432\u0433\u0440\u041e\u041f\u0440\u251c\u252c\u2500\u2524\u253c\u2554-\u256c\u03a3\u03c3\u0393\u03bc\u00b5\u221a\u00ac\u2013\u2014\u0152\u0153\u03c4\u03a6\u0398\u03b4\u0102\u0103\u010e\u010f\u0107\u010d\u0111\u011f\u0131\u015e\u015f\u0413\u0452"
_TRAIL = "\u0080-\u00bf\u0402-\u0407\u0409-\u040f\u0451-\u045f\u0490\u0491\u2018-\u203a\u20ac\u20a7\u2116\u2122\u02c6\u02c7\u02d8-\u02dd\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u2200-\u22ff\u2310\u2320\u2321\u2500-\u25ff\u03b1-\u03c6\u0393\u0398\u03a3\u03a6\u03a9\u2219\u00f7\uf8ff\u0131\u0141\u0142\u0104\u0105\u015e\u015f\u0179-\u017c\u00c0-\u00c3\u00c4-\u00c9\u00cb\u00cd-\u00d6\u00d8-\u00dc\u00e0-\u00f6"
#: Patterns and what each match adds to the cost (fixed weights; None: 0.7 a character).
_COSTS = [
    (re.compile("[\x80-\x9f]"), 3.0),
    (re.compile("\ufffd"), 3.0),
    (re.compile("[\ue000-\uf8ff\ufff0-\uffff]"), 2.0),
    (re.compile("[\u2500-\u259f]"), 1.5),
    (re.compile("[\u00ac\u2202\u220f\u2211\u221a\u221e\u2229\u222b\u2248\u2260-\u2265\u2310\u2320\u2321\u25ca\u20a7\u0192\u2021\u2030\u2039\u203a]"), 1.0),
    (re.compile(f"[{_ACC}]{{3,}}"), None),
    (re.compile(f"(?<!\\S)[{_ACC}]{{2,}}(?!\\S)"), None),
    (re.compile("[a-z\u00df-\u00ff\u0430-\u045f\u03ac-\u03ce][\u00c2-\u00c6\u00ce-\u00d1\u00d8-\u00de]"), 0.8),
    (re.compile("[\u00a4\u00a6-\u00a9\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00bb-\u00be\u02c6\u02dc\u2020-\u2022\u2116\u2122\u2190-\u22ff\u201a-\u201e](?=\\w)|(?<=[^\\W\\d_])[\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u02c6\u02dc\u2020-\u2022\u2116\u2122\u201a-\u201e]"), 0.9),
    (re.compile(f"(?=[\u00c2-\u00f4][\u0080-\u00bf])[{_LEAD}][{_TRAIL}]|[\u00c2-\u00c6\u00ce-\u00d1\u00d8\u00d9\u00e2\u00f0][\u0080-\u00bf\u2013\u2014\u2018-\u203a\u20ac\u2122\u02c6\u02dc\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192]|[\u00e3-\u00e9][\u0080-\u00bf\u2018\u201a-\u201c\u201e-\u2025\u2027-\u203a\u20ac\u2122\u02c6\u02dc\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192]"), 1.5),
    (re.compile("[\u0413\u0420\u0421\u0432\u0433\u0440\u041e\u041f][\u0080-\u00bf\u0402\u0403\u0404-\u0407\u0409-\u040f\u0452-\u0455\u0457-\u045f\u0490\u0491\u201a-\u203a\u20ac\u2122\u2116]"), 1.5),
    (re.compile("[\u0402\u0403\u0409-\u040c\u040f\u0452\u0453\u0459-\u045c\u045f\u0490\u0491]"), 0.8),
    (re.compile("(?<=[a-zA-Z\u00c0-\u024f\u0370-\u052f])[\u2e80-\u9fff\uac00-\ud7ff]|[\u2e80-\u9fff\uac00-\ud7ff](?=[a-zA-Z\u00c0-\u024f\u0370-\u052f])"), 1.5),
    (re.compile("[\u0460-\u052f\u0530-\u058f\u0700-\u0dff\u0f00-\u109f\u1200-\u1dff]"), 1.0),
    (re.compile("(?<=[\u0430-\u045f])[\u0400-\u042f]|(?<=[\u03ac-\u03ce])[\u0386-\u03ab]"), 0.5),
    (re.compile("[\u0305\u0309-\u030a\u030d-\u0322\u0329-\u036f]"), 0.4),
    (re.compile("[\u4e00-\u9fff]"), 0.06),
    (re.compile("[\u0180-\u0191\u0193-\u024f]"), 0.5),
    (re.compile("[\u0390\u03b0]"), 0.5),
    (re.compile("\u03c2(?=\\w)|(?<=[\u03b1-\u03c9])[\u0386-\u038f]"), 0.8),
    (re.compile("\u0412[\u0408\u0490\u00a9\u00ab\u00b0\u00b7\u00bb\u0457\u045b\u00a7\u0406]"), 1.5),
    (re.compile("[\u3400-\u4dbf\uff61-\uff9f\u0590-\u08ff]"), 0.6),
    (re.compile("[\u2013\u2014](?=[^\\s\\w.,!?])"), 0.7),
]
_TARGETS = set(LOOKALIKE.values())
_WORDS = re.compile(r"[^\W\d_]{2,}")


def _mixed(word: str) -> float:
    """Cost of letters from two scripts in one word; look-alikes of Latin letters hardly count."""
    kinds, odd, latin = set(), 0, 0
    for c in word:
        o = ord(c)
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            kinds.add("latin")
            latin += c not in _TARGETS
        elif 0x370 <= o < 0x530:
            kinds.add("greek" if o < 0x400 else "cyrillic")
            odd += c not in LOOKALIKE
        elif o < 0x2E80 and not unicodedata.combining(c):
            kinds.add(o >> 8)
            odd, latin = odd + 1, latin + 1
    if kinds == {"greek"} and len(word) > 3 and not word.isupper() and not re.search("[\u0384-\u0390\u03ac-\u03b0\u03ca-\u03ce]", word):
        return 0.5
    return 0.0 if len(kinds) < 2 else 1.5 if odd and latin else 0.1


def cost(text: str) -> float:
    """Implausibility of a text as something a person wrote; 0 for plain text."""
    total = 0.02 * len(text)
    if ("&" in text or "\\u" in text or "%" in text or "=" in text) and "://" not in text:
        total += 1.2 * len(_ESCAPE.findall(text))
    if text.isascii():
        return total
    for pattern, weight in _COSTS:
        for m in pattern.finditer(text):
            total += weight if weight is not None else 0.7 * len(m.group(0))
    for w in _WORDS.findall(unicodedata.normalize("NFC", text)):
        if not w.isascii():
            total += _mixed(w)
            if w.isupper() and ord(w[0]) >= 0x370:
                total += 0.05 * len(w)
    return total


def restore(value: str) -> tuple[str, bool]:
    """The cheapest reachable text, and whether ``value`` was garbled.

    Empty and ASCII values come back as they are unless they hold escapes of high bytes.
    """
    start = strip_soft(value)
    base = cost(start)
    lossy = "\ufffd" in value
    if base - 0.02 * len(start) < 0.8 and not _ESCAPE.search(start):
        return value, lossy
    # no operation lengthens a text and none is entered twice, so the frontier runs empty
    seen, best, best_cost = {start}, start, base
    heap = [(base, start)]
    while heap:
        c, text = heapq.heappop(heap)
        if c < best_cost - STEP:
            best, best_cost = text, c
        if c - 0.02 * len(text) < 0.1:
            continue
        for t in neighbours(text):
            if t not in seen:
                seen.add(t)
                heapq.heappush(heap, (cost(t), t))
    if best is start or best_cost > base - MARGIN:
        return value, lossy
    return best, True


def strip_soft(text: str) -> str:
    """Invisible characters sprinkled over a text hide byte sequences; U+00AD and U+00A0 may be
    bytes themselves and stay."""
    return re.sub("[\u200b-\u200f\u2060-\u2064\ufeff]", "", text) if any(c in text for c in "\u200b\u200c\u200e\u200f\u2060\u2063\ufeff") else text


# non-deterministic to the optimizer: else a filter on its result is pushed below and runs it twice
@F.pandas_udf(StructType([StructField("text", StringType()), StructField("garbled", BooleanType())]))
def _restore_udf(values: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple[str | None, bool]] = {None: (None, False)}
    rows = [known[v] if v in known else known.setdefault(v, restore(v)) for v in values]
    return pd.DataFrame(rows, columns=["text", "garbled"])


_restore_udf = _restore_udf.asNondeterministic()


def with_restored(df: DataFrame, value: str, out: str, flag: str) -> DataFrame:
    """``df`` with the restored text in ``out`` and whether ``value`` was garbled in ``flag``.

    Null stays null and is not garbled; repeated rows are kept.
    """
    found = df.withColumn("__r", _restore_udf(F.when(df[value].rlike(SUSPICIOUS), df[value])))
    return found.withColumns({
        out: F.coalesce("__r.text", df[value]), flag: F.coalesce("__r.garbled", F.lit(False)),
    }).drop("__r")


def garbled_found(messages: DataFrame) -> DataFrame:
    """``msg_id, field, original``: stored values of ``text`` and ``sender`` that were garbled.

    Senders repeat, so they are searched once per distinct value and joined back.
    """
    texts = spread(messages.select("msg_id", "text").where(F.col("text").rlike(SUSPICIOUS)))
    texts = with_restored(texts, "text", "original", "g")
    texts = texts.where("g").select("msg_id", F.lit("text").alias("field"), "original")
    senders = messages.select("msg_id", "sender").where(F.col("sender").rlike(SUSPICIOUS))
    distinct = with_restored(senders.select(F.col("sender").alias("s")).distinct(), "s", "original", "g").where("g")
    named = senders.join(distinct, F.col("sender") == F.col("s")).select("msg_id", F.lit("sender").alias("field"), "original")
    return texts.unionByName(named)
