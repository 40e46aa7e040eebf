"""Character classes shared by every text operator.

Spark's ``\\s`` and ``trim`` are ASCII-only, so whitespace is always spelled out.
The classes below are fixed values: results depend on these exact members.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of Python's ``\s`` (29 code points), as the inside of a regex class.
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
#: Separators that end a line for ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Emoji, pictographs, dingbats, arrows, variation selectors and the joiner (fixed values).
EMOJI = (
    r"\x{1F000}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}"
    r"\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{25A0}-\x{25FF}\x{FE00}-\x{FE0F}\x{200D}"
)
#: A letter or digit in any script, as ``str.isalnum`` has it.
ALNUM = r"\p{L}\p{N}"
#: Attached to the word before / after when words are joined again (fixed values).
CLOSING = [".", ",", "!", "?", ";", ":", ")", "]", "}", "%", "’", "'", '"', "…"]
OPENING = ["(", "[", "{", "$", "#", "@"]

LRM = "‎"
NNBSP = " "


def utrim(c: Column) -> Column:
    """``str.strip``: white space of any script off both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def urtrim(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))
