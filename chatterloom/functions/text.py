"""Scalar text functions as column expressions, all inside generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterloom.functions.chars import ALNUM, CLOSING, EMOJI, OPENING, WS, utrim

#: A run of word characters, or any single other character that is not white space (fixed pattern).
TOKEN = f"[A-Za-z0-9_'’]+|[^{WS}A-Za-z0-9_]"
#: Words of the index (fixed pattern); its apostrophes are ASCII only.
INDEX_WORD = "[a-z0-9']+"
URL = f"https?://[^{WS}]+|www\\.[^{WS}]+"
#: Words that carry no topic, in queries (fixed values).
QUERY_STOPWORDS = (
    "a an the and or but if of to in on at for with is are was were be been am it its this that these those "
    "i you he she we they me him her them my your his our their as so do did does done not no up out then "
    "what when who why how where which about just u ur im ive dont cant yeah ya ok okay lol like got get "
    "gonna wanna can will would should have has had there here one all some any too"
).split()
#: Words a phrase may not begin or end with (fixed values).
PHRASE_STOPWORDS = (
    "the a an and or but if of to in on at for with is are was were be been it its this that these those "
    "i you he she we they me him her them my your his our their as so do did does not no yes up out then"
).split()
#: Written laughter (fixed values), beside the pattern of repeated syllables.
LAUGHS = ["lol", "lmao", "lmfao", "haha", "hahaha", "ahaha", "rofl", "hehe", "lmaoo", "loll"]
LAUGH_PATTERN = "^(?:(?:ha){2,}|l+o+l+)$"
START, END = "<s>", "</s>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` mentions it; inside
    lambdas an expression would otherwise be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Words and single other characters; URLs count as a blank. Null gives null."""
    return all_matches(no_urls(text), TOKEN)


def has_emoji(token: Column) -> Column:
    return token.rlike(f"[{EMOJI}]")


def is_word(token: Column) -> Column:
    """Whether a token begins with a letter or digit of any script."""
    return token.rlike(f"^[{ALNUM}]")


def train_tokens(text: Column) -> Column:
    """Tokens without emoji."""
    return F.filter(tokens(text), lambda t: ~has_emoji(t))


def lowered(array: Column) -> Column:
    return F.transform(array, F.lower)


def words_of(array: Column) -> Column:
    return F.filter(array, is_word)


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by ``_``; none for fewer than two."""
    n = F.size(words)
    return F.when(
        n > 1,
        F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws("_", F.get(words, i), F.get(words, i + 1))),
    ).otherwise(F.array().cast("array<string>"))


def index_tokens(text: Column) -> Column:
    """Words and bigrams of a text, as the index holds them."""
    return let(all_matches(no_urls(F.lower(text)), INDEX_WORD), lambda w: F.concat(w, bigrams(w)))


def query_tokens(text: Column) -> Column:
    """Words that carry a topic, and bigrams in which at least one does."""
    stop = F.array(*[F.lit(w) for w in QUERY_STOPWORDS])

    def kept(words: Column) -> Column:
        single = F.filter(words, lambda w: ~F.array_contains(stop, w))
        double = F.filter(bigrams(words), lambda b: ~F.forall(F.split(b, "_"), lambda w: F.array_contains(stop, w)))
        return F.concat(single, double)

    return let(all_matches(no_urls(F.lower(text)), INDEX_WORD), kept)


def detokenize(array: Column) -> Column:
    """Tokens as readable text: closing marks attach to the left, nothing follows an opening one."""
    closing, opening = (F.array(*[F.lit(c) for c in cs]) for cs in (CLOSING, OPENING))

    def add(acc: Column, tok: Column) -> Column:
        tight = F.array_contains(closing, tok) | F.array_contains(opening, F.right(acc, F.lit(1)))
        return F.when(acc == "", tok).when(tight, F.concat(acc, tok)).otherwise(F.concat(acc, F.lit(" "), tok))

    return F.aggregate(array, F.lit(""), add)


def fix_double_encoding(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; anything that does not round-trip is unchanged."""
    could = text.rlike("[\\x{80}-\\x{ff}]") & ~text.rlike("[^\\x{00}-\\x{ff}]")
    again = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(could, F.coalesce(again, text)).otherwise(text)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def strip_echo(typed: Column, out: Column) -> Column:
    """What a generator wrote without the part of ``typed`` it said again: all of it, else its
    longest ending of 4 to 80 characters."""

    def cut(x: Column) -> Column:
        low_t, low_o, out = x["t"], x["o"], x["out"]
        n = F.least(F.length(low_t), F.lit(80))
        sizes = F.when(n > 3, F.sequence(n, F.lit(4), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        hit = F.get(F.filter(sizes, lambda k: F.startswith(low_o, F.right(low_t, k))), F.lit(0))
        size = F.when(F.startswith(low_o, low_t), F.length(low_t)).otherwise(F.coalesce(hit, F.lit(0)))
        return let(size, lambda k: F.when(k > 0, F.regexp_replace(F.substring(out, k + 1, F.length(out)), f"^[{WS}]+", "")).otherwise(out))

    return let(utrim(out), lambda o: let(F.struct(F.lower(typed).alias("t"), F.lower(o).alias("o"), o.alias("out")), cut))


def _quoted(name: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in name)


def clean_reply(text: Column, identity: str) -> Column:
    """A generator's answer without name prefix, wrapping quotes and stage directions; at most six
    lines that are not blank."""
    parts = {identity, *identity.replace(" and ", " ").split()}
    names = "|".join(_quoted(n) for n in sorted(parts, key=lambda n: (-len(n), n)) if n)
    prefix = f"(?i)^(?:{names + '|' if names else ''}assistant)[{WS}]*:[{WS}]*"

    def once(t: Column) -> Column:
        return let(utrim(F.regexp_replace(t, prefix, "")), unquoted)

    def unquoted(t: Column) -> Column:
        a, z = F.substring(t, 1, 1), F.right(t, F.lit(1))
        match = ((a == z) & a.isin('"', "'")) | ((a == "“") & (z == "”")) | ((a == "‘") & (z == "’"))
        return F.when((F.length(t) > 1) & match, utrim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)

    t = reduce(lambda acc, _: once(acc), range(2), utrim(text))
    t = F.regexp_replace(t, f"(?i)^\\((?:as|in the style of)[^)]*\\)[{WS}]*", "")
    lines = F.filter(F.split(t, "\r\n|[\n-\r\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"), lambda x: utrim(x) != "")
    return utrim(F.array_join(F.slice(lines, 1, 6), "\n"))


def apply_word(text: Column, word: Column, mode: Column) -> Column:
    """The editor's text after a suggestion is taken: ``extend`` replaces the half-typed word,
    ``append`` adds one; a blank follows."""
    extended = F.concat(F.regexp_replace(text, "[A-Za-z0-9_'’]+$", ""), word)
    gap = F.when((text != "") & ~text.rlike(f"[{WS}]$"), " ").otherwise("")
    return F.concat(F.when(mode == "extend", extended).otherwise(F.concat(text, gap, word)), F.lit(" "))


def insert_phrase(text: Column, phrase: Column) -> Column:
    """``phrase`` added to the editor's text with a blank on either side where none is."""
    gap = F.when((text != "") & ~text.rlike(f"[{WS}]$"), " ").otherwise("")
    return F.concat(text, gap, phrase, F.lit(" "))


def pick_model(installed: Column, preferred: Sequence[str], fallback: bool = True) -> Column:
    """The installed model that stands first in ``preferred``, by name or by ``name:tag``."""

    def first(name: str) -> Column:
        return F.get(F.filter(installed, lambda m: (m == name) | F.startswith(m, F.lit(name + ":"))), F.lit(0))

    hits = [first(n) for n in preferred]
    return F.coalesce(*hits, *([F.get(installed, F.lit(0))] if fallback else []), F.lit(None).cast("string"))
