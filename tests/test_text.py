"""Column functions against small restatements in Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from chatterloom.functions import text as T

SAMPLES = [
    "", " ", "hi", "such a", "see https://x.example/a?b now", "www.x.example", "café don’t (really) 50% “ok”", "that was mad 😂", "👩‍💻 LOL!!", "a b",
    "it's 'fine' _x_", "haha hahaha", "今天 ok", "The THE the", "Ѐ ѓ", "tab\tnew\nline", "e" * 3000,
]
URL = re.compile(r"https?://\S+|www\.\S+")


def toks(t):
    return re.findall(r"[A-Za-z0-9_'’]+|[^\sA-Za-z0-9_]", URL.sub(" ", t))


def words(t):
    return re.findall(r"[a-z0-9']+", URL.sub(" ", t.lower()))


def run(spark, fn, rows=SAMPLES):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_tokens(spark):
    assert run(spark, T.tokens) == [toks(t) for t in SAMPLES]


def test_index_and_query_tokens(spark):
    two = lambda w: [f"{a}_{b}" for a, b in zip(w, w[1:])]
    assert run(spark, T.index_tokens) == [words(t) + two(words(t)) for t in SAMPLES]
    stop = set(T.QUERY_STOPWORDS)
    want = [[w for w in words(t) if w not in stop] + [f"{a}_{b}" for a, b in zip(words(t), words(t)[1:]) if a not in stop or b not in stop] for t in SAMPLES]
    assert run(spark, T.query_tokens) == want


def test_words_and_emoji(spark):
    assert run(spark, lambda c: T.words_of(T.tokens(c))) == [[w for w in toks(t) if unicodedata.category(w[0])[0] in "LN"] for t in SAMPLES]
    assert run(spark, T.train_tokens)[7] == ["that", "was", "mad"]


def test_nulls(spark):
    assert run(spark, T.tokens, [None]) == [None] and run(spark, T.index_tokens, [None]) == [None]


def test_detokenize(spark):
    assert run(spark, lambda c: T.detokenize(T.tokens(c)), ["well , ok ( then ) !", "", "$ 5 %"]) == ["well, ok (then)!", "", "$5%"]


def test_double_encoding(spark):
    rows = ["Ã©", "café", "hi ð\x9f\x98\x82", "Ã© ‘", "plain"]
    assert run(spark, T.fix_double_encoding, rows) == ["é", "café", "hi 😂", "Ã© ‘", "plain"]


@pytest.mark.parametrize(
    "typed, said, want",
    [("so i think", "so i think we go", "we go"), ("bro i was going to", "going to the shop", "the shop"), ("abc", "abd", "abd"), ("", "x ", "x"), ("x" * 200, "x" * 80 + " y", "y")],
)
def test_strip_echo(spark, typed, said, want):
    (r,) = spark.createDataFrame([(typed, said)], "a string, b string").select(T.strip_echo(F.col("a"), F.col("b")).alias("o")).collect()
    assert r.o == want


@pytest.mark.parametrize(
    "said, want",
    [('Ann: "yes"', "yes"), ("assistant: Lee: ok", "ok"), ("“hi”", "hi"), ("(as Ann) sure", "sure"), ("a\n\nb\nc\nd\ne\nf\ng", "a\nb\nc\nd\ne\nf"), ('"', '"'), ("", ""), ("ANN AND LEE : x", "x"), ("announce", "announce")],
)
def test_clean_reply(spark, said, want):
    assert run(spark, lambda c: T.clean_reply(c, "Ann and Lee"), [said]) == [want]


def test_apply_word_and_pick(spark):
    rows = ["see you tues", "ok ", "", "hi 😂"]
    assert run(spark, lambda c: T.apply_word(c, F.lit("tuesday"), F.lit("extend")), rows)[0] == "see you tuesday "
    assert run(spark, lambda c: T.apply_word(c, F.lit("then"), F.lit("append")), rows) == ["see you tues then ", "ok then ", "then ", "hi 😂 then "]
    pick = lambda a, **k: run(spark, lambda c: T.pick_model(F.split(c, ","), ["b", "a:1"], **k), [a])[0]
    assert pick("x,a:1,b:7") == "b:7" and pick("x,y") == "x" and pick("x,y", fallback=False) is None
