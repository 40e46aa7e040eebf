"""A measured writing style: lengths, habits, favourite words, repeated phrases, samples.

Input is one identity's messages (``file_ord, seq, text``); everyone else's are the baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.chars import urtrim
from chatterloom.functions.text import LAUGH_PATTERN, LAUGHS, PHRASE_STOPWORDS, detokenize, has_emoji, is_word, lowered, tokens, train_tokens, words_of
from chatterloom.operators.ngram import surface_forms

TOP_WORDS, TOP_SAYINGS, TOP_SAMPLES = 8, 6, 14


def lengths(mine: DataFrame) -> DataFrame:
    """One row ``median, p90, max`` (the 99th percentile) of words per message; messages without
    words do not count, and 5, 12, 20 stand in when none has any.

    Taken from the histogram of lengths, so only distinct lengths are ordered.
    """
    n = F.size(words_of(tokens(F.col("text"))))
    hist = mine.select(n.alias("c")).where("c > 0").groupBy("c").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("c"))
    cum = hist.select("c", upto.alias("upto")).crossJoin(F.broadcast(hist.agg(F.sum("n").alias("total"))))

    def pick(q: float) -> Column:
        at = F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(q)))
        return F.min(F.when(F.col("upto") > at, F.col("c")))

    return cum.agg(
        F.coalesce(pick(0.5), F.lit(5)).alias("median"), F.coalesce(pick(0.9), F.lit(12)).alias("p90"), F.coalesce(pick(0.99), F.lit(20)).alias("max")
    )


def _measured(mine: DataFrame) -> DataFrame:
    toks = tokens(F.col("text"))
    t = mine.select("file_ord", "seq", "text", toks.alias("toks")).withColumn("words", words_of(F.col("toks")))
    return t.where(F.size("words") > 0)


def _mode(each: DataFrame, value: str) -> DataFrame:
    """The commonest value, ties to the first seen: ``value, cnt`` of one row."""
    per = each.groupBy(value).agg(F.count("*").alias("cnt"), F.min(F.struct("file_ord", "seq", "i")).alias("first"))
    return per.orderBy(F.desc("cnt"), "first").limit(1).select(F.col(value).alias("value"), "cnt")


def traits(mine: DataFrame) -> DataFrame:
    """One row of numeric habits (formatted only by :func:`trait_lines`).

    One pass of conditional sums, and three modes over exploded tokens.
    """
    m = _measured(mine)
    end = F.right(urtrim(F.col("text")), F.lit(1))
    caps = F.size(F.filter("words", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))
    n, total = F.count("*"), F.sum(F.size("words"))
    share = lambda c: F.lit(100.0) * F.sum(c.cast("int")) / n
    main = m.agg(
        n.alias("n"), (total / n).alias("words_per_message"), share(end == "?").alias("questions_pct"),
        share(end.isin(".", "!", "?")).alias("punctuated_pct"), (F.lit(100.0) * F.sum(caps) / total).alias("caps_pct"),
        share(F.exists("toks", has_emoji)).alias("emoji_pct"),
    )
    each = m.select("file_ord", "seq", F.posexplode("toks").alias("i", "tok"))
    emoji = _mode(each.where(has_emoji(F.col("tok"))), "tok").select(F.col("value").alias("top_emoji"))
    low = m.select("file_ord", "seq", F.posexplode(lowered(F.col("words"))).alias("i", "w"))
    laugh = _mode(low.where(F.col("w").isin(*LAUGHS) | F.col("w").rlike(LAUGH_PATTERN)), "w")
    laugh = laugh.where("cnt >= 3").select(F.col("value").alias("laugh"), F.col("cnt").alias("laugh_cnt"))
    opener = _mode(low.where("i = 0"), "w").select(F.col("value").alias("opener"))
    one = main
    for extra in (emoji, laugh, opener):  # one row each at most
        one = one.join(F.broadcast(extra), F.lit(True), "left")
    return one


def trait_lines(measured: DataFrame) -> DataFrame:
    """``traits``: array of ``label, value`` as shown to people; absent habits are left out."""
    line = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    c = F.col
    every = F.array(
        line("words per message", F.format_string("%.1f", c("words_per_message"))),
        line("questions", F.format_string("%.0f%%", c("questions_pct"))),
        line("ends with punctuation", F.format_string("%.0f%%", c("punctuated_pct"))),
        line("words in caps", F.format_string("%.1f%%", c("caps_pct"))),
        line("messages with emoji", F.format_string("%.0f%%", c("emoji_pct"))),
        line("most used emoji", c("top_emoji")),
        line("laughs as", F.when(c("laugh").isNotNull(), F.format_string("%s (%dx)", c("laugh"), c("laugh_cnt")))),
        line("usually opens with", c("opener")),
    )
    return measured.select(F.filter(every, lambda x: x["value"].isNotNull()).alias("traits"))


def _long_words(messages: DataFrame) -> DataFrame:
    low = lowered(train_tokens(F.col("text")))
    return messages.select(F.explode(F.filter(low, lambda t: is_word(t) & (F.length(t) > 1))).alias("word"))


def favourite_words(mine: DataFrame, others: DataFrame, k: int = TOP_WORDS) -> DataFrame:
    """``word, cnt, ratio``: words used at least four times and far more than by everyone else;
    ``word`` in lower case, highest ratio first, then the later word, then the larger count."""
    a = _long_words(mine).groupBy("word").agg(F.count("*").alias("cnt"))
    b = _long_words(others).groupBy("word").agg(F.count("*").alias("theirs"))
    total = lambda d, c, name: F.broadcast(d.agg(F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1)).alias(name)))
    kept = a.where("cnt >= 4").join(b, "word", "left").crossJoin(total(a, "cnt", "mt")).crossJoin(total(b, "theirs", "tt"))
    ratio = (F.col("cnt") / F.col("mt")) / ((F.coalesce("theirs", F.lit(0)) + 0.5) / F.col("tt"))
    return kept.select("word", "cnt", F.round(ratio, 9).alias("ratio")).orderBy(F.desc("ratio"), F.desc("word"), F.desc("cnt")).limit(k)


def phrase_counts(mine: DataFrame, least: int = 3) -> DataFrame:
    """``phrase, cnt, n, first``: runs of two to five words seen at least ``least`` times."""
    low = F.filter(lowered(train_tokens(F.col("text"))), is_word)
    w = mine.select("file_ord", "seq", low.alias("w")).where(F.size("w") > 1)
    at = w.select("file_ord", "seq", "w", F.posexplode("w").alias("i", "__x"))
    runs = F.array(*[F.when(F.col("i") + n <= F.size("w"), F.struct(F.lit(n).alias("n"), F.slice("w", F.col("i") + 1, n).alias("phrase"))) for n in range(2, 6)])
    each = at.select("file_ord", "seq", "i", F.explode(F.filter(runs, lambda r: r.isNotNull())).alias("r"))
    return (
        each.groupBy("r.phrase", "r.n").agg(F.count("*").alias("cnt"), F.min(F.struct("file_ord", "seq", "r.n", "i")).alias("first")).where(F.col("cnt") >= least)
    )


def _overlap(a: Column, b: Column) -> Column:
    """Two phrases are largely one run of words: one holds the other, or they share more than
    half of the shorter's words."""
    inside = lambda x, y: F.contains(F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(y, " "), F.lit(" ")))
    shared = F.size(F.array_intersect(a, b))
    return inside(a, b) | inside(b, a) | (shared * 2 > F.least(F.size(a), F.size(b)))


def sayings(mine: DataFrame, k: int = TOP_SAYINGS) -> DataFrame:
    """``rank, phrase, text, cnt``: up to ``k`` repeated phrases, the most telling first, none of
    them largely another one.

    Phrases are counted and filtered in parallel. The greedy choice then runs in ``k`` rounds:
    each takes the best phrase left (a top-1 of the whole table) and drops what overlaps it,
    so the candidates never meet in one task.
    """
    stop = F.array(*[F.lit(w) for w in PHRASE_STOPWORDS])
    ends = F.array_contains(stop, F.col("phrase")[0]) | F.array_contains(stop, F.element_at("phrase", -1))
    weight = F.col("cnt") * F.pow(F.col("n") - 1, F.lit(2)).cast("bigint")
    pool = phrase_counts(mine).where(~ends).withColumn("weight", weight).persist()
    names = surface_forms(mine)
    picked: list[tuple] = []
    left = pool
    while len(picked) < k:
        top = left.orderBy(F.desc("weight"), F.desc("n"), "first").select("phrase", "cnt").limit(1).collect()
        if not top:
            break
        phrase = F.array(*[F.lit(w) for w in top[0].phrase])
        left = left.where(~_overlap(phrase, F.col("phrase")))
        picked.append((len(picked) + 1, list(top[0].phrase), top[0].cnt))
    pool.unpersist()
    spark = mine.sparkSession
    chosen = spark.createDataFrame(picked, "rank int, phrase array<string>, cnt bigint")
    word = chosen.select("rank", F.posexplode("phrase").alias("i", "w")).join(names, F.col("w") == F.col("lower"), "left")
    shown = word.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("surface", "w").alias("s")))).alias("x"))
    return chosen.join(shown, "rank").select("rank", "phrase", detokenize(F.transform("x", lambda x: x["s"])).alias("text"), "cnt")


def samples(mine: DataFrame, favourites: DataFrame, k: int = TOP_SAMPLES) -> DataFrame:
    """``rank, text, hits, n_words``: characteristic messages of 4 to 18 words that do not begin
    with an emoji, those with most favourite words first, one per first forty characters."""
    m = _measured(mine).where(F.size("words").between(4, 18) & ~has_emoji(F.col("toks")[0]))
    fav = F.broadcast(favourites.agg(F.collect_set("word").alias("fav")))  # eight words at most
    hits = F.size(F.filter(lowered(F.col("words")), lambda w: F.array_contains("fav", w)))
    scored = m.crossJoin(fav).select("file_ord", "seq", "text", F.size("words").alias("n_words"), hits.alias("hits"))
    order = F.struct((-F.col("hits")).alias("h"), (-F.col("n_words")).alias("n"), "file_ord", "seq")
    # one message per key by aggregation, then a top-k: no window over the messages
    one = scored.groupBy(F.substring(F.lower("text"), 1, 40).alias("key")).agg(F.min_by(F.struct("text", "hits", "n_words"), order).alias("m"), F.min(order).alias("o"))
    top = one.orderBy("o").limit(k).select("m.*", "o")
    return top.withColumn("rank", F.row_number().over(Window.orderBy("o"))).select("rank", "text", "hits", "n_words")
