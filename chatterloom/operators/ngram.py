"""An interpolated n-gram predictor as count tables, and batches of queries against it.

Counts are long tables built by one explode and hash aggregations. A distribution blends the
unigram probabilities with every matched context of one to four tokens, each trusted by how
often it was seen and how many words followed it. Queries are rows; all are answered by one
plan of equi-joins, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.chars import CLOSING, WS
from chatterloom.functions.plan import checkpointed
from chatterloom.functions.text import END, START, detokenize, has_emoji, is_word, let, lowered, train_tokens

ORDER, DISCOUNT, TOP = 4, 2.0, 60


@dataclass
class Model:
    counts: DataFrame  # n, ctx, nxt, cnt
    totals: DataFrame  # n, ctx, total, kinds, lam
    unigrams: DataFrame  # word, cnt, p, first
    surface: DataFrame  # lower, surface
    lists: DataFrame  # token lists the others are counted from

    def cached(self) -> Model:
        """The same model with its tables kept, for several batches of queries."""
        return Model(*(t.persist() for t in self._tables()))

    def dropped(self) -> None:
        """No longer kept."""
        for t in self._tables():
            t.unpersist()

    def _tables(self) -> tuple[DataFrame, ...]:
        return self.counts, self.totals, self.unigrams, self.surface, self.lists


def training_lists(messages: DataFrame) -> DataFrame:
    """``file_ord, seq, raw, low``: token lists of messages that have any."""
    raw = messages.select("file_ord", "seq", train_tokens(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    return raw.withColumn("low", lowered(F.col("raw")))


def _lists(messages: DataFrame, lists: DataFrame | None) -> DataFrame:
    return training_lists(messages) if lists is None else lists


def context_key(padded: Column, n: int, end: Column) -> Column:
    """The ``n`` tokens before position ``end`` (from 0), as one string; tokens hold no blanks."""
    return F.array_join(F.slice(padded, end - n + 1, n), " ")


def ngram_counts(messages: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """``n, ctx, nxt, cnt``: how often ``nxt`` followed each context of ``n`` tokens.

    Four start marks stand before a message and one end mark after it. Partial aggregation
    combines the start contexts, which every message holds, before the shuffle.
    """
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), F.col("low"), F.array(F.lit(END)))
    p = _lists(messages, lists).select(padded.alias("p"))
    at = p.select("p", F.explode(F.sequence(F.lit(ORDER), F.size("p") - 1)).alias("i"))
    keys = F.array(*[F.struct(F.lit(n).alias("n"), context_key(F.col("p"), n, F.col("i")).alias("ctx")) for n in range(1, ORDER + 1)])
    each = at.select(F.explode(keys).alias("k"), F.get("p", F.col("i")).alias("nxt"))
    return each.select("k.n", "k.ctx", "nxt").groupBy("n", "ctx", "nxt").agg(F.count("*").alias("cnt"))


def unigrams(messages: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """``word, cnt, p, first``: counts with the end mark, share of all, first appearance."""
    low = F.concat(F.col("low"), F.array(F.lit(END)))
    each = _lists(messages, lists).select("file_ord", "seq", F.posexplode(low).alias("i", "word"))
    per = each.groupBy("word").agg(F.count("*").alias("cnt"), F.min(F.struct("file_ord", "seq", "i")).alias("first"))
    total = F.broadcast(per.agg(F.sum("cnt").alias("total")))
    return per.crossJoin(total).select("word", "cnt", (F.col("cnt") / F.col("total")).alias("p"), "first")


def surface_forms(messages: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """``lower, surface``: the most common spelling of each token, ties to the first seen."""
    each = _lists(messages, lists).select("file_ord", "seq", F.posexplode("raw").alias("i", "tok"))
    per = each.groupBy(F.lower("tok").alias("lower"), "tok").agg(F.count("*").alias("cnt"), F.min(F.struct("file_ord", "seq", "i")).alias("first"))
    best = F.min_by("tok", F.struct((-F.col("cnt")).alias("c"), F.col("first")))
    return per.groupBy("lower").agg(best.alias("surface"))


def build(messages: DataFrame) -> Model:
    """Model of one identity's messages (``file_ord, seq, text``)."""
    lists = training_lists(messages)
    counts = ngram_counts(messages, lists)
    totals = counts.groupBy("n", "ctx").agg(F.sum("cnt").alias("total"), F.count("*").alias("kinds"))
    totals = totals.withColumn("lam", F.col("total") / (F.col("total") + F.lit(DISCOUNT) * F.col("kinds")))
    return Model(counts, totals, unigrams(messages, lists), surface_forms(messages, lists), lists)


def stats(messages: DataFrame, enough: int = 300) -> DataFrame:
    """``messages, tokens, vocab, enough_data``; the vocabulary counts the end mark."""
    n = messages.agg(F.count("*").alias("messages"))
    u = unigrams(messages).agg(
        F.coalesce(F.sum(F.when(F.col("word") != END, F.col("cnt"))), F.lit(0)).cast("bigint").alias("tokens"), F.count("*").alias("vocab")
    )
    return n.crossJoin(F.broadcast(u)).withColumn("enough_data", F.col("messages") >= enough)


def top_unigrams(model: Model) -> DataFrame:
    return model.unigrams.orderBy(F.desc("cnt"), "first").limit(TOP).select("word")


def distribution(model: Model, states: DataFrame) -> DataFrame:
    """``q_id, word, p`` of every candidate next word of ``q_id, context, prefix``.

    Candidates are the sixty commonest words, words that begin with the prefix, and whatever
    followed a matched context. ``context`` is an array of lower-case tokens.
    """
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), F.col("context"))
    keys = F.array(*[F.struct(F.lit(n).alias("n"), context_key(padded, n, F.size(padded)).alias("ctx")) for n in range(1, ORDER + 1)])
    asked = states.select("q_id", F.explode(keys).alias("k")).select("q_id", "k.n", "k.ctx")
    seen = asked.join(model.totals, ["n", "ctx"]).select("q_id", "n", "ctx", "total", "lam")
    follow = seen.join(model.counts, ["n", "ctx"]).select("q_id", F.col("nxt").alias("word"), "n", (F.col("cnt") / F.col("total")).alias("share"))
    # sixty rows at most, whatever the corpus
    common = states.select("q_id").crossJoin(F.broadcast(top_unigrams(model)))
    # only heads somebody asks for are joined; lengths of prefixes are as many as the longest has letters
    lengths = F.broadcast(states.where("prefix <> ''").select(F.length("prefix").alias("len")).distinct().agg(F.collect_set("len").alias("lens")))
    heads = model.unigrams.crossJoin(lengths).select("word", F.explode(F.filter("lens", lambda n: n <= F.length("word"))).alias("len"))
    heads = heads.select("word", F.expr("substring(word, 1, len)").alias("head"))
    begun = states.where("prefix <> ''").join(heads, F.col("prefix") == F.col("head")).select("q_id", "word")
    candidates = common.unionByName(begun).unionByName(follow.select("q_id", "word")).distinct()

    def pivot(col: str) -> list[Column]:
        return [F.max(F.when(F.col("n") == n, F.col(col))).alias(f"{col}{n}") for n in range(1, ORDER + 1)]

    lams = seen.groupBy("q_id").agg(*pivot("lam"))
    shares = follow.groupBy("q_id", "word").agg(*pivot("share"))
    wide = (
        candidates.join(model.unigrams.select("word", "p"), "word", "left")
        .join(shares, ["q_id", "word"], "left")
        .join(lams, "q_id", "left")
    )
    p = F.coalesce("p", F.lit(0.0))
    for n in range(1, ORDER + 1):
        lam = F.coalesce(f"lam{n}", F.lit(0.0))
        p = p * (F.lit(1.0) - lam) + lam * F.coalesce(f"share{n}", F.lit(0.0))
    return wide.select("q_id", "word", p.alias("p"))


def split_caret(text: Column) -> tuple[Column, Column]:
    """Tokens before the caret, and the half-typed word at it (or an empty string)."""

    def split(t: Column) -> Column:
        last = F.right(text, F.lit(1))
        half = F.coalesce((text != "") & ~last.rlike(f"[{WS}]") & ~has_emoji(last) & (F.size(t) > 0), F.lit(False))
        return F.struct(
            F.when(half, F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t).alias("context"),
            F.when(half, F.get(t, F.size(t) - 1)).otherwise("").alias("prefix"),
        )

    made = let(lowered(train_tokens(F.coalesce(text, F.lit("")))), split)
    return made["context"], made["prefix"]


def resolve(model: Model, queries: DataFrame) -> DataFrame:
    """``q_id, text, context, prefix``: whether the last word is finished, decided by whether
    the model finds it likelier than the best word that extends it."""
    context, prefix = split_caret(F.col("text"))
    split = queries.select("q_id", "text", context.alias("context"), prefix.alias("prefix"))
    half = split.where("prefix <> ''")
    dist = distribution(model, half).join(half.select("q_id", "prefix"), "q_id")
    longer = F.startswith("word", F.col("prefix")) & (F.col("word") != F.col("prefix")) & ~F.col("word").isin(START, END) & ~has_emoji(F.col("word"))
    judged = dist.groupBy("q_id").agg(
        F.coalesce(F.max(F.when(F.col("word") == F.col("prefix"), F.col("p"))), F.lit(0.0)).alias("whole"),
        F.coalesce(F.max(F.when(longer, F.col("p"))), F.lit(0.0)).alias("best"),
    )
    done = F.coalesce(F.col("whole") >= F.col("best"), F.lit(False)) & (F.col("prefix") != "")
    return split.join(judged, "q_id", "left").select(
        "q_id", "text",
        F.when(done, F.concat("context", F.array("prefix"))).otherwise(F.col("context")).alias("context"),
        F.when(done, "").otherwise(F.col("prefix")).alias("prefix"),
    )


def ranked(model: Model, states: DataFrame, k: int) -> DataFrame:
    """``q_id, rank, word, p``: the ``k`` likeliest words to offer, ties in word order."""
    dist = distribution(model, states).join(states.select("q_id", "prefix"), "q_id")
    fits = (F.col("prefix") == "") | (F.startswith("word", F.col("prefix")) & (F.col("word") != F.col("prefix")))
    offered = dist.where(is_word(F.col("word")) & ~F.col("word").isin(START, END) & ~has_emoji(F.col("word")) & fits)
    best = Window.partitionBy("q_id").orderBy(F.desc(F.round("p", 12)), "word")
    return offered.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q_id", "rank", "word", "p")


def suggest(model: Model, queries: DataFrame, k: int = 3) -> DataFrame:
    """``q_id, mode, words``: suggestions for ``q_id, text`` in display spelling; ``extend``
    completes the half-typed word, ``append`` follows a finished one."""
    kept = model.cached()  # both distributions read it; lost parts are computed again
    states = checkpointed(resolve(kept, queries))
    top = ranked(kept, states, k).join(kept.surface, F.col("word") == F.col("lower"), "left")
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("surface", "word").alias("w")))), lambda x: x["w"])
    got = top.groupBy("q_id").agg(words.alias("words"))
    done = checkpointed(states.join(got, "q_id", "left").select(
        "q_id", F.when(F.col("prefix") == "", "append").otherwise("extend").alias("mode"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"),
    ))
    kept.dropped()
    return done


def complete(model: Model, queries: DataFrame, max_words: int = 8) -> DataFrame:
    """``q_id, completion``: greedy continuations, all queries one word further each round.

    A word never repeats either of the last two and is used twice at most; an end mark stops,
    but not at the first word. Each round is cut from its lineage by a checkpoint.
    """
    kept = model.cached()  # read in every round; lost parts are computed again
    model = kept
    state = resolve(model, queries).select(
        "q_id", "text", "context", "prefix", F.array().cast("array<string>").alias("made"), F.lit(False).alias("done")
    )
    state = checkpointed(state)
    for step in range(max_words):
        live = state.where(~F.col("done"))
        want = live.select("q_id", "context", F.col("prefix") if step == 0 else F.lit("").alias("prefix"))
        dist = distribution(model, want).join(live.select("q_id", "made", "prefix"), "q_id")
        word = F.col("word")
        order = Window.partitionBy("q_id").orderBy(F.desc(F.round("p", 12)), "word")
        dist = dist.withColumn("r", F.row_number().over(order))
        plain = ~has_emoji(word) & (word != START)
        uses = F.size(F.filter("made", lambda m: m == word))
        fresh = (word == END) | (
            ~word.eqNullSafe(F.try_element_at("made", F.lit(-1))) & ~word.eqNullSafe(F.try_element_at("made", F.lit(-2))) & (uses < 2)
        )
        free = (F.col("r") <= 20) & plain & fresh
        if step == 0:
            grown = F.startswith("word", F.col("prefix")) & (word != F.col("prefix")) & is_word(word) & (word != END) & plain
            pick = F.when(F.col("prefix") != "", grown).otherwise(free & (word != END))
        else:
            pick = free
        choice = dist.where(pick).groupBy("q_id").agg(F.min_by("word", "r").alias("choice"))
        nxt = state.join(choice, "q_id", "left")
        goes = ~F.col("done") & F.col("choice").isNotNull() & (F.col("choice") != END)
        state = checkpointed(nxt.select(
            "q_id", "text",
            F.when(goes, F.concat("context", F.array("choice"))).otherwise(F.col("context")).alias("context"), "prefix",
            F.when(goes, F.concat("made", F.array("choice"))).otherwise(F.col("made")).alias("made"), (~goes).alias("done"),
        ))
        if not state.where(~F.col("done")).limit(1).count():
            break
    shown = _displayed(model, state)
    head = F.expr("substring(made[0], length(prefix) + 1, length(made[0]))")
    rest = detokenize(F.slice("shown", 2, max_words))
    grown = F.when(rest == "", head).otherwise(F.concat(head, F.lit(" "), rest))
    whole = detokenize(F.col("shown"))
    spaced = (F.col("text") != "") & ~F.col("text").rlike(f"[{WS}]$") & ~F.substring(whole, 1, 1).isin(*CLOSING)
    text = F.when(F.size("made") == 0, "").when(F.col("prefix") != "", grown).otherwise(F.when(spaced, F.concat(F.lit(" "), whole)).otherwise(whole))
    done = checkpointed(shown.select("q_id", text.alias("completion")))
    kept.dropped()
    return done


def _displayed(model: Model, state: DataFrame) -> DataFrame:
    """``state`` with ``shown``: the made words in display spelling."""
    each = state.select("q_id", F.posexplode("made").alias("i", "w"))
    named = each.join(model.surface, F.col("w") == F.col("lower"), "left")
    got = named.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("surface", "w").alias("s")))), lambda x: x["s"]).alias("shown"))
    return state.join(got, "q_id", "left").withColumn("shown", F.coalesce("shown", F.array().cast("array<string>")))
