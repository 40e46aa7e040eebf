"""Turns, pairs, retrieval, the predictor and the profile on small tables worked by hand."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatterloom.operators import bm25, ngram, persona, profile, senders, turns

CHAT = "file_ord int, file string, seq long, sender string, text string, at timestamp_ntz"
T0 = datetime(2024, 1, 1, 12)


def chat(spark, rows):
    return spark.createDataFrame([(0, "f", i, s, t, a) for i, (s, t, a) in enumerate(rows, 1)], CHAT)


def brute_turns(rows):
    out = []
    for s, t, a in rows:
        if out and out[-1][0] == s:
            if len(out[-1][1]) < 400:
                out[-1][1] = (out[-1][1] + " " + t).strip()
            continue
        out.append([s, t, a])
    return [tuple(x) for x in out]


def test_turns_against_the_loop(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 5)
    rng = random.Random(3)
    rows = [(rng.choice("aab"), "x" * rng.choice([1, 5, 120, 199, 200, 398, 399, 400, 401]), T0 if rng.random() < 0.7 else None) for _ in range(400)]
    got = turns.turns(chat(spark, rows)).orderBy("turn").collect()
    assert [(r.sender, r.text, r.at) for r in got] == brute_turns(rows)
    assert [r.turn for r in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize(
    "gap, reply, prompt, kept",
    [(30, "ok", "two words", True), (31, "ok", "two words", False), (-1, "ok", "two words", False), (None, "ok", "two words", True),
     (5, "x" * 301, "two words", False), (5, "x" * 300, "two words", True), (5, "ok", "one", False)],
)
def test_pairs(spark, gap, reply, prompt, kept):
    at = None if gap is None else T0 + timedelta(minutes=gap)
    got = turns.reply_pairs(turns.turns(chat(spark, [("you", prompt, T0), ("me", reply, at)])), ["me"]).collect()
    assert [(r.prompt, r.reply, r.who) for r in got] == ([(prompt, reply, "you")] if kept else [])


def test_pairs_stay_in_their_file_and_two_own_labels_are_no_pair(spark):
    rows = [(0, "f", 1, "you", "two words", None), (1, "g", 1, "me", "hi", None), (1, "g", 2, "me2", "hm", None)]
    assert turns.reply_pairs(turns.turns(spark.createDataFrame(rows, CHAT)), ["me", "me2"]).count() == 0
    assert turns.turns(spark.createDataFrame([], CHAT)).count() == 0


def test_senders(spark):
    c = chat(spark, [("b", "x", None), ("a", "x", None), ("a", "y", None), ("c", "z", None)])
    assert [(r.sender, r.cnt) for r in senders.sender_counts(c).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert {r.sender: (r.cnt, r.enough, r.files) for r in senders.sender_payload(c).collect()}["a"] == (2, False, ["f"])


PAIRS = "pair_id long, prompt string, reply string, who string"


def test_bm25_worked_numbers(spark):
    ix = bm25.build(spark.createDataFrame([(1, "good game today", "yes", "x"), (2, "see you friday", "ok", "x")], PAIRS))
    q = spark.createDataFrame([(1, "game today"), (2, "game zebra"), (3, "what about the"), (4, None)], "q_id long, text string")
    got = {(r.q_id, r.pair_id): r.score for r in bm25.search(ix, q).collect()}
    assert got[1, 1] == 1.0 and got[2, 1] == pytest.approx(0.205025, abs=1e-5)
    assert not {k for k in got if k[0] in (3, 4)}
    assert {r.q_id for r in bm25.best(ix, q).collect()} == {1}
    row = ix.corpus.first()
    assert row.avgdl == 5 and row.max_idf == pytest.approx(math.log(6))


def brute_search(docs, asked, k):
    """Every document scored for every query, in Python; words only, all of them topics."""
    grams = lambda t: (w := t.split()) + [f"{a}_{b}" for a, b in zip(w, w[1:])]
    held = {i: Counter(grams(t)) for i, t in docs.items()}
    df, avgdl, out = Counter(t for c in held.values() for t in c), sum(sum(c.values()) for c in held.values()) / len(held), set()
    idf = lambda d: math.log(1 + (len(held) - d + 0.5) / (d + 0.5))
    for q, text in asked.items():
        weight = {t: idf(df[t]) * (0.5 if "_" in t else 1) for t in set(grams(text))}
        norm = {i: 0.25 + 0.75 * sum(c.values()) / avgdl for i, c in held.items()}
        s = {i: sum(w * min(c[t] * 2.5 / (c[t] + 1.5 * norm[i]), 1) for t, w in weight.items() if t in c) / sum(weight.values()) for i, c in held.items()}
        best = sorted((-round(x, 9), i) for i, x in s.items() if x > 0)[:k]
        out |= {(q, r, i, round(-x, 6)) for r, (x, i) in enumerate(best, 1)}
    return out


def shuffled_rows(spark):
    none, gate = spark.sparkContext._gateway.jvm.java.util.ArrayList(), spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gate.new_array(gate.jvm.double, 0), none)
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("least, most, blocks", [(16_384, 131_072, 1), (40, 131_072, 8), (16_384, 100, 4)])
def test_search_is_whole_and_moves_no_matches(spark, monkeypatch, least, most, blocks):
    monkeypatch.setattr(bm25, "LEAST_DOCS", least)
    monkeypatch.setattr(bm25, "MOST_DOCS", most)
    assert bm25.blocks_of(400, 4) == blocks
    rng = random.Random(5)
    word = lambda: f"w{int(rng.expovariate(0.15))}"
    docs = {i: " ".join(["hot", *(word() for _ in range(rng.randint(0, 9)))]) for i in rng.sample(range(9000), 400)}
    asked = {q: "hot " + " ".join([word() for _ in range(4)] + ["unseen"] * (q % 3 == 0)) for q in range(120)}
    ix = bm25.build(spark.createDataFrame([(i, t, "", "x") for i, t in docs.items()], PAIRS))
    before = shuffled_rows(spark)
    got = bm25.search(ix, spark.createDataFrame(list(asked.items()), "q_id long, text string"), 5).collect()
    assert {(r.q_id, r.rank, r.pair_id, round(r.score, 6)) for r in got} == brute_search(docs, asked, 5)
    moved = sum(n for i, n in shuffled_rows(spark).items() if i not in before)
    assert 0 < moved < 400 * 120 / 3  # every document holds a word of every query


def test_earlier_turns_count_less(spark):
    q = spark.createDataFrame([(1, "zebra", ["oldest", "lion", "tiger", "bear", "zebra wolf"])], "q_id long, text string, context array<string>")
    w = {r.term: r.w for r in bm25.weights(q).collect()}
    assert w["zebra"] == 1.0 and w["wolf"] == pytest.approx(0.7) and w["bear"] == pytest.approx(0.49) and w["lion"] == pytest.approx(0.2401)
    assert "oldest" not in w


def test_reply_falls_back(spark):
    ix = bm25.build(spark.createDataFrame([(1, "good game today", "yes it was", "x")], PAIRS))
    h = "q_id long, text string, history array<struct<role:string,text:string>>"
    q = spark.createDataFrame([(1, "good game today", None), (2, "quantum tunnelling", [("user", "hm")])], h)
    assert {r.q_id: (r.source, r.reply) for r in persona.reply(q, ix, "Ann").collect()} == {1: ("retrieval", "yes it was"), 2: ("none", "")}
    p = spark.createDataFrame([([("words per message", "3.0")], 3, 5, 10)], "traits array<struct<label:string,value:string>>, median int, p90 int, messages long")

    def gen(turns_):
        if turns_[-1]["content"].startswith("quantum"):
            raise OSError
        return "Ann: sure"

    assert {r.q_id: (r.source, r.reply) for r in persona.reply(q, ix, "Ann", p, gen).collect()} == {1: ("model", "sure"), 2: ("none", "")}


def test_history_is_cut_and_roles_are_known(spark):
    h = [("user", f"t{i}") for i in range(15)] + [("assistant", ""), ("robot", "x")]
    df = spark.createDataFrame([(h,), (None,)], "h array<struct<role:string,text:string>>")
    a, b = [r.m for r in df.select(persona.build_messages(F.lit("s"), F.col("h"), F.lit("q")).alias("m")).collect()]
    assert [x.content for x in a] == ["s", *(f"t{i}" for i in range(5, 15)), "x", "q"] and a[-2].role == "user"
    assert [x.content for x in b] == ["s", "q"]


def mine(spark, texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "file_ord int, seq long, text string")


def brute_model(texts):
    ctx, uni = defaultdict(Counter), Counter()
    for t in texts:
        low = [w.lower() for w in re.findall(r"[A-Za-z0-9_'’]+|[^\sA-Za-z0-9_]", t)]
        if low:
            p = ["<s>"] * 4 + low + ["</s>"]
            for i in range(4, len(p)):
                uni[p[i]] += 1
                for n in range(1, 5):
                    ctx[tuple(p[i - n : i])][p[i]] += 1
    return ctx, uni


def brute_dist(ctx, uni, context, prefix=""):
    p = ["<s>"] * 4 + context
    cand = {w for w, _ in uni.most_common(60)} | {w for w in uni if prefix and w.startswith(prefix)}
    seen = [ctx[tuple(p[-n:])] for n in range(1, 5) if tuple(p[-n:]) in ctx]
    cand |= {w for c in seen for w in c}
    total = sum(uni.values())
    out = {w: uni[w] / total for w in cand}
    for c in seen:
        n = sum(c.values())
        lam = n / (n + 2 * len(c))
        out = {w: v * (1 - lam) + lam * c[w] / n for w, v in out.items()}
    return out


def test_predictor_worked_numbers_and_brute_force(spark):
    m = ngram.build(mine(spark, ["a b", "a c"]))
    s = spark.createDataFrame([(1, ["a"], "")], "q_id long, context array<string>, prefix string")
    got = {r.word: r.p for r in ngram.distribution(m, s).collect()}
    assert got["b"] == got["c"] == pytest.approx(0.434156, abs=1e-6) and sum(got.values()) == pytest.approx(1)
    q = spark.createDataFrame([(1, "a "), (2, "")], "q_id long, text string")
    assert {r.q_id: (r.mode, r.words) for r in ngram.suggest(m, q).collect()}[1] == ("append", ["b", "c", "a"])
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the cat sat on a mat and ran".split()) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    ctx, uni = brute_model(texts)
    m = ngram.build(mine(spark, texts))
    asks = [["the"], ["cat", "sat"], [], ["zebra"], ["a", "mat", "and"]]
    s = spark.createDataFrame([(i, c, "") for i, c in enumerate(asks)], "q_id long, context array<string>, prefix string")
    got = defaultdict(dict)
    for r in ngram.distribution(m, s).collect():
        got[r.q_id][r.word] = r.p
    for i, c in enumerate(asks):
        assert got[i] == pytest.approx(brute_dist(ctx, uni, c))


def test_half_typed_words(spark):
    m = ngram.build(mine(spark, ["see you Tuesday"] * 5 + ["such a day"] * 5 + ["and then"]))
    q = spark.createDataFrame([(1, "see you tues"), (2, "such a"), (3, "that was mad 😂"), (4, None)], "q_id long, text string")
    got = {r.q_id: (r.mode, list(r.words)) for r in ngram.suggest(m, q).collect()}
    assert got[1] == ("extend", ["Tuesday"]) and got[2][0] == "append" and got[2][1][0] == "day" and got[3][0] == "append"
    done = {r.q_id: r.completion for r in ngram.complete(m, q.where("text is not null")).collect()}
    assert done[1].startswith("day") and done[2] == " day"


def test_profile(spark):
    texts = ["who booked the pitch"] * 4 + ["lol 😂", "LOL ok?", "lol.", "big win big win", "", "😂"]
    m = mine(spark, texts)
    n = sorted(c for c in (len(re.findall(r"\w+", t)) for t in texts) if c)
    row = profile.lengths(m).first()
    assert (row.median, row.p90, row.max) == tuple(n[min(len(n) - 1, int(len(n) * q))] for q in (0.5, 0.9, 0.99))
    empty = profile.lengths(m.where("false")).first()
    assert (empty.median, empty.p90, empty.max) == (5, 12, 20)
    t = profile.traits(m).first()
    assert (t.n, t.laugh, t.laugh_cnt, t.top_emoji, t.opener) == (8, "lol", 3, "😂", "who")
    assert t.questions_pct == pytest.approx(12.5) and t.punctuated_pct == pytest.approx(25)
    lines = {x.label: x.value for x in profile.trait_lines(profile.traits(m)).first().traits}
    assert lines["laughs as"] == "lol (3x)" and lines["questions"] in ("12%", "13%")
    assert [(r.text, r.cnt) for r in profile.sayings(m).collect()][0] == ("who booked the pitch", 4)
    fav = profile.favourite_words(m, mine(spark, ["the pitch"]))
    assert {r.word for r in fav.collect()} == {"who", "booked", "the", "pitch"}
    got = profile.samples(m, fav).collect()
    assert [r.text for r in got] == ["who booked the pitch", "big win big win"]
