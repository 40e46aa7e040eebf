import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterloom.llm import packing, splitting, tokens

PATH = tokens.default_ranks()
TEXTS = [None, "", "a", "hello world\n\nnext <|endoftext|>", "猫" * 20_000, "word " * 9_000, "x\r\ny " * 5_000, "a" * 30_000, "é́😂👩‍💻" * 3000, "line\nnext\n\n\tq  z " * 3000, "�\x00"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_whole_text(text):
    want = tokens.encoder(PATH).encode_ordinary(text) if text else []
    got = tokens.encode(text, PATH)
    assert got == want and tokens.decode(got, PATH) == (text or "")


def test_same_ids_as_the_other_library(spark, sf):
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (t.encode(r.text, add_special_tokens=False).ids if r.text else [])


@pytest.mark.parametrize("limit, overlap", [(16, 4), (64, 0), (64, 63), (1, 0)])
@pytest.mark.parametrize("text", TEXTS)
def test_pieces(text, limit, overlap):
    if limit == 1 or overlap == 63:
        text = text and text[:400]
    ids = tokens.encode(text, PATH)
    got = splitting.split(text, limit, overlap, PATH)
    if len(ids) <= limit:
        assert got == []
        return
    assert [p[0] for p in got] == list(range(len(got)))
    assert all(0 < n <= limit for _, _, n, _ in got)
    ends = [s + n for _, s, n, _ in got]
    assert got[0][1] == 0 and ends[-1] == len(ids)
    assert all(e - s == min(overlap, e) for e, (_, s, _, _) in zip(ends, got[1:]))
    if overlap == 0 and "😂" not in (text or "") and "猫" not in (text or ""):
        assert "".join(t for *_, t in got) == text


def test_cuts_prefer_strong_boundaries():
    text = "\n\n".join(["one two three four five. six seven eight nine ten"] * 12)
    got = splitting.split(text, 40, 0, PATH)
    assert all(t.endswith("\n\n") for *_, t in got[:-1])


def test_split_frame(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "w " * 50, 9), (3, "w " * 50, 9)], "doc_id long, text string, piece int")
    got = splitting.split_corpus(df, [(4, 30, 5), (5, 1000, 0)]).collect()
    assert {(r.doc_id, r.limit_id) for r in got} == {(3, 4)} and len(got) % 2 == 0
    assert splitting.split_corpus(df, []).count() == 0 and splitting.split_corpus(df.where("false"), [(4, 30, 5)]).count() == 0


def test_fill_respects_every_limit():
    rng = np.random.default_rng(3)
    sizes = np.stack([rng.integers(1, 500, 3000), np.ones(3000, dtype=int), rng.integers(0, 300, 3000)], 1)
    sizes[:, 2] = np.minimum(sizes[:, 2], sizes[:, 0])
    limits = np.array([512, 8, 400])
    box = packing.fill(sizes, limits)
    total = np.zeros((box.max() + 1, 3), dtype=int)
    np.add.at(total, box, sizes)
    assert (box >= 0).all() and (total <= limits).all() and (total[:, 0] > 0).all()
    assert len(total) < 1.05 * max(np.ceil(sizes[:, 0].sum() / 512), np.ceil(sizes[:, 2].sum() / 400))


def test_every_token_once(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 7, 100, 512, 513, 2000]), None) for i in range(400)] + [(1, 30, 5), (1, 30, 5), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, n_loss long").withColumn("piece", F.lit("x"))
    got = packing.pack(df, [(1, 512), (2, 64)], 403)
    for limit, cap in ((1, 512), (2, 64)):
        part = got.where(F.col("limit_id") == limit)
        assert part.agg(F.sum("n_tokens")).first()[0] == sum(r[1] or 0 for r in rows)
        assert part.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= cap
        once = part.where("doc_id > 9").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
        assert {r.doc_id: r.n for r in once} == {r[0]: r[1] for r in rows if r[0] > 9 and r[1]}
    assert packing.pack(df.where("false"), [(1, 512)], 0).count() == 0


def decreasing(sizes, limits):
    """First fit in order of decreasing tokens."""
    room, out = [], np.empty(len(sizes), dtype=int)
    for i in np.argsort(-sizes[:, 0], kind="stable"):
        b = next((b for b, r in enumerate(room) if (sizes[i] <= r).all()), None)
        if b is None:
            b, room = len(room), [*room, limits.copy()]
        room[b] = room[b] - sizes[i]
        out[i] = b
    return out


def test_each_limit_binds_and_dot_products_beat_decreasing_order():
    rng = np.random.default_rng(5)
    tokens_ = rng.integers(30, 170, 2000)
    loss = np.where(tokens_ < 100, tokens_, 0)  # short answers and long prompts
    sizes = np.stack([tokens_, loss, np.ones(2000, dtype=int)], 1)
    limits = packing.limits_of(512, 0.37, 12)
    totals = []
    for box in (packing.fill(sizes, limits), decreasing(sizes, limits)):
        total = np.zeros((box.max() + 1, 3), dtype=int)
        np.add.at(total, box, sizes)
        assert (total <= limits).all()
        totals.append(total)
    by_product, by_size = totals
    assert len(by_product) <= 0.95 * len(by_size), (len(by_product), len(by_size))
    smallest = np.where(sizes > 0, sizes, 10**6).min(axis=0)
    assert all((by_product[:, d] + smallest[d] > limits[d]).any() for d in range(3))


def test_an_item_over_another_limit_alone_is_packed_all_the_same():
    sizes = np.array([[500, 500, 1], [10, 10, 1], [300, 20, 1]])
    box = packing.fill(sizes, packing.limits_of(512))
    assert box[0] == box[1] != box[2]


def test_loss_of_a_split_item_goes_to_its_pieces(spark):
    df = spark.createDataFrame([(1, 1300, 400), (2, 600, 600), (3, 100, 0), (4, 50, None)], "doc_id long, n_tokens long, n_loss long")
    got = {(r.doc_id, r.piece): (r.n_tokens, r.n_loss) for r in packing.pack(df, [(1, 512)], 4).collect()}
    assert got == {(1, 0): (512, 0), (1, 1): (512, 124), (1, 2): (276, 276), (2, 0): (512, 512), (2, 1): (88, 88), (3, 0): (100, 0), (4, 0): (50, 50)}
