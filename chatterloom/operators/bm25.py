"""BM25 over prompts, scored as a share of the query's own weight, carrying the conversation.

The index is four tables (documents, postings, document frequencies, one row of corpus
figures). A batch of queries is weighed by an equi-join on terms and handed to every block of
documents; a block is indexed and scored in memory and gives only its best of each query, so
the matches, which grow with queries times documents, are never written anywhere. Stop words
are dropped on the query side, so the hottest posting lists are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chatterloom.functions.text import index_tokens, query_tokens

K1, B, BIGRAM_WEIGHT, DECAY, CONTEXT_TURNS, MIN_SCORE = 1.5, 0.75, 0.5, 0.7, 4, 0.21
#: Documents of a block: at most so many, as a task holds one; fewer only to fill the cores.
MOST_DOCS, LEAST_DOCS = 131_072, 16_384
#: Neighbouring documents whose best sum is looked at first; posting lists under so many entries
#: are added together, as a call for each costs more than its entries.
WIDTH, SHORT = 128, 512


@dataclass
class Index:
    pairs: DataFrame
    docs: DataFrame  # pair_id, toks, doclen
    postings: DataFrame  # term, pair_id, tf, doclen
    terms: DataFrame  # term, df, idf
    corpus: DataFrame  # n, avgdl, max_idf


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def build(pairs: DataFrame) -> Index:
    """Index of ``pair_id, prompt, ...``; null prompts are empty documents. Keys must be unique."""
    docs = pairs.select("pair_id", index_tokens(F.coalesce("prompt", F.lit(""))).alias("toks")).withColumn("doclen", F.size("toks"))
    corpus = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("doclen"), F.lit(1.0)).alias("avgdl")).select(
        "n", "avgdl", F.log(F.lit(1.0) + (F.greatest("n", F.lit(1)) + 0.5) / 0.5).alias("max_idf")
    )
    postings = docs.select("pair_id", "doclen", F.explode("toks").alias("term")).groupBy("term", "pair_id", "doclen").agg(F.count("*").alias("tf"))
    # the corpus row is one row, whatever the corpus
    terms = docs.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus.select("n")))
    terms = terms.select("term", "df", _idf(F.col("n"), F.col("df")).alias("idf"))
    return Index(pairs, docs, postings, terms, corpus)


def weights(queries: DataFrame) -> DataFrame:
    """``q_id, term, w``: terms of the message at 1, terms only the last four turns hold at 0.7,
    0.49, ... by how far back (``context`` is an array of texts, oldest first, or null)."""

    def weighted(text: Column, w: float) -> Column:
        toks = F.array_distinct(query_tokens(F.coalesce(text, F.lit(""))))
        return F.transform(toks, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    parts = [weighted(F.col("text"), 1.0)]
    if "context" in queries.columns:
        back, decay = F.reverse(F.coalesce("context", F.array().cast("array<string>"))), 1.0
        for k in range(CONTEXT_TURNS):
            decay *= DECAY
            parts.append(weighted(F.get(back, F.lit(k)), decay))
    each = queries.select("q_id", F.explode(F.concat(*parts)).alias("x")).select("q_id", "x.*")
    return each.groupBy("q_id", "term").agg(F.max("w").alias("w"))


class Block:
    """Documents in memory, as posting lists of how saturated a term is in each of them."""

    def __init__(self, toks: pa.ListArray, avgdl: float) -> None:
        doclen = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, coded = len(toks), toks.flatten().dictionary_encode()
        self.terms = coded.dictionary
        n = max(self.n, 1)
        keys = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(self.n), doclen)
        keys, tf = np.unique(keys, return_counts=True)
        self.doc = keys % n
        self.start = np.searchsorted(keys, np.arange(len(self.terms) + 1) * n)
        norm = (1.0 - B) + B * doclen / avgdl
        self.saturated = np.minimum(tf * (K1 + 1.0) / (tf + K1 * norm[self.doc]), 1.0)
        self.acc = np.zeros((-(-n // WIDTH), WIDTH))  # room for whole groups

    def best(self, terms: np.ndarray, weights: np.ndarray, ceiling: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents for terms by number in this block, and their shares."""
        acc, flat = self.acc, self.acc.reshape(-1)
        acc.fill(0.0)
        begin, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        short = size < SHORT
        if short.any():
            begin_, size_ = begin[short], size[short]
            at = np.repeat(begin_ - np.cumsum(size_) + size_, size_) + np.arange(size_.sum())
            np.add.at(flat, self.doc[at], np.repeat(weights[short], size_) * self.saturated[at])
        for s, n, w in zip(begin[~short].tolist(), size[~short].tolist(), weights[~short].tolist()):
            np.add.at(flat, self.doc[s : s + n], w * self.saturated[s : s + n])
        # k documents reach the k-th best of the groups' best; the slack keeps ties at nine decimals
        tops = acc.max(axis=1)
        least = np.partition(tops, -k)[-k] - 2e-9 * ceiling if k <= len(tops) else 0.0
        groups = np.flatnonzero(tops >= least) if least > 0.0 else np.flatnonzero(tops)
        row, col = np.nonzero(acc[groups] >= least if least > 0.0 else acc[groups])
        few = groups[row] * WIDTH + col
        share = flat[few] / (ceiling or 1.0)
        if len(few) > k:
            score = np.round(share, 9)
            least = np.partition(score, -k)[-k]
            above, even = np.flatnonzero(score > least), np.flatnonzero(score == least)
            top = np.concatenate([above, even[: k - len(above)]])  # documents are in the order of their keys
            few, share = few[top], share[top]
        return few, share


def _block_best(k: int):
    """Of the rows of one block, documents before queries: the ``k`` best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[pa.RecordBatch] = []
        block: Block | None = None
        for batch in batches:
            n_docs = batch.num_rows - pc.sum(batch["asks"], min_count=0).as_py()
            if n_docs:  # queries follow
                docs.append(batch.slice(0, n_docs).select(["pair_id", "toks"]))
            asked = batch.slice(n_docs)
            if not asked.num_rows or (block is None and not docs):
                continue
            if block is None:
                held = pa.Table.from_batches(docs).combine_chunks()
                ids = held["pair_id"].combine_chunks()
                block = Block(held["toks"].combine_chunks(), asked["avgdl"][0].as_py())
                docs, held = [], None
            # of a slice, flatten() and lengths give its own rows
            known = pc.index_in(asked["toks"].flatten(), value_set=block.terms)
            there = pc.is_valid(known).to_numpy(zero_copy_only=False)
            known = pc.fill_null(known, 0).to_numpy().astype(np.int64)
            weights = asked["weights"].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(asked["toks"]).to_numpy(zero_copy_only=False))
            found, shares, rows = [], [], []
            at = 0
            for row, (end, ceiling) in enumerate(zip(ends.tolist(), asked["ceiling"].to_pylist())):
                here = there[at:end]
                if here.any():
                    doc, share = block.best(known[at:end][here], weights[at:end][here], ceiling, k)
                    found.append(doc)
                    shares.append(share)
                    rows.append(np.full(len(doc), row))
                at = end
            if found:
                took = [asked["q_id"].take(pa.array(np.concatenate(rows))), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(shares))]
                yield pa.RecordBatch.from_arrays(took, names=["q_id", "pair_id", "share"])

    return run


def blocks_of(docs: int, cores: int) -> int:
    """Blocks of so many documents: two a core where that leaves them large enough."""
    return max(1, -(-docs // MOST_DOCS), min(2 * cores, -(-docs // LEAST_DOCS)))


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """``q_id, rank, pair_id, score``: the ``k`` best prompts of each query.

    ``score`` is the share of the query's weight that is matched; words the index has never
    seen count at the largest idf. Ties (at nine decimals) go to the smaller ``pair_id``.
    Queries without any topic word, and those matching nothing, have no rows.
    """
    corpus = F.broadcast(index.corpus)
    w = weights(queries).join(index.terms.select("term", "idf"), "term", "left").crossJoin(corpus)
    weight = F.coalesce("idf", "max_idf") * F.when(F.col("term").contains("_"), BIGRAM_WEIGHT).otherwise(1.0) * F.col("w")
    known = F.when(F.col("idf").isNotNull(), F.struct("term", weight.alias("weight")))
    asked = w.groupBy("q_id").agg(F.collect_list(known).alias("known"), F.sum(weight).alias("ceiling"), F.first("avgdl").alias("avgdl"))
    n = blocks_of(index.docs.count(), index.docs.sparkSession.sparkContext.defaultParallelism)
    docs = index.docs.select(F.pmod(F.xxhash64("pair_id"), F.lit(n)).cast("int").alias("block"), F.lit(0).alias("asks"), "pair_id", "toks")
    asked = asked.where(F.size("known") > 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("asks"), "q_id",
        F.col("known.term").alias("toks"), F.col("known.weight").alias("weights"), "ceiling", "avgdl",
    )
    both = docs.unionByName(asked, allowMissingColumns=True).repartitionById(n, F.col("block")).sortWithinPartitions("asks", "pair_id")
    fields = StructType([queries.schema["q_id"], index.pairs.schema["pair_id"], StructField("share", DoubleType())])
    fields = StructType([StructField(f.name, f.dataType) for f in fields])
    scored = both.mapInArrow(_block_best(k), fields).select("q_id", "pair_id", F.round("share", 9).alias("score"))
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "pair_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q_id", "rank", "pair_id", "score")


def best(index: Index, queries: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The single best pair of each query where it reaches ``least``."""
    return search(index, queries, 1).where(F.col("score") >= least).drop("rank")


def stats(index: Index) -> DataFrame:
    return index.pairs.agg(F.count("*").alias("pairs")).crossJoin(F.broadcast(index.terms.agg(F.count("*").alias("terms"))))
