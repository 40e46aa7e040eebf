"""One person's work: exports added, an identity chosen, questions asked. Nothing is stored
outside the session and no module state is kept; tables are plans until something is asked."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.plan import checkpointed
from chatterloom.operators import bm25, ngram, persona, profile, senders, turns
from chatterloom.sources.text_export import read_uploads
from chatterloom.sources.html_export import parse_any

MAX_FILES = 5
#: Bytes of one batch.
MAX_BYTES = 64 * 1024 * 1024
#: What a session may hand on as JSON and take back.
CHAT_SCHEMA = "file_ord int, file string, seq bigint, sender string, text string, at timestamp_ntz, format string"


class Session:
    def __init__(self, chat: DataFrame | None = None):
        self.chat = chat
        self.me: list[str] = []
        self.model: ngram.Model | None = None
        self.index: bm25.Index | None = None
        self.files: list[str] = []

    def upload(self, spark, paths: list[str] | str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
        """Adds a batch of exports, all or none; the model built before no longer holds.

        A name already added, too many files or bytes, or a file without any message refuses the
        whole batch. Names of earlier batches are kept, so they are not parsed again for them.
        """
        new = read_uploads(spark, paths)
        sizes = {r.file: r.n for r in new.select("file", F.octet_length("raw").alias("n")).collect()}
        if both := sorted(set(sizes) & set(self.files)):
            raise ValueError(f"already added: {both[0]}")
        if len(sizes) + len(self.files) > max_files:
            raise ValueError(f"at most {max_files} files")
        if sum(sizes.values()) > max_bytes:
            raise ValueError(f"at most {max_bytes} bytes")
        made = checkpointed(parse_any(new).withColumn("file_ord", F.col("file_ord") + len(self.files)))
        written = {r.file for r in made.select("file").distinct().collect()}
        if empty := sorted(set(sizes) - written):
            raise ValueError(f"no messages found in {empty[0]}")
        self.files += sorted(sizes)
        return self._add(made)

    def _add(self, made: DataFrame) -> DataFrame:
        self.chat = made if self.chat is None else senders.union_files([self.chat, made])
        self.model = self.index = None
        return self.chat

    def to_json(self, path: str) -> None:
        """The messages as JSON lines, for other tools or :meth:`from_json`."""
        self._need().write.mode("overwrite").json(path)

    def from_json(self, spark, path: str) -> DataFrame:
        """Adds what :meth:`to_json` wrote."""
        made = checkpointed(spark.read.schema(CHAT_SCHEMA).json(path))
        self.files += [r.file for r in made.select("file").distinct().orderBy("file").collect()]
        return self._add(made)

    def remove(self, file: str) -> None:
        self.chat = senders.without_file(self._need(), file)
        self.files = [f for f in self.files if f != file]
        self.model = self.index = None

    def reset(self) -> None:
        self.__init__()

    def _need(self) -> DataFrame:
        if self.chat is None:
            raise ValueError("no export added")
        return self.chat

    def senders(self) -> DataFrame:
        return senders.sender_payload(self._need())

    def identify(self, names: Iterable[str]) -> Session:
        """Builds the predictor, the profile and the reply index of the chosen labels."""
        self.me = sorted(set(names))
        if not self.me:
            raise ValueError("choose at least one name")
        split = senders.identity_split(self._need(), self.me)
        self.mine, self.others = split.where("mine"), split.where(~F.col("mine"))
        self.model = ngram.build(self.mine)
        pairs = turns.reply_pairs(turns.turns(self._need()), self.me)
        self.index = bm25.build(turns.numbered(pairs))
        return self

    @property
    def identity(self) -> str:
        return " and ".join(self.me)

    def profile(self) -> DataFrame:
        """One row: measured habits as shown, usual lengths, number of messages, favourite words,
        sayings and sample messages."""
        lines = profile.trait_lines(profile.traits(self.mine))
        n = self.mine.agg(F.count("*").alias("messages"))
        fav = profile.favourite_words(self.mine, self.others)
        listed = lambda d, order, *cols: d.agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("l"))
        rank = F.row_number().over(Window.orderBy(F.desc("ratio"), F.desc("word"), F.desc("cnt")))  # eight rows at most
        words = listed(fav.withColumn("rank", rank), "rank", "word", "cnt").select(F.transform("l", lambda x: x.dropFields("rank")).alias("favourites"))
        said = listed(profile.sayings(self.mine), "rank", "text", "cnt").select(F.transform("l", lambda x: x.dropFields("rank")).alias("sayings"))
        seen = listed(profile.samples(self.mine, fav), "rank", "text").select(F.transform("l", lambda x: x["text"]).alias("samples"))
        out = lines
        for one in (profile.lengths(self.mine), n, words, said, seen):  # one row each
            out = out.crossJoin(F.broadcast(one))
        return out

    def suggest(self, queries: DataFrame, k: int = 3) -> DataFrame:
        return ngram.suggest(self.model, queries, k)

    def complete(self, queries: DataFrame, max_words: int = 8, generator: persona.Generator | None = None) -> DataFrame:
        """``q_id, completion`` and, with a generator, ``source``: ``model`` where it gave text, else
        ``ngram``, the predictor's own continuation."""
        own = ngram.complete(self.model, queries, max_words)
        if generator is None:
            return own
        said = persona.complete(queries, self.model, self.profile(), self.identity, generator)
        both = said.join(own.withColumnRenamed("completion", "own"), "q_id")
        spoken = F.col("source") == "model"
        return both.select("q_id", F.when(spoken, F.col("completion")).otherwise(F.col("own")).alias("completion"), F.when(spoken, "model").otherwise("ngram").alias("source"))

    def reply(self, queries: DataFrame, generator: persona.Generator | None = None) -> DataFrame:
        return persona.reply(queries, self.index, self.identity, self.profile().select("traits", "median", "p90", "messages") if generator else None, generator)
