"""Queries of the conversation operators, each over its whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions import text as T
from chatterloom.functions.chars import CLOSING, LINE_BREAK, OPENING, utrim
from chatterloom.functions.plan import shared_folder
from chatterloom.operators import bm25, ngram, persona, profile, senders, turns
from chatterloom.plans import sqltext as S
from chatterloom.plans.catalog import query, table
from chatterloom.sources import html_export, render, text_export
from chatterloom.streaming import ingest

ME = S.ME


def chat(spark: SparkSession, sf: str) -> DataFrame:
    """The stored messages as the operators take them: ``file_ord, file, seq, sender, text, at``."""
    m = table(spark, sf, "messages").withColumn("text", utrim(F.col("text"))).where("sender <> '' and text <> ''")
    one = m.groupBy("file", F.col("msg_seq").alias("seq")).agg(F.min_by(F.struct("sender", "text", "at"), "msg_id").alias("m"))
    return one.join(table(spark, sf, "files").select("file_ord", "file"), "file").select("file_ord", "file", "seq", "m.*")


def mine(spark: SparkSession, sf: str) -> DataFrame:
    return chat(spark, sf).where(F.col("sender") == ME)


def others(spark: SparkSession, sf: str) -> DataFrame:
    return chat(spark, sf).where(F.col("sender") != ME)


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: prompts whose ``pair_id`` is divisible by 20; every third is cut
    inside a word, every third ends in a blank."""
    p = table(spark, sf, "pairs").where("pair_id % 20 = 0 and prompt is not null")
    cut = F.when(F.col("pair_id") % 60 == 0, F.substring("prompt", 1, 12)).when(F.col("pair_id") % 60 == 20, F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt"))
    return p.select(F.col("pair_id").alias("q_id"), cut.alias("text"))


ASKED = """SELECT pair_id AS q_id, CASE WHEN pair_id % 60 = 0 THEN substring(prompt, 1, 12) WHEN pair_id % 60 = 20 THEN prompt || ' ' ELSE prompt END AS text
FROM pairs WHERE pair_id % 20 = 0 AND prompt IS NOT NULL"""


def asked_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of retrieval: the same prompts, none of them cut."""
    return table(spark, sf, "pairs").where("pair_id % 20 = 0 and prompt is not null").select(F.col("pair_id").alias("q_id"), F.col("prompt").alias("text"))


ASKED_WHOLE = "SELECT pair_id AS q_id, prompt AS text FROM pairs WHERE pair_id % 20 = 0 AND prompt IS NOT NULL"


# senders ------------------------------------------------------------------------------------


@query("sender_counts", f"WITH {S.CHAT} SELECT sender, count(*) AS cnt FROM chat GROUP BY sender")
def sender_counts(spark, sf):
    return senders.sender_counts(chat(spark, sf)).select("sender", "cnt")


@query(
    "sender_payload",
    f"""WITH {S.CHAT}, per AS (SELECT sender, file, file_ord, count(*) AS n FROM chat GROUP BY ALL)
    SELECT sender, sum(n)::BIGINT AS cnt, sum(n) >= 300 AS enough, string_agg(file, ',' ORDER BY file_ord) AS files FROM per GROUP BY sender""",
)
def sender_payload(spark, sf):
    return senders.sender_payload(chat(spark, sf)).select("sender", "cnt", "enough", F.array_join("files", ",").alias("files"))


@query(
    "file_counts",
    f"""WITH {S.CHAT} SELECT f.file_ord, f.file, f.format, count(c.file) AS cnt FROM files f LEFT JOIN chat c USING (file) GROUP BY f.file_ord, f.file, f.format""",
)
def file_counts(spark, sf):
    return senders.file_counts(chat(spark, sf), table(spark, sf, "files")).select("file_ord", "file", "format", "cnt")


@query("identity_split", f"WITH {S.CHAT} SELECT file, seq, sender = {S.q(ME)} AS mine FROM chat")
def identity_split(spark, sf):
    return senders.identity_split(chat(spark, sf), [ME]).select("file", "seq", "mine")


@query("messages_of_sender", f"WITH {S.CHAT} SELECT file, seq, text FROM chat WHERE sender = {S.q(ME)}")
def messages_of_sender(spark, sf):
    return senders.messages_of(chat(spark, sf), ME).select("file", "seq", "text")


@query("without_file", f"WITH {S.CHAT} SELECT file, count(*) AS cnt FROM chat WHERE file <> (SELECT min(file) FROM files) GROUP BY file")
def without_file(spark, sf):
    first = table(spark, sf, "files").agg(F.min("file")).first()[0]
    return senders.without_file(chat(spark, sf), first).groupBy("file").agg(F.count("*").alias("cnt"))


# turns and pairs ----------------------------------------------------------------------------


@query("turns", f'WITH {S.RUNS} SELECT file, turn, sender, text, "at" FROM timed')
def turns_query(spark, sf):
    return turns.turns(chat(spark, sf)).select("file", "turn", "sender", "text", "at")


@query(
    "reply_pairs",
    f"""WITH {S.RUNS}, adj AS (SELECT file, turn, sender, text AS reply, "at", lag(sender) OVER o AS who, lag(text) OVER o AS prompt, lag("at") OVER o AS asked_at
      FROM timed WINDOW o AS (PARTITION BY file_ord, file ORDER BY turn))
    SELECT file, turn, substring(prompt, 1, 400) AS prompt, reply, who FROM adj
    WHERE sender = {S.q(ME)} AND who <> {S.q(ME)} AND length(reply) <= 300 AND len(regexp_extract_all(lower(prompt), {S.q(T.INDEX_WORD)})) >= 2
      AND ("at" IS NULL OR asked_at IS NULL OR ("at" - asked_at BETWEEN INTERVAL 0 MINUTE AND INTERVAL 30 MINUTE))""",
)
def reply_pairs(spark, sf):
    return turns.reply_pairs(turns.turns(chat(spark, sf)), [ME]).select("file", "turn", "prompt", "reply", "who")


# tokens and scalar functions ----------------------------------------------------------------


def _tokens(spark, sf, fn):
    return table(spark, sf, "documents").select("doc_id", F.array_join(fn(F.col("text")), " ").alias("toks"))


@query("tokenize", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string({S.tokens('text')}, ' ') END AS toks FROM documents")
def tokenize(spark, sf):
    return _tokens(spark, sf, T.tokens)


@query("train_tokens", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string({S.lower(S.train('text'))}, ' ') END AS toks FROM documents")
def train_tokens(spark, sf):
    return _tokens(spark, sf, lambda c: T.lowered(T.train_tokens(c)))


_CUT = f"WITH cut AS MATERIALIZED (SELECT doc_id, {S.index_words('text')} AS w FROM documents)"


@query("index_tokens", f"{_CUT} SELECT doc_id, CASE WHEN w IS NOT NULL THEN array_to_string({S.index_of('w')}, ' ') END AS toks FROM cut")
def index_tokens(spark, sf):
    return _tokens(spark, sf, T.index_tokens)


@query("query_tokens", f"{_CUT} SELECT doc_id, CASE WHEN w IS NOT NULL THEN array_to_string({S.query_of('w')}, ' ') END AS toks FROM cut")
def query_tokens(spark, sf):
    return _tokens(spark, sf, T.query_tokens)


@query(
    "emoji_and_words",
    f"""SELECT doc_id, len(list_filter({S.tokens('text')}, lambda t: {S.emoji('t')})) AS n_emoji, len(list_filter({S.tokens('text')}, lambda t: {S.word('t')})) AS n_words FROM documents WHERE text IS NOT NULL""",
)
def emoji_and_words(spark, sf):
    t = T.tokens(F.col("text"))
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.size(F.filter(t, T.has_emoji)).cast("bigint").alias("n_emoji"), F.size(T.words_of(t)).cast("bigint").alias("n_words"))


_JOINED = f"CASE WHEN list_contains({S.words(CLOSING)}, tok) OR list_contains({S.words(OPENING)}, right(acc, 1)) THEN acc || tok ELSE acc || ' ' || tok END"


@query("detokenize", f"""WITH {S.CHAT}, cut AS (SELECT file, seq, {S.tokens('text')} AS toks FROM chat)
    SELECT file, seq, CASE WHEN len(toks) = 0 THEN '' ELSE list_reduce(toks, lambda acc, tok: {_JOINED}) END AS text FROM cut""")  # fmt: skip
def detokenize(spark, sf):
    return chat(spark, sf).select("file", "seq", T.detokenize(T.tokens(F.col("text"))).alias("text"))


_BYTES = "unhex(array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: printf('%02x', unicode(c))), ''))"


@query("double_encoding", f"""WITH {S.CHAT} SELECT file, seq, CASE WHEN regexp_matches(text, '[\\x{{80}}-\\x{{ff}}]') AND NOT regexp_matches(text, '[^\\x{{0}}-\\x{{ff}}]')
    THEN coalesce(TRY(decode({_BYTES})), text) ELSE text END AS restored FROM chat""")  # fmt: skip
def double_encoding(spark, sf):
    """Every stored text read as the social exports' texts are read."""
    return chat(spark, sf).select("file", "seq", T.fix_double_encoding(F.col("text")).alias("restored"))


@query("apply_word", f"""SELECT pair_id, regexp_replace(prompt, '[A-Za-z0-9_''’]+$', '') || 'word ' AS extended,
    prompt || CASE WHEN prompt <> '' AND NOT regexp_matches(prompt, {S.q('[' + S.WS + ']$')}) THEN ' ' ELSE '' END || 'word ' AS appended FROM pairs WHERE prompt IS NOT NULL""")  # fmt: skip
def apply_word(spark, sf):
    p = table(spark, sf, "pairs").where("prompt is not null")
    use = lambda m: T.apply_word(F.col("prompt"), F.lit("word"), F.lit(m))
    return p.select("pair_id", use("extend").alias("extended"), use("append").alias("appended"))


@query("insert_phrase", f"""SELECT pair_id, prompt || CASE WHEN prompt <> '' AND NOT regexp_matches(prompt, {S.q('[' + S.WS + ']$')}) THEN ' ' ELSE '' END || 'so it goes ' AS text FROM pairs WHERE prompt IS NOT NULL""")
def insert_phrase(spark, sf):
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", T.insert_phrase(F.col("prompt"), F.lit("so it goes")).alias("text"))


@query("strip_echo", f"SELECT pair_id, CASE WHEN length({S.trim('prompt')}) > 0 THEN {S.trim('reply')} END AS rest FROM pairs WHERE prompt IS NOT NULL AND reply IS NOT NULL AND {S.trim('prompt')} <> '' AND {S.trim('reply')} <> ''")
def strip_echo(spark, sf):
    """Replies a generator would give after saying the prompt again; the echo comes off."""
    p = table(spark, sf, "pairs").select("pair_id", utrim(F.col("prompt")).alias("p"), utrim(F.col("reply")).alias("r")).where("p <> '' and r <> ''")
    return p.select("pair_id", T.strip_echo(F.col("p"), F.concat("p", F.lit(" "), "r")).alias("rest"))


def _unwrapped(frm: str, to: str) -> str:
    """CTE that takes a name before a reply away, and then quotes around it."""
    named = S.trim(f"regexp_replace(t, {S.q(f'(?i)^(?:ann and lee|ann|lee|assistant)[{S.WS}]*:[{S.WS}]*')}, '')")
    quoted = "length(t) > 1 AND left(t, 1) || right(t, 1) IN (chr(34) || chr(34), chr(39) || chr(39), '“”', '‘’')"
    return f"{to} AS (SELECT pair_id, CASE WHEN {quoted} THEN {S.trim('substring(t, 2, length(t) - 2)')} ELSE t END AS t FROM (SELECT pair_id, {named} AS t FROM {frm}))"


_NOTE = S.q(f"(?i)^\\((?:as|in the style of)[^)]*\\)[{S.WS}]*")
_LINES = f"list_filter(regexp_split_to_array(regexp_replace(t, {_NOTE}, ''), {S.q(LINE_BREAK)}), lambda l: {S.trim('l')} <> '')[:6]"
_WRAPPED = f"""a AS (SELECT pair_id, {S.trim("'Ann: " + chr(34) + "' || reply || '" + chr(34) + "'")} AS t FROM pairs WHERE reply IS NOT NULL)"""


@query("clean_reply", f"WITH {_WRAPPED}, {_unwrapped('a', 'b')}, {_unwrapped('b', 'c')} SELECT pair_id, {S.trim(f'array_to_string({_LINES}, chr(10))')} AS clean FROM c")
def clean_reply(spark, sf):
    """Every stored reply wrapped as generators wrap them, those of several lines, in quotes or with
    a name before them included."""
    p = table(spark, sf, "pairs").where("reply is not null")
    said = F.concat(F.lit('Ann: "'), "reply", F.lit('"'))
    return p.select("pair_id", T.clean_reply(said, "Ann and Lee").alias("clean"))


# retrieval ----------------------------------------------------------------------------------


def index(spark, sf) -> bm25.Index:
    return bm25.build(table(spark, sf, "pairs"))


@query("bm25_terms", f"WITH {S.INDEX} SELECT term, df, round(idf, 9) AS idf FROM terms")
def bm25_terms(spark, sf):
    return index(spark, sf).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_postings", f"WITH {S.INDEX} SELECT term, pair_id, tf FROM postings")
def bm25_postings(spark, sf):
    return index(spark, sf).postings.select("term", "pair_id", "tf")


@query("bm25_corpus", f"WITH {S.INDEX} SELECT n, round(avgdl, 9) AS avgdl, round(max_idf, 9) AS max_idf FROM corpus")
def bm25_corpus(spark, sf):
    return index(spark, sf).corpus.select("n", F.round("avgdl", 9).alias("avgdl"), F.round("max_idf", 9).alias("max_idf"))


@query("bm25_stats", f"WITH {S.INDEX} SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM terms) AS terms")
def bm25_stats(spark, sf):
    return bm25.stats(index(spark, sf))


@query("bm25_search", f"WITH {S.INDEX}, asked AS ({ASKED}), w AS ({S.OWN}), {S.SCORED} SELECT q_id, rank::INT AS rank, pair_id, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def bm25_search(spark, sf):
    got = bm25.search(index(spark, sf), asked(spark, sf), 5)
    return got.select("q_id", "rank", "pair_id", F.round("score", 6).alias("score"))


_TALK = """asked AS (SELECT p.pair_id AS q_id, p.prompt AS text, b.prompt AS c2, b.reply AS c1, a.prompt AS c4, a.reply AS c3
  FROM pairs p LEFT JOIN pairs b ON b.pair_id = p.pair_id - 1 LEFT JOIN pairs a ON a.pair_id = p.pair_id - 2 WHERE p.pair_id % 20 = 0 AND p.prompt IS NOT NULL)"""


def talks(spark, sf) -> DataFrame:
    """Query prompts with the two exchanges stored before them as their history."""
    p = table(spark, sf, "pairs").select("pair_id", "prompt", "reply")
    out = p.where("pair_id % 20 = 0 and prompt is not null").select(F.col("pair_id").alias("q_id"), F.col("prompt").alias("text"))
    for k in (1, 2):
        b = p.select((F.col("pair_id") + k).alias("q_id"), F.col("prompt").alias(f"p{k}"), F.col("reply").alias(f"r{k}"))
        out = out.join(b, "q_id", "left")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("text"))
    return out.select("q_id", "text", F.array(turn("user", "p2"), turn("assistant", "r2"), turn("user", "p1"), turn("assistant", "r1")).alias("history"))


def _ctx_terms() -> str:
    """The decay runs over the turns that have text, as these are what is handed on."""
    stacked = "SELECT q_id, text, list_filter([c1, c2, c3, c4], lambda c: c IS NOT NULL AND c <> '') AS back FROM asked"
    parts = ["SELECT q_id, unnest(list_distinct(" + S.query_tokens("text") + ")) AS term, 1.0::DOUBLE AS w FROM stacked"]
    for k, d in enumerate((0.7, 0.7 * 0.7, 0.7 * 0.7 * 0.7, 0.7 * 0.7 * 0.7 * 0.7), 1):
        parts.append(f"SELECT q_id, unnest(list_distinct({S.query_tokens(f'back[{k}]')})) AS term, {d!r}::DOUBLE AS w FROM stacked")
    return f"stacked AS ({stacked}), w AS (SELECT q_id, term, max(w) AS w FROM ({' UNION ALL '.join(parts)}) GROUP BY q_id, term)"


@query("bm25_context", f"WITH {S.INDEX}, {_TALK}, {_ctx_terms()}, {S.SCORED} SELECT q_id, rank::INT AS rank, pair_id, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def bm25_context(spark, sf):
    t = talks(spark, sf).withColumn("context", persona.context_of(F.col("history")))
    return bm25.search(index(spark, sf), t, 5).select("q_id", "rank", "pair_id", F.round("score", 6).alias("score"))


@query("bm25_best", f"WITH {S.INDEX}, asked AS ({ASKED}), w AS ({S.OWN}), {S.SCORED} SELECT q_id, pair_id, round(score, 6) AS score FROM ranked WHERE rank = 1 AND score >= 0.21")
def bm25_best(spark, sf):
    return bm25.best(index(spark, sf), asked(spark, sf)).select("q_id", "pair_id", F.round("score", 6).alias("score"))


@query("bm25_search_whole", f"WITH {S.INDEX}, asked AS ({ASKED_WHOLE}), w AS ({S.OWN}), {S.SCORED} SELECT q_id, rank::INT AS rank, pair_id, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def bm25_search_whole(spark, sf):
    got = bm25.search(index(spark, sf), asked_whole(spark, sf), 5)
    return got.select("q_id", "rank", "pair_id", F.round("score", 6).alias("score"))


@query("bm25_best_whole", f"WITH {S.INDEX}, asked AS ({ASKED_WHOLE}), w AS ({S.OWN}), {S.SCORED} SELECT q_id, pair_id, round(score, 6) AS score FROM ranked WHERE rank = 1 AND score >= 0.21")
def bm25_best_whole(spark, sf):
    return bm25.best(index(spark, sf), asked_whole(spark, sf)).select("q_id", "pair_id", F.round("score", 6).alias("score"))


@query(
    "persona_reply",
    f"""WITH {S.INDEX}, {_TALK}, {_ctx_terms()}, {S.SCORED}, one AS (SELECT q_id, pair_id, score FROM ranked WHERE rank = 1)
    SELECT a.q_id, CASE WHEN coalesce(o.score, 0) >= 0.21 THEN p.reply ELSE '' END AS reply, CASE WHEN coalesce(o.score, 0) >= 0.21 THEN 'retrieval' ELSE 'none' END AS source
    FROM asked a LEFT JOIN one o USING (q_id) LEFT JOIN pairs p ON p.pair_id = o.pair_id""",
)
def persona_reply(spark, sf):
    return persona.reply(talks(spark, sf), index(spark, sf), ME).select("q_id", "reply", "source")


@query("persona_messages", f"""WITH {_TALK} SELECT q_id, 2 + len(list_filter([c4, c3, c2, c1], lambda c: c IS NOT NULL AND c <> '')) AS n, text AS last FROM asked""")
def persona_messages(spark, sf):
    made = persona.build_messages(F.lit("be brief"), F.col("history"), F.col("text"))
    t = talks(spark, sf).withColumn("m", made)
    return t.select("q_id", F.size("m").cast("bigint").alias("n"), F.element_at("m", -1)["content"].alias("last"))


@query("persona_generator")
def persona_generator(spark, sf):
    """The whole path with a generator handed in: one that shouts the last message back."""
    p = profile.trait_lines(profile.traits(mine(spark, sf))).crossJoin(F.broadcast(profile.lengths(mine(spark, sf))))
    p = p.crossJoin(F.broadcast(mine(spark, sf).agg(F.count("*").alias("messages"))))

    def shout(turns_: list[dict[str, str]]) -> str:
        return "assistant: " + turns_[-1]["content"].upper()

    return persona.reply(talks(spark, sf), index(spark, sf), ME, p, shout).select("q_id", "reply", "source")


@query("persona_completion")
def persona_completion(spark, sf):
    """Continuations made ready to append: what a generator said after the first words of a text."""
    p = table(spark, sf, "pairs").where("prompt is not null and reply is not null")
    typed = F.substring("prompt", 1, 10)
    return p.select("pair_id", persona.finish_completion(typed, F.concat(typed, F.lit(" "), "reply"), ME, F.lit(False)).alias("text"))


# n-gram model -------------------------------------------------------------------------------


def model(spark, sf) -> ngram.Model:
    return ngram.build(mine(spark, sf))


@query("ngram_counts", f"WITH {S.MODEL} SELECT n, ctx, nxt, cnt FROM counts")
def ngram_counts(spark, sf):
    return model(spark, sf).counts.select("n", "ctx", "nxt", "cnt")


@query("ngram_totals", f"WITH {S.MODEL} SELECT n, ctx, total::BIGINT AS total, kinds, round(lam, 9) AS lam FROM totals")
def ngram_totals(spark, sf):
    return model(spark, sf).totals.select("n", "ctx", "total", "kinds", F.round("lam", 9).alias("lam"))


@query("unigram_probs", f"WITH {S.MODEL} SELECT word, cnt, round(p, 9) AS p FROM uni")
def unigram_probs(spark, sf):
    return model(spark, sf).unigrams.select("word", "cnt", F.round("p", 9).alias("p"))


@query("top_unigrams", f"WITH {S.MODEL} SELECT word FROM top60")
def top_unigrams(spark, sf):
    return ngram.top_unigrams(model(spark, sf))


@query("surface_forms", f"WITH {S.MODEL} SELECT lower, surface FROM surface")
def surface_forms(spark, sf):
    return model(spark, sf).surface


@query(
    "model_stats",
    f"WITH {S.MODEL} SELECT (SELECT count(*) FROM mine) AS messages, (SELECT coalesce(sum(cnt), 0)::BIGINT FROM uni WHERE word <> '</s>') AS tokens, (SELECT count(*) FROM uni) AS vocab, (SELECT count(*) >= 300 FROM mine) AS enough_data",
)
def model_stats(spark, sf):
    return ngram.stats(mine(spark, sf))


@query("next_word_dist", f"WITH {S.MODEL}, {S.asked(ASKED)}, {S.dist('split', 'd')} SELECT q_id, word, round(p, 9) AS p FROM d")
def next_word_dist(spark, sf):
    context, prefix = ngram.split_caret(F.col("text"))
    states = asked(spark, sf).select("q_id", context.alias("context"), prefix.alias("prefix"))
    return ngram.distribution(model(spark, sf), states).select("q_id", "word", F.round("p", 9).alias("p"))


_OPEN = f"word NOT IN ({S.q(T.START)}, {S.q(T.END)}) AND NOT {S.emoji('word')}"
_RESOLVED = f"""half AS (SELECT * FROM split WHERE prefix <> ''), {S.dist('half', 'h')},
judged AS (SELECT q_id, coalesce(max(CASE WHEN word = prefix THEN p END), 0) AS whole,
  coalesce(max(CASE WHEN starts_with(word, prefix) AND word <> prefix AND {_OPEN} THEN p END), 0) AS best FROM h JOIN half USING (q_id) GROUP BY q_id),
resolved AS (SELECT s.q_id, s.text, CASE WHEN s.prefix <> '' AND coalesce(j.whole >= j.best, false) THEN list_append(s.context, s.prefix) ELSE s.context END AS context,
  CASE WHEN s.prefix <> '' AND coalesce(j.whole >= j.best, false) THEN '' ELSE s.prefix END AS prefix FROM split s LEFT JOIN judged j USING (q_id))"""


@query("resolve_caret", f"WITH {S.MODEL}, {S.asked(ASKED)}, {_RESOLVED} SELECT q_id, array_to_string(context, ' ') AS context, prefix FROM resolved")
def resolve_caret(spark, sf):
    got = ngram.resolve(model(spark, sf), asked(spark, sf))
    return got.select("q_id", F.array_join("context", " ").alias("context"), "prefix")


@query(
    "suggest",
    f"""WITH {S.MODEL}, {S.asked(ASKED)}, {_RESOLVED}, {S.dist('resolved', 'd')},
    offered AS (SELECT d.q_id, d.word, row_number() OVER (PARTITION BY d.q_id ORDER BY round(d.p, 12) DESC, d.word) AS r FROM d JOIN resolved s USING (q_id)
      WHERE {S.word('d.word')} AND {_OPEN.replace('word', 'd.word')} AND (s.prefix = '' OR (starts_with(d.word, s.prefix) AND d.word <> s.prefix))),
    best AS (SELECT o.q_id, string_agg(coalesce(f.surface, o.word), ' ' ORDER BY r) AS words FROM offered o LEFT JOIN surface f ON f.lower = o.word WHERE r <= 3 GROUP BY o.q_id)
    SELECT s.q_id, CASE WHEN s.prefix = '' THEN 'append' ELSE 'extend' END AS mode, coalesce(b.words, '') AS words FROM resolved s LEFT JOIN best b USING (q_id)""",
)
def suggest(spark, sf):
    return ngram.suggest(model(spark, sf), asked(spark, sf), 3).select("q_id", "mode", F.array_join("words", " ").alias("words"))


@query("complete")
def complete(spark, sf):
    return ngram.complete(model(spark, sf), asked(spark, sf))


# profile ------------------------------------------------------------------------------------


@query(
    "lengths",
    f"""WITH {S.MINE}, c AS (SELECT len(list_filter({S.tokens('text')}, lambda t: {S.word('t')})) AS c FROM mine), s AS (SELECT list(c ORDER BY c) AS l FROM c WHERE c > 0)
    SELECT coalesce(l[least(len(l) - 1, floor(len(l) * 0.5::DOUBLE))::INT + 1], 5)::INT AS median, coalesce(l[least(len(l) - 1, floor(len(l) * 0.9::DOUBLE))::INT + 1], 12)::INT AS p90,
      coalesce(l[least(len(l) - 1, floor(len(l) * 0.99::DOUBLE))::INT + 1], 20)::INT AS max FROM s""",
)
def lengths(spark, sf):
    return profile.lengths(mine(spark, sf))


_W = f"list_filter({S.tokens('text')}, lambda t: {S.word('t')})"
_END = f"right(regexp_replace(text, {S.q('[' + S.WS + ']+$')}, ''), 1)"
_LAUGH = f"(list_contains({S.words(T.LAUGHS)}, w) OR regexp_matches(w, {S.q(T.LAUGH_PATTERN)}))"


@query(
    "traits",
    f"""WITH {S.MINE}, m AS (SELECT * FROM (SELECT file_ord::BIGINT * 100000000000 + seq * 10000 AS o, text, {S.tokens('text')} AS toks, {_W} AS words FROM mine) WHERE len(words) > 0),
    e AS (SELECT o + generate_subscripts(toks, 1) AS o, unnest(toks) AS tok FROM m), em AS (SELECT tok, count(*) AS c, min(o) AS f FROM e WHERE {S.emoji('tok')} GROUP BY tok),
    l AS (SELECT o + generate_subscripts(words, 1) AS o, lower(unnest(words)) AS w FROM m), la AS (SELECT w, count(*) AS c, min(o) AS f FROM l WHERE {_LAUGH} GROUP BY w),
    op AS (SELECT lower(words[1]) AS w, count(*) AS c, min(o) AS f FROM m GROUP BY 1)
    SELECT count(*) AS n, round(sum(len(words)) / count(*), 9) AS words_per_message, round(100.0 * count(*) FILTER ({_END} = '?') / count(*), 9) AS questions_pct,
      round(100.0 * count(*) FILTER ({_END} IN ('.', '!', '?')) / count(*), 9) AS punctuated_pct,
      round(100.0 * sum(len(list_filter(words, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w))) / sum(len(words)), 9) AS caps_pct,
      round(100.0 * count(*) FILTER (len(list_filter(toks, lambda t: {S.emoji('t')})) > 0) / count(*), 9) AS emoji_pct,
      (SELECT arg_min(tok, (-c, f)) FROM em) AS top_emoji, (SELECT arg_min(w, (-c, f)) FROM la HAVING max(c) >= 3) AS laugh, (SELECT arg_min(w, (-c, f)) FROM op) AS opener FROM m""",
)
def traits(spark, sf):
    r = lambda c: F.round(c, 9).alias(c)
    return profile.traits(mine(spark, sf)).select(
        "n", r("words_per_message"), r("questions_pct"), r("punctuated_pct"), r("caps_pct"), r("emoji_pct"), "top_emoji", "laugh", "opener"
    )


_FAV = f"""a AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({S.lower(S.train('text'))}) AS word FROM mine) WHERE {S.word('word')} AND length(word) > 1 GROUP BY word),
b AS (SELECT word, count(*) AS theirs FROM (SELECT unnest({S.lower(S.train('text'))}) AS word FROM others) WHERE {S.word('word')} AND length(word) > 1 GROUP BY word),
fav AS (SELECT a.word, a.cnt, round((a.cnt::DOUBLE / (SELECT sum(cnt) FROM a)) / ((coalesce(b.theirs, 0) + 0.5::DOUBLE) / (SELECT greatest(coalesce(sum(theirs), 0), 1) FROM b)), 9) AS ratio
  FROM a LEFT JOIN b USING (word) WHERE a.cnt >= 4 ORDER BY ratio DESC, a.word DESC LIMIT 8)"""


@query("favourite_words", f"WITH {S.MINE}, {_FAV} SELECT word, cnt, round(ratio, 6) AS ratio FROM fav")
def favourite_words(spark, sf):
    return profile.favourite_words(mine(spark, sf), others(spark, sf)).select("word", "cnt", F.round("ratio", 6).alias("ratio"))


@query(
    "phrase_counts",
    f"""WITH {S.MINE}, w AS (SELECT list_filter({S.lower(S.train('text'))}, lambda t: {S.word('t')}) AS w FROM mine),
    s AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w), p AS (SELECT n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM s, (VALUES (2), (3), (4), (5)) v(n) WHERE i + n - 1 <= len(w))
    SELECT phrase, n, count(*) AS cnt FROM p GROUP BY ALL HAVING count(*) >= 3""",
)
def phrase_counts(spark, sf):
    return profile.phrase_counts(mine(spark, sf)).select(F.array_join("phrase", " ").alias("phrase"), "n", "cnt")


@query("sayings")
def sayings(spark, sf):
    return profile.sayings(mine(spark, sf)).select("rank", "text", "cnt")


@query(
    "samples",
    f"""WITH {S.MINE}, {_FAV}, m AS (SELECT file_ord, seq, text, {S.tokens('text')} AS toks, {_W} AS words FROM mine),
    s AS (SELECT *, len(words) AS n_words, len(list_filter(words, lambda w: list_contains(fv, lower(w)))) AS hits FROM m, (SELECT list(word) AS fv FROM fav) WHERE len(words) BETWEEN 4 AND 18 AND NOT {S.emoji('toks[1]')}),
    one AS (SELECT *, row_number() OVER (PARTITION BY substring(lower(text), 1, 40) ORDER BY hits DESC, n_words DESC, file_ord, seq) AS r FROM s)
    SELECT text, hits, n_words FROM one WHERE r = 1 ORDER BY hits DESC, n_words DESC, file_ord, seq LIMIT 14""",
)
def samples(spark, sf):
    fav = profile.favourite_words(mine(spark, sf), others(spark, sf))
    return profile.samples(mine(spark, sf), fav).select("text", F.col("hits").cast("bigint").alias("hits"), F.col("n_words").cast("bigint").alias("n_words"))


# sources ------------------------------------------------------------------------------------

_CLEAN = f"{S.trim('sender')} AS sender"
#: Rows a round trip keeps: labels and texts that the formats can hold as they are.
_PLAIN = f"""plain AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS k FROM chat
  WHERE NOT regexp_matches(sender, '[:#~\\x{{200e}}\\x{{202f}}]') AND sender = {S.trim('sender')} AND NOT regexp_matches(text, '[\\r\\x{{b}}\\x{{c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'))"""


def plain(spark, sf) -> DataFrame:
    c = chat(spark, sf)
    return c.where(
        ~F.col("sender").rlike("[:#~\\x{200e}\\x{202f}]") & (F.col("sender") == utrim(F.col("sender")))
        & ~F.col("text").rlike("[\r\\x{b}\\x{c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]")
    )


def _of(c: DataFrame, spark, sf, kind: str) -> DataFrame:
    f = table(spark, sf, "files").where(F.col("format") == kind).select("file")
    return c.join(f, "file", "left_semi")


_BODY = "regexp_replace({c}, '[\\x{{200e}}]*$', '')"


def _text_sql(kind: str, at: str, noise: bool = True) -> str:
    """What a text export of the plain rows must give back: continuation lines lose trailing
    white space and blank ones vanish, noise bodies go with the lines after them."""
    rstrip = f"regexp_replace(l, {S.q('[' + S.WS + ']+$')}, '')"
    lines = f"list_filter(string_split(text, chr(10)), lambda l: {S.trim('l')} <> '')"
    bare = f"lower(regexp_replace({S.trim('string_split(text, chr(10))[1]')}, '^[<>]+|[<>]+$', '', 'g'))"
    return f"""WITH {S.CHAT}, {_PLAIN}, f AS (SELECT p.*, {lines} AS ls, string_split(text, chr(10))[1] AS head FROM plain p JOIN files USING (file) WHERE format = '{kind}'
        AND NOT regexp_matches(text, {S.q('(?m)' + text_export._SYSTEM.replace('^', '^[\\x{200e}]*'))})),
      kept AS (SELECT file, seq, sender, ls, "at", head FROM f WHERE NOT starts_with(text, chr(8206)) AND {bare} NOT IN (SELECT unnest({S.words(text_export.NOISE)}))),
      made AS (SELECT file, seq, sender, array_to_string(list_concat([ls[1]], list_transform(ls[2:], lambda l: {rstrip})), chr(10)) AS t, "at" FROM kept),
      clean AS (SELECT file, seq, sender, {S.trim("regexp_replace(t, '[" + "\\x{2066}-\\x{2069}" + "]', '', 'g')")} AS text, {at} AS "at" FROM made)
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) AS seq, sender, text, "at" FROM clean WHERE text <> ''"""


def _text_ready(spark, sf, kind: str) -> DataFrame:
    c = _of(plain(spark, sf), spark, sf, kind)
    return c.where(~F.col("text").rlike("(?m)" + text_export._SYSTEM.replace("^", "^[\\x{200e}]*")))


_SECOND = "date_trunc('second', \"at\")"


@query("parse_ios", _text_sql("whatsapp", "date_trunc('second', \"at\")"))
def parse_ios(spark, sf):
    made = text_export.parse_text(render.ios_text(_text_ready(spark, sf, "whatsapp")))
    return made.select("file", "seq", "sender", "text", "at")


@query("parse_android", _text_sql("whatsapp", "date_trunc('minute', \"at\")"))
def parse_android(spark, sf):
    made = text_export.parse_text(render.android_text(_text_ready(spark, sf, "whatsapp")))
    return made.select("file", "seq", "sender", "text", "at")


def _html_sql(kind: str, at: str = "NULL::TIMESTAMP", extra: str = "") -> str:
    return f"""WITH {S.CHAT}, {_PLAIN} SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) AS seq, sender, text, {at} AS "at", '{kind}' AS format
      FROM plain p JOIN files USING (file) WHERE format = '{kind}'{extra}"""


def _html(spark, sf, kind: str, rows: DataFrame | None = None) -> DataFrame:
    c = _of(plain(spark, sf), spark, sf, kind) if rows is None else rows
    made = html_export.parse_html(getattr(render, kind)(c))
    return made.select("file", "seq", "sender", "text", "at", "format")


@query("parse_telegram", _html_sql("telegram", "date_trunc('second', \"at\")"))
def parse_telegram(spark, sf):
    return _html(spark, sf, "telegram")


@query("parse_discord", _html_sql("discord"))
def parse_discord(spark, sf):
    return _html(spark, sf, "discord")


@query("parse_meta", _html_sql("meta", extra=" AND sender <> text"))
def parse_meta(spark, sf):
    return _html(spark, sf, "meta", _of(plain(spark, sf), spark, sf, "meta").where("sender <> text"))


@query("parse_imessage", _html_sql("imessage", "date_trunc('second', \"at\")"))
def parse_imessage(spark, sf):
    return _html(spark, sf, "imessage")


@query("parse_text_in_html", f"SELECT *, 'text in html' AS format FROM ({_text_sql('whatsapp', _SECOND)})")
def parse_text_in_html(spark, sf):
    """Text exports saved as web pages."""
    c = render.ios_text(_text_ready(spark, sf, "whatsapp"))
    esc = F.replace(F.replace("raw", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = c.select("file_ord", "file", F.concat(F.lit("<html><head><style>x</style></head><body><pre>"), esc, F.lit("</pre></body></html>")).alias("raw"))
    return html_export.parse_html(page).select("file", "seq", "sender", "text", "at", "format")


_KINDS = {"telegram": "", "discord": "", "meta": " AND sender <> text", "imessage": ""}


@query("export_formats", " UNION ALL ".join(f"SELECT file, format, count(*) AS cnt FROM ({_html_sql(k, extra=x)}) GROUP BY ALL" for k, x in _KINDS.items()))
def export_formats(spark, sf):
    """What each rendered export is recognised as."""
    p = plain(spark, sf)
    parts = [getattr(render, k)(_of(p, spark, sf, k)) for k in _KINDS]
    return html_export.formats(senders.union_files(parts)).select("file", "format", "cnt")


@query(
    "line_kinds",
    f"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, {S.q(text_export.LINE_BREAK.replace('|', '|'))})) AS line FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, line, regexp_replace(line, '^[\\x{{200e}}]+', '') AS s FROM l)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(s, {S.q(text_export._IOS)}) OR regexp_matches(s, {S.q(text_export._ANDROID)})) AS headers FROM s GROUP BY doc_id""",
)
def line_kinds(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("file_ord"), F.col("doc_id").cast("string").alias("file"), F.col("text").alias("raw"))
    k = text_export.classify(text_export.lines(d))
    return k.groupBy(F.col("file_ord").alias("doc_id")).agg(F.count("*").alias("lines"), F.count(F.when(F.col("kind").isin("H", "D"), 1)).alias("headers"))


@query("parse_transcripts")
def parse_transcripts(spark, sf):
    """The transcripts among the documents, read as exports."""
    d = table(spark, sf, "documents").where("kind = 'transcript' and text is not null")
    d = d.select(F.col("doc_id").alias("file_ord"), F.col("doc_id").cast("string").alias("file"), F.col("text").alias("raw"))
    return text_export.parse_text(d).select(F.col("file_ord").alias("doc_id"), "seq", "sender", "text", "at")


@query("sticky_stamps")
def sticky_stamps(spark, sf):
    r = table(spark, sf, "raw_messages").select("raw_id", "file", "line_no", F.col("at").alias("stamp"))
    return text_export.sticky_stamps(r).select("raw_id", "at")


# streams ------------------------------------------------------------------------------------


@query("stream_activity", "SELECT event_type AS kind, date_trunc('hour', ts) AS start_at, count(*) AS n_events FROM events GROUP BY ALL")
def stream_activity(spark, sf):
    """Hourly counts through the streaming engine, everything there is at once."""
    s = ingest.stream_table(spark, f"{sf}/events.parquet")
    folder = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    ingest.to_folder(ingest.per_window(s, "event_type", "ts"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    latest = ingest.latest(spark, f"{folder}/out", ["kind", "start_at"])
    return latest.select("kind", F.col("start_at").cast("timestamp_ntz").alias("start_at"), "n_events")


@query(
    "stream_sessions",
    """
    WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id AS "user", min(ts) AS start_at, max(ts) AS end_at, count(*) AS n_events FROM s GROUP BY user_id, n
    """,
)
def stream_sessions(spark, sf):
    """Sessions by event time through the batch engine's form of the streaming operator."""
    made = ingest.activity(table(spark, sf, "events"), "user_id", "ts")
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return made.select("user", at("start_at"), at("end_at"), "n_events")
