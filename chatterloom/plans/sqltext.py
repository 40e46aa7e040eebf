"""Pieces of the SQL the queries are held against."""

from __future__ import annotations

from chatterloom.functions.chars import ALNUM, EMOJI, WS
from chatterloom.functions.text import END, INDEX_WORD, LAUGH_PATTERN, LAUGHS, PHRASE_STOPWORDS, QUERY_STOPWORDS, START, TOKEN, URL

ME = "Marrowgate Allotment Society"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in items) + "]"


def trim(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(regexp_replace({c}, {q(URL)}, ' ', 'g'), {q(TOKEN)})"


def emoji(c: str) -> str:
    return f"regexp_matches({c}, {q(f'[{EMOJI}]')})"


def word(c: str) -> str:
    return f"regexp_matches({c}, {q(f'^[{ALNUM}]')})"


def train(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda t: NOT {emoji('t')})"


def lower(c: str) -> str:
    return f"list_transform({c}, lambda t: lower(t))"


def index_words(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({c}), {q(URL)}, ' ', 'g'), {q(INDEX_WORD)})"


def bigrams(w: str) -> str:
    """Neighbours joined; zipped, as a lambda that reads the list by place copies it each time."""
    return f"list_transform(list_zip({w}[:-2], {w}[2:], true), lambda x: x[1] || '_' || x[2])"


def index_tokens(c: str) -> str:
    return f"list_concat({index_words(c)}, {bigrams(index_words(c))})"


def index_of(w: str) -> str:
    """As :func:`index_tokens`, of words already cut."""
    return f"list_concat({w}, {bigrams(w)})"


STOP, PHRASE_STOP = words(QUERY_STOPWORDS), words(PHRASE_STOPWORDS)


def query_tokens(c: str) -> str:
    return query_of(index_words(c))


def query_of(w: str) -> str:
    """As :func:`query_tokens`, of words already cut."""
    keep = f"list_filter({w}, lambda x: NOT list_contains({STOP}, x))"
    two = f"list_filter({bigrams(w)}, lambda b: NOT (list_contains({STOP}, split_part(b, '_', 1)) AND list_contains({STOP}, split_part(b, '_', 2))))"
    return f"list_concat({keep}, {two})"


#: Messages as the operators take them: one row a sequence number, written, in upload order.
CHAT = f"""chat AS (
  SELECT f.file_ord, m.file, m.msg_seq AS seq, m.sender, {trim('m.text')} AS text, m."at"
  FROM (SELECT *, row_number() OVER (PARTITION BY file, msg_seq ORDER BY msg_id) AS rn FROM messages
        WHERE sender <> '' AND {trim('text')} <> '') m JOIN files f USING (file) WHERE rn = 1)"""
MINE = f"{CHAT}, mine AS (SELECT * FROM chat WHERE sender = {q(ME)}), others AS (SELECT * FROM chat WHERE sender <> {q(ME)})"
LISTS = f"lists AS (SELECT * FROM (SELECT file_ord, seq, {train('text')} AS raw, {lower(train('text'))} AS low FROM mine) WHERE len(raw) > 0)"
UNI = f"""flat AS (SELECT file_ord, seq, unnest(list_append(low, {q(END)})) AS word, generate_subscripts(list_append(low, {q(END)}), 1) AS i FROM lists),
uni AS (SELECT word, count(*) AS cnt, count(*)::DOUBLE / sum(count(*)) OVER () AS p, min(file_ord::BIGINT * 100000000000 + seq * 10000 + i) AS first FROM flat GROUP BY word)"""
PADDED = f"list_concat([{q(START)}, {q(START)}, {q(START)}, {q(START)}], low, [{q(END)}])"
COUNTS = f"""padded AS (SELECT {PADDED} AS p FROM lists),
spots AS (SELECT p, unnest(range(5, len(p) + 1)) AS i FROM padded),
grams AS (SELECT n, array_to_string(p[i - n : i - 1], ' ') AS ctx, p[i] AS nxt FROM spots, (VALUES (1), (2), (3), (4)) v(n)),
counts AS (SELECT n, ctx, nxt, count(*) AS cnt FROM grams GROUP BY ALL),
totals AS (SELECT n, ctx, sum(cnt) AS total, count(*) AS kinds, sum(cnt) / (sum(cnt) + 2.0::DOUBLE * count(*)) AS lam FROM counts GROUP BY n, ctx)"""
SURFACE = """toks AS (SELECT file_ord, seq, unnest(raw) AS tok, generate_subscripts(raw, 1) AS i FROM lists),
forms AS (SELECT lower(tok) AS lower, tok, count(*) AS cnt, min(file_ord::BIGINT * 100000000000 + seq * 10000 + i) AS first FROM toks GROUP BY ALL),
surface AS (SELECT lower, arg_min(tok, (-cnt, first)) AS surface FROM forms GROUP BY lower)"""
MODEL = f"{MINE}, {LISTS}, {UNI}, {COUNTS}, {SURFACE}, top60 AS (SELECT word FROM uni ORDER BY cnt DESC, first LIMIT 60)"


def dist(states: str, name: str) -> str:
    """CTEs giving ``name(q_id, word, p)`` of ``states(q_id, context, prefix)``."""
    s = f"[{q(START)}, {q(START)}, {q(START)}, {q(START)}]"
    fold = "coalesce(u.p, 0)"
    for n in (1, 2, 3, 4):
        fold = f"(({fold}) * (1 - coalesce(l.l{n}, 0)) + coalesce(l.l{n}, 0) * coalesce(f.s{n}, 0))"
    pick = lambda c, a: ", ".join(f"max(CASE WHEN n = {n} THEN {c} END) AS {a}{n}" for n in (1, 2, 3, 4))
    return f"""{name}_seen AS (SELECT s.q_id, t.n, t.ctx, t.total, t.lam FROM (
      SELECT q_id, n, array_to_string(list_concat({s}, context)[-n:], ' ') AS ctx FROM {states}, (VALUES (1), (2), (3), (4)) v(n)) s
      JOIN totals t ON t.n = s.n AND t.ctx = s.ctx),
    {name}_next AS (SELECT e.q_id, c.nxt AS word, e.n, c.cnt / e.total AS share FROM {name}_seen e JOIN counts c ON c.n = e.n AND c.ctx = e.ctx),
    {name}_cand AS (SELECT q_id, word FROM {states}, top60 UNION SELECT q_id, word FROM {name}_next
      UNION SELECT s.q_id, u.word FROM {states} s JOIN uni u ON s.prefix <> '' AND starts_with(u.word, s.prefix)),
    {name}_l AS (SELECT q_id, {pick('lam', 'l')} FROM {name}_seen GROUP BY q_id),
    {name}_s AS (SELECT q_id, word, {pick('share', 's')} FROM {name}_next GROUP BY q_id, word),
    {name} AS (SELECT c.q_id, c.word, {fold} AS p FROM {name}_cand c LEFT JOIN uni u ON u.word = c.word
      LEFT JOIN {name}_s f ON f.q_id = c.q_id AND f.word = c.word LEFT JOIN {name}_l l ON l.q_id = c.q_id)"""


def asked(text: str) -> str:
    """CTE ``split(q_id, text, context, prefix)`` of ``asked(q_id, text)``."""
    toks = lower(train("text"))
    half = f"text <> '' AND NOT regexp_matches(right(text, 1), {q(f'[{WS}]')}) AND NOT {emoji('right(text, 1)')} AND len(t) > 0"
    return f"""asked AS ({text}), split AS (SELECT q_id, text, CASE WHEN {half} THEN t[:-2] ELSE t END AS context,
      CASE WHEN {half} THEN t[-1] ELSE '' END AS prefix FROM (SELECT q_id, text, {toks} AS t FROM asked))"""


PAIRS_DOCS = f"docs AS (SELECT pair_id, {index_tokens('coalesce(prompt, $$$$)').replace('$$$$', chr(39) * 2)} AS toks FROM pairs)"
INDEX = f"""{PAIRS_DOCS}, corpus AS (SELECT count(*) AS n, coalesce(avg(len(toks)), 1.0) AS avgdl, ln(1 + (greatest(count(*), 1) + 0.5) / 0.5) AS max_idf FROM docs),
postings AS (SELECT term, pair_id, doclen, count(*) AS tf FROM (SELECT pair_id, len(toks) AS doclen, unnest(toks) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings GROUP BY term)"""
SCORED = """weighted AS (SELECT w.q_id, w.term, coalesce(t.idf, c.max_idf) * CASE WHEN contains(w.term, '_') THEN 0.5 ELSE 1.0 END * w.w AS weight, c.avgdl, t.idf IS NOT NULL AS known
  FROM w LEFT JOIN terms t USING (term) CROSS JOIN corpus c),
ceil_ AS (SELECT q_id, sum(weight) AS ceiling FROM weighted GROUP BY q_id),
hits AS (SELECT x.q_id, p.pair_id, sum(x.weight * least(p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.doclen / x.avgdl)), 1.0)) AS s
  FROM weighted x JOIN postings p USING (term) WHERE x.known GROUP BY ALL),
scored AS (SELECT h.q_id, h.pair_id, round(h.s / CASE WHEN c.ceiling = 0 THEN 1 ELSE c.ceiling END, 9) AS score FROM hits h JOIN ceil_ c USING (q_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, pair_id) AS rank FROM scored)"""
OWN = f"SELECT q_id, unnest(list_distinct({query_tokens('text')})) AS term, 1.0::DOUBLE AS w FROM asked"
RUNS = f"""{CHAT}, flags AS (SELECT *, CASE WHEN sender IS DISTINCT FROM lag(sender) OVER o OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS new FROM chat WINDOW o AS (PARTITION BY file_ord, file ORDER BY seq)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY file_ord, file ORDER BY seq)::BIGINT AS turn FROM flags),
lens AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file_ord, file, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, -1) AS before FROM runs),
turns AS (SELECT file_ord, file, turn, any_value(sender) AS sender, string_agg(text, ' ' ORDER BY seq) AS text, arg_min("at", seq) AS first_at, min(seq) AS s0 FROM lens WHERE before < 400 GROUP BY file_ord, file, turn),
timed AS (SELECT t.*, r."at" FROM turns t JOIN lens r ON r.file = t.file AND r.seq = t.s0)"""
