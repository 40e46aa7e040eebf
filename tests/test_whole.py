"""Queries that take every row, on small tables with the rows that are hard."""

import datetime
import re

import pytest
from test_conversation import shuffled_rows

import __spark_entry__ as entry

AT = datetime.datetime(2026, 6, 16, 9, 11, 25)


def stored(spark, path, format_, rows):
    """A data folder of one file whose messages are ``rows`` of ``(sender, text)``."""
    made = [(i, "f", i, s, t, AT + datetime.timedelta(minutes=i)) for i, (s, t) in enumerate(rows, 1)]
    spark.createDataFrame(made, "msg_id long, file string, msg_seq long, sender string, text string, at timestamp_ntz").write.parquet(f"{path}/messages.parquet")
    spark.createDataFrame([(1, "f", format_)], "file_ord int, file string, format string").write.parquet(f"{path}/files.parquet")
    return str(path)


def reread(text):
    """Brute force of the double encoding, in Python."""
    try:
        return text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return text


def test_double_encoding_of_every_stored_text(spark, tmp_path):
    texts = ["plain", "café", "cafÃ©", "Ã\xa9tÃ©", "Ã©", "Ã© ‘", "ð\x9f\x98\x82 ok", "Ã", "Ã©Ã", "Ð¿Ñ\x80Ð¸Ð²ÐµÑ\x82", "í\xa0\x80", "À\x80", "hi 😂", "ÿ", "ça va Ã© la"]
    sf = stored(spark, tmp_path, "meta", [("Ann", t) for t in texts])
    got = {r.seq: r.restored for r in entry.queries()["double_encoding"](spark, sf).collect()}
    assert got == {i: reread(t) for i, t in enumerate(texts, 1)}
    assert sum(got[i] != t for i, t in enumerate(texts, 1)) >= 5


def test_retrieval_asks_whole_prompts(spark, tmp_path):
    rows = [(60, "acho que a canção está ótimo", "sim", "Ann"), (61, "nothing alike here", "no", "Ann"), (62, "ótimo está bem", "ok", "Ann")]
    spark.createDataFrame(rows, "pair_id long, prompt string, reply string, who string").write.parquet(f"{tmp_path}/pairs.parquet")
    found = [(r.q_id, r.rank, r.pair_id) for r in entry.queries()["bm25_search_whole"](spark, str(tmp_path)).collect()]
    assert sorted(found) == [(60, 1, 60), (60, 2, 62)]  # 62 shares only words behind the twelfth character
    assert [(r.q_id, r.pair_id) for r in entry.queries()["bm25_best_whole"](spark, str(tmp_path)).collect()] == [(60, 60)]


@pytest.mark.parametrize("name", ["persona_reply", "bm25_context", "persona_generator", "bm25_search_whole", "bm25_search", "bm25_best_whole", "bm25_best"])
def test_matches_are_not_moved(spark, tmp_path, name):
    sf = stored(spark, tmp_path, "meta", [(entry.reference.ME, "hello there my friend")])
    rows = [(i, f"hot w{i % 37} x{i}", f"r{i}", "Ann") for i in range(2000)]
    spark.createDataFrame(rows, "pair_id long, prompt string, reply string, who string").write.parquet(f"{sf}/pairs.parquet")
    before = shuffled_rows(spark)
    asked = {r.q_id for r in entry.queries()[name](spark, sf).collect()}
    assert asked == set(range(0, 2000, 20))
    assert 0 < sum(n for i, n in shuffled_rows(spark).items() if i not in before) < 100 * 2000 / 4  # each prompt asked for holds a word of all


def cleaned(text):
    """Brute force of the cleaning, in Python, for the identity ``Ann and Lee``."""
    text = text.strip()
    for _ in range(2):
        text = re.sub(r"(?i)^(?:ann and lee|ann|lee|assistant)\s*:\s*", "", text).strip()
        if len(text) > 1 and text[0] + text[-1] in ('""', "''", "“”", "‘’"):
            text = text[1:-1].strip()
    text = re.sub(r"(?i)^\((?:as|in the style of)[^)]*\)\s*", "", text)
    return "\n".join([x for x in text.splitlines() if x.strip()][:6]).strip()


def test_clean_reply_of_every_stored_reply(spark, tmp_path):
    replies = [
        "yes", "a\nb\r\n\nc", "1\n2\n3\n4\n5\n6\n7", "“quoted”", "'so'", "\"so\"", "Lee: ok", "assistant : \"ok\"", "(as Ann) sure",
        "(sure)", "", "  ", "‘half", "Ann and Lee: 'a\n\nb'", "a\u2028b\x85c", "Announce: it", "x\"",
    ]
    rows = [(i, "x", r, "Ann") for i, r in enumerate([*replies, None])]
    spark.createDataFrame(rows, "pair_id long, prompt string, reply string, who string").write.parquet(f"{tmp_path}/pairs.parquet")
    got = {r.pair_id: r.clean for r in entry.queries()["clean_reply"](spark, str(tmp_path)).collect()}
    assert got == {i: cleaned(f'Ann: "{r}"') for i, r in enumerate(replies)}
