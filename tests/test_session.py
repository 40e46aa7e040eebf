"""Uploads all or none, the whole profile, completion with a generator, JSON out and in."""

import pytest

from chatterloom.operators import persona, turns
from chatterloom.operators.session import Session

CHAT = "\n".join(
    f"[2024-03-0{d}, 10:0{i}:00] {who}: {text}"
    for d in (1, 2, 3)
    for i, (who, text) in enumerate([("Bob", "are you coming to the match"), ("Ann", "on my way to the match now"), ("Bob", "great see you there"), ("Ann", "save me a seat at the match please")])
)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_text(CHAT, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("nothing that opens a message", encoding="utf-8")
    return tmp_path


def test_a_file_without_messages_refuses_the_batch(spark, folder):
    s = Session()
    with pytest.raises(ValueError, match="no messages found in empty.txt"):
        s.upload(spark, [str(folder / "a.txt"), str(folder / "empty.txt")])
    assert s.chat is None and s.files == []
    with pytest.raises(ValueError, match="bytes"):
        s.upload(spark, str(folder / "a.txt"), max_bytes=10)
    s.upload(spark, str(folder / "a.txt"))
    with pytest.raises(ValueError, match="already added"):
        s.upload(spark, str(folder / "a.txt"))
    with pytest.raises(ValueError, match="at most 1 files"):
        s.upload(spark, str(folder / "empty.txt"), max_files=1)
    s.remove("a.txt")
    s.upload(spark, str(folder / "a.txt"))
    assert s.chat.count() == 12


def test_profile_completion_and_json(spark, folder):
    s = Session()
    s.upload(spark, str(folder / "a.txt"))
    s.identify(["Ann"])
    (p,) = s.profile().collect()
    assert p.messages == 6 and p.median >= 7 and {f.word for f in p.favourites} <= set("on my way to the match now save me a seat at please".split())
    assert p.samples and "on my way to the match now" in p.samples and p.traits
    asked = spark.createDataFrame([(1, "save me "), (2, ""), (3, "save me a sea")], "q_id long, text string")

    def say(turns_):
        assert turns_[0]["role"] == "system" and "Ann" in turns_[0]["content"]
        return "Ann: " + turns_[-1]["content"] + "a seat"

    got = {r.q_id: (r.completion, r.source) for r in s.complete(asked, generator=say).collect()}
    assert got[1] == ("a seat", "model") and got[2][1] == "ngram" and got[3] == ("t at the match please", "ngram")

    def fail(turns_):
        raise OSError("gone")

    assert {r.source for r in s.complete(asked, generator=fail).collect()} == {"ngram"}
    assert [persona.status(g) for g in (None, fail, lambda t: "yes")] == ["absent", "failing", "ready"]
    s.to_json(str(folder / "out"))
    again = Session()
    again.from_json(spark, str(folder / "out"))
    key = lambda d: sorted(map(tuple, d.select("file", "seq", "sender", "text", "at").collect()))
    assert key(again.chat) == key(s.chat) and again.files == ["a.txt"]


def test_pairs_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 3)
    rows = [(o, f, t) for o, f in ((0, "a"), (1, "b"), (2, "c")) for t in range(2, 30, 2) if (t + o) % 5]
    got = turns.numbered(spark.createDataFrame(rows, "file_ord int, file string, turn long")).collect()
    assert [(r.file_ord, r.file, r.turn) for r in sorted(got, key=lambda r: r.pair_id)] == rows
    assert sorted(r.pair_id for r in got) == list(range(1, len(rows) + 1))
