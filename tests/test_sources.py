"""Exports read line by line and tag by tag; the cases are written out by hand."""

from datetime import datetime

import pytest

from chatterloom.operators.session import Session
from chatterloom.sources import html_export, text_export

L, N = "‎", " "


def text(spark, *lines, **kw):
    df = spark.createDataFrame([(0, "f.txt", "\n".join(lines))], "file_ord int, file string, raw string")
    return [(r.sender, r.text, r.at) for r in text_export.parse_text(df, **kw).orderBy("seq").collect()]


D = datetime(2026, 6, 16, 21, 11)


@pytest.mark.parametrize(
    "lines, want",
    [
        ([f"[2026-06-16, 9:11:25{N}PM] Ann Lee: hi"], [("Ann Lee", "hi", D.replace(second=25))]),
        (["16/06/2026, 21:11 - Ann Lee: hi"], [("Ann Lee", "hi", D)]),
        (["16.06.2026, 21:11 - Ann: hi"], [("Ann", "hi", D)]),
        ([f"{L}[2026-06-16, 9:11:25 PM] Ann: hi"], [("Ann", "hi", D.replace(second=25))]),
        ([f"16/06/2026, 21:11 - Ann: {L}image omitted", "gone too"], []),
        (["16/06/2026, 21:11 - Ann: null"], []),
        (["16/06/2026, 21:11 - Ann: <Media omitted>"], [("Ann", "<Media omitted>", D)]),
        (["16/06/2026, 21:11 - Ann joined", "gone"], []),
        (["16/06/2026, 21:11 - Ann: hi", "second line  ", "", "third"], [("Ann", "hi\nsecond line\nthird", D)]),
        (["16/06/2026, 21:11 - Ann: a", f"b {L}<This message was edited>"], [("Ann", "a\nb", D)]),
        ([f"[2026-06-16, 21:11] ~{N}Ann: hi"], [("Ann", "hi", D)]),
        (["13/06/2026, 9:11 PM - A: x", "06/14/2026, 9:11 PM - A: y"], [("A", "x", datetime(2026, 6, 13, 21, 11)), ("A", "y", None)]),
        (["16/06/70, 21:11 - A: x"], [("A", "x", datetime(1970, 6, 16, 21, 11))]),
        (["16/06/2026, 21:11 - A: see: this"], [("A", "see: this", D)]),
        (["[lol] foo: bar"], [("foo", "bar", None)]),
        (["junk", "16/06/2026, 21:11 - A: x"], [("A", "x", D)]),
        (["12/31/2026, 21:11 - A: x"], [("A", "x", None)]),
        ([""], []),
    ],
)
def test_text_cases(spark, lines, want):
    assert text(spark, *lines) == want


def test_strict_noise(spark):
    assert text(spark, "16/06/2026, 21:11 - Ann: <Media omitted>", strict_noise=True) == []


TG = '<div class="message {c}">{d}{n}<div class="text">{t}</div></div>'
CASES = {
    "telegram": (
        TG.format(c="default", d='<div class="date" title="16.06.2026 21:11:25 UTC+01:00"></div>', n='<div class="from_name">Ann</div>', t="hi<br>you")
        + TG.format(c="default joined", d="", n="", t="more &amp; more")
        + '<div class="message service">x</div>'
        + TG.format(c="default joined", d="", n="", t="lost"),
        [("Ann", "hi\nyou", D.replace(second=25)), ("Ann", "more & more", None)],
    ),
    "discord": (
        '<div class="chatlog__message-group"><span class="chatlog__author" title="Ann#1234">A</span><div class="chatlog__content">hi</div><div class="chatlog__content">yo</div></div>',
        [("Ann", "hi", None), ("Ann", "yo", None)],
    ),
    "discord ungrouped": (
        '<div class="chatlog__message"><span class="chatlog__author">Ann</span><div class="chatlog__content">hi</div></div><div class="chatlog__message"><div class="chatlog__content">yo</div></div>',
        [("Ann", "hi", None), ("Ann", "yo", None)],
    ),
    "meta": (
        '<div class="_a6-g"><div class="_a6-h">RenÃ©e</div><div class="_a6-p">hi<ul><li>r</li></ul></div><div>date</div></div><div class="_a6-g"><div class="_a6-h">x</div><div class="_a6-p">x</div></div>',
        [("Renée", "hi", None)],
    ),
    "meta by place": ('<div class="uiBoxWhite"><div>Ann</div><div>hi</div></div><div class="uiBoxWhite"><div>alone</div></div>', [("Ann", "hi", None)]),
    "imessage": (
        '<div class="message"><div class="received"><p><span class="timestamp">Jan 07, 2026  2:17:24 AM (Read by you after 8 hours)</span><span class="sender">Ann</span></p>'
        '<div class="message_part"><span class="bubble">hi</span></div><div class="replies"><div class="message"><div class="sent"><p><span class="sender">Bob</span></p>'
        '<div class="message_part"><span class="bubble">copy</span></div></div></div></div></div></div>'
        '<div class="message"><div class="sent"><p><span class="sender">Bob</span></p><div class="message_part"><div class="edited"><table><tr><td>old</td></tr><tr><td>note</td><td>new</td></tr></table></div></div></div></div>',
        [("Ann", "hi", datetime(2026, 1, 7, 2, 17, 24)), ("Bob", "new", None)],
    ),
    "text in html": ("<html><style>s</style><p>16/06/2026, 21:11 - Ann: hi</p><script>x</script></html>", [("Ann", "hi", D)]),
    "unrecognised": ("<p>nothing</p>", []),
}


@pytest.mark.parametrize("kind", CASES)
def test_html_cases(spark, kind):
    page, want = CASES[kind]
    df = spark.createDataFrame([(0, "f.html", page)], "file_ord int, file string, raw string")
    got = html_export.parse_html(df).orderBy("seq").collect()
    assert [(r.sender, r.text, r.at) for r in got] == want
    assert html_export.formats(df).first().format == ("text in html" if "text" in kind else kind.split()[0])


def test_empty_and_null_documents(spark):
    df = spark.createDataFrame([(0, "a.html", None), (1, "b.txt", ""), (2, "c.txt", None)], "file_ord int, file string, raw string")
    assert html_export.parse_any(df).count() == 0
    assert html_export.parse_any(df.where("false")).count() == 0


def test_session_from_files(spark, tmp_path):
    a, b, bad = tmp_path / "a.txt", tmp_path / "b.HTML", tmp_path / "c.pdf"
    lines = [f"16/06/2026, 21:{i:02d} - {'Ann' if i % 2 else 'Bob'}: {'good game today' if i % 2 == 0 else 'yes it was'}" for i in range(20)]
    a.write_bytes("\n".join(lines).encode() + b"\n\xff")
    b.write_text(CASES["telegram"][0])
    bad.write_text("x")
    s = Session()
    with pytest.raises(ValueError):
        s.upload(spark, [str(a), str(bad)])
    assert s.chat is None
    s.upload(spark, [str(a), str(b)])
    with pytest.raises(ValueError):
        s.upload(spark, str(a))
    assert {r.sender: r.cnt for r in s.senders().collect()} == {"Ann": 12, "Bob": 10}
    s.identify(["Ann"])
    q = spark.createDataFrame([(1, "good game", None)], "q_id long, text string, history array<struct<role:string,text:string>>")
    assert s.reply(q).first().source == "retrieval"
    assert s.suggest(q.select("q_id", "text")).first().words is not None
    s.remove("a.txt")
    assert s.senders().count() == 1
    s.reset()
    with pytest.raises(ValueError):
        s.senders()
