"""HTML chat exports as rows.

Walking a document tree is the one thing here Spark has no expressions for, so each export is
one row of a ``mapInPandas``: a small tree is built on the standard library's tokenizer, the
dialect is told from class names, and rows come out. Text saved as a web page is stripped of
its tags there and goes on to the text parser as a plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.sources.text_export import parse_text

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_NESTED = {"replies", "reply", "reply_context", "tapbacks"}
_RECEIPT = re.compile(r"\s*\((?:Read|Delivered|Sent|Edited)[^)]*\)\s*", re.I)
SCHEMA = "file_ord int, file string, seq long, sender string, text string, at timestamp_ntz, format string, raw string"


class Node:
    """An element: its tag, attributes, and children that are elements or strings."""

    __slots__ = ("attrs", "children", "classes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = (attrs.get("class") or "").split()
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def one(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def direct(self, tag: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag == tag]

    def text(self, sep: str = "", drop: frozenset[str] = frozenset(), br: bool = False) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif br and c.tag == "br":
                out.append("\n")
            elif c.tag not in drop:
                stack += reversed(c.children)
        return sep.join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def has(*names: str, tag: str | None = None) -> Callable[[Node], bool]:
    """Test for an element that carries all the class names."""
    return lambda n: (tag is None or n.tag == tag) and all(x in n.classes for x in names)


def part(name: str) -> Callable[[Node], bool]:
    """Test for an element with a class that contains ``name``."""
    return lambda n: name in " ".join(n.classes)


def shown(n: Node | None) -> str:
    """Visible text: line breaks kept; lists (reactions), scripts and styles dropped."""
    return "" if n is None else n.text(drop=frozenset({"ul", "script", "style"}), br=True).strip()


def undouble(text: str) -> str:
    """UTF-8 that was written as Latin-1, read again where it round-trips."""
    if not any("\x80" <= c <= "\xff" for c in text):
        return text
    try:
        return text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return text


def dialect(doc: Node) -> str | None:
    tests = [
        ("imessage", lambda: doc.one(has("message_part", tag="div")) and doc.one(has("bubble", tag="span"))),
        ("telegram", lambda: doc.one(part("from_name"))),
        ("telegram", lambda: doc.one(has("history")) and doc.one(has("message"))),
        ("discord", lambda: doc.one(part("chatlog__"))),
        ("meta", lambda: doc.one(part("_a6-g"))),
        ("meta", lambda: doc.one(has("uiBoxWhite")) or doc.one(has("pam"))),
    ]
    return next((k for k, t in tests if t()), None)


def _when(text: str, *formats: str) -> datetime | None:
    for f in formats:
        try:
            return datetime.strptime(text, f)
        except ValueError:
            continue
    return None


def telegram(doc: Node) -> Iterator[tuple[str, str, datetime | None]]:
    """A service line ends a run; a joined message has the sender before it."""
    sender = ""
    for b in doc.all(has("message", tag="div")):
        if part("service")(b):
            sender = ""
            continue
        name = b.one(has("from_name", tag="div"))
        if name is not None:
            sender = shown(name)
        elif not part("joined")(b):
            continue
        text = shown(b.one(has("text", tag="div")))
        if sender and text:
            date = b.one(has("date", tag="div"))
            m = re.search(r"\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}", (date.attrs.get("title") or "") if date else "")
            yield sender, text, _when(m.group(0), "%d.%m.%Y %H:%M:%S") if m else None


def _author(n: Node | None) -> str:
    return "" if n is None else ((n.attrs.get("title") or shown(n)) or "").split("#")[0].strip()


def discord(doc: Node) -> list[tuple[str, str, None]]:
    """Groups name their author once; without groups each message may name one."""
    out = []
    for g in doc.all(has("chatlog__message-group")):
        sender = _author(g.one(has("chatlog__author")))
        out += [(sender, t, None) for c in g.all(has("chatlog__content")) if sender and (t := shown(c))]
    if out:
        return out
    sender = ""
    for b in doc.all(has("chatlog__message")):
        a = b.one(has("chatlog__author"))
        sender = _author(a) if a is not None else sender
        if sender and (t := shown(b.one(has("chatlog__content")))):
            out.append((sender, t, None))
    return out


def meta(doc: Node) -> Iterator[tuple[str, str, None]]:
    """Blocks hold sender, body and date: by class, else the first two direct blocks."""
    for b in doc.all(has("_a6-g", tag="div")) or doc.all(has("uiBoxWhite", tag="div")):
        who, body = b.one(has("_a6-h", tag="div")), b.one(has("_a6-p", tag="div"))
        if who is None or body is None:
            kids = b.direct("div")
            if len(kids) < 2:
                continue
            who, body = who or kids[0], body or kids[1]
        sender, text = undouble(shown(who)), undouble(shown(body))
        if sender and text and sender != text:
            yield sender, text, None


def _last_edit(p: Node) -> list[str]:
    """Texts of a message part; of an edited one only the last version."""
    edited = p.one(has("edited", tag="div"))
    if edited is not None and (rows := edited.all(lambda n: n.tag == "tr")) and (cells := rows[-1].all(lambda n: n.tag == "td")):
        return [t for t in [shown(cells[-1])] if t]
    return [t for b in p.all(has("bubble", tag="span")) if (t := shown(b))]


def imessage(doc: Node) -> Iterator[tuple[str, str, datetime | None]]:
    """Only messages that are not quoted inside another one."""
    for b in doc.all(has("message", tag="div")):
        up, quoted = b.parent, False
        while up is not None and not quoted:
            quoted, up = bool(_NESTED & set(up.classes)), up.parent
        holder = None if quoted else next((d for d in b.direct("div") if {"sent", "received"} & set(d.classes)), None)
        head = next(iter(holder.direct("p")), None) if holder else None
        if head is None:
            continue
        sender = shown(head.one(has("sender", tag="span")))
        stamp = head.one(has("timestamp", tag="span"))
        at = None
        if stamp is not None:
            raw = re.sub(r"\s+", " ", _RECEIPT.sub(" ", " ".join(s.strip() for s in stamp.text("\x00").split("\x00") if s.strip()))).strip()
            at = _when(raw, "%b %d, %Y %I:%M:%S %p", "%b %d, %Y %H:%M:%S")
        text = "\n".join(t for p in holder.direct("div") if "message_part" in p.classes for t in _last_edit(p)).strip()
        if sender and text:
            yield sender, text, at


READERS = {"imessage": imessage, "telegram": telegram, "discord": discord, "meta": meta}


def page_text(doc: Node) -> str:
    return doc.text("\n", drop=frozenset({"script", "style"}))


def _rows(exports: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file_ord", "file", "seq", "sender", "text", "at", "format", "raw"]
    for pdf in exports:
        for r in pdf.itertuples(index=False):
            doc = parse(r.raw or "")
            kind = dialect(doc)
            made = list(READERS[kind](doc)) if kind else []
            if made:
                out = [(r.file_ord, r.file, i, s, t, a, kind, None) for i, (s, t, a) in enumerate(made, 1)]
            else:
                out = [(r.file_ord, r.file, None, None, None, None, None, page_text(doc))]
            part_ = pd.DataFrame(out, columns=cols)
            part_["at"] = pd.to_datetime(part_["at"])
            yield part_


def parse_html(exports: DataFrame) -> DataFrame:
    """``file_ord, file, seq, sender, text, at, format`` of ``file_ord, file, raw``.

    A document of no known dialect, or one that yields no message, is read as text saved as a
    web page. Null documents give nothing.
    """
    slim = exports.select(F.col("file_ord").cast("int").alias("file_ord"), "file", "raw")
    made = slim.mapInPandas(_rows, SCHEMA)
    known = made.where("format is not null").drop("raw")
    saved = parse_text(made.where("format is null").select("file_ord", "file", "raw")).withColumn("format", F.lit("text in html"))
    return known.unionByName(saved)


def formats(exports: DataFrame) -> DataFrame:
    """``file_ord, file, format, cnt``: what each export was read as; ``unrecognised`` gave nothing."""
    got = parse_html(exports).groupBy("file").agg(F.first("format").alias("format"), F.count("*").alias("cnt"))
    return exports.select("file_ord", "file").join(got, "file", "left").select(
        "file_ord", "file", F.coalesce("format", F.lit("unrecognised")).alias("format"), F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def parse_any(exports: DataFrame) -> DataFrame:
    """Text and HTML exports of one batch, by extension."""
    page = F.lower("file").rlike("\\.html?$")
    text = parse_text(exports.where(~page)).withColumn("format", F.lit("whatsapp"))
    return text.unionByName(parse_html(exports.where(page)))
