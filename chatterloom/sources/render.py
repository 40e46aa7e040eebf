"""Messages written as exports: ``file_ord, file, raw`` of ``file_ord, file, seq, sender, text, at``.

The opposite of the parsers, for round trips and for handing a conversation to other tools.
A file's export is one value, as the file itself is; use it for exports of upload size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _body(c: Column) -> Column:
    return F.replace(_escape(c), F.lit("\n"), F.lit("<br>"))


def _file(chat: DataFrame, line: Column, before: str = "", after: str = "", sep: str = "\n") -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), sep)
    return chat.groupBy("file_ord", "file").agg(F.concat(F.lit(before), body, F.lit(after)).alias("raw"))


def ios_text(chat: DataFrame) -> DataFrame:
    stamp = F.replace(F.date_format("at", "yyyy-MM-dd, h:mm:ss a"), F.lit(" "), F.lit(" "))
    stamp = F.replace(stamp, F.lit(", "), F.lit(", "))
    return _file(chat, F.concat(F.lit("["), F.coalesce(stamp, F.lit("?")), F.lit("] "), "sender", F.lit(": "), "text"))


def android_text(chat: DataFrame) -> DataFrame:
    return _file(chat, F.concat(F.coalesce(F.date_format("at", "dd/MM/yyyy, HH:mm"), F.lit("99/99/2000, 00:00")), F.lit(" - "), "sender", F.lit(": "), "text"))


def telegram(chat: DataFrame) -> DataFrame:
    date = F.coalesce(F.concat(F.lit('<div class="date" title="'), F.date_format("at", "dd.MM.yyyy HH:mm:ss"), F.lit(' UTC+01:00"></div>')), F.lit(""))
    line = F.concat(
        F.lit('<div class="message default">'), date, F.lit('<div class="from_name">'), _escape(F.col("sender")),
        F.lit('</div><div class="text">'), _body(F.col("text")), F.lit("</div></div>"),
    )
    return _file(chat, line, '<div class="history">', "</div>")


def discord(chat: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit('<div class="chatlog__message-group"><span class="chatlog__author">'), _escape(F.col("sender")),
        F.lit('</span><div class="chatlog__content">'), _body(F.col("text")), F.lit("</div></div>"),
    )
    return _file(chat, line)


def meta(chat: DataFrame) -> DataFrame:
    """Non-ASCII letters doubly encoded, as these exports have them."""
    double = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    line = F.concat(
        F.lit('<div class="_a6-g"><div class="_a6-h">'), _escape(double(F.col("sender"))), F.lit('</div><div class="_a6-p">'),
        _body(double(F.col("text"))), F.lit("<ul><li>reaction</li></ul></div><div>date</div></div>"),
    )
    return _file(chat, line)


def imessage(chat: DataFrame) -> DataFrame:
    stamp = F.coalesce(F.date_format("at", "MMM dd, yyyy  h:mm:ss a"), F.lit(""))
    line = F.concat(
        F.lit('<div class="message"><div class="received"><p><span class="timestamp">'), stamp, F.lit(' (Read by you)</span><span class="sender">'),
        _escape(F.col("sender")), F.lit('</span></p><div class="message_part"><span class="bubble">'), _body(F.col("text")), F.lit("</span></div></div></div>"),
    )
    return _file(chat, line)
