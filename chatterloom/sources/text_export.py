"""Plain-text chat exports as rows, parsed set-wise.

Every line is classified by patterns alone; a running count of the lines that open something
groups each opener with its continuations, and groups opened by a kept header become
messages. The stamp format is settled per file: the first of a fixed list that reads the
file's first readable stamp is used for all of it.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.chars import LINE_BREAK, LRM, NNBSP, WS, squeeze, urtrim, utrim
from chatterloom.functions.plan import bind

_IOS = f"^\\[([^\\]]+)\\][{WS}]*([^:]+?):[{WS}]?(.*)$"
_STAMP = f"\\d{{1,2}}[/.]\\d{{1,2}}[/.]\\d{{2,4}},[{WS}]\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?(?:[{WS}]*[APap]\\.?[Mm]\\.?)?"
_ANDROID = f"^({_STAMP})[{WS}]-[{WS}]([^:]+?):[{WS}](.*)$"
_SYSTEM = f"^\\[[^\\]]+\\][{WS}]|^{_STAMP}[{WS}]-[{WS}]"
_EDITED = f"(?i)[{WS}]*\\x{{200e}}?<this message was edited>[{WS}]*$"
_ISOLATES = "[\\x{2066}-\\x{2069}]"
#: Bodies that hold no writing (fixed values). Brackets are stripped before the look-up, so the
#: two bracketed ones are only met where ``strict_noise`` strips them here as well.
NOISE = [
    "<media omitted>", "image omitted", "video omitted", "gif omitted", "sticker omitted", "audio omitted",
    "document omitted", "contact card omitted", "this message was deleted", "you deleted this message",
    "missed voice call", "missed video call", "null", "<attached>",
]
#: Stamp formats in order of trial (fixed values): day first before month first.
FORMATS = [
    "yyyy-M-d, h:m:s a", "yyyy-M-d, H:m:s", "yyyy-M-d, H:m",
    "d/M/yyyy, h:m:s a", "d/M/yyyy, h:m a", "d/M/yyyy, H:m:s", "d/M/yyyy, H:m",
    "d/M/yy, h:m:s a", "d/M/yy, h:m a", "d/M/yy, H:m:s", "d/M/yy, H:m",
    "M/d/yyyy, h:m:s a", "M/d/yyyy, h:m a", "M/d/yy, h:m:s a", "M/d/yy, h:m a",
    "d.M.yyyy, h:m:s a", "d.M.yyyy, h:m a", "d.M.yyyy, H:m:s", "d.M.yyyy, H:m",
    "d.M.yy, h:m:s a", "d.M.yy, h:m a", "d.M.yy, H:m:s", "d.M.yy, H:m",
]


def read_uploads(spark, paths: list[str] | str, extensions: tuple[str, ...] = (".txt", ".html", ".htm")) -> DataFrame:
    """``file_ord, file, raw``: whole exports, decoded with replacement of bad bytes.

    An unsupported extension or two files of one name refuse the whole batch, as nothing of a
    batch is taken unless all of it can be. Names are listed from the folder, not the content.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    listed = [r.name for r in found.select(name.alias("name")).collect()]
    if bad := [n for n in listed if not n.lower().endswith(extensions)]:
        raise ValueError(f"not an export: {bad[0]}")
    if len(set(listed)) < len(listed):
        raise ValueError("two files of one name")
    order = F.create_map(*[x for i, n in enumerate(sorted(listed)) for x in (F.lit(n), F.lit(i))]) if listed else F.lit(None)
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    return found.select(F.try_element_at(order, name).alias("file_ord"), name.alias("file"), raw.alias("raw"))


def lines(exports: DataFrame) -> DataFrame:
    """``file_ord, file, line_no, line`` at every Unicode line break."""
    return exports.select("file_ord", "file", F.posexplode(F.split("raw", LINE_BREAK)).alias("line_no", "line"))


def clean_sender(raw: Column) -> Column:
    """A label without direction marks and the tilde of unknown contacts."""
    t = F.regexp_replace(F.regexp_replace(raw, LRM, ""), NNBSP, " ")
    return utrim(F.regexp_replace(t, "^~+", ""))


def is_noise(body: Column, strict: bool = False) -> Column:
    bare = F.lower(F.regexp_replace(utrim(body), "^[<>]+|[<>]+$", ""))
    known = [n.strip("<>") for n in NOISE] if strict else NOISE
    return F.startswith(body, F.lit(LRM)) | bare.isin(known)


def classify(rows: DataFrame, strict_noise: bool = False) -> DataFrame:
    """Lines with ``kind``: H kept header, D header of a placeholder, S system line, B blank,
    C continuation; ``stamp, sender, body`` of headers."""
    rows = bind(rows, s=F.regexp_replace("line", f"^{LRM}+", ""))
    ios, android = F.col("s").rlike(_IOS), F.col("s").rlike(_ANDROID)

    def part(i: int) -> Column:
        return F.when(ios, F.regexp_extract("s", _IOS, i)).when(android, F.regexp_extract("s", _ANDROID, i))

    rows = bind(rows, stamp=part(1), sender=clean_sender(part(2)), body=part(3))
    kind = (
        F.when(F.col("body").isNotNull(), F.when(is_noise(F.col("body"), strict_noise), "D").otherwise("H"))
        .when(F.col("s").rlike(_SYSTEM), "S")
        .when(utrim(F.col("line")) == "", "B")
        .otherwise("C")
    )
    return bind(rows, kind=kind).drop("s")


def parse_with(stamp: Column, fmt: str) -> Column:
    """One format; two-digit years from 69 on are of the last century."""
    at = F.try_to_timestamp(stamp, F.lit(fmt)).cast("timestamp_ntz")
    if "yyyy" in fmt:
        return at
    return F.when(F.year(at) >= 2069, F.add_months(at.cast("date"), -1200).cast("timestamp_ntz") + (at - at.cast("date").cast("timestamp_ntz"))).otherwise(at)


def sticky_stamps(rows: DataFrame, stamp: str = "stamp", file: str = "file", seq: str = "line_no") -> DataFrame:
    """``rows`` with ``at``: every stamp of a file by the format of its first readable one.

    No other format is tried once one is settled, so days and months never swap inside a file.
    """
    text = squeeze(F.regexp_replace(F.regexp_replace(F.col(stamp), NNBSP, " "), LRM, ""))
    rows = bind(rows, __t=text)
    tries = bind(rows, __all=F.array(*[parse_with(F.col("__t"), f) for f in FORMATS]))
    first = F.array_position(F.transform("__all", lambda x: x.isNotNull()), True)
    tries = bind(tries, __i=F.when(first > 0, first))
    chosen = tries.where("__i is not null").groupBy(F.col(file).alias("__f")).agg(F.min_by("__i", seq).alias("__fmt"))
    out = tries.join(chosen, F.col(file) == F.col("__f"), "left")
    return out.withColumn("at", F.get("__all", (F.col("__fmt") - 1).cast("int"))).drop("__t", "__all", "__i", "__f", "__fmt")


def clean_text(text: Column) -> Column:
    return utrim(F.regexp_replace(F.regexp_replace(text, _EDITED, ""), _ISOLATES, ""))


def parse_text(exports: DataFrame, strict_noise: bool = False) -> DataFrame:
    """``file_ord, file, seq, sender, text, at`` of ``file_ord, file, raw``; ``seq`` counts kept
    messages of a file from 1. Text before the first header belongs to nobody and is dropped,
    and so are lines that follow a system line or placeholder."""
    return assemble(classify(lines(exports), strict_noise))


def assemble(kinds: DataFrame) -> DataFrame:
    """Messages of classified lines. One export is one uploaded file, read whole anyway, so its
    lines may share a window."""
    order = Window.partitionBy("file_ord", "file").orderBy("line_no")
    opens = F.col("kind").isin("H", "D", "S").cast("int")
    grouped = kinds.withColumn("island", F.sum(opens).over(order)).where(F.col("kind").isin("H", "D", "S", "C"))
    body = F.when(F.col("kind") == "H", F.col("body")).otherwise(urtrim(F.col("line")))
    head = lambda c: F.min_by(c, "line_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("t")))), lambda x: x["t"]), "\n")
    made = grouped.groupBy("file_ord", "file", "island").agg(
        head("kind").alias("kind"), F.min("line_no").alias("line_no"), head("sender").alias("sender"), head("stamp").alias("stamp"), text.alias("text")
    ).where("kind = 'H'")
    made = sticky_stamps(made).withColumn("text", clean_text(F.col("text"))).where("text <> ''")
    seq = F.row_number().over(Window.partitionBy("file_ord", "file").orderBy("line_no"))
    return made.select("file_ord", "file", seq.cast("bigint").alias("seq"), "sender", "text", "at")


