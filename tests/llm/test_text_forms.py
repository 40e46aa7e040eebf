import unicodedata

import pytest
from pyspark.sql import functions as F

from chatterloom.llm import encoding, lookalike

GOOD = ["déjà vu, le garçon du café", "São três e a estação", "übrigens der große Käse", "слушай, мой телефон сломался",
        "άκου, το τραγούδι έχει πλάκα", "今天我的手机没来", "ねえ、朝ごはんは壊れた。", "cumartesi şu otobüs çok komik", "ok 😂❤️", "£12 or ¥900", "SÃO TRÊS",
        "wie üblich", "chyba śniadanie będzie później"]


def spoil(text, codec):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", GOOD)
def test_good_text_is_left_alone(text):
    assert encoding.restore(text) == (text, False)


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", [t for t in GOOD if not t.startswith("£")])
def test_round_trip(text, codec):
    bad = spoil(text, codec)
    got, hit = encoding.restore(bad)
    assert hit and got == text


def test_twice_and_legacy_and_lost():
    twice = spoil(spoil("réunion à Vexholm", "cp1252"), "cp1252")
    assert encoding.restore(twice) == ("réunion à Vexholm", True)
    assert encoding.restore("завтра новая песня".encode("cp1251").decode("latin-1")) == ("завтра новая песня", True)
    assert encoding.restore("caf�") == ("caf�", True)
    assert encoding.restore("") == ("", False)
    assert encoding.restore("caf&eacute; cr\\u00e8me")[1]


def test_frame_defines_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "cafÃ©", "a"), (3, "cafÃ©", "a"), (4, "x" * 100_000 + "é", None)]
    df = spark.createDataFrame(rows, "msg_id long, text string, sender string")
    got = encoding.with_restored(df, "text", "fixed", "bad").orderBy("msg_id").collect()
    assert [(r.fixed if r.fixed is None or len(r.fixed) < 9 else "long", r.bad) for r in got] == [
        (None, False), ("", False), ("café", True), ("café", True), ("long", False)]
    assert encoding.garbled_found(df.where("false")).count() == 0
    assert sorted((r.msg_id, r.field) for r in encoding.garbled_found(df).collect()) == [(3, "text"), (3, "text")]


def variants(text):
    yield "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)
    yield unicodedata.normalize("NFD", text)
    yield text.replace(" ", " ")
    yield "​".join(text)
    yield text.replace("e", "е").replace("o", "ο").replace("i", "і")
    yield "﻿" + text + "‎"


@pytest.mark.parametrize("text", ["Renée is coming", "meet at noon", "Zoë Kovavonberg"])
def test_same_look_same_key(text):
    for v in variants(text):
        assert lookalike.skeleton(v) == lookalike.skeleton(text)
        assert unicodedata.normalize("NFC", lookalike.canonical(v)) == text
    assert lookalike.skeleton(text.upper()) != lookalike.skeleton(text)
    assert lookalike.skeleton(text.upper(), True) == lookalike.skeleton(text, True)


def test_other_scripts_keep_their_letters():
    for t in ("слушай, мой телефон", "το τραγούδι", "今天", "👩‍💻 ok"):
        assert lookalike.canonical(t) == t
    assert lookalike.canonical("сафé") != "" and lookalike.canonical(None) is None and lookalike.skeleton("​") == ""


def test_written(spark):
    rows = [(None,), ("",), (" ​ ",), ("<Media omitted>",), ("‎image omitted",), ("NULL",), ("null and void",), ("hi",), ("<hi>",)]
    got = [r.w for r in spark.createDataFrame(rows, "t string").select(lookalike.written(F.col("t")).alias("w")).collect()]
    assert [bool(x) for x in got] == [False] * 6 + [True] * 3


def test_pairs_against_brute_force(spark):
    rows = [("f", i, "s", t) for i, t in enumerate(["hi there", "hi there", "hi thеre", "hi there", "Hi there", None, "", "hi\nthere"])]
    rows += [("g", 50, "s", "hi there"), ("f", 60, "ѕ", "x"), ("f", 61, "", "y"), ("f", 62, None, "z"), (None, 63, "ѕ", "hi there")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file string, msg_id long, sender string, text string, look int")
    got = sorted(map(tuple, lookalike.same_look_found(df).collect()))
    assert got == [("sender", 0, 60), ("text", 0, 1), ("text", 0, 2), ("text", 1, 2)]
    assert lookalike.same_look_found(df.where("false")).count() == 0


def test_search_runs_until_nothing_is_left():
    text = "café à la crème"
    for times in (1, 4, 5, 7):
        garbled = text
        for _ in range(times):
            garbled = garbled.encode("utf-8").decode("latin-1")
        assert encoding.restore(garbled) == (text, True), times
