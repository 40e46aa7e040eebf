import itertools

import numpy as np
import pytest

from chatterloom.llm import crf, privacy
from chatterloom.llm.fit_privacy import fillers, measure
from chatterloom.llm.privacy_corpus import FRAMES, Writer, parts


def brute_marginals(e, trans, edges, skip):
    out, z = np.zeros_like(e), 0.0
    for y in itertools.product(range(crf.L), repeat=len(e)):
        s = sum(e[i, y[i]] for i in range(len(e))) + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(skip[k][y[i], y[j]] for i, j, k in edges)
        for i in range(len(e)):
            out[i, y[i]] += np.exp(s)
        z += np.exp(s)
    return out / z


def tables(agree):
    return {k: (np.eye(crf.L) * agree).tolist() for k in crf.EDGES}


def test_chain_is_exact_and_skip_edges_come_close():
    rng = np.random.default_rng(0)
    trans, e = rng.normal(size=(crf.L, crf.L)), rng.normal(size=(5, crf.L))
    none = tables(0.0)
    assert np.allclose(crf.chain(e[None], np.ones((1, 5), dtype=bool), trans)[0][0], brute_marginals(e, trans, [], none))
    skip = rng.normal(size=(crf.L, crf.L)) * 0.5
    model = crf.Model({}, trans * 0.3, {"same": (skip + skip.T).tolist(), "like": none["like"]})
    doc = ["Quorlin", "x", "y", "z", "QUORLIN"]
    assert crf.skip_edges(doc) == [(0, 4, 0)]
    got = crf._batch(model, [doc], [e])[0]
    assert np.abs(got - brute_marginals(e, trans * 0.3, [(0, 4, 0)], [skip + skip.T])).max() < 0.03


def test_edges_join_tokens_of_every_kind():
    edges = crf.skip_edges("Okafor rang 07700 twice , then Okafor's car , 07700 and ng ng the the , okaforr".split())
    assert {(0, 6, 0), (2, 9, 0)} <= set(edges) and (6, 16, 1) in edges
    assert not any(i in (13, 14) for e in edges for i in e[:2])  # words everybody uses say nothing by being repeated


def test_evidence_passes_every_edge():
    model = crf.Model({}, np.zeros((crf.L, crf.L)), tables(3.0))
    doc = ["07700", "x"] * 9
    e = np.zeros((len(doc), crf.L))
    e[0, 2] = 8.0  # one mention is a phone number, eight repeats of it follow
    e[1::2, 0] = 8.0
    got = crf._batch(model, [doc], [e])[0]
    assert (got[0::2].argmax(axis=1) == 2).all() and np.all(np.diff(got[0::2, 2]) < 0)


def test_a_text_has_one_result_in_any_batch():
    model = privacy.model()
    made = [privacy.tokenize(t) for t, _ in Writer("fit", 9).texts(30)]
    docs = [d for d, _ in made if d]
    marks = [[""] * len(d) for d in docs]
    for doc, m, whole in zip(docs, marks, crf.marginals(model, docs, marks)):
        assert np.allclose(crf.marginals(model, [doc], [m])[0], whole, atol=5e-3)


def test_parts_share_nothing():
    a, b = parts("fit"), parts("held")
    assert not set(a.given) & set(b.given) and not set(a.surnames) & set(b.surnames)
    assert not {f for fs in FRAMES["fit"].values() for f in fs} & {f for fs in FRAMES["held"].values() for f in fs}
    model, names = privacy.model(), {n.lower() for n in (*a.surnames, *b.surnames)}
    assert not names & {k.split("=", 1)[1] for k in model.w if k.startswith(("w=", "l1=", "r1="))} - {"hill", "green", "may", "park", "king", "young", "white", "brown", "hall"}


def test_held_out_frames_and_names():
    for kind, (precision, recall, n) in measure("held", 1500, 3).items():
        assert n > 100 and precision >= 0.9 and recall >= 0.9, (kind, precision, recall)


def test_skip_edges_help_where_entities_are_repeated():
    """Tokens of held-out texts that repeat something: fewer wrong labels with the edges than without."""
    wrong = {1.0: 0, 0.0: 0}
    made = [x for x in Writer("held", 11, fillers()).texts(2500)]
    changed = 0
    found = {f: privacy.find([t for t, _ in made], skip=f) for f in wrong}
    for k, (text, spans) in enumerate(made):
        changed += found[1.0][k] != found[0.0][k]
        for f in wrong:
            got = {i for kind, s, e in found[f][k] if kind == "name" for i in range(s, e) if text[i].isalpha()}
            wrong[f] += len(got ^ {i for s, e, kind in spans if kind == "name" for i in range(s, e) if text[i].isalpha()})
    assert changed > 10 and wrong[1.0] < wrong[0.0], (changed, wrong)


PROBES = [
    ("Please contact Sarah Connor regarding the invoice.", "Please contact [NAME] regarding the invoice."),
    ("I had lunch with Mohammed and Olga yesterday.", "I had lunch with [NAME] and [NAME] yesterday."),
    ("my dad Gary and uncle Piotr are visiting", "my dad [NAME] and uncle [NAME] are visiting"),
    ("Jessica said that Tyler broke it", "[NAME] said that [NAME] broke it"),
    ("The meeting with David Okafor was moved. Okafor will call back. Then Okafor left.", "The meeting with [NAME] was moved. [NAME] will call back. Then [NAME] left."),
    ("My name is Margaret Thompson", "My name is [NAME]"),
    ("j.doe@example.org or call", "[EMAIL] or call"),
    ("phone oh seven seven one two three four five six seven eight", "phone [PHONE]"),
    ("Lindqvarn was here. Dr. Lindqvarn said no. and Lindqvarn?", "[NAME] was here. [NAME] said no. and [NAME]?"),
    ("the meeting is in Brinsleyham on Friday", "the meeting is in Brinsleyham on Friday"),
    ("order 4471-2093 has shipped", "order 4471-2093 has shipped"),
]


@pytest.mark.parametrize("text, want", PROBES)
def test_probes(text, want):
    assert privacy.redact(text, privacy.find([text])[0]) == want


def test_the_first_mention_needs_the_later_ones():
    text = PROBES[8][0]
    assert privacy.find([text])[0] != privacy.find([text], skip=0.0)[0]


CASES = [
    ("is Renée coming", ["name"]),
    ("mail me at ann.lee (at) quillmail (dot) test pls", ["email"]),
    ("call me on 0 7 7 0 0 9 0 0 4 3 5", ["phone"]),
    ("keep this safe SSN: 919-25-3444", ["id_number"]),
    ("taxi to PO Box 227, Tolverton please", ["address"]),
    ("order 4471-2093 with the cello has shipped to Pellby", []),
    ("meet at The Tin Lantern saturday, build 2.14.3 i reckon", []),
    ("ｃａｌｌ ｍｅ ｏｎ ０７７００ ９００ ８１３", ["phone"]),
]


@pytest.mark.parametrize("text, kinds", CASES)
def test_kinds(spark, text, kinds):
    (r,) = privacy.scan(spark.createDataFrame([(1, text, "z")], "k long, t string, clean string"), "k", "t").collect()
    assert r.kinds == kinds
    assert all(privacy.PLACEHOLDER[k] in r.clean for k in kinds)


def test_edges(spark):
    long = "the bus is late. " * 4000 + "call me on 07700 900 813"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "​"), (4, long), (4, long)], "k long, t string")
    got = [(r.k, r.kinds, r.clean if r.clean is None or len(r.clean) < 9 else "…") for r in privacy.scan(df, "k", "t").collect()]
    assert sorted(got, key=str) == sorted([(1, [], None), (2, [], ""), (3, [], ""), (4, ["phone"], "…"), (4, ["phone"], "…")], key=str)
    assert privacy.scan(df.where("false"), "k", "t").count() == 0


def test_redacted_has_messages_and_replies(spark, tmp_path):
    from chatterloom.llm import catalog

    m = [(1, "call me on 07700 900 813"), (2, None), (3, "the bus is late")]
    p = [(1, "x", "mail me at ann.lee (at) quillmail (dot) test pls"), (2, "x", None), (3, "x", "")]
    spark.createDataFrame(m, "msg_id long, text string").write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame(p, "pair_id long, prompt string, reply string").write.parquet(f"{tmp_path}/pairs.parquet")
    got = {(r.src, r.rec_id): r.clean for r in catalog.QUERIES["p1_redacted"](spark, str(tmp_path)).collect()}
    assert got == {
        ("messages", 1): "call me on [PHONE]", ("messages", 2): None, ("messages", 3): "the bus is late",
        ("pairs", 1): "mail me at [EMAIL] pls", ("pairs", 2): None, ("pairs", 3): "",
    }
