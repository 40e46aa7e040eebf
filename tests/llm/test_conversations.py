import random

from chatterloom.llm import conversations as C

SCHEMA = "msg_id long, file string, msg_seq long, sender string, text string, at timestamp_ntz, osender string"
FILES = "file string, owner string, text string"


def brute(rows, owners):
    out, files = {}, {}
    for r in rows:
        files.setdefault(r[1], []).append(r)
    for f, rs in files.items():
        if f is None:
            continue
        wr = lambda t: bool(t and t.strip() and t.lower().strip("<>") not in ("null", "media omitted"))
        seqs = {}
        for r in rs:
            seqs.setdefault(r[2], set()).add((r[3], r[4]))
        if not any(wr(r[4]) for r in rs):
            out[f] = "empty"
        elif any(not r[3] for r in rs) or any(len(v) > 1 for v in seqs.values()) or None in seqs or sorted(seqs) != list(range(1, len(seqs) + 1)):
            out[f] = "broken"
        else:
            state, reply = False, False
            for q in sorted(seqs):
                ((s, t),) = seqs[q]
                if wr(t):
                    reply |= state and C.shows(s, owners.get(f))
                    state |= not C.shows(s, owners.get(f))
            if not reply:
                out[f] = "no_reply"
    return out


def run(spark, rows, owners):
    m = spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA)
    f = spark.createDataFrame([(k, v, "t") for k, v in owners.items()], FILES)
    return m, f, {r.file: r.reason for r in C.dropped(m, f).collect()}


def test_random_files(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    rng, rows, owners = random.Random(5), [], {}
    for k in range(150):
        f = f"f{k}"
        owners[f] = rng.choice(["Renée", "Ann", None])
        n = rng.randint(1, 20)
        for q in range(1, n + 1):
            if rng.random() < 0.02:
                continue
            s = rng.choices(["Renée", "RenÃ©e", "Ann", "Bob", "", None], [5, 2, 5, 5, 0.05, 0.05])[0]
            t = rng.choice(["hi", "ok", "", None, "<Media omitted>", " "])
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((len(rows), f, q, s, t if rng.random() < 0.99 else "changed"))
    rng.shuffle(rows)
    _, _, got = run(spark, rows, owners)
    assert got == brute(rows, owners)
    assert {"empty", "broken", "no_reply"} <= set(got.values())


def test_owner_labels():
    assert C.shows("Rеnée", "Renée") and C.shows("Ren�e", "Renée") and C.shows("RenÃ©e", "Renée") and C.shows("Renée​", "Renée")
    assert not C.shows("renée", "Renée") and not C.shows(None, "Renée") and not C.shows("", "") and not C.shows("�", "Renée")


def test_rebuilt_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    rows = [(1, "f", 1, "Bob", "hi"), (2, "f", 2, "Ann", "yo"), (3, "f", 2, "Ann", "yo"), (4, "f", 3, "Bob", None), (5, "f", 4, "Ann", "bye"), (6, "g", 1, "Bob", "x")]
    m, f, _ = run(spark, rows, {"f": "Ann", "g": "Ann"})
    got = sorted((r.file, r.turn, r.role, r.text) for r in C.rebuild(m, f).collect())
    assert got == [("f", 1, "user", "hi"), ("f", 2, "assistant", "yo"), ("f", 3, "assistant", "bye")]


def test_empty(spark):
    m, f, got = run(spark, [], {})
    assert got == {} and C.rebuild(m, f).count() == 0
