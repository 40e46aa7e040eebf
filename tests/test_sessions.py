from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from chatterloom.operators.sessions import sessionize

SCHEMA = "file string, sender string, msg_seq long, at timestamp_ntz, start_at string"


def brute(rows):
    users, out = {}, []
    for f, s, q, t, _ in set(rows):
        if f and s and t is not None:
            users.setdefault((f, s), []).append((t, q))
    for u, pts in users.items():
        pts.sort()
        runs = [[pts[0]]]
        for p in pts[1:]:
            if p[0] - runs[-1][-1][0] > timedelta(minutes=30):
                runs.append([])
            runs[-1].append(p)
        out += [(*u, i + 1, r[0][1], r[-1][1], (r[-1][0] - r[0][0]).total_seconds(), len(r)) for i, r in enumerate(runs)]
    return sorted(out)


def run(spark, rows):
    got = sessionize(spark.createDataFrame(rows, SCHEMA), ["file", "sender"])
    return sorted((r.file, r.sender, r.session_no, r.first_seq, r.last_seq, r.duration_s, r.n_events) for r in got.collect())


T = datetime(2021, 3, 28, 0, 0, 0)
row = st.tuples(
    st.sampled_from(["f", "g", "", None]), st.sampled_from(["a", "b", "", None]), st.integers(1, 9),
    st.one_of(st.none(), st.integers(0, 400).map(lambda m: T + timedelta(minutes=m * 5, microseconds=m % 3))), st.just("x"),
)


@settings(max_examples=15, deadline=None)
@given(st.lists(row, min_size=1, max_size=60))
def test_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_exact_gap_and_one_microsecond_more(spark):
    a, b = T + timedelta(minutes=30), T + timedelta(minutes=60, microseconds=1)
    rows = [("f", "a", 1, T, ""), ("f", "a", 2, a, ""), ("f", "a", 3, b, "")]
    assert [(x[3], x[4]) for x in run(spark, rows)] == [(1, 2), (3, 3)]


def test_empty(spark):
    assert run(spark, []) == []
