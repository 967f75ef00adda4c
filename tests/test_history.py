from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from kenmark.operators.history import attribute_history, reduce_runs

T0 = datetime(2025, 1, 1)
SCHEMA = "who string, at timestamp, id string, a string, b string, part int"


def brute(rows):
    """The openings, read row by row."""
    out, seen, last, who = [], set(), {}, None
    floor = datetime.min
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or floor, r[2] or "")):
        if r[2] is not None and (r[0], r[1], r[2]) in seen:
            continue
        seen.add((r[0], r[1], r[2]))
        opens = r[0] != who
        if opens:
            who, last = r[0], {}
        for k, v in zip("ab", r[3:5]):
            if v:
                opens |= last.get(k, v) != v
                last[k] = v
        if opens:
            out.append((r[0], r[2], r[1]))
    return out


def run(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    return attribute_history(df, "who", "at", "id", {"a": F.col("a"), "b": F.col("b")}).collect()


def test_random_runs_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        who = "hot" if rng.random() < 0.4 else f"d{rng.integers(40)}"
        pick = lambda n: None if rng.random() < 0.5 else str(rng.integers(n))
        rows.append((who, T0 + timedelta(minutes=int(rng.integers(2000))), f"s{i}", pick(2), pick(3), 0))
    rows += rows[::7]
    expected = brute(rows)
    got = run(spark, rows)
    assert sorted((r.who, r.id) for r in got) == sorted((w, i) for w, i, _ in expected)
    ends = {(w, i): (n[2] if n and n[0] == w else None) for (w, i, _), n in zip(expected, [*expected[1:], None])}
    assert all(ends[r.who, r.id] == r.valid_to for r in got)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (None, T0, "x", "1", "1", 0),
        ("e", None, "n", "1", None, 0),
        ("e", T0, "b", "2", "", 0),
        ("e", T0, "a", None, "5", 0),
        ("e", T0, "b", "2", "", 0),
        ("e", T0, None, "2", "5", 0),
    ]
    got = run(spark, rows)
    assert {(r.id, tuple(r.changed)) for r in got} == {("n", ()), ("b", ("a",))} or {(r.id, tuple(r.changed)) for r in got} == {("n", ()), (None, ("a",))}
    assert run(spark, []) == []


def test_values_are_carried(spark):
    rows = [("e", T0, "1", "x", "y", 0), ("e", T0 + timedelta(1), "2", None, "z", 0), ("e", T0 + timedelta(2), "3", "w", None, 0)]
    got = sorted(run(spark, rows), key=lambda r: r.id)
    assert [r.attributes for r in got] == [{"a": "x", "b": "y"}, {"a": "x", "b": "z"}, {"a": "w", "b": "z"}]


def test_reduction_marks_first_observations():
    changed, opening = reduce_runs(np.array([[-1], [3], [-1], [3], [4], [7]]), np.array([1, 0, 0, 0, 0, 1], bool))
    assert changed[:, 0].tolist() == [False, False, False, False, True, False]
    assert opening[:, 0].tolist() == [False, True, False, False, False, True]
