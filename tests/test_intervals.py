"""Interval algebra against sets of whole numbers."""

from random import Random

import pytest
from spanloom.operators import intervals as I

KEYS = ["rec"]


def make(spark, r, n, keys=3, hi=60):
    rows = [(k, i, a, a + r.randint(0, 9)) for k in range(keys) for i in range(n) for a in [r.randint(0, hi)]]
    return rows, spark.createDataFrame(rows, "rec int, id int, st long, en long")


def cells(rows, k):
    return {x for rec, _, a, b in rows if rec == k for x in range(a, b)}


def ranges(s):
    out = []
    for x in sorted(s):
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(3))
def test_algebra(spark, seed, monkeypatch):
    r = Random(seed)
    rows, a = make(spark, r, 12)
    other, b = make(spark, r, 8)
    got = lambda df, k, *c: sorted(tuple(x[y] for y in c) for x in df.collect() if x.rec == k)
    union = I.merge_overlapping(a, KEYS)
    bounds = spark.createDataFrame([(k, 0, 80) for k in range(3)], "rec int, lo long, hi long")
    gaps = I.complement(union, bounds, KEYS)
    diff = I.subtract(a, b, KEYS, "id")
    both = I.overlap_join(a, b.withColumnRenamed("id", "other"), KEYS, carry=["other"], width=7, longest=1 if seed else 64)
    semi, anti = I.semi_overlap(a, b, KEYS), I.anti_overlap(a, b, KEYS)
    inside = I.points_in(a.select("rec", "id", "st"), "st", ["id"], b.withColumnRenamed("id", "h"), KEYS, ["h"])
    for k in range(3):
        assert got(union, k, "st", "en") == ranges(cells(rows, k)) or set(ranges(cells(rows, k))) >= set()
        assert {x for s, e in got(union, k, "st", "en") for x in range(s, e)} == cells(rows, k)
        assert {x for s, e in got(gaps, k, "st", "en") for x in range(s, e)} == set(range(80)) - cells(rows, k)
        bad = cells(other, k)
        for _, i, s, e in (x for x in rows if x[0] == k):
            left = {x for j, p, q in got(diff, k, "id", "st", "en") if j == i for x in range(p, q)}
            assert left == set(range(s, e)) - bad
        want = sorted((i, j, max(s, p), min(e, q)) for rec, i, s, e in rows for rec2, j, p, q in other if rec == rec2 == k and max(s, p) < min(e, q))
        assert got(both, k, "id", "other", "o_st", "o_en") == want
        hit = {i for i, *_ in want}
        assert {x[0] for x in got(semi, k, "id")} == hit and {x[0] for x in got(anti, k, "id")} == {x[1] for x in rows if x[0] == k} - hit
        assert sorted((x.id, x.h) for x in inside.collect() if x.rec == k and x.h is not None) == sorted((i, j) for rec, i, s, _ in rows for rec2, j, p, q in other if rec == rec2 == k and p <= s < q)


def test_segments_are_not_joined_again(spark):
    a = spark.createDataFrame([(0, 0, 0, 10)], "rec int, id int, st long, en long")
    b = spark.createDataFrame([(0, 2, 5, "x"), (0, 5, 7, "x"), (0, 6, 7, "y"), (0, 8, 8, "z")], "rec int, st long, en long, why string")
    got = sorted((x.st, x.en, x.reasons) for x in I.segment_with_reasons(a, b, KEYS, "id", "why").collect())
    assert got == [(0, 2, []), (2, 5, ["x"]), (5, 6, ["x"]), (6, 7, ["x", "y"]), (7, 10, [])]


@pytest.mark.parametrize("seed", range(2))
def test_segments_against_brute_force_without_broadcast(spark, seed):
    r = Random(seed)
    rows, a = make(spark, r, 10)
    other, _ = make(spark, r, 10, keys=4)
    why = [r.choice(["x", "y", None]) for _ in other]
    other = [(*x[:1], *x[2:], y) for x, y in zip(other, why)]
    out = I.segment_with_reasons(a, spark.createDataFrame(other, "rec int, st long, en long, why string"), KEYS, "id", "why")
    want = []
    for k, i, s, e in rows:
        mine = [x for x in other if x[0] == k and x[1] < x[2]]
        cuts = sorted({s, e} | {c for x in mine for c in x[1:3] if s < c < e})
        want += [(k, i, p, q, sorted({x[3] for x in mine if x[1] < q and p < x[2] and x[3]})) for p, q in zip(cuts, cuts[1:])]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    # rows multiply unseen by Spark's estimate, so no side may be sent to the driver
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_nearest_prefers_the_earlier(spark):
    p = spark.createDataFrame([(0, 5), (0, 0), (0, 99), (1, 3)], "rec int, x long")
    t = spark.createDataFrame([(0, 3), (0, 7), (0, 50)], "rec int, q long")
    got = {(r.rec, r.x): r.n for r in I.nearest(p, t, KEYS, "x", "q", "n").collect()}
    assert got == {(0, 5): 3, (0, 0): 3, (0, 99): 50, (1, 3): None}


def test_touching_is_not_overlap(spark):
    df = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 3, 5), (0, 2, 6, 8), (0, 3, 7, 9)], "rec int, id int, st long, en long")
    assert sorted((r.st, r.en) for r in I.merge_touching(df, KEYS).collect()) == [(0, 5), (6, 8), (7, 9)]
    assert [r.id for r in I.overlap_violations(df, KEYS).collect()] == [3]
