from collections import defaultdict
from random import Random

import numpy as np
import pytest
from spanloom.llm import mixing as M


def test_solve_and_fill():
    r = np.random.default_rng(0)
    row = np.sort(r.integers(0, 20, 200))
    tokens, rest = r.integers(1, 50, 200).astype(float), r.random(200) + 0.01
    have = np.bincount(row, tokens, 20)
    goal = have * r.random(20)
    f = M.solve(goal, row, tokens, rest)
    assert np.allclose(np.bincount(row, tokens * np.minimum(1, f[row] * rest), 20), goal)
    f = M.solve(have, row, tokens, rest)
    assert np.allclose(np.bincount(row, tokens * np.minimum(1, f[row] * rest), 20), have)
    got = M.filled(np.array([10.0, 100, 300]), np.array([0.4, 0.3, 0.3]), 200)
    assert np.allclose(got, [10, 95, 95]) and np.allclose(M.filled(np.array([5.0, 5]), np.array([1.0, 1]), 4), [2, 2])


def frame(spark, n=1200):
    r = Random(3)
    rows = []
    for i in range(n):
        src = "hot" if r.random() < 0.4 else f"s{r.randint(0, 4)}"
        rows.append((i, " ".join(r.choices(["alphaword", "betaword", "gammaword", "x"], k=r.randint(1, 30))), r.choice(["en", "fr", None]), src, "c"))
    rows += [(n, None, "en", "hot", "c"), (n + 1, "", None, None, "c"), (5, "again", "en", "hot", "c"), (None, "no id", "en", "s1", "c"), (n + 2, "w " * 400, "fr", "s2", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, prob string").repartition(3), rows


def expected(rows, got):
    """Expected tokens of the sample by axis and value, in plain Python."""
    prob = {}
    for x in got:
        prob[x.doc_id, x.n_tokens, x.topic] = x.prob
    out = {a: defaultdict(float) for a in M.AXES}
    for i, t, lang, src, *_ in rows:
        n, topic = len((t or "").split()), M.topic_of((t or "").encode())
        for a, v in (("source", src), ("lang", lang), ("topic", topic)):
            out[a][M.name_of(v)] += n * prob[i, n, topic]
    return out


def test_expected_sample_meets_its_targets(spark):
    df, rows = frame(spark)
    cells = {(r.source, r.lang, r.topic): (r.n_tokens, r.n_docs) for r in M.cells_of(df).collect()}
    want = {}
    for _, t, lang, src, _ in rows:
        k = (M.name_of(src), M.name_of(lang), M.topic_of((t or "").encode()))
        a, b = want.get(k, (0, 0))
        want[k] = (a + len((t or "").split()), b + 1)
    assert cells == want
    p = M.plan(df, rate=0.7)
    assert p.residual <= 10 * M.CLOSE
    got = M.weigh(df, p).collect()
    assert len(got) == len(rows) and all(r.sampled == (M.draw(r.doc_id) < r.prob) for r in got)
    share = expected(rows, got)
    total = sum(a for a, _ in cells.values())
    assert abs(sum(share["lang"].values()) / total - 0.7) < 1e-5
    for k, axis in enumerate(M.AXES):
        have = defaultdict(float)
        for key, (n, _) in cells.items():
            have[key[k]] += n
        names = sorted(have)
        mass = np.array([have[x] for x in names])
        goal = M.filled(mass, (mass / total) ** M.POWER * (mass > 0), 0.7 * total)
        assert np.allclose([share[axis][x] for x in names], goal, rtol=1e-4, atol=1e-6), axis
    kept = M.weigh(df, p, keep=True)
    assert kept.count() == sum(r.sampled for r in got)
    assert kept.columns == ["doc_id", "text", "lang", "source", "prob", "mix_topic", "n_tokens", "weight", "prob_1"]
    assert all(x.prob == "c" for x in kept.limit(5).collect())


def test_given_targets_and_topic(spark):
    df, rows = frame(spark, 400)
    df = df.where("length(text) < 1000").selectExpr("*", "cast(doc_id % 3 as string) topic")
    p = M.plan(df, {"lang": {"en": 0.5, "fr": 0.3, M.NULL: 0.2}, "source": {"hot": 0.3, **{f"s{i}": 0.14 for i in range(5)}}}, 0.4)
    got = M.weigh(df, p).join(df.select("doc_id", "lang", "source", "text"), "doc_id").where("n_tokens = size(split(trim(text), ' '))").collect()
    n = sum(x.n_tokens * x.prob for x in got)
    by = lambda a, v: sum(x.n_tokens * x.prob for x in got if x[a] == v) / n
    assert abs(by("lang", "en") - 0.5) < 0.01 and abs(by("source", "hot") - 0.3) < 0.01 and {x.topic for x in got} <= {"0", "1", "2", None}


def test_any_number_of_sources(spark):
    """Each of very many sources has a target of its own."""
    r = Random(6)
    rows = [(i, "word " * r.randint(1, 40), r.choice("ab"), f"site{int(3000 * r.random() ** 2)}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = M.plan(df)
    prob = {x.doc_id: x.prob for x in M.weigh(df, p).collect()}
    have, share = defaultdict(float), defaultdict(float)
    for i, t, _, s in rows:
        have[s] += t.count(" ")
        share[s] += t.count(" ") * prob[i]
    names = sorted(have)
    mass = np.array([have[x] for x in names])
    goal = M.filled(mass, (mass / mass.sum()) ** M.POWER, M.RATE * mass.sum())
    assert len(names) > 2000 and np.allclose([share[x] for x in names], goal, rtol=1e-3)


def test_contradicting_targets_are_told(spark):
    df = spark.createDataFrame([(i, "a b c", "en" if i % 2 else "fr", "x" if i % 2 else "y") for i in range(40)], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="contradict"):
        p = M.plan(df, {"lang": {"en": 0.9, "fr": 0.1}, "source": {"x": 0.1, "y": 0.9}}, 0.2)
    assert p.residual > 0.01 and M.weigh(df, p).count() == 40


def test_draws_are_even_and_empty_table(spark):
    u = np.array([M.draw(i) for i in range(20_000)])
    assert np.abs(np.histogram(u, 10, (0, 1))[0] - 2000).max() < 250
    df, _ = frame(spark, 3)
    assert M.weigh(df.limit(0)).count() == 0 and M.weigh(df.limit(0), keep=True).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {x.prob for x in M.weigh(blank).collect()} == {1.0}
    part = blank.unionByName(spark.createDataFrame([(3, "some words", "en", "t")], blank.schema))
    assert all(0 <= x.prob <= 1 for x in M.weigh(part).collect())


def test_passes_are_dealt_by_cells_not_by_shuffle_partitions(spark, monkeypatch):
    df, _ = frame(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few = M.plan(df)
        monkeypatch.setattr(M, "TASK_CELLS", 8)
        many = M.plan(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert few.sources.rdd.getNumPartitions() == 1 < many.sources.rdd.getNumPartitions() < 40
    f, g = ({r.source: r.f for r in p.sources.collect()} for p in (few, many))
    assert f.keys() == g.keys() and all(np.isclose(f[k], g[k]) for k in f)
