import re

import numpy as np
import xxhash
from spanloom.llm import simhash as S


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = list(range(len(fps)))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in ids]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["Alpha", "beta", "ÉTÉ", "d x", "one", "two", "three", "four", "five"]
    base = [" ".join(rng.choice(vocab, 60)) for _ in range(15)]
    texts = [None, "", " \t\n", "A b", "a B", "a  b\x0bc d", *base, *base[:4]]
    for b in base:
        for _ in range(4):
            w = b.split(" ")
            w[int(rng.integers(60))] = "zz"
            texts.append(" ".join(w))
    texts.append("long " * 50_000)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)


def test_random_links_small_blocks(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = []
    for c in centre:
        for _ in range(30):
            x = int(c)
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (8, 4096):
        got = {r.node: r.root for r in S.components(S.links(df, block=block)).collect()}
        comp = brute_components(fps)
        groups = {}
        for x, c in zip(signed, comp):
            groups.setdefault(c, []).append(x)
        for g in groups.values():
            if len(g) > 1:
                assert {got.get(x, x) for x in g} == {min(g)}


def test_forced_thresholds(spark, monkeypatch):
    """Unequal thresholds with probes, on keys beside very common ones, against all pairs."""
    rng = np.random.default_rng(8)
    fps = set()
    for c in rng.integers(0, 2**63, 6, dtype=np.uint64):
        for _ in range(120):
            x = int(c)
            for b in rng.integers(0, 64, int(rng.integers(0, 7))):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    comp = brute_components(fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    order = rng.permutation(64).tolist()
    cut = lambda sizes: [sorted(order[sum(sizes[:i]) : sum(sizes[: i + 1])]) for i in range(len(sizes))]
    for sizes, ts in (([22, 22, 20], (1, 1, 0)), ([32, 32], (2, 1)), ([16, 16, 16, 16], (1, 0, 0, 0))):
        plan = list(zip(cut(sizes), ts))
        biggest = S.probes(df, plan).groupBy("part", "key").count().agg({"count": "max"}).first()[0]
        for block in (16, 4096):
            got = {r.node: r.root for r in S.components(S.links(df, block=block, plan=plan)).collect()}
            least = {}
            for x, c in zip(signed, comp):
                least[c] = min(least.get(c, x), x)
            assert all(got.get(x, x) == least[c] for x, c in zip(signed, comp)), (sizes, block)
        assert biggest > 16


def test_groups_are_dealt_by_all_their_rows(spark):
    """A key beside a common one takes its probes and is split like it."""
    rng = np.random.default_rng(2)
    fps = [(int(h) << 16) | 5 for h in rng.integers(0, 2**40, 500)] + [(int(h) << 16) | 4 for h in rng.integers(0, 2**40, 3)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    plan = [(list(range(16)), 1), (list(range(16, 40)), 1), (list(range(40, 64)), 0)]
    rows = S.probes(df, plan).where("part = 0").groupBy("key").agg({"*": "count"}).collect()
    assert {r.key: r[1] for r in rows}[5] == 503  # its own and the probes of key 4


def test_representatives(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(90)], 80)) for _ in range(3))
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (5, c, 3), (5, c, 3), (5, c, 4), (None, b, 5), (None, None, 6), (7, "", 7), (8, " \n", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _o int").withColumnRenamed("_o", "_O")
    got = sorted(((r.doc_id, r.text) for r in S.representatives(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (5, c), (7, "")], key=str)
    assert S.representatives(df).columns == df.columns and S.representatives(df.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (3, "one two"), (3, "one two"), (None, "three")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]


def test_path_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in S.components(df).collect()} == {0}


def test_thresholds_keep_every_link():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (100, 10**6, 10**10):
        plan = S.plan_index(sample, n)
        assert sorted(b for g, _ in plan for b in g)
        assert sum(t + 1 for _, t in plan) == S.MAX_BITS + 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
