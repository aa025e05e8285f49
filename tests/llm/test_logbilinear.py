import math
import re
import zlib
from collections import Counter

import numpy as np
from spanloom.llm import logbilinear as L


def brute(rows):
    toks = {}
    for i, t in rows:
        s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        toks[i] = re.findall(r"[^\x20\x09-\x0D]+", s) + ["\n"]
    c = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks.items()}, n


def corpus():
    rng = np.random.default_rng(2)
    sets = [[f"{p}{s}{i}" for i in range(60) for s in ("Tion", "ing")] for p in ("aé", "Be", "co")]
    rows = []
    for i in range(300):
        words = sets[i % 3]
        rows.append((i, " ".join(rng.choice(words, 80, p=np.arange(1, 121) / sum(range(1, 121))))))
    return rows + [(300, None), (301, ""), (302, "  x\x0by"), (303, "rare words here " * 3), (304, "w " * 40000)]


def test_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(L, "N_FREQUENT", 200)
    monkeypatch.setattr(L, "N_WORDS", 60)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string").repartition(3)
    got = {r.doc_id: r for r in L.score(df).collect()}
    want, n = brute(rows)
    assert set(got) == set(want)
    for i, (tokens, known, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    t = L.Trainer(np.full(12, 1 / 12), dim=4)
    t.start(0)
    for _ in range(20):
        t.learn(*rng.integers(0, 12, (3, 200)))
    m = L.normalised(t.p)
    for u in range(12):
        for v in range(12):
            assert abs(np.exp(m["g1"][v].astype(float) + m["g2"][u] - m["log_z"][u, v]).sum() - 1) < 1e-4


def test_gradient_is_that_of_noise_contrastive_estimation(monkeypatch):
    """One step against a plain evaluation of the objective, by finite differences."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(L, "NOISE", 5)
    t = L.Trainer(rng.dirichlet(np.ones(7)), dim=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    u, v, w = rng.integers(0, 7, (3, 9))
    t.start(3)
    z = np.minimum(np.searchsorted(t.cum, np.random.default_rng(3).random(5)), 6)
    sigma = lambda x: 1 / (1 + np.exp(-x))

    def loss(p):
        h = p["R"][v] @ p["C1"] + p["R"][u] @ p["C2"]
        q, b = p["Q"][:, :-1], p["Q"][:, -1]
        pos = (h * q[w]).sum(axis=1) + b[w] - t.log_noise[w]
        neg = h @ q[z].T + b[z] - t.log_noise[z]
        return -(np.log(sigma(pos)).sum() + np.log(1 - sigma(neg)).sum()) / len(w)

    seen = {}
    t.step = lambda k, rows, grad: seen.__setitem__(k, grad if rows is None else np.array([grad[rows == i].sum(axis=0) for i in range(7)]))
    t.learn(u, v, w)
    for k in t.KEYS:
        for at in np.ndindex(t.p[k].shape):
            p = {x: y.copy() for x, y in t.p.items()}
            p[k][at] += 1e-5
            up = loss(p)
            p[k][at] -= 2e-5
            assert abs((up - loss(p)) / 2e-5 - seen[k][at]) < 1e-5, (k, at)


def test_a_band_wider_than_the_frequent_words(spark, monkeypatch):
    """Words that all occur once, more than go to every task: the end mark keeps its count."""
    monkeypatch.setattr(L, "N_FREQUENT", 50)
    rows = [(2, " ".join(f"w{i}" for i in range(300)))]
    r = L.score(spark.createDataFrame(rows, "doc_id long, text string")).first()
    want, n = brute(rows)
    tokens, known, base = want[2]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and abs(r.base_score - base) < 1e-6 * abs(base)


def test_every_training_token_is_learnt_from(spark, monkeypatch):
    """The slices of an epoch are all training documents, each once."""
    assert [x for low, high in L.SLICES for x in range(low, high)] == list(range(16))
    seen = []
    whole = L.averaged
    monkeypatch.setattr(L, "averaged", lambda pieces: seen.append(pieces.where("piece = 0").agg({"n": "sum"}).first()[0] or 0) or whole(pieces))
    monkeypatch.setattr(L, "LEAST_TOKENS", 1)
    rows = corpus()
    L.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum(seen) == brute(rows)[1]


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other"), (None, "a")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in L.score(df).collect())
    assert got == [(0, 2), (1, 2), (1, 4), (1, 4)]
    assert L.score(df.limit(0)).count() == 0


def test_classes_of_whole_texts_are_those_of_their_words():
    """Pieces, white space, white-space-like bytes and very long words, against a step for each word."""
    texts = [b"", b" A\tb\x0bC\r\n\x00x \x1cy \xc3\x89t\xc3\xa9\xc2\xa0z  " + b"q" * 300_000 + b" " + b"z" * 600_000, b"\x00abc abc a ab Abcd xAbcd", b"a b c " * 60_000, b"end"]
    named = [L.END, b"abc", b"a", b"q" * 300_000]
    look = L.Classer(L.keys_of(named), np.arange(4), 4)
    rare: list = []
    cls, place = look.texts(texts, rare)
    words = [w for t in texts for w in [*t.lower().split(), L.END]]
    assert cls.tolist() == [named.index(w) if w in named else 4 + L.tail_class(w) for w in words]
    assert place.tolist() == [named.index(w) if w in named else -1 for w in words]
    assert rare == [w for w in words if w not in named]
    u, v, w = L.triples(cls, 0)
    want = []
    for t in texts:
        own = [named.index(x) if x in named else 4 + L.tail_class(x) for x in [*t.lower().split(), L.END]]
        want += zip([0, 0, *own], [0, *own], own)
    assert list(zip(u.tolist(), v.tolist(), w.tolist())) == want
