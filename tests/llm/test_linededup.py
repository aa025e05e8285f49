from random import Random

import numpy as np
from spanloom.llm import linededup as D


def brute(rows, min_words):
    """Every pair of documents: lines in a common run of min_words words or more go from the later one."""
    docs = {i: [(k, x.strip(" ")) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")] for i, t in rows}
    out = {}
    for i, t in rows:
        a, hit = docs[i], set()
        for j in docs:
            if j >= i:
                continue
            b = docs[j]
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p][1] != b[q][1] or p and q and a[p - 1][1] == b[q - 1][1]:
                        continue
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n][1] == b[q + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in a[p : p + n]) >= min_words:
                        hit |= set(range(p, p + n))
        lines = (t or "").split("\n")
        dead = set()
        for p in hit:
            end = a[p + 1][0] if p + 1 < len(a) else a[p][0] + 1
            dead |= set(range(a[p][0], end))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in dead)
    return out


def texts(df):
    return {x.doc_id: x.text for x in D.report(df).collect()}


def test_longest_chain():
    r = Random(1)
    for _ in range(200):
        v = r.sample(range(30), r.randint(0, 12))
        got = [v[i] for i in D.lis(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        assert got == sorted(got) and len(got) == max(best, default=0)


def test_patience_is_a_longest_common_subsequence_of_unique_items():
    assert D.patience(list("abcdefg"), list("xbcdyfg")) == [1, 2, 3, 5, 6]
    assert D.patience([], [1]) == [] and D.patience(list("ab"), list("ba")) in ([0], [1])
    r = Random(4)
    for _ in range(300):
        a, b = r.sample(range(12), r.randint(0, 9)), r.sample(range(12), r.randint(0, 9))
        at = D.patience(a, b)
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        rest = iter(b)
        assert len(at) == size[-1][-1] and at == sorted(at) and all(a[i] in rest for i in at)


def test_blocks_cover_every_common_run():
    r = Random(7)
    for _ in range(200):
        words = np.array([r.choice([0, 1, 5, 12, 29, 30, 31, 60]) for _ in range(r.randint(0, 9))], np.int64)
        key, a, z = D.blocks(np.arange(len(words), dtype=np.int64) + 5, words)
        live = [i for i in range(len(words)) if words[i]]
        assert all(words[p:q].sum() >= 30 for p, q in zip(a, z)) and len(set(key.tolist())) == len(key)
        for s in range(len(live)):
            for e in range(s, len(live)):
                if words[live[s] : live[e] + 1].sum() >= 30:  # any run of enough words is covered by blocks inside it
                    inside = {k for p, q in zip(a, z) if p >= live[s] and max(i for i in live if i < q) <= live[e] for k in range(p, q)}
                    assert {i for i in live[s : e + 1]} <= inside


def test_against_all_pairs(spark):
    r = Random(9)
    pool = [" ".join(r.choices("alpha beta gamma delta eps zeta".split(), k=r.randint(3, 25))) + f" {i}" for i in range(40)]
    rows = []
    for i in range(90):
        k = r.randint(0, 30)
        lines = pool[k : k + r.randint(1, 8)] if r.random() < 0.6 else r.sample(pool, r.randint(1, 6))
        lines = [x if r.random() < 0.9 else f"own {i} {x}" for x in lines]
        if r.random() < 0.3:
            lines.insert(r.randint(0, len(lines)), "")
        if r.random() < 0.2:
            lines = lines[::-1] + lines[:2]
        rows.append((i, "\n".join(lines)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, ""), (93, None), (94, "\n\n"), (95, "long line " * 20_000), (96, "long line " * 20_000), (97, "line of its own, again\n" * 3000), (98, "line of its own, again\n" * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int").repartition(4)
    got = {x.doc_id: x for x in D.report(df).collect()}
    want = brute(rows[:97], D.MIN_WORDS)
    for i, t in rows[:97]:
        assert (got[i].text or "") == want[i], i
    assert got[93].text is None and got[90].text == want[90] and got[98].text == "" and got[97].text == rows[97][1]
    assert sum(x.n_removed > 0 for x in got.values()) > 20


def test_links_that_miss_a_first_holder(spark):
    a, b = "a " * 20 + "x", "b " * 20 + "y"
    df = spark.createDataFrame([(1, f"{b}\n{a}"), (2, f"{a}\n{b}"), (3, f"{a}\n{b}")], "doc_id long, text string")
    assert texts(df) == {1: f"{b}\n{a}", 2: f"{a}\n{b}", 3: ""}  # documents 2 and 3 share a block that 1 lacks
    df = spark.createDataFrame([(1, f"{a}\nown"), (2, f"{b}\nother"), (3, f"{a}\n{b}")], "doc_id long, text string")
    assert texts(df)[3] == f"{a}\n{b}"  # no pair shares a long enough block


def test_moved_blocks(spark):
    a, b, c = ("a " * 40).strip(), ("b " * 50).strip(), ("c " * 60).strip()
    df = spark.createDataFrame([(1, f"{a}\n{b}\n{c}"), (2, f"{c}\nown\n{a}\n{b}\nend")], "doc_id long, text string")
    got = {x.doc_id: x for x in D.report(df).collect()}
    assert (got[2].text, got[2].n_removed, got[2].n_moved, got[1].n_removed) == ("own\nend", 3, 1, 0)


def test_cases(spark):
    passage = "a passage of words " * 12
    rows = [(1, passage), (1, passage), (2, "own\n" + passage + "\nend"), (None, passage), (3, "All rights reserved."), (4, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 99, x.text) for x in D.report(df).collect())
    assert got == [(1, passage), (1, passage), (2, "own\nend"), (3, "All rights reserved."), (4, "All rights reserved."), (99, "")]
    assert D.report(df.limit(0)).count() == 0
    x = "word " * 60
    rows = [(1, f"a\n{x}\nb\n{x}\nc"), (2, f"p\n{x}\nq"), (3, f"r\n{x}\ns")]
    assert texts(spark.createDataFrame(rows, "doc_id long, text string")) == {1: rows[0][1], 2: "p\nq", 3: "r\ns"}


def test_clashing_names(spark):
    passage = "a passage of words " * 12
    names = ["_n_removed", "_runs", "_o", "o", "rid", "key", "hits", "a.b", "_N_LINES"]
    rows = [(i, f"own {i}\n" + passage, *range(9)) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out, new = D.dedup(df)
    assert out.columns == [*df.columns, *new.values()] and len({c.lower() for c in out.columns}) == len(out.columns)
    got = {r[0]: r for r in out.collect()}
    assert [*got[1]][2:] == [*range(9), 2, 1, 0] and got[1][1] == "own 1"
