"""The aligners against exhaustive search over all monotone matchings and covers."""

from itertools import combinations
from random import Random

from spanloom.functions import text as X
from spanloom.operators import sequences as S

WORDS = "there their them theme word words wore a the thing think one two phone fone reach reached é".split()


def brute_align(a, b):
    pairs = [(i, j, s) for i, x in enumerate(a) for j, y in enumerate(b) if X.fuzzy_accepted(x, y, s := X.fuzzy_score(x, y))]
    best = ()
    key = lambda t: (len(t), round(sum(x[2] for x in t), 6), sum(x[2] >= 0.999999 for x in t), tuple(-x[0] for x in t), tuple(x[1] for x in t))
    for n in range(len(pairs) + 1):
        for t in combinations(pairs, n):
            if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(t, t[1:])):
                best = max(best, t, key=key)
    return list(best)


def brute_ground(c, s):
    """Best total over all covers, by plain recursion."""

    def rec(i, j):
        if (i, j) == (len(c), len(s)):
            return 0.0
        got = []
        if i and j < len(s) and i < len(c):
            got.append((rec(i, j + 1), -0.35))
        for a in (1, 2):
            for b in (1, 2):
                if i + a <= len(c) and j + b <= len(s):
                    like = X.group_similarity(c[i : i + a], s[j : j + b])
                    if like is not None:
                        got.append((rec(i + a, j + b), like * a - 0.04 * abs(a - b)))
        return max((x + y for x, y in got if x is not None), default=None)

    return rec(0, 0) if c and s else None


def test_align_words_against_all_matchings():
    r = Random(1)
    for _ in range(250):
        a, b = r.choices(WORDS, k=r.randint(0, 5)), r.choices(WORDS, k=r.randint(0, 5))
        if sum(X.fuzzy_accepted(x, y, X.fuzzy_score(x, y)) for x in a for y in b) <= 12:
            assert S.align_words(a, b) == brute_align(a, b), (a, b)


def test_ground_against_all_covers():
    r = Random(2)
    hits = 0
    for _ in range(400):
        c = r.choices(WORDS, k=r.randint(0, 5))
        s = [y for x in c for y in [x] * r.choice([1, 1, 2]) + r.choices(WORDS, k=r.random() < 0.2)]
        s = s if r.random() < 0.8 else r.choices(WORDS, k=4)
        got, want = S.ground(c, s), brute_ground(c, s)
        assert (got is None) == (want is None), (c, s)
        if got:
            skipped = len(s) - sum(q - p for _, _, p, q, _ in got)
            total = sum(like * (k - i) - 0.04 * abs((k - i) - (q - p)) for i, k, p, q, like in got) - 0.35 * skipped
            assert abs(total - want) < 1e-9 and got[0][:1] == (0,) and got[-1][1] == len(c)
            hits += 1
    assert hits > 150


def test_long_texts():
    """Whole long turns are aligned, in time that follows the matches."""
    r = Random(3)
    a = ["".join(r.choices("abcdefghijklm", k=6)) for _ in range(1500)]
    kept = [i for i in range(1500) if r.random() < 0.9]
    got = S.align_words(a, [a[i] for i in kept])
    assert [x[1] for x in got] == list(range(len(kept))) and sum(x[2] for x in got) == len(kept)
    c = [y for i, x in enumerate(a) for y in ([x, x] if i % 3 == 2 else [x])]
    got = S.ground(a, c)
    assert got is not None and got[-1][1] == len(a)
