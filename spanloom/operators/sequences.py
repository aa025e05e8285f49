"""Alignment of token sequences, and decoding of framed character scores.

The aligners are dynamic programmes over one recording's short sequences; they run in
Arrow-batched functions, filled row by row instead of by recursion, so a long sequence
needs no deep stack.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X


def shared_grams(a: DataFrame, b: DataFrame, a_id: str, b_id: str, tokens: str, n: int = 5) -> DataFrame:
    """(a_id, b_id, a_pos, b_pos, gram) of every run of ``n`` tokens that both have: any row means a common run of n or more."""

    def grams(df: DataFrame, ident: str, at: str) -> DataFrame:
        size = F.size(tokens)
        starts = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
        rows = df.select(ident, tokens, F.explode(starts).alias(at))
        return rows.select(ident, at, F.array_join(F.slice(tokens, F.col(at) + 1, F.lit(n)), " ").alias("gram"))

    return grams(a, a_id, "a_pos").join(grams(b, b_id, "b_pos"), "gram")


@lru_cache(maxsize=200_000)
def _fuzzy(a: str, b: str) -> float | None:
    """Score of two words that may be matched, else null."""
    s = X.fuzzy_score(a, b)
    return s if X.fuzzy_accepted(a, b, s) else None


@lru_cache(maxsize=200_000)
def _alike(a: str, b: str, language: str) -> float | None:
    return X.group_similarity([a], [b], language)


@lru_cache(maxsize=100_000)
def _letters(word: str) -> tuple[str, np.ndarray]:
    """The spelled word and its letters' counts, in classes."""
    spelled = "".join(X.spelled(word))
    return spelled, np.bincount([ord(c) % 32 for c in spelled], minlength=32)


def _matches(expected: tuple[str, ...], observed: tuple[str, ...]) -> list[list[tuple[int, float]]]:
    """For each expected word the observed places that it may match, with scores.

    Two words have at least 0.68 of their letters in common, place apart, or they are not
    alike; only pairs that pass this bound are compared.
    """
    ea, eb = sorted(set(expected)), sorted(set(observed))
    ca, cb = (np.array([_letters(w)[1] for w in e]) for e in (ea, eb))
    la, lb = ca.sum(axis=1), cb.sum(axis=1)
    found: dict[str, dict[str, float]] = {}
    lot = max(1, (1 << 16) // len(eb))
    for k in range(0, len(ea), lot):
        common = np.minimum(ca[k : k + lot, None, :], cb[None]).sum(axis=2)
        for i, j in zip(*np.nonzero(2 * common >= 0.67 * (la[k : k + lot, None] + lb[None]))):
            s = _fuzzy(ea[k + i], eb[j])
            if s is not None:
                found.setdefault(ea[k + i], {})[eb[j]] = s
    return [[(j, s) for j, w in enumerate(observed) if (s := held.get(w)) is not None] if (held := found.get(x)) else [] for x in expected]


def _before(a: tuple, b: tuple) -> bool:
    """Whether chain ``a`` is better than ``b``: (matches, likeness, exact ones, first match with what follows)."""
    if a[0] != b[0]:
        return a[0] > b[0]
    x, y = (round(a[1], 6), a[2]), (round(b[1], 6), b[2])
    if x != y:
        return x > y
    p, q, later = a[3], b[3], 0
    while p is not q:
        if p[0] != q[0]:
            return p[0] < q[0]
        later = later or p[1] - q[1]
        p, q = p[3], q[3]
    return later > 0


def align_words(expected: list[str], observed: list[str]) -> list[tuple[int, int, float]]:
    """As ``_aligned``; the last few results are kept for those who ask again."""
    return list(_aligned(tuple(expected), tuple(observed)))


@lru_cache(maxsize=8)
def _aligned(expected: tuple[str, ...], observed: tuple[str, ...]) -> tuple[tuple[int, int, float], ...]:
    """Monotone fuzzy matches: most of them, then most alike, most exact, earliest expected, latest observed.

    A cell of the table holds its best chain's figures and a link to its first match, so
    the work is that of the cells that a match changes.
    """
    if not expected or not observed:
        return ()
    row = [(0, 0.0, 0, None)] * (len(observed) + 1)
    places = _matches(expected, observed)
    for i in range(len(expected) - 1, -1, -1):
        here = places[i]
        if not here:
            continue
        below, at, carry = row[:], len(here) - 1, None
        j = here[-1][0]
        while j >= 0:
            best = below[j]
            if carry is not None and _before(carry, best):
                best = carry
            if at >= 0 and here[at][0] == j:
                s, rest = here[at][1], below[j + 1]
                chain = (rest[0] + 1, rest[1] + s, rest[2] + (s >= 0.999999), (i, j, s, rest[3]))
                if _before(chain, best):
                    best = chain
                at -= 1
            carry = best if best is not below[j] else None
            row[j] = best
            if carry is None:  # nothing changes before the next match
                if at < 0:
                    break
                j = here[at][0]
            else:
                j -= 1
    out, node = [], row[0][3]
    while node is not None:
        out.append(node[:3])
        node = node[3]
    return tuple(out)


ALIGNED = "array<struct<expected_index: int, expected_word: string, observed_index: int, observed_word: string, score: double>>"


def align_udf():
    """Arrow UDF (array<string>, array<string>) -> matches."""

    @F.pandas_udf(ALIGNED)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"expected_index": i, "expected_word": x[i], "observed_index": j, "observed_word": y[j], "score": round(s, 6)} for i, j, s in align_words([*x], [*y])] for x, y in zip(a, b)])

    return run


def ground(canonical: list[str], source: list[str], language: str = "en") -> list[tuple[int, int, int, int, float]] | None:
    """Best monotone cover of canonical tokens by source tokens in groups of one or two; null if there is none.

    Both ends are anchored: the first source token can't be skipped, later ones can at
    -0.35 each; groups of unlike sizes cost 0.04. Equal scores keep the option met first:
    a skip, then smaller canonical groups, then smaller source groups. Only source places
    that a cover can have before each canonical token, the earliest to the latest, are
    gone through.
    """
    n, m = len(canonical), len(source)
    if not n or not m:
        return None
    sizes = [(a, b) for a in (1, 2) for b in (1, 2)]

    def like(i: int, a: int, j: int, b: int) -> float | None:
        return _alike(canonical[i] if a == 1 else canonical[i] + canonical[i + 1], source[j] if b == 1 else source[j] + source[j + 1], language)

    last = [-1] * n + [m]  # latest place before canonical token i from which the rest can be covered
    for i in range(n - 1, -1, -1):
        for a, b in sizes:
            if i + a > n or last[i + a] < b:
                continue
            for j in (m - b,) if i + a == n else range(last[i + a] - b, last[i], -1):
                if j > last[i] and like(i, a, j, b) is not None:
                    last[i] = j
                    break
    first = [0] + [m + 1] * n  # earliest place after canonical token i - 1
    for i in range(1, n + 1):
        for a, b in sizes:
            if i < a or first[i - a] > m:
                continue
            for j in (0,) if i == a else range(first[i - a], min(first[i], m + 1) - b):
                if j + b <= m and like(i - a, a, j, b) is not None:
                    first[i] = min(first[i], j + b)
                    break
    best: dict[tuple[int, int], tuple[float, tuple | None, tuple[int, int] | None]] = {(n, m): (0.0, None, None)}
    for i in range(n - 1, -1, -1):
        for j in range(min(last[i], m - 1), first[i] - 1, -1):
            found = None
            if i > 0 and (i, j + 1) in best:
                found = (best[i, j + 1][0] - 0.35, None, (i, j + 1))
            for a, b in sizes:
                if i + a > n or j + b > m or (i + a, j + b) not in best:
                    continue
                s = like(i, a, j, b)
                if s is None:
                    continue
                total = best[i + a, j + b][0] + s * a - 0.04 * abs(a - b)
                if found is None or total > found[0]:
                    found = (total, (i, i + a, j, j + b, s), (i + a, j + b))
            if found:
                best[i, j] = found
    if (0, 0) not in best:
        return None
    out, at = [], (0, 0)
    while at != (n, m):
        _, group, at = best[at]
        if group:
            out.append(group)
    return out


def unsupported(canonical: list[str], source: list[str], language: str = "en") -> str | None:
    """The first canonical token that no next source token or pair supports, scanning forward."""
    at = 0
    for k, token in enumerate(canonical):
        starts = range(at, min(at + 1, len(source)) if k == 0 else len(source))
        hit = next((s + c for s in starts for c in (1, 2) if s + c <= len(source) and X.group_similarity([token], source[s : s + c], language) is not None), None)
        if hit is None:
            return token
        at = hit
    return None


GROUNDED = "struct<supported: boolean, groups: int, similarity: double, skipped: int, first_unsupported: string>"


def ground_udf(language: str = "en"):
    """Arrow UDF (canonical, source) -> how the canonical tokens are supported."""

    @F.pandas_udf(GROUNDED)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = [*x], [*y]
            g = ground(x, y, language)
            rows.append((g is not None, len(g or []), round(sum(s[4] for s in g or []), 6), len(y) - sum(s[3] - s[2] for s in g) if g else 0, None if g else unsupported(x, y, language) or (x[-1] if x else "")))
        return pd.DataFrame(rows, columns=["supported", "groups", "similarity", "skipped", "first_unsupported"])

    return run


def insertions(expected: list[str], words: list[dict], longest: int = 6) -> list[dict]:
    """Runs of up to ``longest`` unmatched observed words between strong matches that re-spell the words after them.

    A run counts when, aligned again with the expected words from the right anchor on,
    it matches from their start with mean likeness 0.78 or more, each word's own score is
    0.40 or more with a mean of 0.45, and it lasts five seconds or less.
    """
    matches = align_words(expected, [w["word"] for w in words])
    out, last = [], -1.0
    for (ei, oi, s), (ej, oj, t) in zip(matches, matches[1:]):
        gap = words[oi + 1 : oj]
        if not 1 <= len(gap) <= longest or min(s, t) < 0.90:
            continue
        again = align_words(expected[ej : ej + len(gap)], [w["word"] for w in gap])
        if len(again) != len(gap) or not again:
            continue
        like, own = sum(x[2] for x in again) / len(again), [w["score"] for w in gap]
        if like >= 0.78 and min(own) >= 0.40 and sum(own) / len(own) >= 0.45 and gap[-1]["end"] - gap[0]["start"] <= 5 and gap[0]["start"] >= last:
            out.append({"text": " ".join(w["word"] for w in gap), "start": gap[0]["start"], "end": gap[-1]["end"], "left": expected[ei], "right": expected[ej], "confidence": round(like, 6)})
            last = gap[-1]["end"]
    return out


def substitutions(expected: list[str], words: list[dict], longest: int = 2) -> list[dict]:
    """Equal-count gaps of one or two words between exact anchors, observed clearly (score 0.75 or more), that repeat no neighbour."""
    matches = align_words(expected, [w["word"] for w in words])
    out = []
    for (ei, oi, s), (ej, oj, t) in zip(matches, matches[1:]):
        want, got = expected[ei + 1 : ej], words[oi + 1 : oj]
        if not 1 <= len(want) == len(got) <= longest or min(s, t) < 0.90 or any(w["score"] < 0.75 for w in got):
            continue
        near = {expected[ei], expected[ej], *want}
        if not near & {w["word"] for w in got}:
            out += [{"expected": x, "observed": w["word"], "start": w["start"], "end": w["end"]} for x, w in zip(want, got)]
    return out


def relabel(expected: list[str], words: list[dict], longest: int = 3) -> list[dict]:
    """Observed words with their expected spelling where matched, or in equal-count gaps between exact anchors with scores of 0.65 or more."""
    matches = align_words(expected, [w["word"] for w in words])
    put = {j: (expected[i], s) for i, j, s in matches}
    for (ei, oi, s), (ej, oj, t) in zip(matches, matches[1:]):
        n = ej - ei - 1
        if 1 <= n == oj - oi - 1 <= longest and min(s, t) >= 0.999999 and all(words[oi + 1 + k]["score"] >= 0.65 for k in range(n)):
            put |= {oi + 1 + k: (expected[ei + 1 + k], None) for k in range(n)}
    return [w | {"word": put[k][0] if k in put else w["word"], "observed": w["word"], "source": "match" if k in put and put[k][1] is not None else "gap" if k in put else "observed"} for k, w in enumerate(words)]


def ctc_words(frames: DataFrame, keys: list[str], index: str, label: str, prob: str, blank: str = "<pad>", separators: tuple[str, ...] = ("|", " ", "<space>")) -> DataFrame:
    """Words of a greedy character decoding: equal neighbours collapse, blanks and special labels go, separators split.

    Input: one row per frame with its best label and that label's probability. Output:
    (keys, word_no, word, st, en, score, min_score, n_chars), st and en in frames.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.when(F.col(label) == F.lag(label).over(w), 0).otherwise(1)
    runs = frames.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "_run").agg(F.first(label).alias("_label"), F.min(index).alias("st"), (F.max(index) + 1).alias("en"), F.avg(prob).alias("_score"))
    r = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)
    split = F.lower("_label").isin(*separators)
    marked = runs.withColumn("_word", F.sum(split.cast("int")).over(r))
    chars = marked.where(~split & (F.col("_label") != blank) & ~F.col("_label").rlike(r"^[<\[]") & (F.col("_label") != ""))
    words = chars.groupBy(*keys, "_word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_run", F.lower("_label").alias("c")))), lambda x: x["c"]), "").alias("word"), F.min("st").alias("st"), F.max("en").alias("en"), F.avg("_score").alias("score"), F.min("_score").alias("min_score"), F.count("*").alias("n_chars"))
    return words.withColumn("word_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_word")) - 1).drop("_word")


def split_long(frames: DataFrame, runs: DataFrame, keys: list[str], index: str, level: str, longest: int, least: int) -> DataFrame:
    """Runs of more than ``longest`` frames split at their quietest frame near each target, one after the other."""
    gathered = runs.where(F.col("en") - F.col("st") > longest)
    inside = gathered.join(frames.select(*keys, index, level), keys).where(f"{index} >= st and {index} < en")
    levels = inside.groupBy(*keys, "st", "en").agg(F.transform(F.array_sort(F.collect_list(F.struct(index, level))), lambda x: x[level]).alias("levels"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                at, end = int(r.st), int(r.en)
                while end - at > longest:
                    goal = at + longest
                    lo, hi = max(at + least, goal - longest // 3), min(end - least, goal + longest // 3)
                    near = list(r.levels[lo - r.st : hi - r.st])
                    to = lo + near.index(min(near)) if near else goal
                    rows.append((*[getattr(r, k) for k in keys], at, to))
                    at = to
                if end > at:
                    rows.append((*[getattr(r, k) for k in keys], at, end))
            yield pd.DataFrame(rows, columns=[*keys, "st", "en"])

    kind = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)
    short = runs.where(F.col("en") - F.col("st") <= longest).select(*keys, "st", "en")
    return short.unionByName(levels.mapInPandas(cut, f"{kind}, st long, en long"))
