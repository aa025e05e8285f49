"""Language identification by hierarchical discrimination.

A text's letters, lower-cased, give hashed character n-grams (one to three letters,
runs of anything else being one blank). A softmax model first predicts the language
family from their frequencies; within a family, one-versus-one linear support vector
machines separate the languages, by votes and then by margins.

The models learn from a bounded sample of ``SAMPLE`` labelled training rows, drawn by
hash and spread evenly over the languages, but of ``LEAST`` rows of each language at
least, so every lang value that training rows have is learned; training rows are those whose
crc32(doc_id as text) mod 4 is not 2 and whose lang is not null. Texts are read
whole, in training and in prediction.

The model holds one vector of ``DIM`` weights for each family and each pair of languages
in a family, and goes to every task.

A null text, or one without letters, gets ``und`` and score 0; so does every text when
there is nothing to learn from. Equal texts get equal predictions, ties
between languages go to the last by name; a null id counts as training, repeated rows count as often as they occur. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of, ids_of, small_batches

DIM = 1 << 13
SAMPLE = 2400
LEAST = 8
SEGMENT = 1 << 18
UND = "und"

#: Family of a language code; codes not listed share one family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi fo".split(),
    "romance": "fr es it pt ro ca gl oc la ast sc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "indic": "hi bn mr ne ur pa gu as or sa si".split(),
    "semitic": "ar he am mt ti".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "uralic": "fi et hu se".split(),
    "sinitic": "zh yue wuu".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], "other")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text, in segments that overlap by two letters; nothing without letters."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters()[cp]
    if not ok.any():
        return
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # one blank after each run of letters
    c = np.where(ok, cp, 32)[keep].astype(np.uint32)
    c = np.concatenate([np.array([32], np.uint32), c])
    shift = np.uint32(32 - 13)
    for k in range(0, len(c), SEGMENT):
        x = c[max(0, k - 2) : k + SEGMENT]
        new = k and min(2, k)
        one = (x[new:] * np.uint32(2654435761)) >> shift
        two = (x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> shift
        three = (x[:-2] * np.uint32(0x27D4EB2F) + x[1:-1] * np.uint32(0x165667B1) + x[2:] * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B) >> shift
        yield np.concatenate([one, two[max(0, new - 1) :], three])


def frequencies(text: str | None) -> np.ndarray | None:
    counts, n = np.zeros(DIM, np.float64), 0
    for g in grams(text):
        counts += np.bincount(g, minlength=DIM)
        n += len(g)
    return (counts / n).astype(np.float32) if n else None


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (features + 1, classes) by gradient descent with momentum, classes weighted alike."""
    w, v = np.zeros((x.shape[1], k), np.float32), np.float32(0)
    share = (1 / np.maximum(np.bincount(y, minlength=k), 1) / k).astype(np.float32)
    hot = np.eye(k, dtype=np.float32)[y]
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ ((p - hot) * share[y][:, None]) + np.float32(decay) * w
        v = np.float32(0.9) * v - np.float32(rate) * g
        w += v
    return w


def svm_fit(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Linear SVM of some rows with hinge loss by dual coordinate descent; y is -1 or 1. No row is copied."""
    r = np.random.default_rng(seed)
    w, a = np.zeros(x.shape[1], np.float32), np.zeros(len(y))
    q = np.einsum("ij,ij->i", x, x)[rows] + 1e-9
    top = c / np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    for _ in range(rounds):
        for i in r.permutation(len(y)).tolist():
            row = x[rows[i]]
            new = min(max(a[i] - (y[i] * float(row @ w) - 1) / q[i], 0), top[i])
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * row
                a[i] = new
    return w


class Model:
    """Weights for all n-grams, one column per linear model; scores are means over a text's n-grams."""

    def __init__(self, texts: list[str], langs: list[str]):
        # one matrix, filled and scaled in place: the driver has little memory
        x, seen = np.zeros((len(texts), DIM + 1), np.float32), []
        for t, lang in zip(texts, langs):
            f = frequencies(t)
            if f is not None:
                x[len(seen), :-1] = f
                seen.append(lang)
        x, y = x[: len(seen)], np.array(seen)
        self.langs = sorted(set(seen))
        self.families = sorted({family(y) for y in self.langs})
        self.members = {f: [y for y in self.langs if family(y) == f] for f in self.families}
        self.duels = [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        if not seen:
            return
        scale = 1 / np.sqrt(x[:, :-1].mean(axis=0) + 1e-5)
        x[:, :-1] *= scale
        x[:, -1] = 1
        cols = []
        kin = np.array([self.families.index(family(z)) for z in y])
        if len(self.families) > 1:
            cols += list(softmax_fit(x, kin, len(self.families)).T)
        for _, a, b in self.duels:
            rows = np.flatnonzero((y == a) | (y == b))
            cols.append(svm_fit(x, rows, np.where(y[rows] == a, 1, -1)))
        w = np.array(cols, np.float32).reshape(len(cols), x.shape[1]).T
        self.w, self.bias = np.ascontiguousarray(w[:-1] * scale[:, None]), w[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs:
            return UND, 0.0
        total, n = np.zeros(self.w.shape[1]), 0
        for g in grams(text):
            total += np.bincount(g, minlength=DIM).astype(np.float32) @ self.w if len(g) > DIM else self.w[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        if not n:
            return UND, 0.0
        s = total / n + self.bias
        k, score = 0, 1.0
        if len(self.families) > 1:
            z = np.exp(s[: len(self.families)] - s[: len(self.families)].max())
            k = int(z.argmax())
            score, s = float(z[k] / z.sum()), s[len(self.families) :]
        votes: dict[str, list[float]] = {m: [0, 0.0] for m in self.members[self.families[k]]}
        for (f, a, b), m in zip(self.duels, s.tolist()):
            if f == self.families[k]:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(sorted(votes), key=lambda v: tuple(votes[v]))
        for (f, a, b), m in zip(self.duels, s.tolist()):
            if best in (a, b):
                score *= 1 / (1 + np.exp(-4 * min(max(m if best == a else -m, -20), 20)))
        return best, float(min(max(score, 0.0), 1.0))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` labelled training rows, as many of each language."""
    mod = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(4))
    rows = docs.select("doc_id", "text", "lang").where((mod != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], [])
    share = max(LEAST, sample / len(counts))
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1_000_000)) / F.lit(1e6)
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, share / n))])
    some = rows.where(dice < F.coalesce(F.try_element_at(limit, F.col("lang")), F.lit(0.0))).toArrow().to_pandas()
    some = some.sort_values(["doc_id", "lang", "text"]).reset_index(drop=True)
    return Model(some["text"].tolist(), some["lang"].tolist())


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found, ids = [m.predict(t) for t in ids_of(b, "text")], ids_of(b)
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(crc_of(ids) % 4 == 2), lang, score], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose prediction is a language; no column is added or changed."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield b.filter(pa.array([m.predict(t)[0] != UND for t in ids_of(b, "text")], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
