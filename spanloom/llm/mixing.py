"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic over all documents. Raking scales the
cells of that table until its three marginals meet their targets, and it does so under
the condition that no document can be drawn more than once: a cell's probability is
min(1, f(source) g(language) h(topic)), and the factors are fitted so that the *expected
sample* has the target marginals and ``RATE`` of all tokens. Documents are then drawn with
these calibrated probabilities; a draw is a hash of the id, the same in every run.

Targets are shares of tokens. Where none are given they are the observed shares raised
to ``POWER`` and normalised, which lifts rare sources, languages and topics. A value
cannot give more tokens than it has: where its target asks for more, it gives all it has
and the other values share the rest in proportion. A value that is missing from given
targets has target zero. The topic of a text, if the table has no ``topic`` column, is one
of ``TOPICS`` classes of its longer words by hash: the one that its distinct words prefer.

Any number of sources has targets of its own: the cells stay distributed, one row per
source. In each pass every source solves its own factor exactly, given the factors of the
languages and topics, and the pass returns the marginals of these; languages and topics
are label sets, whose factors the driver holds and scales by what is missing, speeded up
by Anderson's mixing. Passes go on until all marginals are met within ``CLOSE``; where
targets contradict each other they end after ``PASSES``, and what is then left is in
``Plan.residual`` and is told as a warning.

A null source, language or topic is a value of its own. Empty and null texts have no
tokens and follow their cell's probability; a source without any token has factor
``rate``. Rows of one id share their draw; repeated rows count as often as they occur.
Texts are read whole. Columns of the input stay, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, ids_of, small_batches, texts_of

RATE = 0.8
POWER = 0.7
TOPICS = 8
#: Greatest relative error of a marginal, and of a source's own target.
CLOSE = 1e-6
#: Passes after which contradicting targets are given up.
PASSES = 60
#: Cells that a task of a pass has at least, so that a pass costs what its cells do, however many partitions shuffles have.
TASK_CELLS = 50_000
#: Factor of a language or topic that is drawn whole.
WHOLE = 1e9
#: Bytes of the sources' factors up to which they are sent to every task instead of being joined by a shuffle.
SENT = 8 << 20
AXES = ("source", "lang", "topic")
NULL = "\x00null"


def topic_of(text: bytes) -> str:
    """The class that most distinct words of five or more bytes fall into; ties go to the lower one."""
    votes = np.zeros(TOPICS, np.int64)
    for w in set(text.lower().split()):
        if len(w) >= 5:
            votes[zlib.crc32(w) % TOPICS] += 1
    return f"t{int(votes.argmax())}"


def name_of(value) -> str:
    return NULL if value is None else str(value)


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, n_tokens, n_docs), counted over all documents."""
    small_batches(docs.sparkSession)
    given = "topic" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list[int]] = {}
        for b in batches:
            texts = texts_of(b)
            topics = ids_of(b, "topic") if given else map(topic_of, texts)
            for t, *key in zip(texts, ids_of(b, "source"), ids_of(b, "lang"), topics):
                held = total.setdefault(tuple(map(name_of, key)), [0, 0])
                held[0] += len(t.split())
                held[1] += 1
            if len(total) > 50_000:
                yield out(total)
                total.clear()
        yield out(total)

    def out(total: dict) -> pa.RecordBatch:
        keys = list(zip(*total)) or [[], [], []]
        nums = list(zip(*total.values())) or [[], []]
        return pa.RecordBatch.from_arrays([*[pa.array(k, pa.string()) for k in keys], *[pa.array(n, pa.int64()) for n in nums]], [*AXES, "n_tokens", "n_docs"])

    cols = ["source", "lang", *(["topic"] if given else []), "text"]
    part = docs.select(*cols).mapInArrow(run, "source string, lang string, topic string, n_tokens long, n_docs long")
    return part.groupBy(*AXES).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"))


def filled(have: np.ndarray, want: np.ndarray, total: float) -> np.ndarray:
    """``want`` scaled to ``total``, with no value above what it has: the rest is shared in proportion."""
    full = np.zeros(len(have), bool)
    while True:
        free = want[~full].sum()
        scale = (total - have[full].sum()) / free if free > 0 else 0.0
        more = ~full & (want * scale > have)
        if not more.any():
            return np.where(full, have, want * scale)
        full |= more


def source_goals(sources: DataFrame, targets: dict[str, float] | None, total: float, rate: float) -> DataFrame:
    """``sources`` with the tokens that each is to give (``goal``): ``filled`` in distributed passes."""
    if targets is None:
        wanted = sources.withColumn("want", F.when(F.col("have") > 0, F.pow(F.col("have") / F.lit(total), F.lit(POWER))).otherwise(0.0))
    else:
        given = sources.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, want double")
        wanted = sources.join(given, "source", "left").fillna(0.0, ["want"])
    wanted = cut(wanted)
    scale, n = 0.0, -1
    while True:
        full = F.col("want") * F.lit(scale) > F.col("have")
        r = wanted.agg(F.sum(F.when(full, F.col("have")).otherwise(0)).alias("own"), F.sum(F.when(full, 0.0).otherwise(F.col("want"))).alias("free"), F.sum(full.cast("int")).alias("n")).first()
        if r.n == n:
            return wanted.withColumn("goal", F.when(full, F.col("have").cast("double")).otherwise(F.col("want") * F.lit(scale))).drop("want")
        n, scale = r.n, max(0.0, rate * total - r.own) / r.free if r.free else 0.0


def solve(goal: np.ndarray, row: np.ndarray, tokens: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Factor f of each row with sum(tokens * min(1, f * rest)) = goal, by bisection of its logarithm."""
    n = len(goal)
    some = rest > 0
    least, most = np.full(n, np.inf), np.zeros(n)
    np.minimum.at(least, row[some], rest[some])
    np.maximum.at(most, row[some], rest[some])
    ok = (most > 0) & (goal > 0)
    top = np.where(ok, -np.log(np.where(ok, least, 1.0)), 0.0)  # here every cell gives all it has
    low = np.where(ok, -np.log(np.where(ok, most, 1.0)), 0.0) - 60.0
    for _ in range(70):
        mid = (low + top) / 2
        got = np.bincount(row, tokens * np.minimum(1.0, np.exp(mid)[row] * rest), n)
        under = got < goal
        low, top = np.where(under, mid, low), np.where(under, top, mid)
    return np.where(ok, np.exp(top), 0.0)


class Mixer:
    """Anderson's mixing of fixed-point steps: the next point from the last few points and their steps."""

    def __init__(self, depth: int = 6):
        self.depth, self.past, self.best = depth, [], (np.inf, None, None)

    def next(self, x: np.ndarray, step: np.ndarray) -> np.ndarray:
        size = float(np.abs(step).max())
        if size > 2 * self.best[0]:  # the mix went astray: half a plain step from the best point
            self.past = []
            x, step = self.best[1], self.best[2] / 2
            self.best = (self.best[0], x, step)
        elif size < self.best[0]:
            self.best = (size, x, step)
        self.past = [*self.past, (x, step)][-self.depth :]
        if len(self.past) == 1:
            return x + step
        dx, ds = (np.diff(np.array(v), axis=0).T for v in zip(*self.past))
        gamma = np.linalg.lstsq(ds, step, rcond=1e-8)[0]
        return x + step - (dx + ds) @ gamma


@dataclass
class Plan:
    """Factors of every value, the goals in tokens, and how well they are met."""

    sources: DataFrame  # (source, f, goal, have)
    factors: dict[str, dict[str, float]]  # of lang and topic
    goals: dict[str, dict[str, float]]
    total: float
    rate: float
    residual: float
    passes: int


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(goal, row, lang, topic, tokens) of sources with their cells."""
    sizes = np.diff(b.column("l").offsets.to_numpy())
    flat = [b.column(c).flatten().to_numpy() for c in ("l", "t", "n")]
    return b.column("goal").to_numpy(), np.repeat(np.arange(b.num_rows), sizes), *flat


def plan(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> Plan:
    """Fit the factors to the targets; see the module."""
    spark = docs.sparkSession
    targets = targets or {}
    cells = cut(cells_of(docs))
    sums = {a: cells.groupBy(a).agg(F.sum("n_tokens").alias("m"), F.count("*").alias("n")).orderBy(a).collect() for a in ("lang", "topic")}
    labels = {a: {r[a]: float(r.m) for r in rows} for a, rows in sums.items()}
    tasks = max(1, -(-sum(r.n for r in sums["lang"]) // TASK_CELLS))
    total = float(sum(labels["lang"].values()))
    if not total or rate >= 1:
        ones = cells.select("source").distinct().select("source", F.lit(1.0).alias("f"), F.lit(0.0).alias("goal"), F.lit(0.0).alias("have"))
        return Plan(cut(ones), {a: dict.fromkeys(v, 1.0) for a, v in labels.items()}, {}, total, rate, 0.0, 0)
    names, goal, factor, whole = {}, {}, {}, {}
    for a, mass in labels.items():
        names[a], have = list(mass), np.array(list(mass.values()))
        want = (have / total) ** POWER * (have > 0) if a not in targets else np.array([float(targets[a].get(x, 0.0)) for x in mass])
        goal[a] = filled(have, want, rate * total)
        # a value that gives all it has is drawn whole
        whole[a] = (goal[a] > 0) & (goal[a] >= have * (1 - 1e-12))
        factor[a] = np.where(whole[a], WHOLE, np.where(goal[a] > 0, 1.0, 0.0))
    for a in names:
        index = spark.createDataFrame(list(zip(names[a], range(len(names[a])))), f"{a} string, {a}_at int")
        cells = cells.join(index, a)
    rows = cells.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.collect_list("lang_at").alias("l"), F.collect_list("topic_at").alias("t"), F.collect_list("n_tokens").alias("n"))
    sources = cut(source_goals(rows, targets.get("source"), total, rate).coalesce(tasks))

    def marginals() -> tuple[dict[str, np.ndarray], float]:
        """Expected tokens by language and topic, and the greatest error of a source, each source having its best factor."""
        g, h = factor["lang"], factor["topic"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lang, topic, worst = np.zeros(len(g)), np.zeros(len(h)), 0.0
            for b in batches:
                want, row, l, t, n = unpacked(b)
                rest = g[l] * h[t]
                p = n * np.minimum(1.0, solve(want, row, n, rest)[row] * rest)
                lang, topic = lang + np.bincount(l, p, len(g)), topic + np.bincount(t, p, len(h))
                off = np.abs(np.bincount(row, p, len(want)) - want) / np.maximum(want, 1e-9)
                worst = max(worst, float(off[want > 0].max(initial=0.0)))
            yield pa.RecordBatch.from_arrays([*(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (lang, topic)), pa.array([worst])], ["lang", "topic", "worst"])

        got = sources.select("goal", "l", "t", "n").mapInArrow(run, "lang array<double>, topic array<double>, worst double").toArrow().to_pydict()
        return {a: np.sum(got[a], axis=0) for a in factor}, max(got["worst"])

    live = {a: (goal[a] > 0) & ~whole[a] for a in factor}
    residual, passes, fit_to = np.inf, 0, Mixer()
    while passes < PASSES:
        have, worst = marginals()
        passes += 1
        step = np.concatenate([np.log(goal[a][live[a]] / np.maximum(have[a][live[a]], 1e-300)) for a in factor])
        residual = max(worst, float(np.abs(np.expm1(step)).max(initial=0.0)))
        if residual <= CLOSE or not len(step):
            break
        x = fit_to.next(np.concatenate([np.log(factor[a][live[a]]) for a in factor]), np.clip(step, -5, 5))
        for a, part in zip(factor, np.split(x, [int(live["lang"].sum())])):
            # the sources' factors take up the scale
            factor[a][live[a]] = np.exp(np.maximum(part - part.max(), -60.0)) if len(part) else 1.0
    if residual > 10 * CLOSE:
        warnings.warn(f"targets contradict each other: a marginal is off by {residual:.2g} of itself after {passes} passes", stacklevel=2)
    # a neutral scale for sources without tokens
    scale = {a: float((np.array(list(labels[a].values())) * np.minimum(factor[a], 1.0)).sum() / total) or 1.0 for a in factor}
    g, h = factor["lang"] / scale["lang"], factor["topic"] / scale["topic"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, row, l, t, n = unpacked(b)
            have = np.bincount(row, n, len(want))
            f = np.where(have > 0, solve(want, row, n, g[l] * h[t]), rate)
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array(f), b.column("goal"), pa.array(have.astype(np.float64))], ["source", "f", "goal", "have"])

    fitted = cut(sources.select("source", "goal", "l", "t", "n").mapInArrow(fit, "source string, f double, goal double, have double"))
    return Plan(fitted, {"lang": dict(zip(names["lang"], g.tolist())), "topic": dict(zip(names["topic"], h.tolist()))}, {a: dict(zip(names[a], goal[a].tolist())) for a in goal}, total, rate, residual, passes)


def draw(doc_id) -> float:
    """A uniform number of [0, 1) from the id."""
    z = (zlib.crc32(str(doc_id).encode()) << 32 | zlib.crc32(f"{doc_id}/mix".encode())) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    z = (z ^ z >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (z ^ z >> 29) % (1 << 53) / (1 << 53)


def weigh(docs: DataFrame, p: Plan | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, topic, n_tokens, weight, prob, sampled) of every document, or with ``keep`` the drawn documents whole.

    Kept documents have all their columns and topic, n_tokens, weight and prob besides; a
    name that is taken gets a number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    p = p or plan(docs)
    held = spark.sparkContext.broadcast(p.factors)
    given = "topic" in docs.columns
    if not keep:
        docs = docs.select("doc_id", "source", "lang", *(["topic"] if given else []), "text")
    mine = {}
    for name in ("mix_topic", "n_tokens", "rest", "draw", "key", "weight", "prob", "sampled", "f"):
        mine[name] = fresh([*docs.columns, *mine.values()], name)
    kinds = {"mix_topic": T.StringType(), "n_tokens": T.LongType(), "rest": T.DoubleType(), "draw": T.DoubleType(), "key": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = held.value["lang"], held.value["topic"]
        for b in batches:
            ids, texts = ids_of(b), texts_of(b)
            topics = ids_of(b, "topic") if given else [topic_of(t) for t in texts]
            rest = [g.get(name_of(x), 0.0) * h.get(name_of(t), 0.0) for x, t in zip(ids_of(b, "lang"), topics)]
            cols = [[None if t is None else str(t) for t in topics], [len(t.split()) for t in texts], rest, [draw(i) for i in ids], [name_of(x) for x in ids_of(b, "source")]]
            cols = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *(mine[k] for k in kinds)])

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(mine[k], t) for k, t in kinds.items()]]))
    factors = p.sources.select(F.col("source").alias(mine["key"]), F.col("f").alias(mine["f"]))
    size = p.sources.agg(F.sum(F.length("source") + 64).alias("b")).first().b or 0
    rows = rows.join(F.broadcast(factors) if size <= SENT else factors, mine["key"], "left")
    weight = F.coalesce(mine["f"], F.lit(0.0)) * F.col(mine["rest"])
    rows = rows.withColumn(mine["weight"], weight).withColumn(mine["prob"], F.least(F.lit(1.0), F.col(mine["weight"]))).withColumn(mine["sampled"], F.col(mine["draw"]) < F.col(mine["prob"]))
    if keep:
        return rows.where(mine["sampled"]).select(*[F.col(f"`{c}`") for c in docs.columns], *[mine[k] for k in ("mix_topic", "n_tokens", "weight", "prob")])
    return rows.select("doc_id", F.col(mine["mix_topic"]).alias("topic"), "n_tokens", "weight", "prob", "sampled")
