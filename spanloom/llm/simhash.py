"""Near-duplicate grouping by 64-bit SimHash and a generalised pigeonhole index.

Every text becomes one fingerprint: words are folded to ASCII lower case, each
run of four words is hashed by XXH64, and a bit is set where more than half of
the shingle hashes have it. Two fingerprints link at ``max_bits`` or fewer
differing bits; documents are grouped by the connected components.

The index splits the 64 bits into partitions of correlated bits and gives each
partition its own threshold t_i with sum(t_i) = max_bits - m + 1. By the general
pigeonhole principle any linked pair differs by at most t_i bits in at least one
partition, so probing all keys within t_i loses no link. Partitions, their sizes
and thresholds come from a dynamic programme on candidate counts that are
estimated from a bounded sample of fingerprints, scaled to their full number.

Rows of one key, its own and those that probe it, may be many, so a key is dealt into
blocks by both and the pairs of blocks are verified as separate groups; a group emits
only a spanning forest of its links, which leaves the components as they are. Of two
fingerprints whose keys differ, only the one with the lesser key probes.

Null and empty texts have fingerprint zero and link like any other. Texts are read
whole, whatever their length. Repeated rows, ties and extra columns of any name do not
matter; a null id is never a component's least id, unless it has no other. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, ids_of, small_batches, texts_of

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints from which candidate counts are estimated.
SAMPLE = 4096
#: Rows of one key that one group verifies against as many others.
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text; zero if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = memoryview(b" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """(key, fp): fp is the fingerprint of ``text`` as a signed long; ``key`` is any column."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [key, "fp"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


# --- the index -----------------------------------------------------------------


def bit_order(bits: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Group correlated bits: grow each partition by the bit most correlated with it."""
    n = bits.shape[1]
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    corr = np.abs(centred.T @ centred) / np.outer(norm, norm)
    np.fill_diagonal(corr, 0)
    left, out = set(range(n)), []
    for size in sizes:
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def balls(width: int, t: int) -> np.ndarray:
    """All masks over ``width`` bits with at most ``t`` bits set, zero first."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def key_of(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 with sum ``total`` and least cost; cost[i][t + 1]. -1 leaves a partition out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, x in enumerate(row):
                s = used + k - 1
                if s not in nxt or c + x < nxt[s][0]:
                    nxt[s] = (c + x, [*ts, k - 1])
        best = nxt
    return best[total][1]


def plan_index(sample: np.ndarray, n: int, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated work for ``n`` fingerprints."""
    sample = np.unique(sample)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    choices = []
    for sizes in ([22, 22, 20], [16, 16, 16, 16], [13, 13, 13, 13, 12], [32, 32]):
        groups = bit_order(bits, sizes) if len(sample) > 1 else [list(range(sum(sizes[:i]), sum(sizes[: i + 1]))) for i in range(len(sizes))]
        cost = []
        for g in groups:
            keys = key_of(sample, g)
            few = np.random.default_rng(7).permutation(keys)[:512]
            near = np.bitwise_count(keys[:, None] ^ few[None, :])
            pairs = max(1, near.size - len(few))
            row = [0.0]
            for t in range(max_bits + 1):
                probes = float(len(balls(len(g), t))) if t <= 2 else 1e9
                uniform = probes / 2.0 ** len(g)
                share = max(uniform, (float((near <= t).sum()) - len(few)) / pairs)
                row.append(n * probes + 0.02 * n * share * n)
            cost.append(row)
        total = max_bits - len(sizes) + 1
        ts = allocate(cost, total)
        choices.append((sum(c[t + 1] for c, t in zip(cost, ts)), list(zip(groups, ts))))
    return [(g, t) for g, t in min(choices, key=lambda x: x[0])[1] if t >= 0]


class Forest:
    """Union-find over positions that records the links it needed."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def verified(left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of fingerprints (uint64)."""
    both = np.concatenate([left, right])
    uniq, at = np.unique(both, return_inverse=True)
    l, r = np.unique(at[: len(left)]), np.unique(at[len(left) :])
    forest = Forest(len(uniq))
    for k in range(0, len(l), 256):
        part = l[k : k + 256]
        d = np.bitwise_count(uniq[part][:, None] ^ uniq[r][None, :])
        i, j = np.nonzero(d <= max_bits)
        for a, b in zip(part[i].tolist(), r[j].tolist()):
            if a != b:
                forest.link(a, b)
    return [(int(uniq[a]), int(uniq[b])) for a, b in forest.links]


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, probe): one row to be found for each partition, and one for each greater key to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "key", "fp", "probe"]
        masks = [balls(len(g), t)[1:] for g, t in plan]
        for b in batches:
            fp = np.array(ids_of(b, "fp"), np.int64)
            for p, (bits, _) in enumerate(plan):
                key = key_of(fp.view(np.uint64), bits)
                # keys at distance 0 meet as index rows; of two that differ the lesser one looks the other up
                ks, fs = [key], [fp]
                for m in masks[p].tolist():
                    up = (key ^ m) > key
                    ks.append(key[up] ^ m)
                    fs.append(fp[up])
                ks, fs = np.concatenate(ks), np.concatenate(fs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ks), p, np.int32)), pa.array(ks), pa.array(fs), pa.array(np.arange(len(ks)) >= len(fp))], names)

    return fps.select("fp").mapInArrow(run, "part int, key long, fp long, probe boolean")


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, sample: int = SAMPLE, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect every component.

    ``plan`` sets partitions (lists of bits) and thresholds, with sum(t + 1) = max_bits + 1; else they are estimated.
    """
    n = fps.count()
    few = fps.orderBy(F.xxhash64("fp")).limit(sample).toArrow().column("fp").to_numpy().astype(np.int64)
    if not len(few):
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    plan = plan or plan_index(few.view(np.uint64), n, max_bits)
    rows = probes(fps, plan)
    # Every row of a key counts, so that a key beside a common one, which takes all its probes, is dealt too.
    heavy = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("own")).where((F.col("n") > block) & (F.col("own") > 0))
    heavy = cut(heavy.select("part", "key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("nb")))
    light = rows.join(heavy, ["part", "key"], "left_anti").select("part", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "probe", F.lit(0).alias("blk"))
    # Large keys are dealt in blocks, and each pair of blocks is a group of its own.
    own = rows.join(heavy, ["part", "key"]).withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    pairs = F.expr("explode(transform(sequence(0, nb - 1), i -> struct(least(blk, i) AS x, greatest(blk, i) AS y)))")
    dealt = own.select("part", "key", pairs.alias("g"), "fp", "probe", "blk").select("part", "key", "g.x", "g.y", "fp", "probe", "blk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches):
            yield from grouped_links(*cols, max_bits)

    spread = light.unionByName(dealt).repartition("part", "key", "x", "y").sortWithinPartitions("part", "key", "x", "y")
    return spread.mapInArrow(run, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows in pieces that end where a (part, key, x, y) ends."""
    held: list[pa.RecordBatch] = []
    want = rows

    def joined() -> list[np.ndarray]:
        t = pa.Table.from_batches(held)
        return [c.to_numpy() for c in t.columns]

    for b in batches:
        held.append(b)
        size = sum(x.num_rows for x in held)
        if size >= want:
            want = 2 * size  # a group that goes on is not joined anew with every batch
            cols = joined()
            new = group_starts(cols)
            if len(new) > 1:
                yield [c[: new[-1]] for c in cols]
                held = [pa.Table.from_batches(held).slice(int(new[-1])).combine_chunks().to_batches()[0]]
                want = rows + held[0].num_rows
    if held:
        yield joined()


def group_starts(cols: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols[:4]:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def grouped_links(part, key, x, y, fp, probe, blk, max_bits: int, small: int = 4096) -> Iterator[pa.RecordBatch]:
    """Verified links of every group; a spanning forest of them where a group is large."""
    fp, own = fp.astype(np.int64).view(np.uint64), ~probe.astype(bool)
    if not len(fp):
        return
    starts = group_starts([part, key, x, y])
    sizes = np.diff(np.append(starts, len(fp)))
    owns = np.add.reduceat(own.astype(np.int64), starts)
    some = (owns > 0) & (sizes > 1)
    tiny = some & (owns * sizes <= small) & (x[starts] == y[starts])
    out_a, out_b = [], []
    group = np.repeat(np.arange(len(starts)), sizes)
    i = np.nonzero(own & tiny[group])[0]
    for k in range(0, len(i), 4096):
        part_i = i[k : k + 4096]
        g = group[part_i]
        many = sizes[g]
        left = np.repeat(part_i, many)
        right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[g], many)
        ok = (np.bitwise_count(fp[left] ^ fp[right]) <= max_bits) & (fp[left] != fp[right])
        out_a.append(fp[left[ok]])
        out_b.append(fp[right[ok]])
    for g in np.nonzero(some & ~tiny)[0].tolist():
        s = slice(starts[g], starts[g] + sizes[g])
        f, o, b, p, q = fp[s], own[s], blk[s], int(x[s.start]), int(y[s.start])
        found = verified(f[o & (b == p)], f[b == q], max_bits)
        if p != q:
            found += verified(f[o & (b == q)], f[b == p], max_bits)
        out_a.append(np.array([u for u, _ in found], np.uint64))
        out_b.append(np.array([v for _, v in found], np.uint64))
    if out_a:
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; root is the least node of its component.

    Alternating large-star and small-star steps, until nothing changes; each is one
    shuffle of the links and shortens all paths. No component is ever held by one task: a
    star's centre is found by a partial aggregate, cut, and joined back, so that Spark
    can split the rows of a hub.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    while True:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = cut(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r")))
        large = cut(both.join(low, "n").where("m > n").select(F.col("r").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: every node points at its least neighbour, and its other smaller neighbours do too
        low2 = cut(large.groupBy("v").agg(F.min("u").alias("r")))
        small = large.join(low2, "v").select("r", "u", "v")
        e = cut(small.select(F.col("r").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct())
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and e.groupBy("v").count().where("count > 1").isEmpty():
            return e.select(F.col("v").alias("node"), F.col("u").alias("root"))


def classes_of(fp: DataFrame, key: str, max_bits: int = MAX_BITS, plan: list | None = None) -> DataFrame:
    """(fp, least): the least ``key`` of each fingerprint's component, cut so that very common fingerprints can be split."""
    distinct = cut(fp.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(links(distinct, max_bits, plan=plan))
    reps = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(reps.groupBy("root").agg(F.min("first").alias("least")))
    return cut(reps.join(least, "root").select("fp", "least"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    fp = cut(fingerprints(docs, shingle))
    classes = classes_of(fp, "doc_id", max_bits)
    return fp.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def representatives(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: least id, null ids last, ties by a hash of the text.

    Rows are told apart by id and text, so a repeated id takes no other text with it; of
    rows alike in both, one stays.
    """
    o = fresh(docs.columns, "_o")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("hash"))
    fp = cut(fingerprints(docs.select(order.alias("o"), "text"), shingle, "o"))
    rows = cut(fp.groupBy("o", "fp").agg(F.count("*").alias("n")))
    marked = rows.join(classes_of(fp, "o", max_bits), "fp")
    # what to do with a row: rows not listed stay
    others = cut(marked.where("o <> least or n > 1").select(F.col("o").alias(o), (F.col("o") == F.col("least")).alias("first")))
    mark = fresh([*docs.columns, o], "_first")
    joined = docs.withColumn(o, order).join(others.withColumnRenamed("first", mark), o, "left")
    out = joined.where(F.col(mark).isNull())
    if not others.where("first").isEmpty():
        out = out.unionByName(joined.where(F.col(mark)).dropDuplicates([o]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
