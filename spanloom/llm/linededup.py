"""Line deduplication by pairwise alignment.

A line of few words is too common to point at another document, so lines are made rare:
each line opens, and each line closes, a block, the least run of lines around which
``MIN_WORDS`` words are reached (a long line is a block by itself; blank lines are passed
over). Documents overlap if they share a block's hash. Documents are ordered by id, and
every block leads from each document that holds it to the first one that does: a block
that any number of documents share gives each of them one partner for it, and copies are
never paired with one another.

Each pair is aligned by patience diff over the hashes of the blocks that it shares, which
gives the blocks that stand in the same order in both; what the diff leaves are blocks
that were moved. Both kinds are deleted from the later document, and their lines are
counted apart. So, exactly: a line goes if and only if it lies in a run of lines of
``MIN_WORDS`` words or more that also stands, blank lines aside, in an earlier document,
whichever that is. Shorter common runs, such as a licence line, stay. Blank lines behind
a deleted block go with it.

Null texts stay null and count as empty. Rows alike in id and text are one document,
and each keeps its row; rows of one id and different texts are ordered by a hash of the
text; rows without an id come last. Whole texts are read, whatever their length; a task
holds the blocks of one document at a time, and one row per block is shuffled. Extra
columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, ids_of, small_batches

MIN_WORDS = 30
#: An odd number; block hashes are sums of line hashes times its powers.
_BASE = 0x9E3779B97F4A7C15 | 1


def lis(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[int]:
    """Positions of ``a`` that patience diff aligns with equal items of ``b``; an item occurs once in each."""
    low, ah, bh = 0, len(a), len(b)
    while low < min(ah, bh) and a[low] == b[low]:
        low += 1
    while ah > low and bh > low and a[ah - 1] == b[bh - 1]:
        ah, bh = ah - 1, bh - 1
    place = {x: j for j, x in enumerate(b[low:bh])}
    anchors = [(i, place[a[i]]) for i in range(low, ah) if a[i] in place]
    inner = [anchors[k][0] for k in lis([j for _, j in anchors])]
    return [*range(low), *inner, *range(ah, len(a))]


def blocks(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first line, line after) of every block of a document's lines, in order; blank lines have no words."""
    live = np.flatnonzero(words)
    none = np.zeros(0, np.int64)
    if not len(live) or words.sum() < min_words:
        return none.view(np.uint64), none, none
    h, total = hashes[live].view(np.uint64), np.concatenate([[0], np.cumsum(words[live])])
    n = len(live)
    ends = np.searchsorted(total, total[:-1] + min_words)  # of the block that a line opens
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # of the block that a line closes
    opens, closes = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    spans = np.unique(np.concatenate([opens * (n + 1) + ends[opens], starts[closes] * (n + 1) + closes + 1]))
    a, z = spans // (n + 1), spans % (n + 1)
    up = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
    down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype=np.uint64)])
    key = (sums[z] - sums[a]) * down[a]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    # blank lines behind the block go with it, but for those at the text's end
    after = np.append(live[1:], live[-1] + 1)
    return key, live[a], after[z - 1]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def gone(hits: list[dict]) -> tuple[list[tuple[int, int]], int]:
    """Spans of lines to delete from one document, and how many of these lines only moved blocks hold.

    A hit is a block shared with a partner: ``owner``, the spans ``pos`` (a << 32 | z) in
    this document and the place ``at`` of the first one in the partner.
    """
    by_owner: dict = {}
    for x in hits:
        by_owner.setdefault(x["owner"], {})[(x["pos"][0], x["at"])] = x["pos"]
    every, aligned = [], []
    for shared in by_owner.values():
        a = sorted(shared)
        kept = set(patience([at for _, at in a], sorted(at for _, at in a)))
        for k, x in enumerate(a):
            pieces = [(p >> 32, p & 0xFFFFFFFF) for p in shared[x]]
            every += pieces
            if k in kept:
                aligned += pieces
    spans = union(every)
    return spans, sum(z - a for a, z in spans) - sum(z - a for a, z in union(aligned))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with deleted blocks taken out of ``text``, and three more columns.

    The second value names them: ``n_lines``, ``n_removed`` and ``n_moved`` of the lines
    before. A name that ``docs`` has already gets a number.
    """
    small_batches(docs.sparkSession)
    rid = F.xxhash64(F.col("doc_id"), F.col("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), rid.alias("rid"))
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    hashes = F.transform(split, lambda x: F.xxhash64(F.trim(x)))
    counts = F.transform(split, lambda x: F.when(F.trim(x) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(x), r"\s+"))))
    lines = docs.select(order.alias("o"), hashes.alias("hs"), counts.alias("ws"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ws = b.column(1), b.column(2)
            rows, keys, pos = [], [], []
            ha, wa, off = hs.flatten().to_numpy(), ws.flatten().to_numpy().astype(np.int64), hs.offsets.to_numpy()
            off = off - off[0]
            for i, (p, q) in enumerate(zip(off.tolist(), off[1:].tolist())):
                key, a, z = blocks(ha[p:q], wa[p:q], min_words)
                if not len(key):
                    continue
                spans = a << 32 | z
                uniq, first, count = np.unique(key, return_index=True, return_counts=True)
                each = np.split(spans[np.argsort(key, kind="stable")], np.cumsum(count)[:-1])
                rows += [i] * len(uniq)
                keys.append(uniq.view(np.int64))
                pos += each
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(0).take(pa.array(rows)), pa.array(pos, pa.list_(pa.int64()))], ["key", "o", "pos"])

    kind = lines.schema["o"].dataType.simpleString()
    found = cut(lines.mapInArrow(find, f"key long, o {kind}, pos array<long>"))
    least = found.groupBy("key").agg(F.min(F.struct("o", F.col("pos")[0].alias("at"))).alias("f"), F.max("o").alias("last")).where("last <> f.o")
    # cut, so that the join deals both sides anew and Spark can split a very common block
    least = cut(least.select("key", F.col("f.o").alias("owner"), F.col("f.at").alias("at")))
    hits = found.join(least, "key").where("o <> owner").select("o", "key", "owner", "pos", "at").dropDuplicates(["o", "key"])
    hits = hits.groupBy("o").agg(F.collect_list(F.struct(F.xxhash64("owner").alias("owner"), "pos", "at")).alias("hits"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())]))
        for b in batches:
            runs, removed, moved = [], [], []
            for hits in b.column(1):
                spans, m = gone(hits.as_py())
                edges = [0, *(x for s in spans for x in s), (1 << 31) - 2]
                runs.append([{"a": a + 1, "n": z - a} for a, z in zip(edges[::2], edges[1::2]) if z > a])
                removed.append(sum(z - a for a, z in spans))
                moved.append(m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, run), pa.array(removed, pa.int64()), pa.array(moved, pa.int64())], ["o", "runs", "removed", "moved"])

    cuts = cut(hits.mapInArrow(decide, f"o {kind}, runs array<struct<a: int, n: int>>, removed long, moved long"))
    names = {x: fresh(docs.columns, f"_{x}") for x in ("n_lines", "n_removed", "n_moved")}
    o, runs, removed, moved = (fresh(docs.columns, f"_{x}") for x in ("o", "runs", "removed", "moved"))
    joined = docs.withColumn(o, order).join(cuts.select(F.col("o").alias(o), F.col("runs").alias(runs), F.col("removed").alias(removed), F.col("moved").alias(moved)), o, "left")
    rest = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(F.split("text", "\n"), r["a"], r["n"]))), "\n")
    text = F.when(F.col(runs).isNull(), F.col("text")).otherwise(rest)
    out = joined.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns], F.size(split).cast("long").alias(names["n_lines"]), *[F.coalesce(x, F.lit(0)).cast("long").alias(names[n]) for n, x in (("n_removed", removed), ("n_moved", moved))])
    return out, names


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_moved) of every document."""
    out, names = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", *[F.col(x).alias(n) for n, x in names.items()])
