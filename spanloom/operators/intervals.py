"""Half-open interval algebra on DataFrames.

An interval table has key columns (a recording, usually) and BIGINT bounds ``st`` and
``en``. Every window is partitioned by the keys, so recordings are processed apart and a
chain of operators over one key shares its sort. Empty intervals (st >= en) overlap
nothing and are dropped where a rule could see them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bin of range joins, in the coordinates' unit: about a long interval's length.
BIN = 600_000_000


def _order(keys: list[str], *by: str):
    return Window.partitionBy(*keys).orderBy(*by)


# --- union, complement, difference ---------------------------------------------------


def merge_overlapping(df: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Union of overlapping or touching intervals; ``extra`` are aggregates over each union's members."""
    w = _order(keys, "st", "en")
    reach = F.max("en").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where("st < en").withColumn("_new", F.when(F.col("st") > reach, 1).otherwise(F.when(reach.isNull(), 1).otherwise(0)))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("st").alias("st"), F.max("en").alias("en"), *(extra or [])).drop("_island")


def merge_touching(df: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Union of intervals that touch exactly; overlaps are not joined (see ``overlap_violations``)."""
    w = _order(keys, "st", "en")
    marked = df.withColumn("_new", F.when(F.col("st") == F.lag("en").over(w), 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("st").alias("st"), F.max("en").alias("en"), *(extra or [])).drop("_island")


def overlap_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that start before the row before them ends."""
    w = _order(keys, "st", "en")
    return df.withColumn("prev_en", F.lag("en").over(w)).where("st < prev_en")


def complement(merged: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """What of each key's [lo, hi) in ``bounds`` no merged interval covers; a key without intervals is all gap."""
    edges = merged.join(bounds, keys).select(*keys, F.greatest("st", "lo").alias("st"), F.least("en", "hi").alias("en")).where("st < en")
    ends = bounds.select(*keys, F.col("hi").alias("st"), F.col("hi").alias("en"))
    starts = bounds.select(*keys, F.col("lo").alias("st"), F.col("lo").alias("en"))
    w = _order(keys, "st", "en")
    return edges.unionByName(starts).unionByName(ends).select(*keys, F.lag("en").over(w).alias("g_st"), F.col("st").alias("g_en")).where("g_st < g_en").select(*keys, F.col("g_st").alias("st"), F.col("g_en").alias("en"))


def pieces(a: DataFrame, b: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """``a`` cut at every edge of ``b`` inside it: (keys, ident, st, en), in order and never re-joined."""
    a = a.where("st < en")
    hit = overlap_join(a.select(*keys, ident, "st", "en"), b.select(*keys, "st", "en"), keys)
    cuts = hit.select(*keys, ident, F.explode(F.array("o_st", "o_en")).alias("c"))
    own = a.select(*keys, ident, F.explode(F.array("st", "en")).alias("c"))
    w = _order([*keys, ident], "c")
    return cuts.unionByName(own).distinct().select(*keys, ident, F.col("c").alias("st"), F.lead("c").over(w).alias("en")).where("en is not null")


def subtract(a: DataFrame, b: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """A minus B per interval of A: what remains, in order, with A's identity."""
    union = merge_overlapping(b, keys)
    return anti_overlap(pieces(a, union, keys, ident), union, keys)


def segment_with_reasons(a: DataFrame, b: DataFrame, keys: list[str], ident: str, reason: str) -> DataFrame:
    """A cut at every edge of B, each piece with the sorted distinct reasons that cover it (empty: a candidate).

    B's edges number the stretches between them, 0 being what lies before the first. One
    ordered stream per key tells the stretches that a row of A touches and those that a
    reason covers; they meet by number, so each row of the join is one row of the result.
    That join is a merge join, as Spark's estimate doesn't see how rows multiply.
    """
    a, b = a.where("st < en"), b.where("st < en").dropna(subset=keys)
    place = lambda at, kind, n: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), F.lit(n).alias("n"))
    # at equal places A's ends come first and its starts last: an edge there doesn't cut it
    theirs = b.select(*keys, F.lit(None).cast(a.schema[ident].dataType).alias(ident), F.lit(None).cast("long").alias("st"), F.lit(None).cast("long").alias("en"), F.col(reason).alias("_reason"), F.inline(F.array(place("st", 1, 1), place("en", 1, -1))))
    ours = a.select(*keys, ident, "st", "en", F.lit(None).cast(b.schema[reason].dataType).alias("_reason"), F.inline(F.array(place("en", 0, 0), place("st", 2, 0))))
    w = _order(keys, "at", "kind")
    again = (F.lag("kind").over(w) == 1) & (F.lag("at").over(w) == F.col("at"))
    new = F.when((F.col("kind") == 1) & ~F.coalesce(again, F.lit(False)), 1).otherwise(0)
    stream = theirs.unionByName(ours).withColumn("_new", new).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = stream.where("kind = 1")
    by_reason = _order([*keys, "_reason"], "_k")
    held = edges.where("_reason is not null").groupBy(*keys, "_reason", "_k").agg(F.sum("n").alias("n"))
    held = held.withColumn("_open", F.sum("n").over(by_reason.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_to", F.lead("_k").over(by_reason)).where("_open > 0")
    held = held.select(*keys, F.explode(F.sequence(F.col("_k"), F.col("_to") - 1)).alias("_k"), F.lit(None).cast("long").alias("at"), "_reason")
    stretches = edges.select(*keys, "_k", "at", F.lit(None).cast(b.schema[reason].dataType).alias("_reason")).unionByName(held)
    stretches = stretches.groupBy(*keys, "_k").agg(F.max("at").alias("_st"), F.array_sort(F.collect_set("_reason")).alias("reasons")).withColumn("_en", F.lead("_st").over(_order(keys, "_k")))
    # the stretch before the first edge has no row; its pieces begin and end with A or the edge
    first = stretches.where("_k = 1").select(*keys, F.lit(0).cast("long").alias("_k"), F.lit(None).cast("long").alias("_st"), F.array().cast(stretches.schema["reasons"].dataType).alias("reasons"), F.col("_st").alias("_en"))
    touched = stream.where("kind <> 1").groupBy(*keys, ident, "st", "en").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    touched = touched.select(*keys, ident, "st", "en", F.explode(F.sequence("_lo", "_hi")).alias("_k"))
    found = touched.join(stretches.unionByName(first).hint("merge"), [*keys, "_k"], "left")
    return found.select(*keys, ident, F.greatest("st", "_st").alias("st"), F.least("en", "_en").alias("en"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def split_long(df: DataFrame, longest: int, overlap: int) -> DataFrame:
    """Chunks of at most ``longest`` that overlap by ``overlap``; the last one ends with the interval."""
    step = longest - overlap
    n = F.when(F.col("en") - F.col("st") <= longest, F.lit(0)).otherwise(F.ceil((F.col("en") - F.col("st") - longest) / F.lit(step)).cast("long"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunk")
    rows = df.select("*", at)
    st = F.col("st") + F.col("chunk") * step
    return rows.withColumn("c_st", st).withColumn("c_en", F.least("en", F.col("c_st") + longest))


# --- joins by position ---------------------------------------------------------------


def _binned(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.expr(f"st div {width}"), F.expr(f"(en - 1) div {width}"))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], carry: list[str] | None = None, width: int = BIN, longest: int = 64) -> DataFrame:
    """Rows of A with each overlapping row of B as ``o_st``, ``o_en`` (clipped to A) and ``carry``.

    An equi-join on the keys and a bin, with each pair kept only in the bin where its
    overlap starts, so nothing is emitted twice and no nested loop is planned. Rows of B
    that span more than ``longest`` bins would be copied into all of them; they meet A by
    the keys alone instead. Coordinates must not be negative.
    """
    carry = carry or []
    span = F.expr(f"(en - 1) div {width} - st div {width}")
    a, b = a.where("st < en"), b.where("st < en")
    theirs = [F.col("st").alias("b_st"), F.col("en").alias("b_en"), *carry]
    short, long = b.where(span < longest), b.where(span >= longest)
    narrow, wide = a.where(span < longest), a.where(span >= longest)
    binned = _binned(narrow, width).join(_binned(short, width).select(*keys, "_bin", *theirs), [*keys, "_bin"])
    binned = binned.where("st < b_en and b_st < en").where(F.col("_bin") == F.expr(f"greatest(st, b_st) div {width}")).drop("_bin")
    meet = lambda x, y: x.join(y.select(*keys, *theirs), keys).where("st < b_en and b_st < en")
    both = binned.unionByName(meet(narrow, long)).unionByName(meet(wide, b))
    return both.withColumn("o_st", F.greatest("st", "b_st")).withColumn("o_en", F.least("en", "b_en")).drop("b_st", "b_en")


def semi_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of A that some row of B overlaps. B's union decides, so each A meets few rows."""
    return _with_flag(a, b, keys).where("_hit").drop("_hit")


def anti_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of A that no row of B overlaps."""
    return _with_flag(a, b, keys).where("not _hit").drop("_hit")


def _with_flag(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A with ``_hit``: decided in one sort, from the farthest end of B's rows that start before A ends.

    A row of B overlaps [st, en) exactly if it starts before en and ends after st; over
    all B starting before en the greatest end tells. B's starts and A's ends are merged
    into one ordered stream for that.
    """
    empty = F.lit(None).cast("long")
    cols = [F.col(c) for c in a.columns]
    left = a.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*cols).alias("_row"), F.col("en").alias("_at"), F.lit(0).alias("_kind"), empty.alias("_end"))
    right = b.where("st < en").select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("st").alias("_at"), F.lit(1).alias("_kind"), F.col("en").alias("_end"))
    # at equal places A comes first: a B that starts at A's end does not overlap it
    w = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = left.unionByName(right).withColumn("_far", F.max("_end").over(w)).where("_kind = 0")
    hit = (F.col("_row.st") < F.col("_row.en")) & (F.col("_far") > F.col("_row.st"))
    return seen.select("_row.*", F.coalesce(hit, F.lit(False)).alias("_hit"))


def containment(inner: DataFrame, outer: DataFrame, keys: list[str], tolerance: int = 0, carry: list[str] | None = None) -> DataFrame:
    """Pairs whose inner row lies in the outer one up to ``tolerance``, and pairs that only partly overlap, told by ``whole``."""
    carry = carry or []
    wide = outer.select(*keys, (F.col("st") - tolerance).alias("st"), (F.col("en") + tolerance).alias("en"), F.col("st").alias("w_st"), F.col("en").alias("w_en"), *carry)
    wide = wide.withColumn("st", F.greatest("st", F.lit(0)))
    hits = overlap_join(inner, wide, keys, carry=["w_st", "w_en", *carry])
    hits = hits.withColumn("whole", (F.col("st") >= F.col("w_st") - tolerance) & (F.col("en") <= F.col("w_en") + tolerance))
    return hits.where("whole or (st < w_en and w_st < en)").drop("o_st", "o_en")


def points_in(points: DataFrame, at: str, ident: list[str], spans: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Every point, known by ``ident`` within its keys, with the intervals that hold it (st <= x < en) by their columns ``carry``; none: null."""
    probe = points.select(*keys, *ident, F.col(at).alias("st"), (F.col(at) + 1).alias("en"))
    hits = overlap_join(probe, spans, keys, carry=carry).select(*keys, *ident, *carry)
    return points.join(hits, [*keys, *ident], "left")


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], at: str, to: str, ident: str) -> DataFrame:
    """For each point the nearest target of its key; ties go to the smaller target, then the smaller point's own order.

    One sort per key: the last target at or before and the first at or after a point.
    """
    cols = [F.col(c) for c in points.columns]
    left = points.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*cols).alias("_row"), F.col(at).alias("_at"), F.lit(None).cast("long").alias("_t"))
    right = targets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(to).alias("_at"), F.col(to).alias("_t"))
    w = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at")
    both = left.unionByName(right)
    both = both.withColumn("_lo", F.last("_t", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.withColumn("_hi", F.first("_t", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))).where("_row is not null")
    lo, hi = F.col("_at") - F.col("_lo"), F.col("_hi") - F.col("_at")
    pick = F.when(F.col("_lo").isNull(), F.col("_hi")).when(F.col("_hi").isNull() | (lo <= hi), F.col("_lo")).otherwise(F.col("_hi"))
    return both.select("_row.*", pick.alias(ident))


# --- ids, runs and cursors -----------------------------------------------------------


def ids_to_ranges(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Maximal runs of consecutive ids as [st, en)."""
    w = _order(keys, ident)
    return df.select(*keys, ident).distinct().withColumn("_g", F.col(ident) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(ident).cast("long").alias("st"), (F.max(ident) + 1).cast("long").alias("en")).drop("_g")


def ranges_to_ids(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """The distinct ids that ranges cover."""
    return df.where("st < en").select(*keys, F.explode(F.sequence(F.col("st"), F.col("en") - 1)).alias(ident)).distinct()


def runs(df: DataFrame, keys: list[str], index: str, mask: Column, least: int = 1, extra: list[Column] | None = None) -> DataFrame:
    """Maximal runs of rows with ``mask``, of ``least`` rows or more, as [st, en) of the index."""
    w = _order(keys, index)
    on = df.where(mask).withColumn("_g", F.col(index) - F.row_number().over(w))
    out = on.groupBy(*keys, "_g").agg(F.min(index).cast("long").alias("st"), (F.max(index) + 1).cast("long").alias("en"), F.count("*").alias("n"), *(extra or []))
    return out.where(F.col("n") >= least).drop("_g")


def sessions(df: DataFrame, keys: list[str], gap: int, extra: list[Column] | None = None) -> DataFrame:
    """Islands that break where a row starts more than ``gap`` after the end of the row before it."""
    w = _order(keys, "st", "en")
    new = F.when(F.col("st") - F.lag("en").over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("n"), *(extra or []))


def cursor(df: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Output bounds of intervals laid end to end: a running sum of their lengths."""
    w = _order(keys, *by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("out_en", F.sum(F.col("en") - F.col("st")).over(w)).withColumn("out_st", F.col("out_en") - (F.col("en") - F.col("st")))


def gaps(df: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Each row with the next one's start and the gap to it, at least zero."""
    w = _order(keys, *by)
    return df.withColumn("next_st", F.lead("st").over(w)).withColumn("gap", F.greatest(F.col("next_st") - F.col("en"), F.lit(0)))


def degenerate_runs(df: DataFrame, keys: list[str], index: str, droppable: Column) -> DataFrame:
    """Drop runs of two or more droppable zero-length rows at one place; single ones stay."""
    w = _order(keys, index)
    flat = (F.col("st") == F.col("en")) & droppable
    same = flat & F.lag(flat).over(w) & (F.col("st") == F.lag("st").over(w))
    marked = df.withColumn("_flat", flat).withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = numbered.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_g")))
    return sized.where(~(F.col("_flat") & (F.col("_n") >= 2))).drop("_flat", "_new", "_g", "_n")
