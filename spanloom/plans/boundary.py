"""Composite plans: pauses, alignment events, cuts, and the output trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import intervals as I

#: Target pauses of each class in milliseconds.
PAUSE_MS = {"continuation": 0, "short": 180, "thought": 420, "section": 900}


def pause_plan(thoughts: DataFrame, keys: list[str], given: DataFrame | None = None) -> DataFrame:
    """(keys, idx, pause_type, rule) of each transition between neighbours.

    ``given`` holds a planner's classes (keys, idx, pause_type); where it has none, or a
    class that does not exist, the deterministic rules decide.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    nxt = thoughts.withColumn("_next", F.lead("text").over(w)).where("_next is not null")
    ruled = nxt.select(*keys, "idx", X.pause_type(F.col("text"), F.col("_next")).alias("p")).select(*keys, "idx", "p.pause_type", "p.rule")
    if given is None:
        return ruled
    valid = given.where(F.col("pause_type").isin(*PAUSE_MS)).select(*keys, "idx", F.col("pause_type").alias("_given"))
    out = ruled.join(valid, [*keys, "idx"], "left")
    return out.select(*keys, "idx", F.coalesce("_given", "pause_type").alias("pause_type"), F.when(F.col("_given").isNotNull(), "planner").otherwise(F.col("rule")).alias("rule"))


def joins(segments: DataFrame, pauses: DataFrame, keys: list[str], ms: int = 1000) -> DataFrame:
    """Each output join with its target, the silence it already has, and the deficit to insert."""
    gaps = I.gaps(segments, keys, "idx").where("next_st is not null")
    target = F.create_map(*[F.lit(x) for k, v in PAUSE_MS.items() for x in (k, v * ms)])
    both = gaps.join(pauses.select(*keys, "idx", "pause_type"), [*keys, "idx"], "left").withColumn("target", F.coalesce(F.try_element_at(target, F.col("pause_type")), F.lit(0)).cast("long"))
    return both.withColumn("existing", F.least("gap", "target")).withColumn("inserted", F.greatest(F.col("target") - F.col("gap"), F.lit(0)))


def alignment_events(ranges: DataFrame, words: DataFrame, keys: list[str], retained_gap: int) -> DataFrame:
    """(keys, kind, left_id, right_id) of every place an aligner must look at.

    The first range's start, both sides of each omitted stretch, the last range's end or
    the end of the recording, and long gaps between retained neighbours that no omitted
    stretch covers already.
    """
    w = Window.partitionBy(*keys).orderBy("st")
    last_word = words.groupBy(*keys).agg((F.max("word_id") + 1).cast("long").alias("n"))
    r = ranges.withColumn("_prev", F.lag("en").over(w)).withColumn("_next", F.lead("st").over(w)).join(last_word, keys)
    row = lambda kind, a, b: (F.lit(kind).alias("kind"), a.cast("long").alias("left_id"), b.cast("long").alias("right_id"))
    leading = r.where("_prev is null").select(*keys, *row("leading", F.col("st") - 1, F.col("st")))
    gap_left = r.where("_next is not null and _next > en").select(*keys, *row("gap_left", F.col("en") - 1, F.col("en")))
    gap_right = r.where("_prev is not null and st > _prev").select(*keys, *row("gap_right", F.col("st") - 1, F.col("st")))
    trailing = r.where("_next is null").select(*keys, *row("trailing", F.col("en") - 1, F.col("en")), "n").withColumn("kind", F.when(F.col("right_id") == F.col("n"), "eof").otherwise("trailing")).drop("n")
    k = Window.partitionBy(*keys).orderBy("word_id")
    pairs = words.withColumn("_nid", F.lead("word_id").over(k)).withColumn("_nst", F.lead("st").over(k)).where(F.col("_nst") - F.col("en") >= retained_gap)
    spans = pairs.select(*keys, F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 2).cast("long").alias("en"))
    inside = I.containment(spans, ranges.select(*keys, "st", "en"), keys).where("whole").select(*keys, *row("retained_gap", F.col("st"), F.col("st") + 1)).distinct()
    events = leading.unionByName(gap_left).unionByName(gap_right).unionByName(trailing)
    return events.unionByName(inside.join(events.select(*keys, "left_id", "right_id"), [*keys, "left_id", "right_id"], "left_anti"))


def cuts(events: DataFrame, phones: DataFrame, keys: list[str], margin: int, dense: int) -> DataFrame:
    """A cut for every event at ``at``: in the middle of the phone-free stretch around it, with margins, and its safety.

    A stretch of ``dense`` or more is ``verified``; a shorter one is ``dense`` and is cut in
    its middle without margins; inside a phone there is no safe cut.
    """
    free = phones.where("st < en").select(*keys, "st", "en")
    cols = [F.col(c) for c in events.columns]
    left = events.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*cols).alias("_row"), F.col("at").alias("_at"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e"))
    right = free.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("st").alias("_at"), F.col("st").alias("_s"), F.col("en").alias("_e"))
    w = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at")
    both = left.unionByName(right).withColumn("_before", F.max("_e").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_after", F.min("_s").over(w.rangeBetween(1, Window.unboundedFollowing))).where("_row is not null")
    out = both.select("_row.*", F.col("_before").alias("quiet_st"), F.col("_after").alias("quiet_en"))
    room = F.col("quiet_en") - F.col("quiet_st")
    status = F.when(F.col("quiet_st").isNull() | F.col("quiet_en").isNull(), "edge").when(F.col("quiet_st") > F.col("at"), "unsafe").when(room >= dense, "verified").otherwise("dense")
    middle = F.floor((F.col("quiet_st") + F.col("quiet_en")) / 2).cast("long")
    inside = F.greatest(F.col("quiet_st") + margin, F.least(F.col("at"), F.col("quiet_en") - margin))
    return out.withColumn("status", status).withColumn("cut", F.when(F.col("status") == "verified", inside).when(F.col("status") == "dense", middle).otherwise(F.col("at")))


def output_trace(segments: DataFrame, pauses: DataFrame, keys: list[str]) -> DataFrame:
    """Source segments and inserted pauses in output order, with their output bounds end to end."""
    j = joins(segments, pauses, keys)
    src = segments.select(*keys, "idx", F.lit(0).alias("part"), F.lit("source").alias("kind"), "st", "en")
    ins = j.where("inserted > 0").select(*keys, "idx", F.lit(1).alias("part"), F.lit("ambience").alias("kind"), F.lit(0).cast("long").alias("st"), F.col("inserted").alias("en"))
    return I.cursor(src.unionByName(ins), keys, "idx", "part")


def trace_violations(trace: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """Broken invariants of an output trace: gaps or overlaps in output, empty pieces, cuts inside protected spans."""
    from spanloom.operators.validate import violations

    w = Window.partitionBy(*keys).orderBy("out_st", "part")
    t = trace.withColumn("_prev", F.lag("out_en").over(w))
    own = violations(t, {"output_not_contiguous": F.coalesce(F.col("_prev"), F.lit(0)) != F.col("out_st"), "empty_segment": F.col("en") <= F.col("st")}, [*keys, "idx"])
    edges = trace.where("kind = 'source'").select(*keys, "idx", F.explode(F.array("st", "en")).alias("at"))
    hit = I.overlap_join(edges.select(*keys, "idx", F.col("at").alias("st"), (F.col("at") + 1).alias("en"), "at"), protected.select(*keys, "st", "en", F.col("st").alias("p_st")), keys, carry=["p_st"]).where("p_st < at")
    return own.unionByName(hit.select(F.lit("cut_inside_protected").alias("rule"), *keys, "idx").distinct())


def visual_timeline(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Picture segments: an inserted pause freezes the segment before it."""
    w = Window.partitionBy(*keys).orderBy("idx", "part")
    t = trace.withColumn("_k", F.lead("kind").over(w)).withColumn("_len", F.lead(F.col("out_en") - F.col("out_st")).over(w))
    freeze = F.when(F.col("_k") == "ambience", F.col("_len")).otherwise(F.lit(0))
    return t.where("kind = 'source'").select(*keys, "idx", "st", "en", "out_st", (F.col("out_en") + freeze).alias("out_en"), freeze.alias("freeze"))


def grown_selection(selected: DataFrame, unsafe: DataFrame, keys: list[str], n: DataFrame) -> DataFrame:
    """Conservative growth: the omitted stretch beside every unsafe edge joins the selection.

    One monotone pass; a caller repeats it until nothing changes, which it must within the
    number of omitted stretches.
    """
    omitted = I.complement(I.merge_overlapping(selected, keys), n.select(*keys, F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")), keys)
    wide = omitted.select(*keys, F.greatest(F.col("st") - 1, F.lit(0)).alias("st"), (F.col("en") + 1).alias("en"), F.col("st").alias("o_s"), F.col("en").alias("o_e"))
    hits = I.overlap_join(unsafe.select(*keys, F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 1).cast("long").alias("en")), wide, keys, carry=["o_s", "o_e"], width=64)
    extra = hits.select(*keys, F.col("o_s").alias("st"), F.col("o_e").alias("en")).distinct()
    return I.merge_overlapping(selected.select(*keys, "st", "en").unionByName(extra), keys)


def passthrough(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """The trivial plan of a recording [0, total): one source segment, marked as degraded."""
    return bounds.select(*keys, F.lit(0).cast("long").alias("idx"), F.lit("source").alias("kind"), F.lit(0).cast("long").alias("st"), F.col("total").cast("long").alias("en"), F.lit("full_source_passthrough").alias("status"))


def retarget_pauses(old: DataFrame, thoughts: DataFrame, keys: list[str], video: bool = False) -> DataFrame:
    """Pause classes re-keyed to a repaired plan: a transition whose two texts are unchanged keeps its class, others are ruled anew; video has no pauses."""
    w = Window.partitionBy(*keys).orderBy("idx")
    nxt = thoughts.withColumn("following", F.lead("text").over(w)).where("following is not null")
    same = nxt.join(old.select(*keys, "text", "following", F.col("pause_type").alias("_kept")).dropDuplicates([*keys, "text", "following"]), [*keys, "text", "following"], "left")
    ruled = same.withColumn("_r", X.pause_type(F.col("text"), F.col("following")))
    kind = F.lit("continuation") if video else F.coalesce("_kept", "_r.pause_type")
    return ruled.select(*keys, "idx", kind.alias("pause_type"), F.when(F.lit(video), "video").when(F.col("_kept").isNotNull(), "kept").otherwise(F.col("_r.rule")).alias("rule"))
