"""Ranking of candidates, and ordered allocation.

The first candidate long enough comes from a window; only requests that none can fill
alone go through an ordered greedy pass, one request a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(pairs: DataFrame, keys: list[str], reference: Column, level_delta: Column, prior_use: Column | None = None) -> DataFrame:
    """Candidates of each request in order of preference: level band of 3 dB, prior use, level, nearness of the middle, stationarity, length, start, id."""
    middle = F.floor((F.col("st") + F.col("en")) / 2)
    order = [F.floor(level_delta / 3), prior_use if prior_use is not None else F.lit(0), level_delta, F.abs(middle - reference), F.col("stationarity"), -(F.col("en") - F.col("st")), F.col("st"), F.col("candidate_id")]
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_long_enough(ranked: DataFrame, keys: list[str], need: str) -> DataFrame:
    """The best candidate that can fill its request alone, as the centred range of the needed length."""
    fits = ranked.where(F.col("en") - F.col("st") >= F.col(need))
    best = fits.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where("_r = 1").drop("_r")
    st = (F.col("st") + F.floor((F.col("en") - F.col("st") - F.col(need)) / 2)).cast("long")
    return best.withColumn("take_st", st).withColumn("take_en", F.col("take_st") + F.col(need))


def greedy_assembly(ranked: DataFrame, keys: list[str], need: str, fade: int) -> DataFrame:
    """(keys, status, takes): non-overlapping candidates in rank order until they fill the need.

    Each further take overlaps the one before by ``fade`` samples. The fold runs over the
    request's sorted candidates inside SQL; a request that can't be filled is
    ``unavailable`` and takes nothing.
    """
    listed = ranked.groupBy(*keys, need).agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "st", "en"))).alias("_c"))
    start = F.struct(F.lit(0).cast("long").alias("have"), F.array().cast("array<struct<candidate_id: string, st: bigint, en: bigint>>").alias("takes"))

    def step(acc: Column, c: Column) -> Column:
        clash = F.exists(acc["takes"], lambda t: F.greatest(t["st"], c["st"]) < F.least(t["en"], c["en"]))
        first = F.size(acc["takes"]) == 0
        gain = F.when(first, c["en"] - c["st"]).otherwise(c["en"] - c["st"] - fade)
        use = F.least(gain, F.col(need) - acc["have"])
        length = F.when(first, use).otherwise(use + fade)
        take = F.struct(c["candidate_id"].cast("string").alias("candidate_id"), c["st"].cast("long").alias("st"), (c["st"] + length).cast("long").alias("en"))
        done = (acc["have"] >= F.col(need)) | clash | (gain <= 0)
        return F.when(done, acc).otherwise(F.struct((acc["have"] + use).cast("long").alias("have"), F.concat(acc["takes"], F.array(take)).alias("takes")))

    out = listed.withColumn("_a", F.aggregate("_c", start, step))
    full = F.col("_a.have") >= F.col(need)
    return out.select(*keys, need, F.when(full & (F.size("_a.takes") == 1), "single").when(full, "assembled").otherwise("unavailable").alias("status"), F.when(full, F.col("_a.takes")).otherwise(F.array().cast("array<struct<candidate_id: string, st: bigint, en: bigint>>")).alias("takes"))


def replacements(events: DataFrame, editable: DataFrame, keys: list[str], ident: str, guard: int) -> DataFrame:
    """Targets of events inside editable gaps: the clipped intersection grown by a guard within its gap, never before the last target's end."""
    from spanloom.operators.intervals import overlap_join

    hits = overlap_join(events.select(*keys, ident, "st", "en"), editable.select(*keys, "st", "en", F.col("st").alias("gap_st"), F.col("en").alias("gap_en")), keys, carry=["gap_st", "gap_en"])
    wide = hits.select(*keys, ident, F.greatest(F.col("o_st") - guard, F.col("gap_st")).alias("t_st"), F.least(F.col("o_en") + guard, F.col("gap_en")).alias("t_en"))
    w = Window.partitionBy(*keys).orderBy("t_st", "t_en", ident).rowsBetween(Window.unboundedPreceding, -1)
    clamped = wide.withColumn("target_st", F.greatest("t_st", F.coalesce(F.max("t_en").over(w), F.col("t_st")))).withColumn("target_en", F.col("t_en"))
    return clamped.where("target_st < target_en").select(*keys, ident, "target_st", "target_en")


def merge_weighted(events: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching events merged in order of start; the mean probability is weighted by the length each one adds.

    The weight depends on what was merged before, so each island's events are folded in order.
    """
    w = Window.partitionBy(*keys).orderBy("st", "en", "mean_p")
    reach = F.max("en").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("_new", F.when(reach.isNull() | (F.col("st") > reach), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = marked.groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct("st", "en", "mean_p", "max_p"))).alias("_e"))
    first = F.get("_e", F.lit(0))
    start = F.struct(first["st"].alias("st"), first["en"].alias("en"), first["mean_p"].alias("mean_p"), first["max_p"].alias("max_p"))

    def step(a: Column, e: Column) -> Column:
        fresh = (e["en"] - e["st"]) - F.greatest(F.lit(0).cast("long"), F.least(a["en"], e["en"]) - F.greatest(a["st"], e["st"]))
        fresh = F.greatest(F.lit(0).cast("long"), fresh)
        have = a["en"] - a["st"]
        return F.struct(F.least(a["st"], e["st"]).alias("st"), F.greatest(a["en"], e["en"]).alias("en"), ((a["mean_p"] * have + e["mean_p"] * fresh) / (have + fresh)).alias("mean_p"), F.greatest(a["max_p"], e["max_p"]).alias("max_p"))

    out = lists.withColumn("_a", F.aggregate(F.slice("_e", F.lit(2), F.size("_e")), start, step))
    return out.select(*keys, "_a.st", "_a.en", "_a.mean_p", "_a.max_p", F.size("_e").cast("long").alias("n_fragments"))


def accepted_in_order(items: DataFrame, keys: list[str], out: str = "accepted") -> DataFrame:
    """Items kept in order of start if they begin at or after the end of the last one kept."""
    lists = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("st", "en"))).alias("_l"))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<st: bigint, en: bigint>>").alias("kept"))
    fold = F.aggregate("_l", start, lambda a, x: F.when(x["st"] >= a["end"], F.struct(x["en"].alias("end"), F.concat(a["kept"], F.array(F.struct(x["st"].alias("st"), x["en"].alias("en")))).alias("kept"))).otherwise(a))
    return lists.select(*keys, fold["kept"].alias(out))
