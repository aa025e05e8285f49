"""Framed signals: levels, thresholds, masks, stable silence, signal metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numeric as N


def tumbling(df: DataFrame, keys: list[str], index: str, x: str, size: int, floor: float = 1e-10) -> DataFrame:
    """Level of every frame of ``size`` samples; the last frame counts as filled up with zeros."""
    out = df.groupBy(*keys, F.floor(F.col(index) / size).cast("int").alias("frame")).agg(F.sum(F.col(x) * F.col(x)).alias("_e"), F.max(F.abs(x)).alias("peak"))
    return out.withColumn("rms_db", N.db(F.sqrt(F.col("_e") / size), floor)).drop("_e")


def hopping(df: DataFrame, samples: str, size: int, hop: int, tail: bool = False) -> DataFrame:
    """(…, start, frame) of every frame of ``size`` samples each ``hop``; with ``tail`` one more ends with the signal."""
    n = F.size(samples)
    last = F.when(n >= size, F.floor((n - size) / hop).cast("int") * hop)
    starts = F.when(n >= size, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    if tail:
        end = F.greatest(n - size, F.lit(0))
        starts = F.when(n > 0, F.array_distinct(F.concat(starts, F.array(end))))
    return df.withColumn("start", F.explode(starts)).withColumn("frame", F.expr(f"slice({samples}, start + 1, {size})"))


def noise_floor(df: DataFrame, keys: list[str], level: str, share: float = 0.12) -> DataFrame:
    """Exact percentile of the finite levels, and the activity threshold 17 dB above it within [-56, -34]."""
    finite = F.when(~F.isnan(level) & (F.abs(F.col(level)) < float("inf")), F.col(level))
    out = df.groupBy(*keys).agg(F.percentile(finite, share).alias("noise_floor_db"))
    return out.withColumn("threshold_db", N.clip(F.col("noise_floor_db") + 17.0, -56.0, -34.0))


def local_threshold(df: DataFrame, keys: list[str], index: str, level: str, reach: int, share: float = 0.20) -> DataFrame:
    """Local floor: a percentile over ``reach`` frames on each side, and the threshold 12 dB above it within [-55, -30]."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(-reach, reach)
    levels = F.array_sort(F.collect_list(level).over(w))
    at = (F.size("_l") - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    value = lambda i: F.get("_l", i)
    out = df.withColumn("_l", levels)
    out = out.withColumn("local_floor_db", value(low) + (value(F.least(low + 1, F.size("_l") - 1)) - value(low)) * (at - low))
    return out.withColumn("threshold_db", N.clip(F.col("local_floor_db") + 12.0, -55.0, -30.0)).drop("_l")


def dilate(df: DataFrame, keys: list[str], index: str, mask: str, size: int, out: str) -> DataFrame:
    """Binary dilation by a structure of ``size`` frames; one of even size reaches one frame further back."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(-(size // 2), size - 1 - size // 2)
    return df.withColumn(out, F.max(F.col(mask).cast("int")).over(w) == 1)


def erode(df: DataFrame, keys: list[str], index: str, mask: str, size: int, out: str) -> DataFrame:
    """Binary erosion; what lies beyond either end counts as false."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(-(size // 2), size - 1 - size // 2)
    full = (F.min(F.col(mask).cast("int")).over(w) == 1) & (F.count("*").over(w) == size)
    return df.withColumn(out, full)


def _mirrored_dilate(df: DataFrame, keys: list[str], index: str, mask: str, size: int, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(-(size - 1 - size // 2), size // 2)
    return df.withColumn(out, F.max(F.col(mask).cast("int")).over(w) == 1)


def close_gaps(df: DataFrame, keys: list[str], index: str, mask: str, size: int, out: str) -> DataFrame:
    """Dilation and then erosion: gaps shorter than the structure are filled."""
    return erode(_mirrored_dilate(df, keys, index, mask, size, "_d"), keys, index, "_d", size, out).drop("_d")


def open_specks(df: DataFrame, keys: list[str], index: str, mask: str, size: int, out: str) -> DataFrame:
    """Erosion and then dilation: runs shorter than the structure go."""
    return _mirrored_dilate(erode(df, keys, index, mask, size, "_e"), keys, index, "_e", size, out).drop("_e")


def stable_silence(df: DataFrame, keys: list[str], start: str, level: str, threshold: float, frame: int, stable: int, raw_end: str, gap: int, need_active: bool = True) -> DataFrame:
    """(keys, silence_start): the first quiet run of ``stable`` samples at or after ``raw_end`` that follows activity within ``gap``.

    A frame is active at or above the threshold. A run counts from its first frame at or
    after raw_end; the first run that gets long enough, and passes, decides.
    """
    w = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    active = F.col(level) >= threshold
    seen = df.withColumn("_act", F.max(F.when(active, F.col(start) + frame)).over(w)).withColumn("_block", F.sum(active.cast("int")).over(w))
    quiet = seen.where(~active & (F.col(start) >= F.col(raw_end)))
    run = quiet.withColumn("_run", F.min(start).over(Window.partitionBy(*keys, "_block")))
    ok = F.col(start) + frame - F.col("_run") >= stable
    if need_active:
        ok = ok & F.col("_act").isNotNull() & (F.col("_run") - F.col("_act") <= gap)
    return run.where(ok).groupBy(*keys).agg(F.min("_run").alias("silence_start"))


def atoms(frames: DataFrame, runs: DataFrame, keys: list[str], before: int, after: int, total: str, least: int) -> DataFrame:
    """Padded speech regions: each side grows by its padding but not past the middle of the gap; short ones go; dense ids."""
    w = Window.partitionBy(*keys).orderBy("st")
    lo = F.floor((F.coalesce(F.lag("en").over(w), F.lit(0)) + F.col("st")) / 2)
    hi = F.floor((F.col("en") + F.coalesce(F.lead("st").over(w), F.col(total))) / 2)
    grown = runs.join(frames.groupBy(*keys).agg((F.max("idx") + 1).cast("long").alias(total)), keys)
    grown = grown.withColumn("a_st", F.greatest(lo, F.col("st") - before).cast("long")).withColumn("a_en", F.least(hi, F.col("en") + after).cast("long"))
    kept = grown.where(F.col("a_en") - F.col("a_st") >= least)
    return kept.select(*keys, (F.row_number().over(w) - 1).alias("atom_index"), "a_st", "a_en")


# --- arrays ------------------------------------------------------------------------------


def metrics(samples: Column) -> list[Column]:
    """RMS, peak, crest factor, largest step, clipped samples and non-finite samples of an array."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    steps = F.zip_with(F.slice(samples, F.lit(2), F.size(samples) - 1), F.slice(samples, F.lit(1), F.size(samples) - 1), lambda a, b: F.abs(a - b))
    rms = N.rms(samples)
    return [
        rms.alias("rms"), peak.alias("peak"), (20 * F.log10(F.try_divide(peak, rms))).alias("crest_db"), F.coalesce(F.array_max(steps), F.lit(0.0)).alias("max_step"),
        F.try_divide(F.coalesce(F.array_max(steps), F.lit(0.0)), rms).alias("step_to_rms"), F.size(F.filter(samples, lambda x: F.abs(x) >= 0.999)).alias("clipped"), F.size(F.filter(samples, bad)).alias("non_finite"),
    ]


def zero_crossings(samples: Column) -> Column:
    """Positions i where the signal passes zero between i and i + 1: from <= 0 to > 0 or from >= 0 to < 0."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(samples) - 2), lambda i: F.when(((F.get(samples, i) <= 0) & (F.get(samples, i + 1) > 0)) | ((F.get(samples, i) >= 0) & (F.get(samples, i + 1) < 0)), i))
    return F.when(F.size(samples) >= 2, F.filter(pairs, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def argmin_abs(samples: Column) -> Column:
    """Position of the quietest sample; the first of equals."""
    loud = F.transform(samples, lambda x: F.abs(x))
    return (F.array_position(loud, F.array_min(loud)) - 1).cast("int")


def crossfade(a: Column, b: Column, n: int) -> Column:
    """A followed by B, the last ``n`` samples of A and the first of B overlapping with equal power."""
    out, into = N.equal_power_gain(F.lit(n), False), N.equal_power_gain(F.lit(n), True)
    tail, head = F.slice(a, F.size(a) - n + 1, F.lit(n)), F.slice(b, F.lit(1), F.lit(n))
    mixed = F.zip_with(F.zip_with(tail, out, lambda x, g: x * g), F.zip_with(head, into, lambda x, g: x * g), lambda x, y: x + y)
    return F.concat(F.slice(a, F.lit(1), F.size(a) - n), mixed, F.slice(b, F.lit(n + 1), F.size(b) - n))


def edge_fades(samples: Column, n: int) -> Column:
    """Linear ramps over the first and last ``n`` samples."""
    size = F.size(samples)
    up = N.linear_gain(F.lit(n), True)
    gain = lambda i: F.when(i < n, F.get(up, i.cast("int"))).otherwise(1.0) * F.when(i >= size - n, F.get(up, (size - 1 - i).cast("int"))).otherwise(1.0)
    return F.transform(samples, lambda x, i: x * gain(i))


def insert_segment(samples: Column, at: Column, piece: Column) -> Column:
    return F.concat(F.slice(samples, F.lit(1), at), piece, F.slice(samples, at + 1, F.size(samples) - at))


#: The gates of an ambience candidate, as (reason, metric, limit).
GATES = [
    ("clipping", "clipped", 0.0),
    ("excessive_crest_factor", "crest_db", 18.0),
    ("excessive_spectral_flux", "flux", 0.65),
    ("unstable_log_band_energy", "band_variance", 25.0),
    ("sudden_rms_burst", "burst_db", 8.0),
    ("sample_discontinuity", "max_step", 0.05),
    ("sample_discontinuity", "step_to_rms", 12.0),
]


def gate_reasons(columns: list[str], least_duration: tuple[str, float] | None = None, least_rms: float = 1e-8, level: tuple[str, float] | None = None, limits: list[tuple[str, str, float]] | None = None) -> Column:
    """Reasons, with metric, value and limit, for which a candidate is refused; empty: accepted."""

    def reason(code: str, metric: str, limit: float, fails: Column) -> Column:
        return F.when(fails, F.struct(F.lit(code).alias("code"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"), F.lit(float(limit)).alias("limit")))

    tests = []
    if least_duration:
        tests.append(reason("insufficient_duration", *least_duration, F.col(least_duration[0]) < least_duration[1]))
    if "non_finite" in columns:
        tests.append(reason("non_finite_samples", "non_finite", 0, F.col("non_finite") > 0))
    tests.append(reason("digital_or_near_silence", "rms", least_rms, F.col("rms") < least_rms))
    tests += [reason(c, m, x, F.col(m) > x) for c, m, x in limits or GATES if m in columns]
    if level:
        tests.append(reason("noise_level_mismatch", *level, F.col(level[0]) > level[1]))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())
