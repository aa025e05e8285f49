"""Queries over framed signals and sample arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import numeric as N
from spanloom.operators import frames as R
from spanloom.operators import intervals as I
from spanloom.operators import sequences as S
from spanloom.plans.catalog import query
from spanloom.sources.adapters import FRAMES_SQL, frames, signals, table

K = ["rec_id"]
FR = f"WITH {FRAMES_SQL}"
#: A frame is active where its sample reaches this.
ON = 0.05


def runs_sql(where: str, least: int = 1) -> str:
    return f"SELECT rec_id, CAST(min(idx) AS BIGINT) AS st, CAST(max(idx) + 1 AS BIGINT) AS en, count(*) AS n FROM (SELECT rec_id, idx, x, idx - row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS g FROM frames WHERE {where}) GROUP BY rec_id, g HAVING count(*) >= {least}"


@query(f"{FR} {runs_sql(f'x >= {ON}')}")
def true_runs(spark: SparkSession, d: str) -> DataFrame:
    """H1: maximal active runs."""
    return I.runs(frames(spark, d), K, "idx", F.col("x") >= ON)


@query(f"{FR} SELECT rec_id, CAST(min(idx) AS BIGINT) AS st, CAST(max(idx) + 1 AS BIGINT) AS en, count(*) AS n, round(max(x), 6) AS max_p, round(avg(x), 6) AS mean_p, CAST(floor(min(idx) * 44100 / 100) AS BIGINT) AS st_sample, CAST(ceil((max(idx) + 1) * 44100 / 100) AS BIGINT) AS en_sample FROM (SELECT rec_id, idx, x, idx - row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS g FROM frames WHERE x >= {ON}) GROUP BY rec_id, g HAVING count(*) >= 3")
def threshold_runs_min_len(spark: SparkSession, d: str) -> DataFrame:
    """H2, H3, D3: runs of three frames or more, with probabilities and sample bounds."""
    out = I.runs(frames(spark, d), K, "idx", F.col("x") >= ON, 3, [F.round(F.max("x"), 6).alias("max_p"), F.round(F.avg("x"), 6).alias("mean_p")])
    return out.withColumn("st_sample", N.frame_to_sample(F.col("st"), 44100, False)).withColumn("en_sample", N.frame_to_sample(F.col("en"), 44100, True))


@query(f"{FR}, r AS ({runs_sql(f'x < {ON}', 2)}), k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, st) AS a, row_number() OVER (PARTITION BY rec_id ORDER BY st) AS b, row_number() OVER (PARTITION BY rec_id ORDER BY st DESC) AS c FROM r) SELECT rec_id, max(st) FILTER (a = 1) AS longest, max(st) FILTER (b = 1) AS leftmost, max(st) FILTER (c = 1) AS rightmost, count(*) AS n FROM k GROUP BY rec_id")
def quiet_runs(spark: SparkSession, d: str) -> DataFrame:
    """H4: the longest, leftmost and rightmost quiet run."""
    r = I.runs(frames(spark, d), K, "idx", F.col("x") < ON, 2)
    return r.groupBy("rec_id").agg(F.min_by("st", F.struct(-F.col("n"), "st")).alias("longest"), F.min("st").alias("leftmost"), F.max("st").alias("rightmost"), F.count("*").alias("n"))


@query(f"""{FR}, s AS (SELECT *, max(CASE WHEN x >= {ON} THEN idx + 2 END) OVER w AS act, sum(CASE WHEN x >= {ON} THEN 1 ELSE 0 END) OVER w AS blk FROM frames WINDOW w AS (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT *, min(idx) OVER (PARTITION BY rec_id, blk) AS run FROM s WHERE x < {ON} AND idx >= 10) SELECT rec_id, min(run) AS silence_start FROM r WHERE idx + 2 - run >= 5 AND act IS NOT NULL AND run - act <= 3 GROUP BY rec_id""")
def first_stable_silence(spark: SparkSession, d: str) -> DataFrame:
    """H5: the first long enough quiet run after a raw end that follows activity."""
    f = frames(spark, d).withColumn("raw_end", F.lit(10))
    return R.stable_silence(f, K, "idx", "x", ON, 2, 5, "raw_end", 3)


@query(f"{FR} SELECT rec_id, CAST(idx // 10 AS INTEGER) AS frame, round(20 * log10(greatest(sqrt(sum(x * x) / 10), 1e-10)), 6) AS rms_db, round(max(abs(x)), 6) AS peak FROM frames GROUP BY 1, 2")
def tumbling_frames(spark: SparkSession, d: str) -> DataFrame:
    """Levels of frames of ten samples, the last filled up with zeros."""
    return R.tumbling(frames(spark, d), K, "idx", "x", 10).select("rec_id", "frame", F.round("rms_db", 6).alias("rms_db"), F.round("peak", 6).alias("peak"))


@query("""WITH s AS (SELECT vec_id AS rec_id, embedding AS a, unnest(range(0, len(embedding) - 9, 5)) AS start FROM embeddings) SELECT rec_id, CAST(start AS INTEGER) AS start, round(sqrt(list_sum(list_transform(a[start + 1:start + 10], lambda x: CAST(x AS DOUBLE) * x)) / 10), 6) AS rms FROM s""")
def hopping_frames(spark: SparkSession, d: str) -> DataFrame:
    """H7: frames of ten samples each five, no partial tail."""
    out = R.hopping(signals(spark, d), "samples", 10, 5)
    return out.select("rec_id", "start", F.round(N.rms(F.col("frame")), 6).alias("rms"))


@query("""WITH s AS (SELECT vec_id AS rec_id, embedding AS a, unnest(list_distinct(range(0, len(embedding) - 24, 10) || [len(embedding) - 25])) AS start FROM embeddings) SELECT rec_id, CAST(start AS INTEGER) AS start, len(a[start + 1:start + 25]) AS n FROM s""")
def hopping_frames_with_tail(spark: SparkSession, d: str) -> DataFrame:
    """H8: frames of 25 samples each ten, and one that ends with the signal."""
    out = R.hopping(signals(spark, d), "samples", 25, 10, True)
    return out.select("rec_id", "start", F.size("frame").cast("long").alias("n"))


def _win(expr: str, a: int, b: int) -> str:
    return f"{expr} OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


@query(f"""{FR}, m AS (SELECT rec_id, idx, CASE WHEN x >= {ON} THEN 1 ELSE 0 END AS v FROM frames), d AS (SELECT rec_id, idx, v, {_win('max(v)', 2, 1)} AS dil, {_win('max(v)', 1, 2)} AS d1 FROM m),
  c AS (SELECT rec_id, idx, dil, CASE WHEN {_win('min(d1)', 2, 1)} = 1 AND {_win('count(*)', 2, 1)} = 4 THEN 1 ELSE 0 END AS clo FROM d), e AS (SELECT *, CASE WHEN {_win('min(clo)', 1, 0)} = 1 AND {_win('count(*)', 1, 0)} = 2 THEN 1 ELSE 0 END AS ero FROM c)
  SELECT rec_id, idx, dil = 1 AS dilated, clo = 1 AS closed, {_win('max(ero)', 0, 1)} = 1 AS opened FROM e""")
def morphology_mask(spark: SparkSession, d: str) -> DataFrame:
    """H9: dilation by 4, closing by 4, then opening by 2 of the activity mask."""
    f = frames(spark, d).select("rec_id", "idx", (F.col("x") >= ON).alias("m"))
    f = R.dilate(f, K, "idx", "m", 4, "dilated")
    f = R.close_gaps(f, K, "idx", "m", 4, "closed")
    return R.open_specks(f, K, "idx", "closed", 2, "opened").select("rec_id", "idx", "dilated", "closed", "opened")


@query(f"""{FR}, r AS ({runs_sql(f'x >= {ON}', 2)}), g AS (SELECT rec_id, max(idx) + 1 AS total FROM frames GROUP BY rec_id),
  p AS (SELECT r.rec_id, greatest(CAST(floor((coalesce(lag(en) OVER w, 0) + st) / 2) AS BIGINT), st - 3) AS a_st, least(CAST(floor((en + coalesce(lead(st) OVER w, total)) / 2) AS BIGINT), en + 5) AS a_en FROM r JOIN g USING (rec_id) WINDOW w AS (PARTITION BY r.rec_id ORDER BY st))
  SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY a_st) - 1 AS INTEGER) AS atom_index, a_st, a_en FROM p WHERE a_en - a_st >= 4""")
def padded_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Speech regions padded up to the middle of their gaps, short ones dropped, dense ids."""
    f = frames(spark, d)
    return R.atoms(f, I.runs(f, K, "idx", F.col("x") >= ON, 2).select("rec_id", "st", "en"), K, 3, 5, "total", 4).select("rec_id", "atom_index", "a_st", "a_en")


@query()
def split_long_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Long runs split at quiet frames, one after the other."""
    f = frames(spark, d)
    return S.split_long(f, I.runs(f, K, "idx", F.col("x") >= -0.3, 2).select("rec_id", "st", "en"), K, "idx", "x", 12, 3)


@query(f"{FR} SELECT rec_id, min(idx) FILTER (x >= 0.2) AS first_active, max(idx) FILTER (x >= 0.2) + 1 AS last_active_end, arg_min(x, idx) AS first_value, arg_max(x, idx) AS last_value FROM frames GROUP BY rec_id")
def active_handles(spark: SparkSession, d: str) -> DataFrame:
    """First and last active frame, first and last value."""
    on = F.when(F.col("x") >= 0.2, F.col("idx"))
    return frames(spark, d).groupBy("rec_id").agg(F.min(on).alias("first_active"), (F.max(on) + 1).alias("last_active_end"), F.min_by("x", "idx").alias("first_value"), F.max_by("x", "idx").alias("last_value"))


@query(f"""{FR}, q AS ({runs_sql(f'x < {ON}', 2)}), a AS ({runs_sql(f'x >= {ON}', 2)}) SELECT q.rec_id, q.st AS quiet_st, q.en AS at, a.en AS active_en FROM q JOIN a ON q.rec_id = a.rec_id AND a.st = q.en""")
def leading_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A quiet run with sustained activity right after it."""
    f = frames(spark, d)
    q = I.runs(f, K, "idx", F.col("x") < ON, 2).select("rec_id", F.col("st").alias("quiet_st"), F.col("en").alias("at"))
    a = I.runs(f, K, "idx", F.col("x") >= ON, 2).select("rec_id", F.col("st").alias("at"), F.col("en").alias("active_en"))
    return q.join(a, ["rec_id", "at"]).select("rec_id", "quiet_st", "at", "active_en")


@query(f"{FR}, t AS (SELECT rec_id, idx, CASE WHEN x < -0.1 THEN '<pad>' WHEN x < 0 THEN '|' WHEN x < 0.08 THEN 'A' ELSE 'b' END AS l, abs(x) AS p FROM frames), m AS (SELECT *, CASE WHEN l = lag(l) OVER (PARTITION BY rec_id ORDER BY idx) THEN 0 ELSE 1 END AS nw FROM t), r AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM m), c AS (SELECT rec_id, run, min(l) AS l, min(idx) AS st, max(idx) + 1 AS en, avg(p) AS s FROM r GROUP BY 1, 2), w AS (SELECT *, sum(CASE WHEN l = '|' THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY k) - 1 AS INTEGER) AS word_no, string_agg(lower(l), '' ORDER BY run) AS word, min(st) AS st, max(en) AS en, round(avg(s), 6) AS score, round(min(s), 6) AS min_score, count(*) AS n_chars FROM w WHERE l NOT IN ('|', '<pad>') GROUP BY rec_id, k")
def ctc_collapse(spark: SparkSession, d: str) -> DataFrame:
    """frames' best labels collapsed to words."""
    x = F.col("x")
    label = F.when(x < -0.1, "<pad>").when(x < 0, "|").when(x < 0.08, "A").otherwise("b")
    out = S.ctc_words(frames(spark, d).select("rec_id", "idx", label.alias("l"), F.abs(x).alias("p")), K, "idx", "l", "p")
    return out.select("rec_id", "word_no", "word", "st", "en", F.round("score", 6).alias("score"), F.round("min_score", 6).alias("min_score"), "n_chars")


@query("""WITH s AS (SELECT vec_id AS rec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), m AS (SELECT rec_id, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS rms, list_max(list_transform(a, lambda x: abs(x))) AS peak, list_max(list_transform(range(2, len(a) + 1), lambda i: abs(a[i] - a[i - 1]))) AS step FROM s)
  SELECT rec_id, round(rms, 6) AS rms, round(peak, 6) AS peak, round(20 * log10(peak / rms), 5) AS crest_db, round(step, 6) AS max_step, round(step / rms, 5) AS step_to_rms FROM m""")
def signal_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Level, peak, crest factor and largest step of each waveform."""
    m = signals(spark, d).select("rec_id", *R.metrics(F.col("samples")))
    return m.select("rec_id", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), F.round("crest_db", 5).alias("crest_db"), F.round("max_step", 6).alias("max_step"), F.round("step_to_rms", 5).alias("step_to_rms"))


@query()
def spectral_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Spectral flux, band variance and level bursts, by an Arrow UDF."""
    from spanloom.functions.spectral import spectral_udf

    out = signals(spark, d).withColumn("s", spectral_udf(16, 8)("samples"))
    return out.select("rec_id", F.round("s.flux", 6).alias("flux"), F.round("s.band_variance", 4).alias("band_variance"), F.round("s.burst_db", 4).alias("burst_db"))


@query("SELECT vec_id AS rec_id, array_to_string(list_transform(list_filter(range(1, len(embedding)), lambda i: (embedding[i] <= 0 AND embedding[i + 1] > 0) OR (embedding[i] >= 0 AND embedding[i + 1] < 0)), lambda i: i - 1), ',') AS places FROM embeddings")
def zero_crossings(spark: SparkSession, d: str) -> DataFrame:
    """K6: where a waveform passes zero."""
    return signals(spark, d).select("rec_id", F.array_join(F.transform(R.zero_crossings(F.col("samples")), lambda x: x.cast("string")), ",").alias("places"))


@query("SELECT vec_id AS rec_id, CAST(list_position(list_transform(embedding, lambda x: abs(x)), list_min(list_transform(embedding, lambda x: abs(x)))) - 1 AS INTEGER) AS at FROM embeddings")
def argmin_snap(spark: SparkSession, d: str) -> DataFrame:
    """The quietest sample, the first of equals."""
    return signals(spark, d).select("rec_id", R.argmin_abs(F.col("samples")).alias("at"))


@query("""WITH s AS (SELECT vec_id AS rec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), g AS (SELECT rec_id, a, list_transform(range(1, len(a) + 1), lambda i: a[i] * (CASE WHEN i <= 8 THEN (i - 1) / 7.0 ELSE 1 END) * (CASE WHEN i > len(a) - 8 THEN (len(a) - i) / 7.0 ELSE 1 END)) AS f FROM s)
  SELECT rec_id, round(list_sum(list_transform(f, lambda x: abs(x))), 6) AS total, round(f[1], 6) + 0.0 AS head, round(f[4], 6) + 0.0 AS fourth, round(f[64], 6) + 0.0 AS tail FROM g""")
def gain_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Linear fades over both edges."""
    f = signals(spark, d).select("rec_id", R.edge_fades(F.col("samples"), 8).alias("f"))
    return f.select("rec_id", F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"), *[(F.round(F.get("f", F.lit(i)), 6) + 0.0).alias(n) for i, n in ((0, "head"), (3, "fourth"), (63, "tail"))])


@query("""WITH p AS (SELECT a.vec_id AS rec_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  c AS (SELECT rec_id, a[1:48] || list_transform(range(1, 17), lambda i: a[48 + i] * cos(pi() / 2 * (i - 1) / 15) + b[i] * sin(pi() / 2 * (i - 1) / 15)) || b[17:64] AS f FROM p) SELECT rec_id, len(f) AS n, round(list_sum(f), 5) AS total, round(f[56], 6) AS mid FROM c""")
def crossfade(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2: two waveforms joined with an equal-power crossfade of sixteen samples."""
    s = signals(spark, d)
    b = s.select((F.col("rec_id") - 1).alias("rec_id"), F.col("samples").alias("b"))
    f = s.join(b, "rec_id").select("rec_id", R.crossfade(F.col("samples"), F.col("b"), 16).alias("f"))
    return f.select("rec_id", F.size("f").cast("long").alias("n"), F.round(F.aggregate("f", F.lit(0.0), lambda x, y: x + y), 5).alias("total"), F.round(F.get("f", F.lit(55)), 6).alias("mid"))


@query("SELECT vec_id AS rec_id, len(embedding[1:10] || [9.0, 9.0] || embedding[11:64]) AS n, CAST((embedding[1:10] || [9.0, 9.0] || embedding[11:64])[11] AS DOUBLE) AS first_new, CAST((embedding[1:10] || [9.0, 9.0] || embedding[11:64])[13] AS DOUBLE) AS after FROM embeddings")
def insert_segment(spark: SparkSession, d: str) -> DataFrame:
    """K4: a segment put in at a place."""
    f = signals(spark, d).select("rec_id", R.insert_segment(F.col("samples"), F.lit(10), F.array(F.lit(9.0), F.lit(9.0))).alias("f"))
    return f.select("rec_id", F.size("f").cast("long").alias("n"), F.get("f", F.lit(10)).alias("first_new"), F.get("f", F.lit(12)).alias("after"))


@query("SELECT event_id, CAST(greatest(0, least(1000000, CASE WHEN abs(value * 16 - round_even(value * 16, 0)) <= 1e-6 THEN round_even(value * 16, 0) ELSE floor(value * 16) END)) AS BIGINT) AS lo, CAST(greatest(0, least(1000000, CASE WHEN abs(value * 16 - round_even(value * 16, 0)) <= 1e-6 THEN round_even(value * 16, 0) ELSE ceil(value * 16) END)) AS BIGINT) AS hi, CAST(floor(value * 48000 + 1e-9) AS BIGINT) AS ev_lo, CAST(ceil(value * 48000 - 1e-9) AS BIGINT) AS ev_hi, CAST(round_even(value * 8, 0) AS BIGINT) AS nearest FROM events")
def sample_rounding(spark: SparkSession, d: str) -> DataFrame:
    """The two ways from seconds to samples."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", N.timestamp_to_sample(v, 16, 1_000_000, "floor").alias("lo"), N.timestamp_to_sample(v, 16, 1_000_000, "ceil").alias("hi"), N.seconds_to_sample(v, 48000, "floor").alias("ev_lo"), N.seconds_to_sample(v, 48000, "ceil").alias("ev_hi"), N.seconds_to_sample(v, 8, "nearest").alias("nearest"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), -1) AS number, CASE event_id % 4 WHEN 0 THEN round(30000 / 1001, 6) WHEN 1 THEN 25.0 ELSE NULL END AS rate FROM events")
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Casts with a fallback, and frame rates given as ratios."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "x").otherwise(i.cast("string"))
    rate = F.when(i % 4 == 0, "30000/1001").when(i % 4 == 1, "25").when(i % 4 == 2, "0/0").otherwise("n/a")
    return table(spark, d, "events").select("event_id", N.finite_or(text, -1.0).alias("number"), F.round(N.ratio(rate), 6).alias("rate"))


@query("""WITH s AS (SELECT vec_id AS rec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), e AS (SELECT rec_id, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM s) SELECT rec_id, round(list_max(e) / list_sum(e), 6) AS top, round(e[1] / list_sum(e), 6) AS head FROM e""")
def emission_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Emission rows as probabilities."""
    p = signals(spark, d).select("rec_id", N.softmax(F.col("samples")).alias("p"))
    return p.select("rec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.get("p", F.lit(0)), 6).alias("head"))
