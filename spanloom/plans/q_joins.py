"""Queries that join by position, aggregates, and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import allocate as A
from spanloom.operators import intervals as I
from spanloom.plans.catalog import query
from spanloom.plans.q_intervals import K, union_sql
from spanloom.sources.adapters import WORDS_SQL, micros, role, table, words

W = f"WITH {WORDS_SQL}"


@query(f"{W} SELECT a.rec_id, a.word_id, b.word_id AS other_id, greatest(a.st, b.st) AS o_st, least(a.en, b.en) AS o_en FROM words a JOIN words b ON a.rec_id = b.rec_id AND a.text = 'error' AND b.text = 'view' AND greatest(a.st, b.st) < least(a.en, b.en)")
def overlap_join_clip(spark: SparkSession, d: str) -> DataFrame:
    """Events against retained words, clipped."""
    b = role(spark, d, "view").select("rec_id", "st", "en", F.col("word_id").alias("other_id"))
    return I.overlap_join(role(spark, d, "error"), b, K, carry=["other_id"]).select("rec_id", "word_id", "other_id", "o_st", "o_en")


@query(f"{W} SELECT DISTINCT p.rec_id, p.text, greatest(p.st, i.st) AS st, least(p.en, i.en) AS en FROM words p JOIN words i ON p.rec_id = i.rec_id AND p.text = 'click' AND i.text = 'view' AND p.st < i.en AND i.st < p.en AND p.st < p.en AND i.st < i.en")
def protected_mask(spark: SparkSession, d: str) -> DataFrame:
    """protected phones clipped to retained intervals, duplicates removed."""
    b = role(spark, d, "view").select("rec_id", "st", "en")
    return I.overlap_join(role(spark, d, "click"), b, K).select("rec_id", "text", F.col("o_st").alias("st"), F.col("o_en").alias("en")).dropDuplicates()


@query(f"""{W}, i AS (SELECT * FROM words WHERE text = 'click' AND st < en), o AS (SELECT * FROM words WHERE text = 'view' AND st < en)
  SELECT i.rec_id, i.word_id, o.word_id AS outer_id, i.st >= o.st - 2000 AND i.en <= o.en + 2000 AS whole FROM i JOIN o ON i.rec_id = o.rec_id
  AND ((i.st >= o.st - 2000 AND i.en <= o.en + 2000) OR (i.st < o.en AND o.st < i.en))""")
def containment_join(spark: SparkSession, d: str) -> DataFrame:
    """phones inside words with a tolerance; partial overlaps are told apart."""
    outer = role(spark, d, "view").where("st < en").select("rec_id", "st", "en", F.col("word_id").alias("outer_id"))
    return I.containment(role(spark, d, "click").select("rec_id", "word_id", "st", "en"), outer, K, 2000, ["outer_id"]).select("rec_id", "word_id", "outer_id", "whole")


@query(f"{W} SELECT rec_id, word_id FROM words a WHERE text = 'view' AND EXISTS (SELECT 1 FROM words b WHERE b.rec_id = a.rec_id AND b.text = 'click' AND b.st < b.en AND a.st < a.en AND a.st < b.en AND b.st < a.en)")
def semi_overlap(spark: SparkSession, d: str) -> DataFrame:
    """words that hold some phone."""
    return I.semi_overlap(role(spark, d, "view").select("rec_id", "word_id", "st", "en"), role(spark, d, "click"), K).select("rec_id", "word_id")


@query(f"{W} SELECT rec_id, word_id FROM words a WHERE text = 'view' AND NOT EXISTS (SELECT 1 FROM words b WHERE b.rec_id = a.rec_id AND b.text = 'error' AND b.st < b.en AND a.st < a.en AND a.st < b.en AND b.st < a.en)")
def anti_overlap(spark: SparkSession, d: str) -> DataFrame:
    """words free of events."""
    return I.anti_overlap(role(spark, d, "view").select("rec_id", "word_id", "st", "en"), role(spark, d, "error"), K).select("rec_id", "word_id")


@query(f"{W} SELECT p.rec_id, p.word_id, p.st AS at, min(i.word_id) AS holder, count(i.word_id) AS holders FROM words p LEFT JOIN words i ON i.rec_id = p.rec_id AND i.text = 'purchase' AND i.st <= p.st AND p.st < i.en WHERE p.text = 'signup' GROUP BY p.rec_id, p.word_id, p.st")
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    """the interval that holds a point, with the number of holders to check that it is one."""
    spans = role(spark, d, "purchase").select("rec_id", "st", "en", F.col("word_id").alias("h"))
    out = I.points_in(role(spark, d, "signup").select("rec_id", "word_id", F.col("st").alias("at")), "at", ["word_id"], spans, K, ["h"])
    return out.groupBy("rec_id", "word_id", "at").agg(F.min("h").alias("holder"), F.count("h").alias("holders"))


@query(f"""{W}, p AS (SELECT rec_id, word_id, st FROM words WHERE text = 'signup'), t AS (SELECT DISTINCT rec_id, st AS q FROM words WHERE text = 'view'),
  r AS (SELECT p.rec_id, p.word_id, p.st, t.q, row_number() OVER (PARTITION BY p.rec_id, p.word_id ORDER BY abs(p.st - t.q), t.q) AS n FROM p LEFT JOIN t ON p.rec_id = t.rec_id) SELECT rec_id, word_id, st, q AS nearest FROM r WHERE n = 1""")
def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    """the nearest target of each point, the earlier one of equals."""
    p = role(spark, d, "signup").select("rec_id", "word_id", "st")
    return I.nearest(p, role(spark, d, "view").select("rec_id", F.col("st").alias("q")).distinct(), K, "st", "q", "nearest")


@query(f"""{W}, a AS (SELECT rec_id, word_id, text, row_number() OVER (PARTITION BY rec_id ORDER BY word_id) AS pos FROM words WHERE text = 'view'), b AS (SELECT rec_id, word_id, row_number() OVER (PARTITION BY rec_id ORDER BY word_id) AS pos FROM words WHERE text = 'click')
  SELECT coalesce(a.rec_id, b.rec_id) AS rec_id, CAST(coalesce(a.pos, b.pos) - 1 AS INTEGER) AS pos, a.word_id AS left_id, b.word_id AS right_id FROM a FULL JOIN b ON a.rec_id = b.rec_id AND a.pos = b.pos""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """two ordered lists joined by place; a missing partner shows as null."""
    w = Window.partitionBy("rec_id").orderBy("word_id")
    side = lambda kind, name: role(spark, d, kind).select("rec_id", (F.row_number().over(w) - 1).alias("pos"), F.col("word_id").alias(name))
    return side("view", "left_id").join(side("click", "right_id"), ["rec_id", "pos"], "full")


@query(f"""{W}, k AS (SELECT *, CAST(sum(en - st) OVER (PARTITION BY rec_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) - (en - st) AS BIGINT) AS o FROM words WHERE text = 'view')
  SELECT e.rec_id, e.word_id, k.word_id AS segment_id, k.o + greatest(e.st, k.st) - k.st AS out_st, k.o + least(e.en, k.en) - k.st AS out_en FROM words e JOIN k ON e.rec_id = k.rec_id AND e.text = 'error' AND greatest(e.st, k.st) < least(e.en, k.en)""")
def source_to_output_map(spark: SparkSession, d: str) -> DataFrame:
    """where events land in the output, through the segments that keep them."""
    kept = I.cursor(role(spark, d, "view"), K, "word_id").select("rec_id", "st", "en", F.col("word_id").alias("segment_id"), F.col("st").alias("s0"), "out_st")
    hits = I.overlap_join(role(spark, d, "error").select("rec_id", "word_id", "st", "en"), kept.withColumnRenamed("out_st", "o0"), K, carry=["segment_id", "s0", "o0"])
    return hits.select("rec_id", "word_id", "segment_id", (F.col("o0") + F.col("o_st") - F.col("s0")).alias("out_st"), (F.col("o0") + F.col("o_en") - F.col("s0")).alias("out_en"))


@query(f"{W}, j AS (SELECT rec_id, word_id, text FROM words WHERE text IN ('view', 'click')), r AS (SELECT rec_id, word_id, st FROM words WHERE text = 'view' AND word_id % 3 <> 0) SELECT j.rec_id, j.word_id, coalesce(r.st, -1) AS st, CASE WHEN r.st IS NULL THEN 'missing' ELSE 'ok' END AS status FROM j LEFT JOIN r USING (rec_id, word_id)")
def left_join_default(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their results; a missing one becomes a status row."""
    jobs = words(spark, d).where("text in ('view', 'click')").select("rec_id", "word_id")
    results = role(spark, d, "view").where("word_id % 3 <> 0").select("rec_id", "word_id", "st")
    return jobs.join(results, ["rec_id", "word_id"], "left").select("rec_id", "word_id", F.coalesce("st", F.lit(-1)).alias("st"), F.when(F.col("st").isNull(), "missing").otherwise("ok").alias("status"))


@query(f"{W}, r AS (SELECT rec_id, word_id AS owner, unnest(range(word_id, word_id + 3)) AS id FROM words WHERE text = 'signup') SELECT rec_id, id, min(owner) AS owner, count(*) AS owners FROM r GROUP BY rec_id, id")
def word_owners(spark: SparkSession, d: str) -> DataFrame:
    """which range owns each word; more than one owner is a violation that shows in ``owners``."""
    r = role(spark, d, "signup").select("rec_id", F.col("word_id").alias("owner"), F.explode(F.sequence("word_id", F.col("word_id") + 2)).alias("id"))
    return r.groupBy("rec_id", "id").agg(F.min("owner").alias("owner"), F.count("*").alias("owners"))


@query(f"{W}, p AS (SELECT rec_id, CAST(word_id // 4 AS INTEGER) AS parent, word_id, text FROM words) SELECT rec_id, parent, count(*) AS parts, string_agg(text, ' ' ORDER BY word_id) AS joined FROM p GROUP BY rec_id, parent")
def recombine_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts joined under their parent, in order."""
    listed = F.array_sort(F.collect_list(F.struct("word_id", "text")))
    return words(spark, d).groupBy("rec_id", F.floor(F.col("word_id") / 4).cast("int").alias("parent")).agg(F.count("*").alias("parts"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("joined"))


@query(f"{W}, l AS (SELECT *, lag(text) OVER (PARTITION BY rec_id ORDER BY word_id) AS before FROM words), b AS (SELECT rec_id, word_id, st, 'in' AS edge FROM words WHERE text = 'signup' UNION ALL SELECT rec_id, word_id, en, 'out' FROM words WHERE text = 'click') SELECT i.rec_id, i.word_id, string_agg(b.edge || ':' || b.st, ',' ORDER BY b.st, b.edge) AS fades FROM l i JOIN b ON i.rec_id = b.rec_id AND (b.word_id = i.word_id - 1 OR b.word_id = i.word_id + 1) WHERE i.text = 'view' GROUP BY i.rec_id, i.word_id")
def interval_fades(spark: SparkSession, d: str) -> DataFrame:
    """an interval with the fades of both its neighbours, from two lookups, in order."""
    w = words(spark, d)
    fades = w.where("text = 'signup'").select("rec_id", F.col("word_id").alias("b"), F.col("st").alias("at"), F.lit("in").alias("edge")).unionByName(w.where("text = 'click'").select("rec_id", F.col("word_id").alias("b"), F.col("en").alias("at"), F.lit("out").alias("edge")))
    need = w.where("text = 'view'").select("rec_id", "word_id", F.explode(F.array(F.col("word_id") - 1, F.col("word_id") + 1)).alias("b"))
    listed = F.array_sort(F.collect_list(F.struct("at", "edge")))
    return need.join(fades, ["rec_id", "b"]).groupBy("rec_id", "word_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["edge"], F.lit(":"), x["at"].cast("string"))), ",").alias("fades"))


# --- aggregates ------------------------------------------------------------------------


@query("SELECT user_id AS rec_id, round(quantile_cont(20 * log10(greatest(value / 100, 1e-10)), 0.12), 6) AS noise_floor_db, round(greatest(-56, least(-34, quantile_cont(20 * log10(greatest(value / 100, 1e-10)), 0.12) + 17)), 6) AS threshold_db, round(median(value), 6) AS median_value, round(var_pop(value), 4) AS var_value FROM events GROUP BY user_id")
def noise_floor_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentile, clipped threshold, median and population variance."""
    from spanloom.functions import numeric as N
    from spanloom.operators.frames import noise_floor

    e = table(spark, d, "events").select(F.col("user_id").alias("rec_id"), "value", N.db(F.col("value") / 100, 1e-10).alias("db"))
    stats = e.groupBy("rec_id").agg(F.round(F.median("value"), 6).alias("median_value"), F.round(F.var_pop("value"), 4).alias("var_value"))
    return noise_floor(e, ["rec_id"], "db").select("rec_id", F.round("noise_floor_db", 6).alias("noise_floor_db"), F.round("threshold_db", 6).alias("threshold_db")).join(stats, "rec_id")


@query(f"""{W}, r AS (SELECT a.rec_id, a.word_id, b.value AS score, row_number() OVER (PARTITION BY a.rec_id, a.word_id ORDER BY abs(b.word_id - a.word_id), b.word_id) AS n FROM words a JOIN words b ON a.rec_id = b.rec_id AND a.text = 'signup' AND b.text = 'view' AND abs(b.word_id - a.word_id) <= 20)
  SELECT rec_id, word_id, count(*) AS n, round(median(score), 6) AS context_median, round(min(score), 6) AS edge_min FROM r WHERE n <= 8 GROUP BY rec_id, word_id""")
def edge_support(spark: SparkSession, d: str) -> DataFrame:
    """Median and minimum of the eight nearest scores around an edge."""
    a = role(spark, d, "signup").select("rec_id", "word_id", F.greatest(F.col("word_id") - 20, F.lit(0)).cast("long").alias("st"), (F.col("word_id") + 21).cast("long").alias("en"))
    b = role(spark, d, "view").select("rec_id", F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 1).cast("long").alias("en"), F.col("word_id").alias("other"), F.col("value").alias("score"))
    near = I.overlap_join(a, b, K, carry=["other", "score"], width=64)
    w = Window.partitionBy("rec_id", "word_id").orderBy(F.abs(F.col("other") - F.col("word_id")), "other")
    return near.withColumn("n", F.row_number().over(w)).where("n <= 8").groupBy("rec_id", "word_id").agg(F.count("*").alias("n"), F.round(F.median("score"), 6).alias("context_median"), F.round(F.min("score"), 6).alias("edge_min"))


@query(f"{W} SELECT rec_id, count(*) AS words, count(*) FILTER (text = 'error') AS unsupported, count(*) FILTER (text = 'view') AS selected, sum(CASE WHEN text = 'signup' THEN 1 ELSE 0 END) AS retries, count(DISTINCT text) AS kinds, NOT bool_or(text = 'error') AS plan_accepted, CASE WHEN bool_or(text = 'error') THEN 'fallback' WHEN bool_or(text = 'signup') THEN 'retried' ELSE 'complete' END AS status FROM words GROUP BY rec_id")
def grounding_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts, acceptance, and status by priority."""
    status = F.when(F.bool_or(F.expr("text = 'error'")), "fallback").when(F.bool_or(F.expr("text = 'signup'")), "retried").otherwise("complete")
    return words(spark, d).groupBy("rec_id").agg(F.count("*").alias("words"), F.count_if(F.expr("text = 'error'")).alias("unsupported"), F.count_if(F.expr("text = 'view'")).alias("selected"), F.sum(F.when(F.col("text") == "signup", 1).otherwise(0)).alias("retries"), F.count_distinct("text").alias("kinds"), (~F.bool_or(F.expr("text = 'error'"))).alias("plan_accepted"), status.alias("status"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1, 2")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status with a condition."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.expr("o_totalprice > 200000")).alias("large"))


@query(f"{W}, r AS (SELECT rec_id, CAST(word_id // 5 AS INTEGER) AS event, CASE text WHEN 'error' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS pri, text, st, en FROM words) SELECT rec_id, event, count(*) AS fragments, min(st) AS st, max(en) AS en, CASE max(pri) WHEN 3 THEN 'error' WHEN 2 THEN 'click' WHEN 1 THEN 'view' ELSE 'other' END AS status FROM r GROUP BY rec_id, event")
def event_priority_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One record per event, its status the one of highest priority."""
    pri = F.when(F.col("text") == "error", 3).when(F.col("text") == "click", 2).when(F.col("text") == "view", 1).otherwise(0)
    name = F.when(pri > 0, F.col("text")).otherwise("other")
    return words(spark, d).groupBy("rec_id", F.floor(F.col("word_id") / 5).cast("int").alias("event")).agg(F.count("*").alias("fragments"), F.min("st").alias("st"), F.max("en").alias("en"), F.max_by(name, pri).alias("status"))


@query()
def weighted_event_merge(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping events merged with order-dependent weights."""
    e = words(spark, d).where("st < en").select("rec_id", "st", "en", F.col("value").alias("mean_p"), F.col("value").alias("max_p"))
    out = A.merge_weighted(e, K)
    return out.select("rec_id", "st", "en", F.round("mean_p", 6).alias("mean_p"), F.round("max_p", 6).alias("max_p"), "n_fragments")


@query("SELECT c.c_custkey AS candidate, count(o.o_orderkey) AS uses, count(o.o_orderkey) > 1 AS reused FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1")
def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Uses of every candidate, none included."""
    used = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("candidate")).agg(F.count("*").alias("n"))
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate")).join(used, "candidate", "left")
    return out.select("candidate", F.coalesce("n", F.lit(0)).alias("uses"), (F.coalesce("n", F.lit(0)) > 1).alias("reused"))


@query(f"{W} SELECT rec_id, CAST(word_id // 12 AS INTEGER) AS thought, min(word_id) AS first_id, max(word_id) AS last_id, arg_min(st, word_id) AS st, arg_max(en, word_id) AS en FROM words GROUP BY 1, 2")
def thought_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of each thought by its first and last word."""
    return words(spark, d).groupBy("rec_id", F.floor(F.col("word_id") / 12).cast("int").alias("thought")).agg(F.min("word_id").alias("first_id"), F.max("word_id").alias("last_id"), F.min_by("st", "word_id").alias("st"), F.max_by("en", "word_id").alias("en"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys met more than once."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Rows not yet in the table of finished keys."""
    e = table(spark, d, "events")
    done = e.where("event_id % 3 = 0").select("event_id")
    return e.join(done, "event_id", "left_anti").select("event_id", micros("ts").alias("us"))


# --- validators --------------------------------------------------------------------------


@query(f"""{W}, l AS (SELECT *, lag(en) OVER w AS p, lag(word_id) OVER w AS pid FROM words WINDOW w AS (PARTITION BY rec_id ORDER BY word_id))
  SELECT 'starts_before_previous_end' AS rule, rec_id, word_id FROM l WHERE st < p UNION ALL SELECT 'empty_interval', rec_id, word_id FROM l WHERE en <= st UNION ALL SELECT 'id_gap', rec_id, word_id FROM l WHERE word_id - pid <> 1 UNION ALL SELECT 'unknown_kind', rec_id, word_id FROM l WHERE text NOT IN ('view', 'click', 'error', 'signup')""")
def plan_violations(spark: SparkSession, d: str) -> DataFrame:
    """Each rule's violations as rows; an empty result is a valid plan."""
    from spanloom.operators.validate import violations

    w = Window.partitionBy("rec_id").orderBy("word_id")
    df = words(spark, d).withColumn("p", F.lag("en").over(w)).withColumn("pid", F.lag("word_id").over(w))
    rules = {"starts_before_previous_end": F.col("st") < F.col("p"), "empty_interval": F.col("en") <= F.col("st"), "id_gap": F.col("word_id") - F.col("pid") != 1, "unknown_kind": ~F.col("text").isin("view", "click", "error", "signup")}
    return violations(df, rules, ["rec_id", "word_id"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, array_to_string(list_sort(json_keys(props)), ',') = 'k' AS exact_keys FROM events")
def json_exact_keys(spark: SparkSession, d: str) -> DataFrame:
    """Parsed fields and equality of the key set."""
    from spanloom.operators.validate import exact_keys

    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), exact_keys(F.col("props"), ["k"]).alias("exact_keys"))


@query(f"""{W}, p AS (SELECT a.rec_id, a.word_id, min(b.word_id) AS retry_id FROM words a JOIN words b ON a.rec_id = b.rec_id AND a.text = b.text AND b.word_id BETWEEN a.word_id + 1 AND a.word_id + 4 WHERE length(a.text) >= 5 GROUP BY 1, 2) SELECT rec_id, word_id, retry_id FROM p""")
def nearby_retry(spark: SparkSession, d: str) -> DataFrame:
    """A word said again within the next four."""
    w = Window.partitionBy("rec_id").orderBy("word_id")
    again = F.coalesce(*[F.when(F.lead("text", k).over(w) == F.col("text"), F.lead("word_id", k).over(w)) for k in range(1, 5)])
    return words(spark, d).withColumn("retry_id", again).where("length(text) >= 5 and retry_id is not null").select("rec_id", "word_id", "retry_id")


@query(f"""{W} SELECT a.rec_id, a.word_id, string_agg(b.text, ' ' ORDER BY b.word_id) AS nearby FROM words a JOIN words b ON a.rec_id = b.rec_id AND b.word_id BETWEEN a.word_id AND a.word_id + 2 WHERE a.text = 'error' GROUP BY 1, 2""")
def nearby_words(spark: SparkSession, d: str) -> DataFrame:
    """The words that an error message names."""
    w = Window.partitionBy("rec_id").orderBy("word_id").rowsBetween(0, 2)
    return words(spark, d).withColumn("nearby", F.array_join(F.collect_list("text").over(w), " ")).where("text = 'error'").select("rec_id", "word_id", "nearby")


@query("SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Content identity over JSON with fixed key order."""
    from spanloom.functions.numeric import fingerprint

    return table(spark, d, "orders").select("o_orderkey", fingerprint("o_orderkey", "o_orderstatus").alias("fingerprint"))


@query("""WITH h AS (SELECT o_orderkey AS id, sha256(o_orderstatus) AS now, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) AS saved FROM orders) SELECT id, now = saved AS is_current FROM h""")
def stage_freshness(spark: SparkSession, d: str) -> DataFrame:
    """A stage is current when its saved input hash equals the input's."""
    from spanloom.operators.validate import is_current

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2("o_orderstatus", 256).alias("now"), F.sha2(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), 256).alias("saved"))
    return is_current(o.select("id", "now"), o.select("id", "saved"), ["id"])
