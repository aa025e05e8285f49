"""Queries over interval sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import intervals as I
from spanloom.sources.adapters import WORDS_SQL, role, words
from spanloom.plans.catalog import query

K = ["rec_id"]
ISLANDS = """marked AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY rec_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {src} WHERE st < en),
  isl AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM marked)"""
MERGE = "SELECT rec_id, min(st) AS st, max(en) AS en FROM ({islands}) GROUP BY rec_id, g"


def union_sql(name: str, where: str) -> str:
    """CTEs that end in ``name``: the union of some words."""
    return f"""{name}_m AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY rec_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM words WHERE st < en AND {where}),
  {name}_i AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m),
  {name} AS (SELECT rec_id, min(st) AS st, max(en) AS en FROM {name}_i GROUP BY rec_id, g)"""


def subtract_sql(name: str, a: str, b: str, ident: str) -> str:
    """CTEs that end in ``name``: a minus the disjoint intervals b."""
    return f"""{name}_c AS (SELECT a.rec_id, a.{ident}, greatest(a.st, b.st) AS c FROM {a} a JOIN {b} b ON a.rec_id = b.rec_id AND a.st < b.en AND b.st < a.en
     UNION SELECT a.rec_id, a.{ident}, least(a.en, b.en) FROM {a} a JOIN {b} b ON a.rec_id = b.rec_id AND a.st < b.en AND b.st < a.en
     UNION SELECT rec_id, {ident}, st FROM {a} WHERE st < en UNION SELECT rec_id, {ident}, en FROM {a} WHERE st < en),
  {name}_p AS (SELECT rec_id, {ident}, c AS st, lead(c) OVER (PARTITION BY rec_id, {ident} ORDER BY c) AS en FROM {name}_c),
  {name} AS (SELECT p.* FROM {name}_p p WHERE en IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} b WHERE b.rec_id = p.rec_id AND b.st < p.en AND p.st < b.en))"""


@query(f"WITH {WORDS_SQL} SELECT rec_id, word_id, text, st, en FROM words")
def word_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A3, A4: the ordered ledger with dense ids."""
    return words(spark, d).select("rec_id", "word_id", "text", "st", "en")


@query(f"WITH {WORDS_SQL}, l AS (SELECT *, lag(en) OVER (PARTITION BY rec_id ORDER BY word_id) AS prev_en FROM words) SELECT rec_id, word_id, st, prev_en FROM l WHERE st < prev_en")
def ledger_chronology_violations(spark: SparkSession, d: str) -> DataFrame:
    """Words that begin before the word before them ended."""
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id").orderBy("word_id")
    return words(spark, d).withColumn("prev_en", F.lag("en").over(w)).where("st < prev_en").select("rec_id", "word_id", "st", "prev_en")


@query(f"WITH {WORDS_SQL}, {union_sql('u', 'true')} SELECT rec_id, st, en FROM u")
def merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Union of overlapping or touching spans."""
    return I.merge_overlapping(words(spark, d), K).select("rec_id", "st", "en")


def _touching(spark: SparkSession, d: str) -> DataFrame:
    """Word ranges [id, id + 1) of every word but the errors: many touch."""
    return words(spark, d).where("text <> 'error'").select("rec_id", F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 1).cast("long").alias("en"))


TOUCH = "r AS (SELECT rec_id, CAST(word_id AS BIGINT) AS st, CAST(word_id + 1 AS BIGINT) AS en FROM words WHERE text <> 'error')"


@query(f"""WITH {WORDS_SQL}, {TOUCH}, m AS (SELECT *, CASE WHEN st = lag(en) OVER (PARTITION BY rec_id ORDER BY st, en) THEN 0 ELSE 1 END AS nw FROM r),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT rec_id, min(st) AS st, max(en) AS en, count(*) AS n FROM g GROUP BY rec_id, k""")
def merge_touching(spark: SparkSession, d: str) -> DataFrame:
    """Ranges that touch exactly become one."""
    return I.merge_touching(_touching(spark, d), K, [F.count("*").alias("n")]).select("rec_id", "st", "en", "n")


@query(f"""WITH {WORDS_SQL}, m AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY rec_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM words WHERE st < en),
  i AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM m)
  SELECT rec_id, min(st) AS st, max(en) AS en, string_agg(DISTINCT text, ',' ORDER BY text) AS kinds, count(*) AS n FROM i GROUP BY rec_id, g""")
def union_with_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Unions with the sorted set of what made them."""
    kinds = F.array_join(F.array_sort(F.collect_set("text")), ",").alias("kinds")
    return I.merge_overlapping(words(spark, d), K, [kinds, F.count("*").alias("n")]).select("rec_id", "st", "en", "kinds", "n")


BOUNDS = "bounds AS (SELECT rec_id, min(st) - 1000000 AS lo, max(en) + 1000000 AS hi FROM words GROUP BY rec_id)"


def _bounds(w: DataFrame) -> DataFrame:
    return w.groupBy("rec_id").agg((F.min("st") - 1_000_000).alias("lo"), (F.max("en") + 1_000_000).alias("hi"))


@query(f"""WITH {WORDS_SQL}, {BOUNDS}, {union_sql('u', 'true')},
  e AS (SELECT rec_id, st, en FROM u UNION ALL SELECT rec_id, lo, lo FROM bounds UNION ALL SELECT rec_id, hi, hi FROM bounds),
  g AS (SELECT rec_id, lag(en) OVER (PARTITION BY rec_id ORDER BY st, en) AS st, st AS en FROM e)
  SELECT rec_id, st, en FROM g WHERE st < en""")
def complement_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What no span covers."""
    w = words(spark, d)
    return I.complement(I.merge_overlapping(w, K), _bounds(w), K)


@query(f"WITH {WORDS_SQL}, a AS (SELECT rec_id, word_id, st, en FROM words WHERE text = 'view'), {union_sql('b', chr(39).join(['text = ', 'error', '']))}, {subtract_sql('s', 'a', 'b', 'word_id')} SELECT rec_id, word_id, st, en FROM s")
def subtract_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Retained spans without nuisance events."""
    return I.subtract(role(spark, d, "view").select("rec_id", "word_id", "st", "en"), role(spark, d, "error"), K, "word_id")


@query(f"""WITH {WORDS_SQL}, a AS (SELECT rec_id, word_id, st, en FROM words WHERE text = 'purchase' AND st < en), b AS (SELECT rec_id, st, en, text FROM words WHERE text IN ('error', 'click') AND st < en),
  c AS (SELECT a.rec_id, a.word_id, greatest(a.st, b.st) AS c FROM a JOIN b ON a.rec_id = b.rec_id AND a.st < b.en AND b.st < a.en UNION
        SELECT a.rec_id, a.word_id, least(a.en, b.en) FROM a JOIN b ON a.rec_id = b.rec_id AND a.st < b.en AND b.st < a.en UNION SELECT rec_id, word_id, st FROM a UNION SELECT rec_id, word_id, en FROM a),
  p AS (SELECT rec_id, word_id, c AS st, lead(c) OVER (PARTITION BY rec_id, word_id ORDER BY c) AS en FROM c)
  SELECT p.rec_id, p.word_id, p.st, p.en, coalesce(string_agg(DISTINCT b.text, ',' ORDER BY b.text), '') AS reasons FROM p LEFT JOIN b ON b.rec_id = p.rec_id AND b.st < p.en AND p.st < b.en
  WHERE p.en IS NOT NULL GROUP BY ALL""")
def segment_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Silences cut at every exclusion's edge, with sorted reasons; pieces are never joined again."""
    a = role(spark, d, "purchase").select("rec_id", "word_id", "st", "en")
    b = role(spark, d, "error", "click").select("rec_id", "st", "en", "text")
    out = I.segment_with_reasons(a, b, K, "word_id", "text")
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {WORDS_SQL}, {BOUNDS}, {union_sql('kept', "text = 'view'")}, {union_sql('mask', "text IN ('click', 'signup')")},
  a AS (SELECT rec_id, st AS iv, st, en FROM kept), {subtract_sql('free', 'a', 'mask', 'iv')},
  pts AS (SELECT rec_id, st AS p FROM words WHERE text = 'error'),
  cut AS (SELECT rec_id, iv, st AS c, st, en FROM free UNION SELECT f.rec_id, f.iv, p.p, f.st, f.en FROM free f JOIN pts p ON p.rec_id = f.rec_id AND f.st < p.p AND p.p < f.en),
  out AS (SELECT rec_id, iv, c AS st, coalesce(lead(c) OVER (PARTITION BY rec_id, iv, st, en ORDER BY c), en) AS en FROM cut)
  SELECT rec_id, iv, st, en FROM out""")
def editable_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Kept intervals without protected spans, split at insertion points."""
    kept = I.merge_overlapping(role(spark, d, "view"), K).withColumn("iv", F.col("st"))
    free = I.subtract(kept, role(spark, d, "click", "signup"), K, "iv")
    points = role(spark, d, "error").select("rec_id", F.col("st").alias("p"))
    inside = I.overlap_join(free, points.select("rec_id", F.col("p").alias("st"), (F.col("p") + 1).alias("en"), "p"), K, carry=["p"]).where("st < p and p < en")
    cuts = inside.select("rec_id", "iv", "st", "en", F.col("p").alias("c")).unionByName(free.select("rec_id", "iv", "st", "en", F.col("st").alias("c"))).distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id", "iv", "st", "en").orderBy("c")
    return cuts.select("rec_id", "iv", F.col("c").alias("st"), F.coalesce(F.lead("c").over(w), F.col("en")).alias("en"))


@query(f"WITH {WORDS_SQL}, {union_sql('sil', chr(39).join(['text = ', 'purchase', '']))}, a AS (SELECT rec_id, st AS iv, st, en FROM sil), {union_sql('sp', chr(39).join(['text <> ', 'purchase', '']))}, {subtract_sql('s', 'a', 'sp', 'iv')} SELECT rec_id, st, en FROM s")
def silence_minus_speech(spark: SparkSession, d: str) -> DataFrame:
    """Silence spans that no speech overlaps."""
    silence = I.merge_overlapping(role(spark, d, "purchase"), K).withColumn("iv", F.col("st"))
    speech = words(spark, d).where("text <> 'purchase'")
    return I.merge_overlapping(I.subtract(silence, speech, K, "iv"), K).select("rec_id", "st", "en")


@query(f"""WITH {WORDS_SQL}, a AS (SELECT rec_id, word_id, st, en FROM words WHERE text = 'error' AND st < en), {union_sql('b', "text = 'signup'")}, {subtract_sql('s', 'a', 'b', 'word_id')},
  f AS (SELECT rec_id, word_id, count(*) AS n, sum(en - st) AS kept FROM s GROUP BY rec_id, word_id)
  SELECT a.rec_id, a.word_id, coalesce(f.n, 0) AS fragments, CAST(coalesce(f.kept, 0) AS BIGINT) AS kept, f.n IS NULL AS covered FROM a LEFT JOIN f ON a.rec_id = f.rec_id AND a.word_id = f.word_id""")
def event_fragments(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each event, and the events wholly covered."""
    a = role(spark, d, "error").where("st < en").select("rec_id", "word_id", "st", "en")
    parts = I.subtract(a, role(spark, d, "signup"), K, "word_id").groupBy("rec_id", "word_id").agg(F.count("*").alias("n"), F.sum(F.col("en") - F.col("st")).alias("kept"))
    return a.join(parts, ["rec_id", "word_id"], "left").select("rec_id", "word_id", F.coalesce("n", F.lit(0)).alias("fragments"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.col("n").isNull().alias("covered"))


@query(f"""WITH {WORDS_SQL}, s AS (SELECT rec_id, word_id, st, en, CASE WHEN en - st <= 30000000 THEN 0 ELSE CAST(ceil((en - st - 30000000) / 28000000.0) AS BIGINT) END AS n FROM words WHERE st < en),
  c AS (SELECT *, unnest(range(0, n + 1)) AS chunk FROM s) SELECT rec_id, word_id, chunk, st + chunk * 28000000 AS c_st, least(en, st + chunk * 28000000 + 30000000) AS c_en FROM c""")
def split_long_spans(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of thirty seconds that overlap by two; some 535 rows a word, so Parquet gets them as differences."""
    from spanloom.sources.sinks import as_differences

    as_differences(spark, "chunk", "c_st", "c_en")
    return I.split_long(words(spark, d).where("st < en"), 30_000_000, 2_000_000).select("rec_id", "word_id", "chunk", "c_st", "c_en")


@query("SELECT conv_id AS rec_id, CAST(floor(turn / 39) AS BIGINT) AS batch, min(turn) AS first_turn, max(turn) + 1 AS last_turn, count(*) AS transitions FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL GROUP BY 1, 2")
def pause_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of forty thoughts that overlap by one, so that each transition is in exactly one."""
    from pyspark.sql import Window

    from spanloom.sources.adapters import thoughts

    w = Window.partitionBy("rec_id").orderBy("idx")
    t = thoughts(spark, d).withColumn("nxt", F.lead("idx").over(w)).where("nxt is not null")
    return t.groupBy("rec_id", F.floor(F.col("idx") / 39).cast("long").alias("batch")).agg(F.min("idx").alias("first_turn"), (F.max("idx") + 1).alias("last_turn"), F.count("*").alias("transitions"))


@query(f"WITH {WORDS_SQL}, g AS (SELECT rec_id, word_id, word_id - row_number() OVER (PARTITION BY rec_id ORDER BY word_id) AS k FROM words WHERE text <> 'click') SELECT rec_id, CAST(min(word_id) AS BIGINT) AS st, CAST(max(word_id) + 1 AS BIGINT) AS en FROM g GROUP BY rec_id, k")
def ids_to_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Id sets as ranges."""
    return I.ids_to_ranges(words(spark, d).where("text <> 'click'"), K, "word_id")


@query(f"WITH {WORDS_SQL}, r AS (SELECT rec_id, CAST(word_id AS BIGINT) AS st, CAST(word_id + 3 AS BIGINT) AS en FROM words WHERE text = 'signup') SELECT DISTINCT rec_id, unnest(range(st, en)) AS id FROM r")
def ranges_to_ids(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping ranges as an id set."""
    r = role(spark, d, "signup").select("rec_id", F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 3).cast("long").alias("en"))
    return I.ranges_to_ids(r, K, "id")


@query(f"""WITH {WORDS_SQL}, a AS (SELECT DISTINCT rec_id, word_id AS id FROM words WHERE text <> 'error'), b AS (SELECT DISTINCT rec_id, word_id AS id FROM words WHERE text IN ('view', 'click', 'error')),
  j AS (SELECT coalesce(a.rec_id, b.rec_id) AS rec_id, a.id IS NOT NULL AS ia, b.id IS NOT NULL AS ib FROM a FULL JOIN b ON a.rec_id = b.rec_id AND a.id = b.id)
  SELECT rec_id, count(*) FILTER (ia AND ib) AS both_n, count(*) FILTER (ia AND NOT ib) AS only_a, count(*) FILTER (ib AND NOT ia) AS only_b, bool_and(NOT ia OR ib) AS a_subset, NOT bool_or(ia AND ib) AS is_disjoint FROM j GROUP BY rec_id""")
def id_set_tests(spark: SparkSession, d: str) -> DataFrame:
    """Subset, difference and disjointness of id sets, in one pass over both."""
    w = words(spark, d)
    a = w.where("text <> 'error'").select("rec_id", "word_id", F.lit(1).alias("a"))
    b = w.where("text in ('view', 'click', 'error')").select("rec_id", "word_id", F.lit(1).alias("b"))
    j = a.unionByName(b, True).groupBy("rec_id", "word_id").agg(F.max("a").isNotNull().alias("ia"), F.max("b").isNotNull().alias("ib"))
    return j.groupBy("rec_id").agg(F.count_if(F.expr("ia and ib")).alias("both_n"), F.count_if(F.expr("ia and not ib")).alias("only_a"), F.count_if(F.expr("ib and not ia")).alias("only_b"), F.bool_and(F.expr("not ia or ib")).alias("a_subset"), (~F.bool_or(F.expr("ia and ib"))).alias("is_disjoint"))


@query(f"""WITH {WORDS_SQL} SELECT rec_id, st - 30000 AS st, en + 30000 AS en, 'event' AS reason FROM words WHERE text = 'error'
  UNION ALL SELECT rec_id, st, en, 'phone' FROM words WHERE text = 'click' UNION ALL SELECT rec_id, st - 1, st + 1, 'cut' FROM words WHERE text = 'signup'""")
def exclusion_union(spark: SparkSession, d: str) -> DataFrame:
    """Exclusions of several kinds, each with its reason."""
    w = words(spark, d)
    event = w.where("text = 'error'").select("rec_id", (F.col("st") - 30_000).alias("st"), (F.col("en") + 30_000).alias("en"), F.lit("event").alias("reason"))
    phone = w.where("text = 'click'").select("rec_id", "st", "en", F.lit("phone").alias("reason"))
    cut = w.where("text = 'signup'").select("rec_id", (F.col("st") - 1).alias("st"), (F.col("st") + 1).alias("en"), F.lit("cut").alias("reason"))
    return event.unionByName(phone).unionByName(cut)


@query(f"""WITH {WORDS_SQL}, runs AS (SELECT rec_id, word_id, st, en FROM words WHERE text = 'purchase' AND st < en), {union_sql('ok', "text IN ('view', 'signup')")}, {union_sql('bad', "text = 'error'")},
  a AS (SELECT r.rec_id, r.word_id, greatest(r.st, k.st) AS st, least(r.en, k.en) AS en FROM runs r JOIN ok k ON k.rec_id = r.rec_id AND r.st < k.en AND k.st < r.en),
  c AS (SELECT a.rec_id, a.word_id, a.st AS p, greatest(a.st, b.st) AS c FROM a JOIN bad b ON a.rec_id = b.rec_id AND a.st < b.en AND b.st < a.en UNION
        SELECT a.rec_id, a.word_id, a.st, least(a.en, b.en) FROM a JOIN bad b ON a.rec_id = b.rec_id AND a.st < b.en AND b.st < a.en UNION SELECT rec_id, word_id, st, st FROM a UNION SELECT rec_id, word_id, st, en FROM a),
  q AS (SELECT rec_id, word_id, c AS st, lead(c) OVER (PARTITION BY rec_id, word_id, p ORDER BY c) AS en FROM c)
  SELECT rec_id, word_id, st, en FROM q WHERE en IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.rec_id = q.rec_id AND b.st < q.en AND q.st < b.en)""")
def room_tone_runs(spark: SparkSession, d: str) -> DataFrame:
    """Quiet runs inside allowed spans and outside exclusions."""
    runs = role(spark, d, "purchase").select("rec_id", "word_id", "st", "en")
    inside = I.overlap_join(runs, I.merge_overlapping(role(spark, d, "view", "signup"), K), K).select("rec_id", "word_id", F.col("o_st").alias("st"), F.col("o_en").alias("en"))
    tagged = inside.withColumn("part", F.struct("word_id", "st"))
    return I.subtract(tagged.select("rec_id", "part", "st", "en"), role(spark, d, "error"), K, "part").select("rec_id", "part.word_id", "st", "en")


SESSION = """s AS (SELECT *, CASE WHEN st - lag(en) OVER (PARTITION BY rec_id ORDER BY st, en) > 3600000000 THEN 1 ELSE 0 END AS nw FROM words),
  i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY rec_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s)"""


@query(f"WITH {WORDS_SQL}, {SESSION} SELECT rec_id, island, min(st) - 400000 AS st, max(en) + 400000 AS en, count(*) AS n, count(*) FILTER (text = 'signup') AS roles FROM i GROUP BY rec_id, island HAVING count(*) FILTER (text = 'signup') > 0")
def speech_islands(spark: SparkSession, d: str) -> DataFrame:
    """Islands split at long gaps; those with a role word are kept and padded."""
    out = I.sessions(words(spark, d), K, 3_600_000_000, [F.count_if(F.expr("text = 'signup'")).alias("roles")]).where("roles > 0")
    return out.select("rec_id", F.col("island").cast("long").alias("island"), (F.col("st") - 400_000).alias("st"), (F.col("en") + 400_000).alias("en"), "n", "roles")


FLAT = "flat AS (SELECT rec_id, word_id, text, st - st % 7200000000 AS st, CASE WHEN text IN ('click', 'view') THEN st - st % 7200000000 ELSE st - st % 7200000000 + 5 END AS en FROM words)"


@query(f"""WITH {WORDS_SQL}, {FLAT}, m AS (SELECT *, st = en AS f, CASE WHEN st = en AND lag(st = en) OVER w AND st = lag(st) OVER w THEN 0 ELSE 1 END AS nw FROM flat WINDOW w AS (PARTITION BY rec_id ORDER BY word_id)),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS k FROM m), z AS (SELECT *, count(*) OVER (PARTITION BY rec_id, k) AS n FROM g)
  SELECT rec_id, word_id, text, st, en FROM z WHERE NOT (f AND n >= 2)""")
def degenerate_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more zero-length words at one anchor are dropped."""
    st = F.col("st") - F.col("st") % 7_200_000_000
    flat = words(spark, d).select("rec_id", "word_id", "text", st.alias("st"), (st + F.when(F.col("text").isin("click", "view"), 0).otherwise(5)).alias("en"))
    return I.degenerate_runs(flat, K, "word_id", F.lit(True)).select("rec_id", "word_id", "text", "st", "en")


@query(f"WITH {WORDS_SQL} SELECT rec_id, word_id, CAST(sum(en - st) OVER (PARTITION BY rec_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) - (en - st) AS BIGINT) AS out_st, CAST(sum(en - st) OVER (PARTITION BY rec_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS out_en FROM words WHERE text = 'view'")
def output_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Output bounds of kept intervals laid end to end."""
    return I.cursor(role(spark, d, "view"), K, "word_id").select("rec_id", "word_id", "out_st", "out_en")


@query(f"WITH {WORDS_SQL} SELECT rec_id, word_id, lead(word_id) OVER w AS next_id, greatest(lead(st) OVER w - en, 0) AS gap FROM words WINDOW w AS (PARTITION BY rec_id ORDER BY word_id)")
def adjacent_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each word with its successor and the gap to it."""
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id").orderBy("word_id")
    return I.gaps(words(spark, d), K, "word_id").select("rec_id", "word_id", F.lead("word_id").over(w).alias("next_id"), F.when(F.col("next_st").isNotNull(), F.col("gap")).otherwise(0).alias("gap"))
