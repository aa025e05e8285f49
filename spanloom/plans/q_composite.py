"""Queries of rankings, allocation, boundary plans, streaming plans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import allocate as A
from spanloom.operators import frames as R
from spanloom.operators import intervals as I
from spanloom.plans import boundary as B
from spanloom.plans import enrich as N
from spanloom.plans.catalog import query
from spanloom.plans.q_intervals import K, subtract_sql, union_sql
from spanloom.sources import readers, sinks
from spanloom.sources.adapters import THOUGHTS_SQL, WORDS_SQL, role, signals, table, thoughts, words
from spanloom.streaming import planner as P

W = f"WITH {WORDS_SQL}"

METRICS_SQL = """m AS (SELECT rec_id, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS rms, list_max(list_transform(a, lambda x: abs(x))) AS peak, list_max(list_transform(range(2, len(a) + 1), lambda i: abs(a[i] - a[i - 1]))) AS step FROM (SELECT vec_id AS rec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings))"""


@query(f"WITH {METRICS_SQL} SELECT rec_id, array_to_string(list_filter([CASE WHEN 20 * log10(peak / rms) > 7.5 THEN 'excessive_crest_factor' END, CASE WHEN step > 0.42 THEN 'sample_discontinuity' END, CASE WHEN step / rms > 3.5 THEN 'sample_discontinuity' END], lambda x: x IS NOT NULL), ',') AS reasons, NOT (20 * log10(peak / rms) > 7.5 OR step > 0.42 OR step / rms > 3.5) AS accepted FROM m")
def ambience_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates with their reasons; a candidate is accepted when there is none."""
    m = signals(spark, d).select("rec_id", *R.metrics(F.col("samples")))
    limits = [("excessive_crest_factor", "crest_db", 7.5), ("sample_discontinuity", "max_step", 0.42), ("sample_discontinuity", "step_to_rms", 3.5)]
    g = m.withColumn("r", R.gate_reasons(m.columns, limits=limits))
    return g.select("rec_id", F.array_join(F.transform("r", lambda x: x["code"]), ",").alias("reasons"), (F.size("r") == 0).alias("accepted"))


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    req = role(spark, d, "signup").select("rec_id", F.col("word_id").alias("req"), F.col("st").alias("ref"), (F.floor(F.col("value") / 2).cast("long") * 2_000_000 + 1).alias("need"))
    cand = role(spark, d, "purchase").where("st < en").select("rec_id", F.col("word_id").cast("string").alias("candidate_id"), "st", "en", F.round(F.col("value") / 100, 2).alias("stationarity"), F.col("value").alias("level"))
    return req, cand


PAIRS = """req AS (SELECT rec_id, word_id AS req, st AS ref, CAST(floor(value / 2) AS BIGINT) * 2000000 + 1 AS need FROM words WHERE text = 'signup'), cand AS (SELECT rec_id, CAST(word_id AS VARCHAR) AS candidate_id, st, en, round(value / 100, 2) AS stationarity, value AS level FROM words WHERE text = 'purchase' AND st < en),
  ranked AS (SELECT q.rec_id, q.req, q.need, c.candidate_id, c.st, c.en, row_number() OVER (PARTITION BY q.rec_id, q.req ORDER BY floor(abs(c.level - 40) / 3), abs(c.level - 40), abs(floor((c.st + c.en) / 2) - q.ref), c.stationarity, c.st - c.en, c.st, c.candidate_id) AS rank FROM req q JOIN cand c USING (rec_id))"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    req, cand = _requests(spark, d)
    return A.rank(req.join(cand, "rec_id"), ["rec_id", "req"], F.col("ref"), F.abs(F.col("level") - 40))


@query(f"{W}, {PAIRS} SELECT rec_id, req, candidate_id, rank FROM ranked WHERE rank <= 3")
def ambience_rank(spark: SparkSession, d: str) -> DataFrame:
    """The three best candidates of each request by eight keys."""
    return _ranked(spark, d).where("rank <= 3").select("rec_id", "req", "candidate_id", F.col("rank").cast("long").alias("rank"))


@query(f"{W}, {PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY rec_id, req ORDER BY rank) AS k FROM ranked WHERE en - st >= need) SELECT rec_id, req, candidate_id, CAST(st + (en - st - need) // 2 AS BIGINT) AS take_st, CAST(st + (en - st - need) // 2 + need AS BIGINT) AS take_en FROM f WHERE k = 1")
def ambience_top1(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate that is long enough, centred."""
    return A.first_long_enough(_ranked(spark, d), ["rec_id", "req"], "need").select("rec_id", "req", "candidate_id", "take_st", "take_en")


@query()
def greedy_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Requests filled by several takes with crossfades."""
    out = A.greedy_assembly(_ranked(spark, d), ["rec_id", "req"], "need", 1_000_000)
    return out.select("rec_id", "req", "status", F.size("takes").alias("n_takes"), F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + t["en"] - t["st"]).alias("total"))


@query(f"""{W}, {union_sql('gap', "text IN ('view', 'purchase')")}, h AS (SELECT e.rec_id, e.word_id, greatest(greatest(e.st, g.st) - 30000, g.st) AS t_st, least(least(e.en, g.en) + 30000, g.en) AS t_en FROM words e JOIN gap g ON e.rec_id = g.rec_id AND e.text = 'error' AND e.st < e.en AND e.st < g.en AND g.st < e.en),
  c AS (SELECT rec_id, word_id, greatest(t_st, coalesce(max(t_en) OVER (PARTITION BY rec_id ORDER BY t_st, t_en, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t_st)) AS target_st, t_en AS target_en FROM h) SELECT * FROM c WHERE target_st < target_en""")
def breath_replacements(spark: SparkSession, d: str) -> DataFrame:
    """Events inside editable gaps as guarded targets that never overlap."""
    gaps = I.merge_overlapping(role(spark, d, "view", "purchase"), K)
    return A.replacements(role(spark, d, "error"), gaps, K, "word_id", 30_000)


@query()
def hidden_retries(spark: SparkSession, d: str) -> DataFrame:
    """Items accepted in order when they begin after the last accepted one."""
    out = A.accepted_in_order(role(spark, d, "click", "view").where("st < en").select("rec_id", "st", "en"), K)
    return out.select("rec_id", F.size("accepted").alias("n"), F.aggregate("accepted", F.lit(0).cast("long"), lambda s, x: s + x["en"] - x["st"]).alias("total"))


@query(f"""WITH RECURSIVE {WORDS_SQL}, win(rec_id, no, st) AS (SELECT rec_id, 0, min(word_id) FROM words GROUP BY rec_id UNION ALL
  SELECT w.rec_id, w.no + 1, (SELECT min(n.word_id) FROM words n WHERE n.rec_id = w.rec_id AND n.word_id > w.st AND n.st / 1e6 >= c.st / 1e6 + 86400) FROM win w JOIN words c ON c.rec_id = w.rec_id AND c.word_id = w.st WHERE w.st IS NOT NULL)
  SELECT rec_id, no AS window_no, CAST(st AS BIGINT) AS st, CAST(coalesce(lead(st) OVER (PARTITION BY rec_id ORDER BY no), (SELECT max(word_id) + 1 FROM words m WHERE m.rec_id = win.rec_id)) AS BIGINT) AS en FROM win WHERE st IS NOT NULL""")
def lookahead_windows(spark: SparkSession, d: str) -> DataFrame:
    """M1: windows of a day anchored at each first unread word."""
    w = words(spark, d).select("rec_id", "word_id", (F.col("st") / 1e6).alias("start_s"))
    return P.windows(w, "rec_id", 86400.0)


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Turns as timed words: half a second each, a pause of two after every turn."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("rec_id"), "turn", F.posexplode(F.split("text", r"\s+")).alias("i", "text"))
    w = Window.partitionBy("rec_id").orderBy("turn", "i")
    n = t.select("rec_id", "turn", "text", (F.row_number().over(w) - 1).alias("word_id"))
    return n.select("rec_id", F.col("word_id").cast("long").alias("word_id"), "text", (F.col("word_id") * 0.5 + F.col("turn") * 2.0).alias("start_s"), (F.col("word_id") * 0.5 + F.col("turn") * 2.0 + 0.5).alias("end_s"))


@query()
def stream_plan(spark: SparkSession, d: str) -> DataFrame:
    """Retake planning in windows with committed and pending state."""
    return P.plan_batch(_spoken(spark, d), "rec_id")


@query(f"""{W}, sel AS (SELECT rec_id, word_id, CAST(word_id AS BIGINT) AS st, CAST(word_id + 1 AS BIGINT) AS en FROM words WHERE text <> 'error'), m AS (SELECT *, CASE WHEN st = lag(en) OVER (PARTITION BY rec_id ORDER BY st) THEN 0 ELSE 1 END AS nw FROM sel), g AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY st ROWS UNBOUNDED PRECEDING) AS k FROM m),
  r AS (SELECT rec_id, min(st) AS st, max(en) AS en FROM g GROUP BY rec_id, k), o AS (SELECT *, lag(en) OVER (PARTITION BY rec_id ORDER BY st) AS p, lead(st) OVER (PARTITION BY rec_id ORDER BY st) AS n FROM r), t AS (SELECT rec_id, max(word_id) + 1 AS total FROM words GROUP BY rec_id),
  e AS (SELECT rec_id, 'leading' AS kind, st - 1 AS left_id, st AS right_id FROM o WHERE p IS NULL UNION ALL SELECT rec_id, 'gap_left', en - 1, en FROM o WHERE n > en UNION ALL SELECT rec_id, 'gap_right', st - 1, st FROM o WHERE st > p UNION ALL SELECT o.rec_id, CASE WHEN en = total THEN 'eof' ELSE 'trailing' END, en - 1, en FROM o JOIN t USING (rec_id) WHERE n IS NULL),
  x AS (SELECT rec_id, word_id, en, lead(st) OVER (PARTITION BY rec_id ORDER BY word_id) AS ns FROM words), q AS (SELECT DISTINCT x.rec_id, CAST(x.word_id AS BIGINT) AS a, CAST(x.word_id + 1 AS BIGINT) AS b FROM x JOIN r ON r.rec_id = x.rec_id AND r.st <= x.word_id AND x.word_id + 2 <= r.en WHERE x.ns - x.en >= 7200000000)
  SELECT * FROM e UNION ALL SELECT rec_id, 'retained_gap', a, b FROM q WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.rec_id = q.rec_id AND e.left_id = q.a AND e.right_id = q.b)""")
def alignment_events(spark: SparkSession, d: str) -> DataFrame:
    """O3: the places that an aligner must look at."""
    w = words(spark, d)
    sel = w.where("text <> 'error'").select("rec_id", F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 1).cast("long").alias("en"))
    return B.alignment_events(I.merge_touching(sel, K), w, K, 7_200_000_000)


@query(f"""{W}, ph AS (SELECT rec_id, st, en FROM words WHERE text = 'click' AND st < en), ev AS (SELECT rec_id, word_id, st AS pos FROM words WHERE text = 'signup'),
  q AS (SELECT rec_id, word_id, pos, (SELECT max(en) FROM ph WHERE ph.rec_id = ev.rec_id AND ph.st <= ev.pos) AS qs, (SELECT min(st) FROM ph WHERE ph.rec_id = ev.rec_id AND ph.st > ev.pos) AS qe FROM ev),
  s AS (SELECT *, CASE WHEN qs IS NULL OR qe IS NULL THEN 'edge' WHEN qs > pos THEN 'unsafe' WHEN qe - qs >= 600000000 THEN 'verified' ELSE 'dense' END AS status FROM q)
  SELECT rec_id, word_id, status, CAST(CASE status WHEN 'verified' THEN greatest(qs + 10000, least(pos, qe - 10000)) WHEN 'dense' THEN (qs + qe) // 2 ELSE pos END AS BIGINT) AS cut FROM s""")
def boundary_cuts(spark: SparkSession, d: str) -> DataFrame:
    """A cut for every event, with its safety."""
    ev = role(spark, d, "signup").select("rec_id", "word_id", F.col("st").alias("at"))
    return B.cuts(ev, role(spark, d, "click"), K, 10_000, 600_000_000).select("rec_id", "word_id", "status", "cut")


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = thoughts(spark, d)
    n = F.length("text").cast("long")
    w = Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    seg = t.select("rec_id", "idx", (F.sum(n).over(w) * 1000 + F.col("idx") * 150_000).alias("en"), n.alias("n")).withColumn("st", F.col("en") - F.col("n") * 1000).drop("n")
    return seg, B.pause_plan(t, K)


@query()
def output_trace(spark: SparkSession, d: str) -> DataFrame:
    """Segments and inserted pauses laid end to end."""
    return B.output_trace(*_segments(spark, d), K)


@query()
def trace_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the output trace; there is none."""
    trace = B.output_trace(*_segments(spark, d), K)
    protected = trace.where("kind = 'source'").select("rec_id", (F.col("st") + 1).alias("st"), (F.col("en") - 1).alias("en"))
    return B.trace_violations(trace, protected, K)


@query()
def visual_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Picture segments with freezes."""
    return B.visual_timeline(B.output_trace(*_segments(spark, d), K), K)


@query()
def filter_graph(spark: SparkSession, d: str) -> DataFrame:
    """A media tool's graph text."""
    g = sinks.filter_graph(B.output_trace(*_segments(spark, d), K), K, 1_000_000)
    return g.select("rec_id", F.length("graph").alias("n"), F.sha2("graph", 256).alias("digest"))


@query(f"""{W}, n AS (SELECT rec_id, CAST(max(word_id) + 1 AS BIGINT) AS n FROM words GROUP BY rec_id), sel AS (SELECT rec_id, CAST(word_id AS BIGINT) AS id FROM words WHERE text IN ('view', 'click', 'signup')), uns AS (SELECT rec_id, CAST(word_id AS BIGINT) AS id FROM words WHERE text = 'signup'),
  omit AS (SELECT rec_id, CAST(word_id AS BIGINT) AS id, word_id - row_number() OVER (PARTITION BY rec_id ORDER BY word_id) AS g FROM words WHERE text NOT IN ('view', 'click', 'signup')), st AS (SELECT rec_id, g, min(id) AS a, max(id) + 1 AS b FROM omit GROUP BY rec_id, g),
  grow AS (SELECT DISTINCT st.* FROM st JOIN uns ON uns.rec_id = st.rec_id AND (uns.id = st.a - 1 OR uns.id = st.b)), al AS (SELECT rec_id, id FROM sel UNION SELECT rec_id, unnest(range(a, b)) FROM grow), k AS (SELECT rec_id, id, id - row_number() OVER (PARTITION BY rec_id ORDER BY id) AS g FROM al)
  SELECT rec_id, min(id) AS st, max(id) + 1 AS en FROM k GROUP BY rec_id, g""")
def conservative_growth(spark: SparkSession, d: str) -> DataFrame:
    """The selection grown by the omitted stretch beside each unsafe edge."""
    w = words(spark, d)
    one = lambda df: df.select("rec_id", F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 1).cast("long").alias("en"))
    n = w.groupBy("rec_id").agg((F.max("word_id") + 1).cast("long").alias("n"))
    return B.grown_selection(one(w.where("text in ('view', 'click', 'signup')")), w.where("text = 'signup'"), K, n).select("rec_id", "st", "en")


@query(f"WITH {THOUGHTS_SQL}, w AS (SELECT rec_id, idx, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS q FROM thoughts), k AS (SELECT rec_id, idx, q, trim(word) AS text FROM w WHERE trim(word) <> '') SELECT CAST(rec_id AS VARCHAR) AS rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY idx, q) - 1 AS INTEGER) AS word_id, text FROM k")
def transcript_scan(spark: SparkSession, d: str) -> DataFrame:
    """Transcript documents as JSON, read by schema and flattened to a dense ledger."""
    words_of = F.transform(F.split("text", " ", -1), lambda x: F.struct(x.alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    docs = thoughts(spark, d).groupBy(F.col("rec_id").cast("string").alias("rec_id")).agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("atom_index"), words_of.alias("words"))).alias("atoms"))
    text = docs.select(F.to_json(F.struct("rec_id", "atoms")).alias("j"))
    parsed = text.select(F.from_json("j", readers.TRANSCRIPT, {"mode": "FAILFAST"}).alias("p")).select("p.*")
    return readers.transcript_words(parsed).select("rec_id", "word_id", "text")


@query("SELECT conv_id AS context_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(floor((conv_id * 10 + turn * 0.5) * 16000 + 1e-9)) AS BIGINT) AS starts, CAST(0 AS BIGINT) AS errors FROM conversations GROUP BY 1")
def aligner_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Aligner output parsed from JSON tiers to absolute samples, with errors as rows."""
    entry = F.array((F.col("turn") * 0.5).cast("string"), (F.col("turn") * 0.5 + 0.5).cast("string"), F.col("role"))
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("context_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"])).alias("e"), (F.max("turn") * 0.5 + 0.5).alias("duration_s"))
    docs = t.select("context_id", (F.col("context_id") * 10).cast("double").alias("offset_s"), "duration_s", F.concat(F.lit('{"tiers":{"words":{"entries":'), F.col("e"), F.lit("}}}")).alias("payload"))
    x = readers.tier_intervals(docs, "words", 16000)
    return x.groupBy("context_id").agg(F.count("*").alias("n"), F.sum("st").alias("starts"), F.count("error").alias("errors"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'aac' END AS audio, CASE WHEN n_nationkey % 3 = 0 THEN 'h264' END AS video, CAST(n_nationkey + 1.5 AS DOUBLE) AS duration FROM nation")
def media_probe(spark: SparkSession, d: str) -> DataFrame:
    """A10: a probe's first audio, first real video and longest duration."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit('{"format":{"duration":"'), (k + 1.5).cast("string"), F.lit('"},"streams":[{"codec_type":"video","codec_name":"mjpeg","disposition":{"attached_pic":1}}'), F.when(k % 2 == 0, ',{"codec_type":"audio","codec_name":"aac","duration":"1.0"}').otherwise(""), F.when(k % 3 == 0, ',{"codec_type":"video","codec_name":"h264","disposition":{"attached_pic":0}}').otherwise(""), F.lit("]}"))
    audio, video, duration = readers.first_streams(text)
    return table(spark, d, "nation").select(k.alias("id"), audio["codec_name"].alias("audio"), video["codec_name"].alias("video"), duration.alias("duration"))


@query(f"""{W}, g AS (SELECT *, CASE WHEN st < max(en) OVER (PARTITION BY rec_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM words), i AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
  e AS (SELECT rec_id, word_id, min(word_id) OVER (PARTITION BY rec_id, k) AS a, max(word_id) OVER (PARTITION BY rec_id, k) AS b, max(word_id) OVER (PARTITION BY rec_id) AS m FROM i)
  SELECT r.rec_id, r.word_id, CAST(x.a AS BIGINT) AS st, CAST(y.b + 1 AS BIGINT) AS en FROM e r JOIN words w ON w.rec_id = r.rec_id AND w.word_id = r.word_id AND w.text = 'signup' JOIN e x ON x.rec_id = r.rec_id AND x.word_id = greatest(r.word_id - 3, 0) JOIN e y ON y.rec_id = r.rec_id AND y.word_id = least(r.word_id + 3, r.m)""")
def context_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of three words around roles, grown over overlapping words."""
    return N.contexts(role(spark, d, "signup").select("rec_id", "word_id"), words(spark, d), K)


@query(f"""{W}, t AS (SELECT rec_id, CAST(word_id // 12 AS BIGINT) AS thought, CAST(min(word_id) AS BIGINT) AS st, CAST(max(word_id) + 1 AS BIGINT) AS en FROM words WHERE word_id % 12 < 9 GROUP BY 1, 2), c AS (SELECT *, greatest(st - 80, coalesce(lag(en) OVER w, 0)) AS ctx_st, least(en + 80, coalesce(lead(st) OVER w, 1152921504606846976)) AS ctx_en FROM t WINDOW w AS (PARTITION BY rec_id ORDER BY st))
  SELECT c.rec_id, c.thought, c.ctx_st, c.ctx_en, count(*) AS n FROM c JOIN words f ON f.rec_id = c.rec_id AND f.text = 'error' AND c.st <= f.word_id AND f.word_id < c.en GROUP BY ALL""")
def repair_targets(spark: SparkSession, d: str) -> DataFrame:
    """M7: the thoughts that failures implicate, with contexts clipped by their neighbours."""
    w = words(spark, d)
    t = w.where("word_id % 12 < 9").groupBy("rec_id", F.floor(F.col("word_id") / 12).cast("long").alias("thought")).agg(F.min("word_id").cast("long").alias("st"), (F.max("word_id") + 1).cast("long").alias("en"))
    return N.repair_targets(w.where("text = 'error'"), t, K)


@query()
def edge_transitions(spark: SparkSession, d: str) -> DataFrame:
    """K8: fades of inserted pieces towards their neighbours."""
    return N.edge_transitions(B.output_trace(*_segments(spark, d), K), K, 5_000)


@query()
def room_tone_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Requests served in order, with use counts that carry over."""
    req, cand = _requests(spark, d)
    return N.allocate_in_order(req.withColumn("req", F.col("req").cast("long")).withColumn("level", F.lit(40.0)), cand, "rec_id")


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns as atoms, and made-up evidence: words heard, every seventh one misspelt, some segments failed or missing."""
    from spanloom.functions.text import ascii_words

    t = table(spark, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("atom"), ascii_words(F.col("text")).alias("expected"))
    heard = F.transform("expected", lambda x, i: F.struct(F.when(i % 7 == 3, F.concat(x, F.lit("z"))).otherwise(x).alias("word"), (i * 0.5).cast("double").alias("start"), (i * 0.5 + 0.4).cast("double").alias("end"), F.lit(0.9).alias("score")))
    seg = t.where("atom % 5 <> 4").select("rec_id", "atom", heard.alias("observed"), F.when(F.col("atom") % 5 == 3, "decoder failed").alias("error"))
    return t, seg


@query()
def enrich_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts enriched with acoustic evidence, counted by status."""
    return N.report(N.enrich(*_evidence(spark, d)))


@query("SELECT conv_id AS rec_id, turn AS atom, 'missing_segment' AS rule FROM conversations WHERE turn % 5 = 4")
def evidence_violations(spark: SparkSession, d: str) -> DataFrame:
    """Atoms and segments that do not pair one to one."""
    return N.join_evidence(*_evidence(spark, d))[1]


@query()
def mapped_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Aligner outputs consumed in order, one to three a token."""
    t = _evidence(spark, d)[0].where("size(expected) > 0")
    parts = F.flatten(F.transform("expected", lambda x, i: F.when((i % 3 == 1) & (F.length(x) > 3), F.array(F.substring(x, F.lit(1), F.lit(2)), F.substring(x, F.lit(3), F.length(x)))).otherwise(F.array(x))))
    m = t.withColumn("m", N.mapped_outputs_udf()("expected", parts))
    return m.select("rec_id", "atom", F.coalesce(F.size("m"), F.lit(-1)).alias("n_tokens"), F.size(parts).alias("n_outputs"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, least(greatest(turn * 10.0, 5.0), 60.0) AS a FROM conversations), t AS (SELECT *, least(greatest(turn * 10.0 + 7, a), 60.0) AS b FROM s), u AS (SELECT *, unnest(range(0, len(w))) AS p FROM t)
  SELECT conv_id AS rec_id, turn AS segment, CAST(p AS INTEGER) AS pos, w[p + 1] AS word, round(a + p * ((b - a) / len(w)), 5) AS start_s, round(a + (p + 1) * ((b - a) / len(w)), 5) AS end_s FROM u""")
def pseudo_words(spark: SparkSession, d: str) -> DataFrame:
    """Untimed results as equal slots inside their window."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("segment"), "text", (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + 7).alias("end_s"), F.lit(5.0).alias("clip_start"), F.lit(60.0).alias("clip_end"))
    out = readers.pseudo_words(t)
    return out.select("rec_id", "segment", "pos", "word", F.round("start_s", 5).alias("start_s"), F.round("end_s", 5).alias("end_s"))


@query(f"{W} SELECT rec_id, CAST(0 AS BIGINT) AS idx, 'source' AS kind, CAST(0 AS BIGINT) AS st, CAST(max(en) AS BIGINT) AS en, 'full_source_passthrough' AS status FROM words GROUP BY rec_id")
def source_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """The degraded plan that keeps everything, marked as such."""
    return B.passthrough(words(spark, d).groupBy("rec_id").agg(F.max("en").alias("total")), K)


@query()
def retargeted_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Pause classes carried over to a repaired plan."""
    t = thoughts(spark, d)
    w = Window.partitionBy("rec_id").orderBy("idx")
    old = t.withColumn("following", F.lead("text").over(w)).where("following is not null and idx % 2 = 0").withColumn("pause_type", F.lit("thought"))
    return B.retarget_pauses(old, t.where("idx <> 1"), K)
