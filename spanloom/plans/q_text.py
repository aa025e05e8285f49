"""Queries over text: tokens, keys, classes, retakes and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import sequences as S
from spanloom.plans.catalog import query
from spanloom.sources.adapters import THOUGHTS_SQL, table, thoughts

TOKENS = "regexp_extract_all(lower(replace(text, '’', '''')), '[a-z0-9]+(?:''[a-z0-9]+)?')"


def _english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE lang = 'en')")
def tokenize_basic(spark: SparkSession, d: str) -> DataFrame:
    """ASCII words and numerals of a text, in SQL."""
    t = _english(spark, d).select("doc_id", X.ascii_words(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


STEM = """CASE WHEN NOT regexp_full_match(w, '[a-z]+') OR length(w) <= 4 THEN w WHEN w LIKE '%ies' AND length(w) > 5 THEN w[:-4] || 'y' WHEN w LIKE '%ing' AND length(w) > 6 THEN w[:-4]
  WHEN w LIKE '%ed' AND length(w) > 5 THEN w[:-3] WHEN w LIKE '%s' AND NOT regexp_matches(w, '(is|ss|us)$') THEN w[:-2] ELSE w END"""


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents WHERE lang = 'en') SELECT stem, count(*) AS n, count(DISTINCT w) AS forms FROM (SELECT w, {STEM} AS stem FROM t) GROUP BY stem")
def light_stem(spark: SparkSession, d: str) -> DataFrame:
    """Stems with their words."""
    w = _english(spark, d).select(F.explode(X.ascii_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    return w.groupBy(X.stem_column(F.col("w")).alias("stem")).agg(F.sum("k").alias("n"), F.count("*").alias("forms"))


@query()
def spoken_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Folded tokens with contractions and numbers expanded."""
    t = _english(spark, d).select("doc_id", X.tokens_udf()("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


PHON = r"regexp_replace(replace(replace(replace(replace(regexp_replace(w, '[^\p{L}]', '', 'g'), 'ph', 'f'), 'ck', 'k'), 'qu', 'k'), 'x', 'ks'), '^$', '')"


@query(rf"""WITH t AS (SELECT DISTINCT unnest({TOKENS}) AS w FROM documents WHERE lang = 'en'), k AS (SELECT w, {PHON} AS x FROM t), v AS (SELECT w, x[1:1] || regexp_replace(x[2:], '[aeiouy]', '', 'g') AS y FROM k),
  c AS (SELECT w, list_reduce(list_prepend('', string_split(y, '')), lambda a, b: CASE WHEN right(a, 1) = b THEN a ELSE a || b END) AS key FROM v) SELECT w, key FROM c""")
def phonetic_key(spark: SparkSession, d: str) -> DataFrame:
    """Consonant skeletons of distinct words."""
    return _english(spark, d).select(F.explode(X.ascii_words(F.col("text"))).alias("w")).distinct().select("w", X.phonetic_key(F.col("w")).alias("key"))


ANCHOR = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH p AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS a, split_part(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ', 1) AS b FROM conversations)
  SELECT conv_id, turn, CASE WHEN {ANCHOR.format('a')} <> '' OR {ANCHOR.format('b')} <> '' THEN {ANCHOR.format('a')} <> '' AND {ANCHOR.format('a')} = {ANCHOR.format('b')} ELSE trim(lower(a)) <> '' AND trim(lower(a)) = trim(lower(b)) END AS matches FROM p WHERE b IS NOT NULL""")
def anchor_match(spark: SparkSession, d: str) -> DataFrame:
    """First words of neighbouring turns compared as anchors."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    p = table(spark, d, "conversations").select("conv_id", "turn", first(F.col("text")).alias("a"), first(F.lead("text").over(w)).alias("b")).where("b is not null")
    return p.select("conv_id", "turn", X.anchors_match(F.col("a"), F.col("b")).alias("matches"))


CHUNKS = """chunks AS (SELECT doc_id, CAST((i - 1) // 12 AS INTEGER) AS idx, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents WHERE lang = 'en') GROUP BY 1, 2)"""
_QUOTE = "[\\s\"''“”‘’(\\[{]+"
_CLOSE = "[\\s\"''“”‘’\\])}]+"
PAUSE = """SELECT *, lower(regexp_replace(nxt, '^QUOTE', '')) AS a, regexp_replace(text, 'CLOSE$', '') AS b FROM (SELECT *, lead(text) OVER (PARTITION BY KEY ORDER BY idx) AS nxt FROM SRC) WHERE nxt IS NOT NULL"""


def _paused(key: str, src: str) -> str:
    return PAUSE.replace("QUOTE", _QUOTE).replace("CLOSE", _CLOSE).replace("KEY", key).replace("SRC", src)


RULE = f"""CASE WHEN regexp_matches(a, '{X.SECTION.replace(chr(39), chr(39) * 2)}') THEN 'section:explicit_section_cue' WHEN regexp_matches(b, '(\\.\\.\\.|…)$') THEN 'continuation:previous_ellipsis'
  WHEN regexp_matches(b, '[,:—–-]$') THEN 'continuation:previous_continuation_punctuation' WHEN NOT regexp_matches(b, '[.?!;]$') THEN 'continuation:previous_has_no_terminal_punctuation'
  WHEN regexp_matches(b, ';$') THEN 'short:previous_semicolon' WHEN regexp_matches(a, '{X.CONNECTED}') THEN 'short:next_thought_connective' ELSE 'thought:complete_sentence_default' END"""


@query(f"WITH {CHUNKS} SELECT doc_id, idx, {RULE} AS pause FROM ({_paused('doc_id', 'chunks')})")
def pause_type(spark: SparkSession, d: str) -> DataFrame:
    """The pause between twelve-word chunks, by the first rule that holds."""
    words = _english(spark, d).select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "w"))
    listed = F.array_sort(F.collect_list(F.struct("i", "w")))
    chunks = words.groupBy("doc_id", F.floor(F.col("i") / 12).cast("int").alias("idx")).agg(F.array_join(F.transform(listed, lambda x: x["w"]), " ").alias("text"))
    nxt = chunks.withColumn("nxt", F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx"))).where("nxt is not null")
    p = nxt.select("doc_id", "idx", X.pause_type(F.col("text"), F.col("nxt")).alias("p"))
    return p.select("doc_id", "idx", F.concat_ws(":", "p.pause_type", "p.rule").alias("pause"))


@query(f"WITH {THOUGHTS_SQL} SELECT rec_id, idx, {RULE} AS pause FROM ({_paused('rec_id', 'thoughts')})")
def pause_plan(spark: SparkSession, d: str) -> DataFrame:
    """A pause plan for the turns of every conversation."""
    from spanloom.plans.boundary import pause_plan as plan

    p = plan(thoughts(spark, d), ["rec_id"])
    return p.select("rec_id", "idx", F.concat_ws(":", "pause_type", "rule").alias("pause"))


@query("SELECT event_id, lower(event_type) IN ('', '<eps>', 'sil', 'silence', 'sp', 'click') AS direct, lower(trim('sil_' || event_type)) IN ('', '<eps>', 'sil', 'silence', 'sp') OR regexp_replace(lower('sil_' || event_type), '_[^_]*$', '') IN ('', '<eps>', 'sil', 'silence', 'sp') AS by_suffix, regexp_replace('spn_x', '_[^_]*$', '') IN ('', '<eps>', 'sil', 'silence', 'sp') AS spn FROM events")
def silence_labels(spark: SparkSession, d: str) -> DataFrame:
    """Which labels mean silence."""
    e = table(spark, d, "events")
    return e.select("event_id", (X.is_silence(F.col("event_type")) | (F.lower("event_type") == "click")).alias("direct"), X.is_silence(F.concat(F.lit("sil_"), F.col("event_type"))).alias("by_suffix"), X.is_silence(F.lit("spn_x")).alias("spn"))


GRAMS = """t AS (SELECT {id}, string_split(regexp_replace(trim(lower(text)), '[^a-z0-9]+', ' ', 'g'), ' ') AS t FROM {src}), g AS (SELECT {id}, i - 1 AS pos, array_to_string(t[i:i + 4], ' ') AS gram FROM (SELECT *, unnest(range(1, len(t) - 3)) AS i FROM t))"""


@query(f"""WITH a AS (WITH {GRAMS.format(id='doc_id', src="documents WHERE lang = 'en'")} SELECT * FROM g), b AS (WITH {GRAMS.format(id='item_id', src='benchmark')} SELECT * FROM g)
  SELECT a.doc_id, b.item_id, count(*) AS shared, min(a.pos) AS first_pos FROM a JOIN b USING (gram) GROUP BY 1, 2""")
def retake_5gram(spark: SparkSession, d: str) -> DataFrame:
    """Texts that share a run of five tokens, by an equi-join on grams."""
    split = F.split(F.regexp_replace(F.trim(F.lower("text")), "[^a-z0-9]+", " "), " ", -1).alias("t")
    a = _english(spark, d).select("doc_id", split)
    b = table(spark, d, "benchmark").select("item_id", split)
    return S.shared_grams(a, b, "doc_id", "item_id", "t").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.min("a_pos").cast("long").alias("first_pos"))


@query("SELECT n_regionkey, n_nationkey, lower(regexp_extract('clip_' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp4' ELSE '.txt' END, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE n_nationkey % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' END AS kind FROM nation")
def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    """C20: media kind by extension."""
    k = F.col("n_nationkey")
    path = F.concat(F.lit("clip_"), k.cast("string"), F.when(k % 3 == 0, ".WAV").when(k % 3 == 1, ".mp4").otherwise(".txt"))
    return table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), X.media_kind(path).alias("kind"))


@query("SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS endpoint FROM pages")
def redacted_urls(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints without user, query and fragment."""
    return table(spark, d, "pages").select("page_id", X.redacted_url(F.col("url")).alias("endpoint"))


@query("SELECT rec, t, len(list_filter(range(3, CAST(len(l) // 2 + 1 AS BIGINT)), lambda w: l[len(l) - w + 1:len(l)] = l[len(l) - 2 * w + 1:len(l) - w])) > 0 AS repeats FROM (SELECT conv_id AS rec, turn AS t, string_split(text, ' ') || CASE WHEN turn % 2 = 1 THEN string_split(text, ' ')[-4:] ELSE [] END AS l FROM conversations)")
def repeated_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns, every other one with its last four words said again, whose end repeats what stands before it, over any width of three or more."""
    base = F.split("text", " ", -1)
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").alias("t"), F.when(F.col("turn") % 2 == 1, F.concat(base, F.slice(base, -F.least(F.lit(4), F.size(base)), 4))).otherwise(base).alias("l"))
    n = F.size("l")
    widths = F.when(n >= 6, F.sequence(F.lit(3), F.floor(n / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    same = F.exists(widths, lambda w: F.slice("l", n - w + 1, w) == F.slice("l", n - 2 * w + 1, w))
    return t.select("rec", "t", same.alias("repeats"))


@query("SELECT conv_id, turn, min(i) FILTER (regexp_matches(w, '[\\p{L}\\p{N}]')) AS first_lexical, max(i) FILTER (regexp_matches(w, '[\\p{L}\\p{N}]')) AS last_lexical FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations) GROUP BY 1, 2")
def lexical_edges(spark: SparkSession, d: str) -> DataFrame:
    """First and last word that holds a letter or digit."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "w"))
    lexical = F.when(F.col("w").rlike(r"[\p{L}\p{N}]"), F.col("i").cast("long"))
    return w.groupBy("conv_id", "turn").agg(F.min(lexical).alias("first_lexical"), F.max(lexical).alias("last_lexical"))


@query()
def fuzzy_word_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of neighbouring words, by an Arrow UDF."""
    w = _english(spark, d).select("doc_id", X.ascii_words(F.col("text")).alias("t")).where("size(t) >= 2")
    pairs = w.select(F.explode(F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("p.*").where("a <> b").distinct()
    # similarity can't reach 0.68 where 2 * min / (a + b) does not
    la, lb = F.length("a"), F.length("b")
    pairs = pairs.where((F.least(la, lb) > 3) & (2 * F.least(la, lb) / (la + lb) >= 0.68))
    return pairs.withColumn("score", F.round(X.fuzzy_score_udf()("a", "b"), 6)).where("score >= 0.68")


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", X.ascii_words(F.col("text")).alias("a"))
    return t.withColumn("b", F.lead("a").over(w)).where("b is not null")


@query()
def align_dp(spark: SparkSession, d: str) -> DataFrame:
    """I8: fuzzy monotone alignment of neighbouring turns."""
    out = _turn_pairs(spark, d).select("conv_id", "turn", S.align_udf()("a", "b").alias("m"))
    return out.select("conv_id", "turn", F.size("m").alias("matches"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x["score"]), 6).alias("similarity"))


@query()
def grounding_dp(spark: SparkSession, d: str) -> DataFrame:
    """Support of canonical tokens by a range's source tokens; every third source token is doubled."""
    t = table(spark, d, "conversations").select("conv_id", "turn", X.tokens_udf()("text").alias("a")).where("size(a) > 0")
    noisy = F.flatten(F.transform("a", lambda x, i: F.when(i % 3 == 2, F.array(x, x)).otherwise(F.array(x))))
    out = t.withColumn("b", F.when(F.col("turn") % 4 == 3, F.slice("a", F.lit(2), F.size("a"))).otherwise(noisy)).withColumn("g", S.ground_udf()("a", "b"))
    return out.select("conv_id", "turn", "g.*")
