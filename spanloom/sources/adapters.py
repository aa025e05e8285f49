"""Word, frame and thought ledgers made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom import ship

HOUR, MINUTE, SECOND = 3_600_000_000, 60_000_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long")
    second = (F.expr(f"extract(SECOND FROM {ts})") * SECOND).cast("long")
    return days * (24 * HOUR) + F.hour(ts).cast("long") * HOUR + F.minute(ts).cast("long") * MINUTE + second


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed word ledger (rec_id, word_id, text, st, en, value) of ``events``: dense ids per recording."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    length = F.bround(F.col("value") * 100, 0).cast("long") * 3 * SECOND
    out = e.select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).alias("word_id"), F.col("event_type").alias("text"), micros("ts").alias("st"), length.alias("_len"), "value")
    return out.withColumn("en", F.col("st") + F.col("_len")).drop("_len")


def role(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Words of some kinds; kinds stand for phones, events, silences and anchors."""
    return words(spark, sf_dir).where(F.col("text").isin(*kinds))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short waveforms (rec_id, samples) of ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").cast("array<double>").alias("samples"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame features (rec_id, idx, x) at a fixed hop: every sample of a waveform is a frame."""
    return signals(spark, sf_dir).select("rec_id", F.posexplode("samples").alias("idx", "x"))


def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered thoughts (rec_id, idx, text): the turns of each conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("idx"), "text")


#: The same ledgers for DuckDB.
WORDS_SQL = """words AS (SELECT user_id AS rec_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS word_id,
  event_type AS text, epoch_us(ts) AS st, epoch_us(ts) + CAST(round_even(value * 100, 0) AS BIGINT) * 3000000 AS en, value FROM events)"""
FRAMES_SQL = """frames AS (SELECT vec_id AS rec_id, CAST(i - 1 AS INTEGER) AS idx, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
THOUGHTS_SQL = "thoughts AS (SELECT conv_id AS rec_id, turn AS idx, text FROM conversations)"
