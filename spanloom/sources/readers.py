"""Readers of recorded documents: JSON plans, aligner tiers, WAV audio and media probes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed schemas: nothing is inferred.
TRANSCRIPT = "rec_id string, atoms array<struct<atom_index: int, words: array<struct<word: string, start: double, end: double>>>>, whole struct<words: array<struct<word: string, start: double, end: double>>>"
PLAN = "rec_id string, committed array<struct<canonical_text: string, source_ranges: array<struct<start_word_id: int, end_word_id: int>>>>"
PROBE = "format struct<duration: string>, streams array<struct<index: int, codec_type: string, codec_name: string, duration: string, sample_rate: string, channels: int, width: int, height: int, avg_frame_rate: string, disposition: struct<attached_pic: int>>>"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents; one that does not fit the schema is kept with its text in ``bad``, so good ones go on."""
    return spark.read.schema(f"{schema}, bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)


def transcript_words(docs: DataFrame) -> DataFrame:
    """(rec_id, word_id, text, start_s, end_s): words of the atoms in order, or of the whole where atoms hold none; blank words go, ids are dense."""
    atoms = docs.select("rec_id", F.posexplode("atoms").alias("_p", "a")).select("rec_id", F.col("a.atom_index").alias("_a"), "_p", F.posexplode("a.words").alias("_q", "w"))
    has = atoms.select("rec_id").distinct()
    whole = docs.join(has, "rec_id", "left_anti").select("rec_id", F.lit(0).alias("_a"), F.lit(0).alias("_p"), F.posexplode("whole.words").alias("_q", "w"))
    rows = atoms.unionByName(whole).where(F.trim("w.word") != "")
    w = Window.partitionBy("rec_id").orderBy("_a", "_p", "_q")
    return rows.select("rec_id", (F.row_number().over(w) - 1).alias("word_id"), F.trim("w.word").alias("text"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"))


def word_violations(words: DataFrame) -> DataFrame:
    """Words whose times are not finite, negative or reversed."""
    from spanloom.operators.validate import violations

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return violations(words, {"not_finite": ~(finite("start_s") & finite("end_s")), "reversed": F.col("end_s") < F.col("start_s"), "negative": F.col("start_s") < 0}, ["rec_id", "word_id"])


def plan_ranges(plans: DataFrame) -> DataFrame:
    """(rec_id, thought, range_no, st, en) of a plan's selected ranges, in order."""
    t = plans.select("rec_id", F.posexplode("committed").alias("thought", "c"))
    return t.select("rec_id", "thought", F.posexplode("c.source_ranges").alias("range_no", "r")).select("rec_id", "thought", "range_no", F.col("r.start_word_id").cast("long").alias("st"), F.col("r.end_word_id").cast("long").alias("en"))


def tier_intervals(docs: DataFrame, tier: str, rate: int, tolerance: float = 0.002) -> DataFrame:
    """Intervals of an aligner's tier given as [start, end, label] rows: in seconds from the context's start and in samples.

    Bounds may leave [0, duration] by the tolerance and are clamped; rows beyond it, or that
    begin before the farthest end so far, carry an error instead of being dropped.
    """
    from spanloom.functions.numeric import seconds_to_sample

    rows = docs.select("context_id", "offset_s", "duration_s", F.posexplode(F.from_json(F.get_json_object("payload", f"$.tiers.{tier}.entries"), "array<array<string>>")).alias("pos", "e"))
    x = rows.select("context_id", "offset_s", "duration_s", "pos", F.get("e", F.lit(0)).try_cast("double").alias("a"), F.get("e", F.lit(1)).try_cast("double").alias("b"), F.get("e", F.lit(2)).alias("label"))
    reach = F.max("b").over(Window.partitionBy("context_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    error = F.when(F.col("a").isNull() | F.col("b").isNull(), "not_a_number").when((F.col("a") < -tolerance) | (F.col("b") > F.col("duration_s") + tolerance), "out_of_bounds").when(F.col("b") < F.col("a"), "reversed").when(F.col("a") < reach - tolerance, "out_of_order")
    lo, hi = F.greatest("a", F.lit(0.0)), F.least("b", "duration_s")
    return x.select("context_id", "pos", "label", (F.col("offset_s") + lo).alias("start_s"), (F.col("offset_s") + hi).alias("end_s"), seconds_to_sample(F.col("offset_s") + lo, rate, "floor").alias("st"), seconds_to_sample(F.col("offset_s") + hi, rate, "ceil").alias("en"), error.alias("error"))


def contexts_with_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Every expected context with its file's payload; a missing or unreadable one is an error row and the others go on."""
    j = expected.join(files, "context_id", "left")
    return j.withColumn("error", F.when(F.col("payload").isNull(), "missing").when(F.get_json_object("payload", "$.tiers").isNull(), "unreadable"))


def first_streams(probe: Column) -> tuple[Column, Column, Column]:
    """First audio stream, first video stream that is no cover, and the longest positive duration of a probe."""
    p = F.from_json(probe, PROBE)
    streams = p["streams"]
    audio = F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))
    video = F.get(F.filter(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    lengths = F.filter(F.transform(F.concat(F.array(p["format"]["duration"]), F.transform(streams, lambda s: s["duration"])), lambda x: x.try_cast("double")), lambda x: x > 0)
    return audio, video, F.array_max(lengths)


WAV = "struct<rate: int, channels: int, samples: array<float>, error: string>"


def decode_wav(data: bytes) -> tuple[int | None, int | None, list | None, str | None]:
    """16-bit PCM as the mean of its channels in [-1, 1]."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            if f.getsampwidth() != 2:
                return None, None, None, f"{8 * f.getsampwidth()}-bit samples"
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
            return f.getframerate(), f.getnchannels(), (x.mean(axis=1) / 32768).astype(np.float32).tolist(), None
    except (wave.Error, EOFError, ValueError) as e:
        return None, None, None, str(e) or type(e).__name__


def wav_udf():
    @F.pandas_udf(WAV)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_wav(x) for x in data], columns=["rate", "channels", "samples", "error"])

    return run


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, samples, error) of WAV files; an unreadable one is an error row."""
    from spanloom import ship

    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", wav_udf()("content").alias("w")).select("path", "w.*")


def chunks(audio: DataFrame, key: str, size: int) -> DataFrame:
    """(key, chunk_id, start_sample, samples): a waveform in pieces, never one row a sample."""
    n = F.greatest(F.ceil(F.size("samples") / size).cast("int"), F.lit(1))
    rows = audio.select(key, "samples", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_id"))
    return rows.select(key, "chunk_id", (F.col("chunk_id").cast("long") * size).alias("start_sample"), F.slice("samples", F.col("chunk_id") * size + 1, F.lit(size)).alias("samples"))


def pseudo_words(segments: DataFrame) -> DataFrame:
    """Words of segments without timings: equal slots of the segment's span clipped to its window, marked approximate."""
    s = segments.withColumn("_a", F.least(F.greatest("start_s", "clip_start"), F.col("clip_end"))).withColumn("_b", F.least(F.greatest("end_s", "_a"), F.col("clip_end")))
    w = s.withColumn("_w", F.filter(F.split("text", r"\s+"), lambda x: x != "")).select("*", F.posexplode("_w").alias("pos", "word"))
    step = (F.col("_b") - F.col("_a")) / F.size("_w")
    return w.select("rec_id", "segment", "pos", "word", (F.col("_a") + F.col("pos") * step).alias("start_s"), (F.col("_a") + (F.col("pos") + 1) * step).alias("end_s"), F.lit(True).alias("approximate"))
