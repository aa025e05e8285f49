"""Sinks: documents, compact places, verified waveforms, run ledgers and filter graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing target is kept unless ``overwrite`` is given."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def as_differences(spark: SparkSession, *columns: str) -> None:
    """Parquet holds these columns of whole numbers as differences between neighbours, without a dictionary.

    Long runs of evenly spaced places then take next to no room; rows and types are the same.
    The settings stay for the session: a plan reads them when it is written. What the caller has set stays.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in (("parquet.writer.version", "v2"), *((f"parquet.enable.dictionary#{c}", "false") for c in columns)):
        if spark.conf.get(key, None) is None and hadoop.get(key) is None:
            spark.conf.set(key, value)


def content_hash(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, digest) of an array column, by its exact bits."""
    bits = F.transform(column, lambda x: x.cast("string"))
    return df.select(*keys, F.sha2(F.array_join(bits, ","), 256).alias("digest"))


def write_verified(df: DataFrame, path: str, keys: list[str], column: str) -> DataFrame:
    """Write Parquet, read it back and fail unless every array is bit-identical."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    a, b = content_hash(df, keys, column), content_hash(back, keys, column).withColumnRenamed("digest", "written")
    bad = a.join(b, keys, "full").where("not (digest <=> written)").limit(1).collect()
    if bad:
        raise ValueError(f"what was written differs: {bad[0].asDict()}")
    return back


def append_done(df: DataFrame, path: str, run_id: str) -> None:
    """Add finished keys of a run; a later run skips them (see ``pending``)."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def pending(spark: SparkSession, jobs: DataFrame, path: str, run_id: str, keys: list[str]) -> DataFrame:
    """Jobs not finished by this run's identity."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return jobs
    return jobs.join(spark.read.parquet(path).where(F.col("run_id") == run_id).select(*keys), keys, "left_anti")


def filter_graph(trace: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """(keys, graph): a media tool's trim-and-join description of an output trace, in order."""
    piece = F.format_string("[0:a]atrim=%.6f:%.6f,asetpts=PTS-STARTPTS[s%d]", F.col("st") / rate, F.col("en") / rate, F.col("idx"))
    listed = F.array_sort(F.collect_list(F.struct("out_st", "idx", piece.alias("p"))))
    g = trace.where("kind = 'source'").groupBy(*keys).agg(listed.alias("l"))
    labels = F.array_join(F.transform("l", lambda x: F.format_string("[s%d]", x["idx"])), "")
    return g.select(*keys, F.concat(F.array_join(F.transform("l", lambda x: x["p"]), ";"), F.lit(";"), labels, F.format_string("concat=n=%d:v=0:a=1[out]", F.size("l"))).alias("graph"))


def publication_ok(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Whether a published duration is within max(0.12 s, 0.2 %) of the planned one."""
    return df.withColumn("ok", F.abs(F.col(actual) - F.col(expected)) <= F.greatest(F.lit(0.12), 0.002 * F.col(expected)))
