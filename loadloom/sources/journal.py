"""Append-only journals: first receipt wins, equal repeats are ignored, different ones are reported; retention by completeness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON counter points {metric, data: {time, value}}; lines that do not parse have NULL in every column but ``_line``."""
    schema = "metric string, data struct<time:timestamp, value:double>, _line string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_line").json(path)
    return rows.select("metric", F.col("data.time").alias("time"), F.col("data.value").alias("value"), "_line")


def idempotent_append(path: str, keys: list[str], conflicts: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows whose key is new are appended; a key with other content than the journal's, or with several
    contents in one batch, goes to ``conflicts`` (of several contents the one with the least hash is kept).

    Each batch has a folder of its own, in the journal and among the conflicts, which a batch that comes again writes anew. So a
    restart between the two writes, or after them, changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        said = F.sha2(F.to_json(F.struct(*rest)), 256)
        rows = batch.withColumn("_said", said).groupBy(*keys).agg(F.min_by(F.struct(*rest), "_said").alias("r"), F.min("_said").alias("_said"), F.max("_said").alias("_other"), F.max_by(F.struct(*rest), "_said").alias("o"))
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = None
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            known = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != batch_id).select(*keys, said.alias("_known"))
        rows = rows.join(known, keys, "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("string"))
        if conflicts:
            told = rows.where("_said <> _other or _said <> _known or _other <> _known")
            other = F.when(F.col("_known").isNull() | (F.col("_other") != F.col("_known")), F.col("o")).otherwise(F.col("r")).alias("r")
            told.select(*keys, other).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).write.mode("overwrite").parquet(f"{conflicts}/batch={batch_id}")
        rows.where("_known is null").select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def retained(issuances: DataFrame, outcomes: DataFrame, models: int, before: int) -> DataFrame:
    """What compaction keeps: windows at or after ``before``, and older ones for which not every model has a terminal outcome."""
    done = outcomes.where("status in ('scored', 'unscorable')").groupBy("series_id", "origin").agg(F.count_distinct("model").alias("n")).where(F.col("n") >= models)
    old = done.where(F.col("origin") < before).select("series_id", "origin")
    return issuances.join(old, ["series_id", "origin"], "left_anti")
