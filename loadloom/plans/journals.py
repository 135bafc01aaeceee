"""Queries on journals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.plans.registry import DAY, H, HOUR, START, hourly, query
from loadloom.session import scratch_dir
from loadloom.sources.indexed import IndexedJournal


@query(
    "s09_indexed_journal",
    f"""WITH {H}, b AS (SELECT 0 AS batch, series_id, t, value FROM h WHERE t < {START + 15 * DAY} UNION ALL SELECT 1, series_id, t, value + (t // 3600 % 5 = 0)::INTEGER FROM h WHERE t >= {START + 10 * DAY} AND t < {START + 25 * DAY}
  UNION ALL SELECT 2, series_id, t, value + (t // 3600 % 7 = 0)::INTEGER FROM h WHERE t >= {START + 20 * DAY}), f AS (SELECT series_id, t, min(batch) AS batch, arg_min(value, batch) AS value FROM b GROUP BY 1, 2)
 SELECT 'kept' AS kind, series_id, t, value, batch::BIGINT AS batch FROM f UNION ALL SELECT 'correction', b.series_id, b.t, b.value, b.batch::BIGINT FROM b JOIN f ON f.series_id = b.series_id AND f.t = b.t WHERE b.batch > f.batch AND b.value <> f.value""",
)
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping batches of hourly counts, the later ones with some other values; the second comes twice."""
    h = hourly(spark, sf_dir)
    journal = IndexedJournal(f"{scratch_dir(spark)}/journal-{uuid.uuid4().hex}", h.schema, ["series_id", "t"], "t", buckets=8)
    changed = lambda every: F.col("value") + F.when(F.floor(F.col("t") / HOUR) % every == 0, 1.0).otherwise(0.0)
    first = h.where(F.col("t") < START + 15 * DAY)
    second = h.where((F.col("t") >= START + 10 * DAY) & (F.col("t") < START + 25 * DAY)).withColumn("value", changed(5))
    third = h.where(F.col("t") >= START + 20 * DAY).withColumn("value", changed(7))
    for batch_id, batch in ((0, first), (1, second), (1, second), (2, third)):
        journal.append(batch, batch_id)
    kept = journal.rows(spark).withColumn("kind", F.lit("kept"))
    return kept.unionByName(journal.corrections(spark).withColumn("kind", F.lit("correction"))).select("kind", "series_id", "t", "value", "batch")
