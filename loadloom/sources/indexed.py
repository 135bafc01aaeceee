"""A journal whose batches read only the part of it that may hold their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Where a NULL position counts: before every other.
LEAST = -(1 << 62)


class IndexedJournal:
    """Append-only rows with unique ``keys``; the first content of a key stays, a different one goes to the corrections.

    Rows lie in a folder for each batch and hash bucket of their keys. Beside them the batch writes an index, one row for each
    of its buckets: the range of ``along`` (a whole-number column such as the event time) that the bucket's rows span. A later
    batch joins its own ranges to the index and reads the folders it meets, so its cost follows what it holds and not the
    journal's length; records that come in order of time meet nothing old at all.

    ``append`` is a ``foreachBatch`` function. A batch that comes again, after a crash between any two of its writes, overwrites its
    own folders in rows, corrections and index and looks at those of other batches only, so both sinks change together or not.
    """

    def __init__(self, path: str, schema: StructType, keys: list[str], along: str, content: list[str] | None = None, first_by: str | None = None, buckets: int = 64) -> None:
        """``content``: what makes two rows of a key different (else all columns but the keys). ``first_by``: which of a batch's rows of a key
        counts as first, by least value (else by least hash of the content)."""
        self.path, self.schema, self.keys, self.along = path.rstrip("/"), schema, keys, along
        self.content = content or [c for c in schema.names if c not in keys]
        self.first_by, self.buckets = first_by, buckets
        self.looked_at: list[str] = []

    def _said(self) -> Column:
        return F.sha2(F.to_json(F.struct(*self.content), {"ignoreNullFields": "false"}), 256)

    def _place(self) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"), F.coalesce(F.col(self.along).cast("bigint"), F.lit(LEAST))

    def _exists(self, spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def _ranges(self, rows: DataFrame) -> DataFrame:
        bucket, at = self._place()
        return rows.groupBy(bucket.alias("bucket")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))

    def folders(self, batch: DataFrame, batch_id: int) -> list[str]:
        """Folders of other batches that may hold keys of this one."""
        spark, index = batch.sparkSession, f"{self.path}/index"
        if not self._exists(spark, index):
            return []
        known = spark.read.schema("bucket int, lo long, hi long, rows long, batch long").parquet(index).where(F.col("batch") != batch_id)
        own = F.broadcast(self._ranges(batch).select("bucket", F.col("lo").alias("a"), F.col("hi").alias("b")))  # one row a bucket
        met = known.join(own, "bucket").where("lo <= b and hi >= a").select("batch", "bucket").distinct()
        return sorted(f"{self.path}/rows/batch={r.batch}/bucket={r.bucket}" for r in met.collect())

    def append(self, batch: DataFrame, batch_id: int) -> None:
        spark, names = batch.sparkSession, self.schema.names
        batch = batch.select(*names)
        self.looked_at = self.folders(batch, batch_id)
        order = F.struct(F.col(self.first_by) if self.first_by else F.lit(0), F.col("_said"))
        contents = batch.withColumn("_said", self._said()).groupBy(*self.keys, "_said").agg(F.min_by(F.struct(*names), order).alias("_row"), F.min(order).alias("_order"))
        contents = contents.withColumn("_first", F.min("_order").over(Window.partitionBy(*self.keys)))
        if self.looked_at:
            known = spark.read.schema(self.schema).parquet(*self.looked_at).select(F.struct(*self.keys).alias("_key"), self._said().alias("_known"))
            contents = contents.join(known, F.struct(*self.keys).eqNullSafe(F.col("_key")), "left")
        else:
            contents = contents.withColumn("_known", F.lit(None).cast("string"))
        rows = contents.where("_known is null and _order = _first").select("_row.*")
        others = contents.where("_said <> coalesce(_known, _first._said)").select("_row.*")
        others.write.mode("overwrite").parquet(f"{self.path}/corrections/batch={batch_id}")
        bucket, _ = self._place()
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch_id}")
        written = spark.read.schema(self.schema).parquet(f"{self.path}/rows/batch={batch_id}")
        counts = written.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"))
        self._ranges(written).join(counts, "bucket").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/batch={batch_id}")

    def _read(self, spark: SparkSession, what: str) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("batch", LongType())])
        if not self._exists(spark, f"{self.path}/{what}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}/batch=*").select(*schema.names)

    def rows(self, spark: SparkSession) -> DataFrame:
        """What the journal holds, with the batch that brought it."""
        return self._read(spark, "rows")

    def corrections(self, spark: SparkSession) -> DataFrame:
        """Later contents of a key that differ from the journal's, with the batch that brought them."""
        return self._read(spark, "corrections")
