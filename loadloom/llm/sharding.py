"""Size-tiered compaction of immutable shards under a versioned manifest. DataFrame functions only.

Arrivals become small shards without a shuffle. Shards whose sizes lie in one tier are merged in runs up to the target size;
merged shards move up a tier. A manifest lists the live shards of a version and is written by the tasks under a name of its
own; a version is committed by one small file that holds the manifest's name: it is written under a temporary name and
renamed to the version's number without overwriting. Of two writers one gets the number, the other has to try again and its
shards are removed; a writer that dies before the rename leaves nothing that stands in the way. Readers see the old version or
the new one. That is as atomic as the file system's rename without overwrite: HDFS's is, a local disk's nearly.

A scan needs the paths of its shards on the driver, as Spark's own file index does: one for each 64 MB at full size.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loadloom.session import materialize

TARGET_BYTES = 64 << 20
#: Least bytes of a tier over least bytes of the one below.
FACTOR = 4
#: Shards under this many bytes are of tier 0.
SMALLEST = 1 << 20
#: Shards that are put in order together when runs are planned.
PLANNED = 10_000
MANIFEST = "shard string, bytes long, rows long, tier int"
#: Plans of up to so many rows are sent to every task; a longer one is shuffled.
BROADCAST_ROWS = 100_000


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardStore:
    """Shards of one schema under ``path``: data/<run>/..., manifests/<name>/..., commits/<version>, schema."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES) -> None:
        self.spark, self.path, self.target = spark, path.rstrip("/"), target

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _put(self, name: str, content: str) -> bool:
        """Writes a small file whole or not at all; False if the name is taken."""
        jvm = self.spark._jvm
        fs, place = self._fs(f"{self.path}/{name}")
        _, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        fs.mkdirs(place.getParent())
        if fs.exists(place) and not fs.getFileStatus(place).getLen():
            fs.delete(place, False)  # no writer leaves an empty file any more: what is left of one that died is in the way
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, keep)
        except Py4JJavaError:
            fs.delete(draft, False)
            if not fs.exists(place):
                raise
            return False
        return True

    def _get(self, name: str) -> str | None:
        fs, place = self._fs(f"{self.path}/{name}")
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}").collect()) if fs.exists(place) else None

    def _remove(self, name: str) -> None:
        fs, place = self._fs(name)
        fs.delete(place, True)

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The last committed version; 0 before the first. A file that its writer left empty is no version."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getLen() and s.getPath().getName().isdigit()), default=0)

    def schema(self) -> StructType | None:
        """Of the rows; None before the first arrival."""
        told = self._get("schema")
        return StructType.fromJson(json.loads(told)) if told else None

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.path}/commits/{version:010d}").first()[0]
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{name}")

    def commit(self, live: DataFrame, base: int, run: str | None = None) -> int:
        """Makes ``live`` the version after ``base``; if another writer made it, removes the shards of ``run`` and raises Conflict."""
        name = uuid.uuid4().hex
        live.write.json(f"{self.path}/manifests/{name}")
        if not self._put(f"commits/{base + 1:010d}", name):
            self._remove(f"{self.path}/manifests/{name}")
            if run:
                self._remove(run)
            raise Conflict(f"{self.path} has a version {base + 1}")
        return base + 1

    def _measured(self, run: str) -> DataFrame:
        """Manifest rows for the files of a run; bytes and rows come from the files themselves."""
        rows = self.spark.read.parquet(run).groupBy(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)) / SMALLEST) / F.log(F.lit(float(FACTOR)))) + 1).cast("int")
        return rows.select("shard", "bytes", "rows", tier.alias("tier"))

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival: each of its partitions is cut into shards of about a quarter of the target. One without rows changes nothing."""
        base = self.version()
        self._put("schema", rows.schema.json())  # the first arrival's stays
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        sized = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in rows.schema.fields if f.dataType.typeName() in ("string", "binary")]
        mean = rows.agg(F.avg(sum(sized, F.lit(8 * len(rows.columns))))).first()[0]
        if mean is None:
            return base
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", max(1, int(self.target / 4 / mean))).parquet(run)
        return self.commit(self.manifest(base).unionByName(self._measured(run)), base, run)

    def plan(self, live: DataFrame) -> DataFrame:
        """(shard, run): runs of two or more shards of a tier, smallest first, each up to the target size."""
        small = live.where(F.col("bytes") < self.target / 2)
        parts = {r["tier"]: -(-r["count"] // PLANNED) for r in small.groupBy("tier").count().collect()}  # a row for each tier
        if not parts:
            return small.select("shard", F.lit("").alias("run"), "bytes", "rows").limit(0)
        of = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        small = small.withColumn("part", F.pmod(F.xxhash64("shard"), F.element_at(of, F.col("tier"))))
        sums = Window.partitionBy("tier", "part").orderBy("bytes", "shard").rowsBetween(Window.unboundedPreceding, -1)
        runs = small.withColumn("run", F.concat_ws("-", "tier", "part", F.floor(F.coalesce(F.sum("bytes").over(sums), F.lit(0)) / self.target).cast("long")))
        many = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
        return runs.join(many, "run").select("shard", "run", "bytes", "rows")

    def compact(self) -> int:
        """Merges until no tier has a run left; each round reads only the shards it merges, and commits a version."""
        while True:
            base = self.version()
            live = self.manifest(base)
            plan = materialize(self.plan(live), "shard-plan")
            total = plan.agg(F.count("*").alias("shards"), F.count_distinct("run").alias("runs")).first()
            if not total["shards"]:
                return base
            shards = [r["shard"] for r in plan.select("shard").toLocalIterator()]
            data = self.spark.read.parquet(*[unquote(s) for s in shards])
            columns = [F.col(f"`{c}`") for c in data.columns]
            numbered = plan.select("run").distinct().withColumn("_no", F.row_number().over(Window.orderBy("run")) - 1)  # a row for each run
            small = plan.select("shard", "run").join(numbered, "run")
            placed = data.select("*", F.col("_metadata.file_path").alias("_shard")).join(F.broadcast(small) if total["shards"] <= BROADCAST_ROWS else small, F.col("_shard") == F.col("shard"))
            run = f"{self.path}/data/{uuid.uuid4().hex}"
            # a task for each run: by a hash of its name several would meet in one
            placed = placed.select(*columns, F.col("run").alias("_run"), "_no").repartitionById(total["runs"], "_no").drop("_no")
            placed.write.option("compression", "zstd").partitionBy("_run").parquet(run)
            merged = self._measured(run)
            self.commit(live.join(plan.select("shard"), "shard", "left_anti").select("shard", "bytes", "rows", "tier").unionByName(merged), base, run)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with ``_shard`` (the file) and ``_tier``; without shards, no rows of the schema."""
        live = self.manifest(version).select(F.col("shard").alias("_shard"), F.col("tier").alias("_tier"))
        shards = [unquote(r["_shard"]) for r in live.toLocalIterator()]
        if not shards:
            return self.spark.createDataFrame([], StructType([*(self.schema() or StructType()).fields, StructField("_shard", StringType()), StructField("_tier", IntegerType())]))
        data = self.spark.read.parquet(*shards).select("*", F.col("_metadata.file_path").alias("_shard"))
        return data.join(F.broadcast(live) if len(shards) <= BROADCAST_ROWS else live, "_shard", "left")

    def vacuum(self, versions: int = 1, age: float = 86400.0) -> int:
        """Removes all but the last ``versions`` versions, and data, manifests and drafts that none of these holds and that are over ``age`` seconds
        old (younger ones may be a writer's who has not committed yet); returns how many runs of data went. The driver holds the names of runs and
        manifests, not of shards."""
        last = self.version()
        kept = [v for v in range(max(1, last - versions + 1), last + 1)]
        manifests = {self._get(f"commits/{v:010d}") for v in kept}
        folder = F.regexp_extract("shard", "/data/([^/]+)/", 1).alias("run")
        runs = {r["run"] for m in manifests if m for r in self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{m}").select(folder).distinct().collect()}
        old = {f"{v:010d}" for v in range(1, last - versions + 1)}
        gone = 0
        for where, live in (("commits", None), ("manifests", manifests), ("drafts", set()), ("data", runs)):
            for name in self._names(where):
                fs, p = self._fs(f"{self.path}/{where}/{name}")
                dead = name in old if live is None else name not in live
                if dead and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 >= age:
                    fs.delete(p, True)
                    gone += where == "data"
        return gone


def shard_documents(docs: DataFrame, path: str, arrivals: int = 3, target: int = TARGET_BYTES) -> ShardStore:
    """A store at ``path`` holding every row of ``docs`` (doc_id and any columns), come in ``arrivals`` parts and compacted.

    All rows are kept as they are: nulls (a null doc_id is in the first arrival), empty and very long texts, repeated rows.
    Empty table: a store without shards at version 0, which reads as no rows. Columns named ``_run``, ``_shard``, ``_tier`` or ``_no``, in
    either case, are refused.
    """
    clash = {"_run", "_shard", "_tier", "_no"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the store's own")
    store = ShardStore(docs.sparkSession, path, target)
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0))
    for k in range(arrivals):
        store.append(docs.where(part == k))
    store.compact()
    return store
