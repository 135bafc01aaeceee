"""Merkle manifest of a dataset: a digest of every row, a root for every source and for all, and a proof for every row.

Rows are numbered within their source (``ranked``), and a number's digits in base 16 say where it stands in the tree.
``rolled`` groups rows by blocks of 256 numbers and groups the digits away one after the other, least first: what was a row
becomes a struct in its parent's array, and the parent's digest is that of its children's. A block is one row of bounded
size and its top is a row of the next round, so each round leaves a 256th of the rows and any source, however large,
is spread over its blocks. When every source is one row, the sources themselves are numbered and rolled up.

Proofs go the other way (``spread``): each block is united with what its top was given and exploded again, and every child
takes its siblings from the arrays around it. No step is a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loadloom.session import materialize

FAN = 16
BLOCK = FAN * FAN
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest of a row: each value with the number of its bytes before it, ``-`` for null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return digest(F.concat(*told))


def _numbered(schema: StructType, key: str) -> object:
    """Adds to rows that are sorted by ``key``: the task, the number of the key within the task, the row's number within its key."""
    names = [*schema.names, "_task", "_run", "_at"]
    at = schema.names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs, now, n = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            run_of, place = [], []
            for value in batch.column(at).to_pylist():
                if runs < 0 or value != now:
                    runs, now, n = runs + 1, value, 0
                run_of.append(runs)
                place.append(n)
                n += 1
            new = [pa.array([task] * len(place), pa.int64()), pa.array(run_of, pa.int64()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return run


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``rank``: a row's number from 0 within its ``key``, by ``order`` ascending, nulls first.

    Rows are dealt by ranges of (key, order), so a key with a third of all rows lies in many tasks; each task numbers its own, and
    only its first key can have rows in tasks before it. The driver gets one row a task. A running number of the row as it
    was read breaks ties of the ranges, so that even one row repeated without end is spread.
    """
    spread_out = rows.withColumn("_read", F.monotonically_increasing_id())
    sorted_rows = spread_out.repartitionByRange(key, *order, "_read").drop("_read").sortWithinPartitions(key, *order)
    schema = StructType([*sorted_rows.schema.fields, *(StructField(c, LongType()) for c in ("_task", "_run", "_at"))])
    numbered = materialize(sorted_rows.mapInArrow(_numbered(sorted_rows.schema, key), schema), "manifest-ranks")
    ends = numbered.groupBy("_task").agg(
        F.min_by(F.struct(key), "_run").alias("first"),
        F.max_by(F.struct(key), "_run").alias("last"),
        F.max("_run").alias("runs"),
        (F.max_by("_at", F.struct("_run", "_at")) + 1).alias("in_last"),
    )
    before, held, open_key = [], 0, None
    for e in ends.orderBy("_task").collect():
        offset = held if e["first"] == open_key else 0
        before.append((e["_task"], offset))
        open_key, held = e["last"], e["in_last"] + (offset if e["runs"] == 0 else 0)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_task long, _offset long"))  # one row a task
    rank = F.col("_at") + F.when(F.col("_run") == 0, F.col("_offset")).otherwise(0)
    return numbered.join(offsets, "_task").withColumn("rank", rank).drop("_task", "_run", "_at", "_offset")


def rolled(rows: DataFrame) -> DataFrame:
    """Blocks of 256 rows of a tree; rows: tree, rank, node (its digest), item (what comes back with its proof).

    One row a block: tree, block, node, high, kids (array of digit, node, kids (array of digit, node, item)). Levels are built
    while there is more than one node: the first block of a tree with fewer than 256 rows is the whole tree, and may have
    none (``high`` 0) or one.
    """
    digits = rows.select("tree", F.expr(f"rank div {BLOCK}").alias("block"), F.expr(f"rank div {FAN} % {FAN}").alias("d1"), (F.col("rank") % FAN).alias("d0"), "node", "item")
    # dealt by block once: both groupings find their rows where they are
    runs = digits.repartition("tree", "block").groupBy("tree", "block", "d1").agg(F.array_sort(F.collect_list(F.struct("d0", "node", "item"))).alias("kids"))
    runs = runs.withColumn("node", digest(F.array_join("kids.node", "")))
    blocks = runs.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("d1", "node", "kids"))).alias("kids"))
    lone = (F.col("block") == 0) & (F.size("kids") == 1)
    high = F.when(lone & (F.size(F.col("kids")[0]["kids"]) == 1), 0).when(lone, 1).otherwise(2)
    node = F.when(F.col("high") == 0, F.col("kids")[0]["kids"][0]["node"]).when(F.col("high") == 1, F.col("kids")[0]["node"]).otherwise(digest(F.array_join("kids.node", "")))
    return materialize(blocks.withColumn("high", high).withColumn("node", node), "manifest-blocks")


def rounds_of(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rolls up until every tree is one row: the rounds' blocks, and (tree, node)."""
    rounds = []
    while True:
        rounds.append(rolled(rows))
        tops = rounds[-1].select("tree", F.col("block").alias("rank"), "node")
        if not (tops.agg(F.max("rank")).first()[0] or 0):
            return rounds, tops.select("tree", "node")
        rows = tops.withColumn("item", F.lit(0))


LEVEL = "struct<before:string,after:string>"


def _siblings(kids: str, at: str) -> Column:
    """Digests before and after a place among ``kids``, each as one text."""
    nodes = F.col(f"{kids}.node")
    joined = lambda start, length: F.array_join(F.slice(nodes, start, length), "")
    return F.struct(joined(F.lit(1), F.col(at)).alias("before"), joined(F.col(at) + 2, F.lit(FAN)).alias("after"))


def spread(blocks: DataFrame, given: DataFrame) -> DataFrame:
    """What each row of ``blocks`` needs: tree, rank, node, item, proof (array of before and after, its own level first), told.

    ``given`` has (tree, block, proof, told) for every block's top; it meets the block in one grouping of their union.
    """
    both = blocks.select("tree", "block", F.struct("high", "kids").alias("held"), F.lit(None).cast(f"array<{LEVEL}>").alias("proof"), F.lit(None).cast(given.schema["told"].dataType).alias("told"))
    both = both.unionByName(given.withColumn("held", F.lit(None).cast(both.schema["held"].dataType)))
    pick = lambda c: F.first(c, ignorenulls=True).alias(c)
    met = both.groupBy("tree", "block").agg(pick("held"), pick("proof"), pick("told"))
    upper = met.select("tree", "block", "proof", "told", F.col("held.high").alias("high"), F.col("held.kids").alias("runs"), F.posexplode("held.kids").alias("i1", "run"))
    upper = upper.withColumn("upper", _siblings("runs", "i1")).drop("runs").select("*", F.posexplode("run.kids").alias("i0", "kid"))
    own = F.array(_siblings("run.kids", "i0"), F.col("upper"))
    rank = F.col("block") * BLOCK + F.col("i1") * FAN + F.col("i0")
    return upper.select("tree", rank.alias("rank"), F.col("kid.node").alias("node"), F.col("kid.item").alias("item"), F.concat(F.slice(own, 1, F.col("high")), "proof").alias("proof"), "told")


def spread_rounds(rounds: list[DataFrame], given: DataFrame) -> DataFrame:
    """``spread`` through all rounds, the last one's first."""
    for blocks in reversed(rounds[1:]):
        given = spread(blocks, given).select("tree", F.col("rank").alias("block"), "proof", "told")
    return spread(rounds[0], given)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: digest(F.concat(level["before"], node, level["after"])))


def tampered_leaf(columns: dict[str, Column]) -> Column:
    """The leaf of a tampered row, null where the row is left as it is: text lower-cased where 5 divides the id's checksum."""
    changed = columns | {"text": F.translate(columns["text"].cast("string"), UPPER, LOWER)}
    return F.when(F.crc32(columns["doc_id"].cast("string").cast("binary")) % 5 == 0, leaf_of(changed))


def manifest(docs: DataFrame) -> DataFrame:
    """A proof for every row of ``docs``: doc_id, source, leaf, other_leaf (of the tampered row, else null), subroot, root, proof
    (array of before and after: the siblings' digests on either side, level by level up to the root).

    Reads doc_id, source, lang, n_chars and text; other columns are in no digest. Null values have a digest of their own. Null
    source: a source by itself, first of all. Null doc_id: first in its source, never tampered. Repeated rows: each is a
    leaf; rows of one doc_id come by their digests. Empty table: no rows. One row alone: leaf, subroot and root are the same.
    """
    columns = {c: F.col(c) for c in FIELDS}
    columns |= {c: F.col(c).cast("long") for c in ("doc_id", "n_chars")}
    leaves = docs.select(columns["doc_id"].alias("doc_id"), columns["source"].cast("string").alias("tree"), leaf_of(columns).alias("node"), tampered_leaf(columns).alias("other_leaf"))
    leaves = ranked(leaves, "tree", ["doc_id", "node"]).select("tree", "rank", "node", F.struct("doc_id", "other_leaf").alias("item"))
    rounds, subroots = rounds_of(leaves)
    sources = ranked(subroots.select(F.lit(0).alias("all"), F.col("tree").alias("source"), "node"), "all", ["source"])
    tops, root = rounds_of(sources.select(F.col("all").alias("tree"), "rank", "node", F.struct("source").alias("item")))
    start = root.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(f"array<{LEVEL}>").alias("proof"), F.col("node").alias("told"))
    given = spread_rounds(tops, start).select(F.col("item.source").alias("tree"), F.lit(0).cast("long").alias("block"), "proof", F.struct(F.col("node").alias("subroot"), F.col("told").alias("root")).alias("told"))
    return spread_rounds(rounds, given).select("item.doc_id", F.col("tree").alias("source"), F.col("node").alias("leaf"), "item.other_leaf", "told.subroot", "told.root", "proof")


def verify(proofs: DataFrame) -> DataFrame:
    """Folds each row's proof: adds proof_sha256, folded_root (from the tampered leaf where there is one) and verified."""
    siblings = F.array_join(F.transform("proof", lambda level: F.concat(level["before"], level["after"])), "")
    told = proofs.withColumn("proof_sha256", digest(siblings)).withColumn("folded_root", folded(F.coalesce("other_leaf", "leaf"), F.col("proof")))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
