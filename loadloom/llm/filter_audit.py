"""How filters interact: what each order of the filters keeps, removes and leaves to nobody, by count-weighted decision diagrams.

Each text gets a mask of the filters it fails. A part has at most 32 masks, so the table comes down to a few counts a part
before anything is compared. These counts are the leaves of a decision diagram with one level for each filter: a node's
low child holds the documents that pass the level's filter, its high child those that fail it, equal children are stored
once, and a node weighs what lies under it. Swapping two adjacent levels touches the nodes of the upper one alone; plain
changes (each order differs from the last by one such swap) visit all orders. The path of low children from the root is
what stays: its nodes weigh what is kept, their high children what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
#: What a diagram weighs: documents, those labelled good, those labelled toxic.
Weight = tuple[int, int, int]
NOTHING: Weight = (0, 0, 0)


def own_mask(text: str | None) -> tuple[int, bytes]:
    """Bits of the filters A to D that a text fails by itself, and what stands for the text when copies are looked for."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * capitals > MAX_CAPITAL_PERCENT * len(text or ""),
        len(raw) > len(raw.translate(None, SIGNS)),
    )
    return sum(f << k for k, f in enumerate(fails)), hashlib.sha256(raw).digest()[:16]


def own_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [own_mask(t) for t in batch.column(2).to_pylist()]
        masks, digests = pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part.

    E asks whether a smaller doc_id has the same text anywhere, so rows first come together by text; rows that agree in
    text, part and labels are counted where they are, and only counts meet.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(own_masks, "doc_id long, part string, mask int, digest binary").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("rows"))
    marks = labels.select(F.col("doc_id").cast("long"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))
    same = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("nameless"), F.min(known).alias("least"))
    first = same.withColumn("first_id", F.expr("min(least.doc_id) over (partition by digest)"))
    fresh = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.rows")).otherwise(0)
    both = first.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), fresh.alias("n")), F.struct(F.lit(16).alias("copy"), (F.col("n") - fresh).alias("n")))).alias("e"))
    total = lambda c: F.sum(F.col("e.n") * c)
    return both.where("e.n > 0").groupBy("part", (F.col("mask") + F.col("e.copy")).alias("mask")).agg(F.sum("e.n").alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


class Diagram:
    """Count-weighted decision diagram of failure masks. Node 0 is empty at every level; other nodes are (low, high)."""

    def __init__(self, counts: dict[int, Weight], variables: int) -> None:
        self.order = list(range(variables))
        self.weight: list[Weight] = [NOTHING]
        self.leaves: dict[Weight, int] = {NOTHING: 0}
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(variables)]
        unique: list[dict[tuple[int, int], int]] = [{} for _ in range(variables)]

        def build(level: int, mask: int) -> int:
            if level == variables:
                return self._leaf(counts.get(mask, NOTHING))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level), unique[level])

        self.root = build(0, 0)

    def _leaf(self, weight: Weight) -> int:
        if weight not in self.leaves:
            self.leaves[weight] = len(self.weight)
            self.weight.append(weight)
        return self.leaves[weight]

    def _node(self, level: int, low: int, high: int, unique: dict[tuple[int, int], int]) -> int:
        if not (low or high):
            return 0
        node = unique.get((low, high))
        if node is None:
            node = unique[low, high] = len(self.weight)
            self.weight.append(tuple(a + b for a, b in zip(self.weight[low], self.weight[high], strict=True)))
            self.levels[level][node] = (low, high)
        return node

    def swap(self, level: int) -> None:
        """Exchanges the variables of ``level`` and the next; nodes of ``level`` keep their number, so those above stay as they are."""
        upper, lower = self.levels[level], self.levels[level + 1]
        self.levels[level + 1] = {}
        unique: dict[tuple[int, int], int] = {}
        for node, (low, high) in upper.items():
            (ll, lh), (hl, hh) = lower.get(low, (0, 0)), lower.get(high, (0, 0))
            upper[node] = (self._node(level + 1, ll, hl, unique), self._node(level + 1, lh, hh, unique))
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def passing(self) -> Iterator[tuple[int, Weight, Weight]]:
        """(variable, kept, removed) along the path of those that pass everything so far."""
        node = self.root
        for level, variable in enumerate(self.order):
            low, high = self.levels[level].get(node, (0, 0))
            yield variable, self.weight[low], self.weight[high]
            node = low


def plain_changes(n: int) -> Iterator[int]:
    """Positions of the adjacent swaps that lead through all orders of ``n`` things: the last thing walks through each order
    of the others, down and up in turn."""
    if n < 2:
        return
    down = True
    inner = plain_changes(n - 1)
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def audit_part(counts: dict[int, Weight]) -> list[tuple]:
    """(filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order."""
    n = len(FILTERS)
    diagram = Diagram(counts, n)
    walks = [(tuple(diagram.order), list(diagram.passing()))]
    for level in plain_changes(n):
        diagram.swap(level)
        walks.append((tuple(diagram.order), list(diagram.passing())))
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for _, walk in walks:
        for step, (variable, _, removed) in enumerate(walk):
            shapley[variable] += removed[0]
            if step == 0:
                fails[variable] = removed[0]
            if step == n - 1:
                alone[variable] = removed[0]
    out = []
    for order, walk in walks:
        name = "".join(FILTERS[v] for v in order)
        out += [(name, step, FILTERS[v], kept[0], gone[0], fails[v] - gone[0], alone[v], gone[1], gone[2], shapley[v]) for step, (v, kept, gone) in enumerate(walk, 1)]
    return out


AUDIT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7]


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in AUDIT.split(", ")]
    for batch in batches:
        for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(part, *r) for r in audit_part({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks})]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source) and each order of the five filters, what every step does; 600 rows a part, zeros included.

    Reads doc_id, source and text of ``docs`` and doc_id, quality and toxic of ``labels``; other columns are left alone.

    Null text: the empty text, and so a copy of other empty ones. Null source: part ''. Null doc_id: the row is counted, is
    no copy of others and others are none of it, and has no labels. Repeated rows: each counts; with the same doc_id
    neither is the other's copy. A doc_id with several labels is good (toxic) if one of them says so. No documents: no rows.
    """
    masks = F.collect_list(F.struct("mask", "n", "good", "toxic"))
    return mask_counts(docs, labels).groupBy("part").agg(masks.alias("masks")).mapInArrow(_audits, AUDIT)
