"""N-gram Jaccard join by count-vector R-trees.

A text's set of word shingles becomes a vector: shingles are hashed into groups and each group's shingles are counted.
The overlap of two sets is at most the sum over groups of the smaller count, so a tree whose nodes keep the largest
count of each group below them finds every partner that can reach the needed overlap. Survivors are verified on the sets.

One tree over a whole corpus would neither fit a task nor prune, so a forest is used, and it loses no pair:

1. Equal sets collapse to one node each (128-bit digest of the sorted shingle hashes).
2. Nodes meet in blocks. Two sets that link share one of the first ``n - ceil(s * n) + 1`` shingles of any order common
   to all sets; ordinary shingles come first in that order, and ones that a count over all documents shows to be
   frequent come last, so passages that many documents share seldom make a block.
3. In each block a tree is searched breadth-first: what a search reaches is taken out of the tree, so a block of m nodes
   gives under m edges, whatever the number of its pairs.
4. Connected components of those edges hold every linked pair. In each component a tree over the sets' exact vectors
   proposes pairs, the sets verify them, and what links is taken out in the same way.

Blocks and components over ``CHUNK`` nodes are dealt out as tiles, each holding two chunks, so no task gathers an
unbounded group, and every pair of chunks meets in one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loadloom.llm.text import PORTION, WordHashes, held, overlap, portions, shingle_set, space_words
from loadloom.session import materialize

#: Shingle counts are kept in so many counters; they only decide the order of shingles, never the result.
BUCKET_BITS = 18
CHUNK = 1024
#: Edges, blocks and sets that a task remembers in order not to give them twice; repeats are dropped later anyway.
SAID = 100_000
#: Shingles for one group of the vectors that blocks are searched with.
BLOCK_SHARE = 2
LEAF = 32


def count_vector(s: np.ndarray, groups: int) -> np.ndarray:
    """Shingles of a set in each group; more groups than asked for where a count would pass 255."""
    while True:
        v = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if not len(s) or v.max() <= 255:
            return v.astype(np.uint8)
        groups *= 2


def groups_for(n: int, share: int) -> int:
    """A power of two, about one group for ``share`` shingles."""
    return 1 << max(4, (n // share).bit_length())


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups."""
    return v.astype(np.uint16) if len(v) == groups else v.reshape(-1, groups).sum(0, dtype=np.uint16)


class CountTree:
    """R-tree over count vectors, packed by halving on the most varied group; found points can be taken out."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray, percent: int) -> None:
        self.n, self.v, self.percent = sizes.astype(np.int64), vectors, percent
        self.alive = np.ones(len(sizes), bool)
        self.nodes: list[list] = []  # high corner, least and largest size, children, points, live points, parent
        self.leaf_of = np.zeros(len(sizes), np.int64)
        self._pack(np.arange(len(sizes)), -1)

    def _pack(self, at: np.ndarray, parent: int) -> int:
        k = len(self.nodes)
        own = self.v[at]
        node = [own.max(0), int(self.n[at].min()), int(self.n[at].max()), (), at, len(at), parent]
        self.nodes.append(node)
        if len(at) <= LEAF:
            self.leaf_of[at] = k
        else:
            column = own[:, int(own.var(0).argmax())]
            order, half = np.argsort(column, kind="stable"), len(at) // 2
            node[3], node[4] = (self._pack(at[order[:half]], k), self._pack(at[order[half:]], k)), None
        return k

    def take(self, i: int) -> None:
        self.alive[i] = False
        k = int(self.leaf_of[i])
        while k >= 0:
            self.nodes[k][5] -= 1
            k = self.nodes[k][6]

    def reach(self, i: int) -> np.ndarray:
        """Live points whose bound allows the needed overlap with point ``i``."""
        q, n, p, found, stack = self.v[i], int(self.n[i]), self.percent, [], [0]
        while stack:
            high, least, most, children, at, live, _ = self.nodes[stack.pop()]
            if not live or p * n > 100 * most or p * least > 100 * n:
                continue
            if int(np.minimum(high, q).sum(dtype=np.int64)) * (100 + p) < p * (n + max(least, -(-p * n // 100))):
                continue
            if children:
                stack += children
                continue
            at = at[self.alive[at]]
            bound = np.minimum(self.v[at], q).sum(1, dtype=np.int64)
            found.append(at[bound * (100 + p) >= p * (self.n[at] + n)])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def spanning_edges(sizes: list[int], vectors: list[np.ndarray], percent: int, share: int, sets: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph of the points whose bound (with ``sets``: whose overlap) is enough.

    The number of groups grows with a set's size, else long sets would all look alike. Each number of groups has a tree of
    its own, which also takes the larger sets that its points could still link to, folded to as few groups.
    """
    n = np.array(sizes, np.int64)
    level = np.array([groups_for(int(x), share) for x in sizes])
    for groups in np.unique(level).tolist():
        own = level == groups
        near = np.flatnonzero(own | ((level > groups) & (percent * n <= 100 * n[own].max())))
        if len(near) > 1:
            yield from _forest(near, CountTree(n[near], np.stack([fold(vectors[i], groups) for i in near]), percent), percent, sets)


def _forest(points: np.ndarray, tree: CountTree, percent: int, sets: list[np.ndarray] | None) -> Iterator[tuple[int, int]]:
    for first in range(len(points)):
        if not tree.alive[first]:
            continue
        tree.take(first)
        queue = [first]
        while queue:
            i = queue.pop()
            for j in tree.reach(i).tolist():
                if sets is not None:
                    a, b = sets[points[i]], sets[points[j]]
                    if overlap(a, b) * (100 + percent) < percent * (len(a) + len(b)):
                        continue
                tree.take(j)
                queue.append(j)
                yield int(points[i]), int(points[j])


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal first ``keys`` columns, of batches that are sorted by them."""
    now, rows = None, []
    for batch in (b.slice(at, PORTION[0]) for b in batches for at in range(0, b.num_rows, PORTION[0])):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def digest_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


SIGNATURE = "doc_id long, mark_a long, mark_b long, n long, node long, digest binary, vec binary, bucket int, seen long"
SIGNATURE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64())
#: Texts that are sent for by their marks to every task (under 32 MB); beyond that all texts are shuffled.
BROADCAST_MARKS = 2_000_000


def signatures(k: int):
    """For each text its set's size, digest and vector; for each task how many texts had a shingle of each bucket."""
    names = [c.split()[0] for c in SIGNATURE.split(", ")]

    def batch_of(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SIGNATURE_TYPES, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = held("words", WordHashes), np.zeros(1 << BUCKET_BITS, np.int64)
        pick = np.uint64(64 - BUCKET_BITS)
        for batch in (p for b in batches for p in portions(b, 3)):
            rows = []
            for text in batch.column(3).to_pylist():
                s = shingle_set(space_words(text), hashes, k)
                d = digest_of(s)
                rows.append((len(s), int.from_bytes(d[:8], "little", signed=True), d, count_vector(s, groups_for(len(s), BLOCK_SHARE)).tobytes() if len(s) else b""))
                if len(s):
                    np.add.at(seen, (s >> pick).astype(np.int64), 1)
            if rows:
                none = [None] * len(rows)
                yield batch_of(*batch.columns[:3], *zip(*rows, strict=True), none, none)
        full = np.flatnonzero(seen)
        for at in range(0, len(full), 1 << 16):
            b = full[at : at + (1 << 16)]
            yield batch_of(*[[None] * len(b)] * 7, b.astype(np.int32), seen[b])

    return run


def frequent(counters: DataFrame) -> np.ndarray:
    """Counts of the buckets that stand out, 0 for the rest: ``2 ** BUCKET_BITS`` numbers, however many documents."""
    weight = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in counters.toArrow().to_batches():
        weight[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    mean = weight.mean()
    weight[weight < mean + 8 * max(1.0, mean**0.5)] = 0
    return weight


def prefix_keys(k: int, percent: int, weights):
    """(key, node) for each shingle of a set's prefix; equal sets in a task give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weight, done = held("words", WordHashes), weights.value, set()
        pick = np.uint64(64 - BUCKET_BITS)
        for batch in (p for b in batches for p in portions(b, 0)):
            keys, nodes, lengths = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(space_words(text), hashes, k)
                if not len(s) or (d := digest_of(s)[:8]) in done:
                    continue
                if len(done) >= SAID:
                    done.clear()
                done.add(d)
                w = weight[(s >> pick).astype(np.int64)]
                if w.any():
                    s = s[np.lexsort((s, w))]
                keys.append(s[: len(s) - -(-percent * len(s) // 100) + 1])
                nodes.append(int.from_bytes(d, "little", signed=True))
                lengths.append(len(keys[-1]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths))], names=["key", "node"])

    return run


def block_edges(percent: int):
    """Edges of the bound's graph in each block; rows: key, tile, digest, n, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, said, out = set(), set(), []
        for _, rows in groups_of(batches, 2):
            own = {r[0]: r for r in rows}
            same = hash(tuple(sorted(own)))
            if len(own) < 2 or same in blocks:
                continue
            if len(blocks) >= SAID:
                blocks.clear()
            if len(said) >= SAID:
                said.clear()
            blocks.add(same)
            ids = list(own)
            for i, j in spanning_edges([own[d][1] for d in ids], [np.frombuffer(own[d][2], np.uint8) for d in ids], percent, BLOCK_SHARE):
                e = (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
                if e not in said:
                    said.add(e)
                    out.append(e)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["u", "v"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["u", "v"])

    return run


def verified_edges(k: int, percent: int):
    """Links of a spanning forest in each component; rows: component, tile, digest, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)

        def loaded():
            now, own = None, {}
            for batch in (p for b in batches for p in portions(b, 3)):
                for root, tile, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (root, tile) != now:
                        if len(own) > 1:
                            yield own
                        now, own = (root, tile), {}
                    if digest not in own:
                        s = shingle_set(space_words(text), hashes, k)
                        own[digest] = s
            if len(own) > 1:
                yield own

        for own in loaded():
            ids, sets = list(own), list(own.values())
            sizes = [len(s) for s in sets]
            edges = [(ids[i], ids[j]) for i, j in spanning_edges(sizes, [count_vector(s, groups_for(len(s), 1)) for s in sets], percent, 1, sets)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges, strict=True)], names=["u", "v"])

    return run


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node of the component.

    Large-star and small-star rounds, each one aggregation and one join on the node, until no edge changes. A node with
    very many neighbours only sends a partial minimum from each task; its edges are joined in splits by skew handling.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, tag)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def tiles(rows: DataFrame, key: str, identity: str) -> DataFrame:
    """Adds ``tile``: rows of a key with over ``CHUNK`` members (column ``members``) go to every tile with their chunk."""
    parts = F.ceil(F.col("members") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64(identity), parts).cast("int")
    both = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.least(o, chunk) * parts + F.greatest(o, chunk))
    return rows.withColumn("tile", F.explode(F.when(F.col("members") <= CHUNK, F.array(F.lit(0))).otherwise(both)))


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Groups documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent``/100 or more.

    Reads ``doc_id`` and ``text``; other columns are left alone. Returns one row for each row of ``docs``: doc_id,
    n_shingles, component_id (least doc_id reachable by links), copies (rows with the same set), component (bytes that stand for
    the component, null for empty sets), mark_a and mark_b (hashes that stand for the text).

    Null text, empty text and text without words: an empty set, linked with nothing, component_id is its doc_id.
    Null doc_id: the row links like any other, but is in no minimum; its component_id is null if all of its component are null.
    Repeated rows: each is returned. A doc_id with several texts: each text is judged by itself. Empty table: no rows.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), *text_marks(text), text.alias("text"))
    found = materialize(docs.mapInArrow(signatures(k), SIGNATURE), "ngram-signatures")
    rows = found.where("bucket is null")
    counts = found.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen"))
    weights = docs.sparkSession.sparkContext.broadcast(frequent(counts))
    nodes = materialize(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("mark_a", "mark_b")).alias("mark"), F.first("n").alias("n"), F.first("node").alias("node"), F.first("vec").alias("vec")), "ngram-nodes")

    keys = docs.select("text").mapInArrow(prefix_keys(k, percent, weights), "key long, node long")
    blocks = keys.selectExpr("key", "node", "min(node) over (partition by key) lo", "max(node) over (partition by key) hi")
    blocks = materialize(blocks.where("lo < hi").select("key", "node").distinct(), "ngram-blocks")
    # near copies share many shingles, so many blocks hold the same nodes; one of each kind stays
    kinds = blocks.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"))
    kinds = kinds.groupBy("members", "a", "b").agg(F.min("key").alias("key")).select("key", "members")
    placed = tiles(blocks.join(kinds, "key").join(nodes.select("node", "digest", "n", "vec"), "node"), "key", "digest")
    placed = placed.select("key", "tile", "digest", "n", "vec").repartition("key", "tile").sortWithinPartitions("key", "tile")
    near = components(placed.mapInArrow(block_edges(percent), "u binary, v binary"), "ngram-near")

    sized = near.join(near.groupBy("root").agg(F.count("*").alias("members")), "root")
    sized = materialize(sized.join(nodes.select(F.col("digest").alias("node"), "mark.mark_a", "mark.mark_b"), "node"), "ngram-members")
    wanted = sized.select("mark_a", "mark_b")  # one text for each node, found by 128 bits
    few = wanted.count() <= BROADCAST_MARKS
    texts = docs.join(F.broadcast(wanted), ["mark_a", "mark_b"], "left_semi") if few else docs
    texts = texts.groupBy("mark_a", "mark_b").agg(F.first("text").alias("text"))
    texts = tiles(sized.join(texts, ["mark_a", "mark_b"]), "root", "node").select("root", "tile", F.col("node").alias("digest"), "text")
    texts = texts.repartition("root", "tile").sortWithinPartitions("root", "tile")
    linked = components(texts.mapInArrow(verified_edges(k, percent), "u binary, v binary"), "ngram-linked")

    of = nodes.select(F.col("digest").alias("node"), "rep", "copies").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = materialize(of.join(least, "root").select(F.col("node").alias("digest"), "root", "component_id", "copies"), "ngram-classes")
    return rows.select("doc_id", "mark_a", "mark_b", F.col("n").alias("n_shingles"), "digest").join(of, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.col("root").alias("component"),
        "mark_a",
        "mark_b",
    )


def text_marks(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("mark_a"), F.xxhash64(F.lit(1), text).alias("mark_b")]


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any columns), unchanged, of which each component of ``ngram_join`` keeps one.

    The one with the least doc_id stays; rows without an id come last, and ties go by a hash of the text. Of rows that repeat
    doc_id and text any one stays. Texts without words are linked with nothing and all stay.
    """
    found = ngram_join(docs, k, percent)
    least = found.where("component is not null").groupBy("component", (F.col("doc_id").isNull()).alias("_last"), "doc_id", "mark_a", "mark_b").agg(F.count("*").alias("rows"))
    chosen = least.groupBy("component").agg(F.min(F.struct("_last", "doc_id", "mark_a", "mark_b", "rows")).alias("row")).select("row.*")
    chosen = materialize(chosen.select(F.col("doc_id").alias("_ngram_id"), F.col("mark_a").alias("_ngram_a"), F.col("mark_b").alias("_ngram_b"), "rows"), "ngram-chosen")
    a, b = text_marks(F.col("text").cast("string"))
    marked = docs.withColumns({"_ngram_row_a": a, "_ngram_row_b": b})
    same = lambda other: (F.col("_ngram_row_a") == other["_ngram_a"]) & (F.col("_ngram_row_b") == other["_ngram_b"]) & F.col("doc_id").cast("long").eqNullSafe(other["_ngram_id"])
    once, more = chosen.where("rows = 1"), chosen.where("rows > 1")
    kept = marked.join(once, same(once), "left_semi")
    if not more.isEmpty():
        kept = kept.unionByName(marked.join(more, same(more), "left_semi").dropDuplicates(["doc_id", "_ngram_row_a", "_ngram_row_b"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
