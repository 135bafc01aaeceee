"""Near-duplicate removal by SetSketch registers.

Every shingle of a text draws one exponential number for each of 128 registers (from its hash), and a register keeps the least
of them on a scale of powers of ``BASE``, cut off at both ends of 16 bits: ``K = floor(1 - log_b(x))``. Registers of a union are
the larger of each pair (``merged``), and registers of two sets agree about as often as the sets overlap, so they serve as a
locality-sensitive hash: four registers make a band of 64 bits, and texts that share one of 32 bands meet.

Texts that meet are compared by the joint likelihood of their registers: how many are larger, smaller and equal, given both
sizes, says how likely each similarity is (``similarity``). A pair goes on unless the similarities asked for are less likely than
the best one by a factor of e^25; what goes on is verified on the full sets.

Chance of losing a link: at a similarity of 0.85 all bands differ with probability (1 - 0.85^4)^32 = 6e-11, and the
likelihood rejects with about e^-25 = 1e-11; both are less for closer pairs, and a group holds together by many links.

1. Equal sets collapse to one node (128-bit digest of the sorted shingle hashes).
2. Nodes meet in bands. Bands that hold the same nodes are taken once. In each, a spanning forest of the pairs that the
   likelihood lets pass is built by searches that take out what they reach: a band of m nodes gives under m edges.
3. The components of these edges hold every link. In each the same search, now also verifying the sets, gives the links
   of a spanning forest, and their components are the groups.

Bands and components over ``ngram_join.CHUNK`` nodes are dealt out as tiles of two chunks, so that tasks stay bounded and
every two chunks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadloom.llm.ngram_join import BROADCAST_MARKS, components, digest_of, groups_of, text_marks, tiles
from loadloom.llm.text import PLACES, WordHashes, mix, overlap, shingle_set, space_words
from loadloom.session import materialize

REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 0xFFFF
#: Natural logarithm of how much less likely the similarities asked for must be before a pair is given up.
DOUBT = 25.0
#: Share of equal registers under which a pair is given up unseen: at 0.85 that happens with probability e^-68.
LEAST_EQUAL = 0.4
#: Shingles that are hashed at a time.
PIECE = 1 << 15

_ORDER = np.arange(1, REGISTERS + 1, dtype=np.uint64)
_FLIP, _SPIN = mix(_ORDER * PLACES[0]), mix(_ORDER * PLACES[1]) | np.uint64(1)


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each (non-empty) set and register the least hash of the set's shingles."""
    low = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(values), PIECE):
        v, o = values[at : at + PIECE], owner[at : at + PIECE]
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        whose = o[starts]
        for j in range(REGISTERS):
            h = (v ^ _FLIP[j]) * _SPIN[j]
            h ^= h >> np.uint64(32)
            low[whose, j] = np.minimum(low[whose, j], np.minimum.reduceat(h * _SPIN[j], starts))
    return low


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets x 128, 16 bits) of non-empty sets of 64-bit hashes."""
    uniform = (least_hashes(sets).astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _larger(share: np.ndarray) -> np.ndarray:
    """Chance that one register is larger, from the share of the union that only its set has."""
    return -np.log1p(-np.maximum(share, 0) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(similarity: np.ndarray, share: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Of similarities, where the first set has ``share`` of both sizes' sum and so many of its registers are larger and smaller."""
    up, down = _larger(share - (1 - share) * similarity), _larger(1 - share - share * similarity)
    equal = np.maximum(1 - up - down, 1e-300)
    of = lambda n, p: n * np.log(np.maximum(p, 1e-300))
    return of(more, up) + of(less, down) + of(REGISTERS - more - less, equal)


def similarity(share: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The likeliest similarity (the likelihood is concave in it)."""
    low, high = np.zeros(len(share)), np.minimum(share, 1 - share) / np.maximum(share, 1 - share)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rises = log_likelihood(a, share, more, less) < log_likelihood(b, share, more, less)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    return (low + high) / 2


def may_link(n: int, own: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` the registers leave as partners of one set."""
    go = (percent * np.maximum(sizes, n) <= 100 * np.minimum(sizes, n)) & ((others == own).sum(1) >= LEAST_EQUAL * REGISTERS)
    at = np.flatnonzero(go)
    if len(at):
        more, less = (own > others[at]).sum(1), (own < others[at]).sum(1)
        share = n / (n + sizes[at])
        most = np.minimum(share, 1 - share) / np.maximum(share, 1 - share)
        # two bounds of the best likelihood settle nearly all pairs: that of free chances, and that of the share of equal registers
        asked = log_likelihood(np.minimum(percent / 100, most), share, more, less)
        counts = np.stack([more, less, REGISTERS - more - less])
        free = (counts * np.log(np.maximum(counts, 1) / REGISTERS)).sum(0)
        near = log_likelihood(np.minimum(counts[2] / REGISTERS, most), share, more, less)
        sure = free - asked <= DOUBT
        go[at] = sure
        rest = np.flatnonzero(~sure & ((near - asked <= DOUBT) | (100 * counts[2] >= percent * REGISTERS)))
        if len(rest):
            share, more, less, most = share[rest], more[rest], less[rest], most[rest]
            best = similarity(share, more, less)
            asked = log_likelihood(np.minimum(np.maximum(best, percent / 100), most), share, more, less)
            go[at[rest]] = log_likelihood(best, share, more, less) - asked <= DOUBT
    return go


def spanning_edges(sizes: np.ndarray, registers: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that registers (with ``sets``: the sets) let pass."""
    left = np.arange(len(sizes))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            go = may_link(int(sizes[i]), registers[i], sizes[left], registers[left], percent)
            if sets is not None:
                for at in np.flatnonzero(go):
                    a, b = sets[i], sets[left[at]]
                    go[at] = overlap(a, b) * (100 + percent) >= percent * (len(a) + len(b))
            found, left = left[go].tolist(), left[~go]
            queue += found
            yield from ((i, j) for j in found)


SKETCH = "doc_id long, mark_a long, mark_b long, n long, node long, digest binary, registers binary"


def sketches(k: int):
    """A row for each text: its set's size, digest and registers (none for an empty set)."""
    names = [c.split()[0] for c in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(space_words(t), hashes, k) for t in part.column(3).to_pylist()]
                full = [s for s in sets if len(s)]
                found = iter(registers_of(full) if full else ())
                drawn = [next(found).tobytes() if len(s) else None for s in sets]
                digests = [digest_of(s) for s in sets]
                nodes = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(digests, pa.binary()), pa.array(drawn, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=names)

    return run


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) for each band of a node: four registers are 64 bits, mixed with the band's number."""
    salt = mix(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64) * PLACES[2])
    for batch in batches:
        if batch.num_rows:
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            keys = mix(bands ^ salt).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])


def _edges(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges, strict=True)], names=["u", "v"])


def band_edges(percent: int):
    """Edges between nodes that share a band; rows: key, tile, digest, n, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches, 2):
            own = {r[0]: r for r in rows}
            ids = list(own)
            sizes = np.array([own[d][1] for d in ids])
            registers = np.frombuffer(b"".join(own[d][2] for d in ids), np.uint16).reshape(len(ids), -1)
            if edges := [(ids[i], ids[j]) for i, j in spanning_edges(sizes, registers, percent)]:
                yield _edges(edges)

    return run


def verified_edges(k: int, percent: int):
    """Links of a spanning forest in each component; rows: component, tile, digest, registers, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def loaded():
            now, own = None, {}
            for batch in batches:
                for root, tile, digest, registers, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (root, tile) != now:
                        if len(own) > 1:
                            yield own
                        now, own = (root, tile), {}
                    if digest not in own:
                        own[digest] = (registers, shingle_set(space_words(text), hashes, k))
            if len(own) > 1:
                yield own

        for own in loaded():
            ids, sets = list(own), [s for _, s in own.values()]
            registers = np.frombuffer(b"".join(r for r, _ in own.values()), np.uint16).reshape(len(ids), -1)
            if edges := [(ids[i], ids[j]) for i, j in spanning_edges(np.array([len(s) for s in sets]), registers, percent, sets)]:
                yield _edges(edges)

    return run


def if_small(keys: DataFrame) -> DataFrame:
    """Rows of two numbers, sent to every task where they are few (under 32 MB), so that the other side stays where it is."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_MARKS else keys


def near_groups(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """Groups documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent``/100 or more.

    Reads ``doc_id`` and ``text``; other columns are left alone. Returns one row for each row of ``docs``: doc_id,
    n_shingles, component_id (least doc_id reachable by links), kept (doc_id is the component_id).

    Null text, empty text and text without words: an empty set, linked with nothing, component_id is its doc_id.
    Null doc_id: the row links like any other, but is in no minimum; its component_id is null if all of its component are null,
    and it is never kept. Repeated rows: each is returned. A doc_id with several texts: each text is judged by itself.
    Empty table: no rows.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), *text_marks(text), text.alias("text"))
    rows = materialize(docs.mapInArrow(sketches(k), SKETCH), "dedup-sketches")
    full = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("mark_a", "mark_b")).alias("mark"), F.first("n").alias("n"), F.first("node").alias("node"), F.first("registers").alias("registers"))
    nodes = materialize(full, "dedup-nodes")

    bands = nodes.select("node", "registers").mapInArrow(band_keys, "key long, node long")
    kinds = bands.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")).where("members > 1")
    kinds = materialize(kinds.groupBy("members", "a", "b").agg(F.min("key").alias("key")).select("key", "members"), "dedup-bands")
    placed = tiles(bands.join(if_small(kinds), "key").join(nodes.select("node", "digest", "n", "registers"), "node"), "key", "digest")
    placed = placed.select("key", "tile", "digest", "n", "registers").repartition("key", "tile").sortWithinPartitions("key", "tile")
    near = components(placed.mapInArrow(band_edges(percent), "u binary, v binary"), "dedup-near")

    sized = near.join(near.groupBy("root").agg(F.count("*").alias("members")), "root")
    sized = materialize(sized.join(nodes.select(F.col("digest").alias("node"), "registers", "mark.mark_a", "mark.mark_b"), "node"), "dedup-members")
    texts = docs.join(if_small(sized.select("mark_a", "mark_b")), ["mark_a", "mark_b"], "left_semi").groupBy("mark_a", "mark_b").agg(F.first("text").alias("text"))
    texts = tiles(sized.join(texts, ["mark_a", "mark_b"]), "root", "node").select("root", "tile", F.col("node").alias("digest"), "registers", "text")
    texts = texts.repartition("root", "tile").sortWithinPartitions("root", "tile")
    linked = components(texts.mapInArrow(verified_edges(k, percent), "u binary, v binary"), "dedup-linked")

    of = nodes.select(F.col("digest").alias("node"), "rep").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = materialize(of.join(least, "root").select(F.col("node").alias("digest"), "component_id"), "dedup-groups")
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of, "digest", "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
