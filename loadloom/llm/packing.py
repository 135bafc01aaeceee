"""Best-fit packing of documents into sequences, certified by dual-feasible-function bounds.

Each partition of pieces is packed by best-fit decreasing. A dual-feasible function turns lengths into weights of which no
sequence can hold more than one, so the sum of weights bounds the number of sequences from below. A partition that meets its
bound frees its emptiest sequences, which others may fill; one with a gap frees every sequence that has room. Freed pieces
are dealt to other, fewer partitions and packed again; a packing that needs more sequences than were freed is not taken.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadloom.llm.text import PORTION, held, portions  # noqa: F401  (PORTION: the slices of ``portions``)
from loadloom.session import materialize

SEQUENCE = 2048
END_ID = 0
#: Pieces that are packed together; a task holds a few numbers for each.
PARTITION_PIECES = 200_000
#: Share of the sequences packed again that a round of exchange must save for another one to follow.
GAIN = 1e-4
#: Numbers of sequences set aside for one partition and for one round; both are far more than there can be.
PART_BINS, ROUND_BINS = 1 << 22, 1 << 50
#: Chunks of text and runs in them whose ids a task remembers; when it has more it keeps those that came again, if they are under half.
REMEMBERED = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, free boolean"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_tokenizers: dict = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are Spark's to share
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Latin letters, with accents or not; texts with other letters, signs or control characters are cut at white space alone.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SPACE = re.compile(r"[ \t\n\r]")
RUN = re.compile(f"[{LETTERS}]+|[^{LETTERS}\\s]+")
ODD = re.compile(f"[^\\t\\n\\r -&(-~{LETTERS}]|<\\|")


class ChunkIds:
    """Token ids of texts, as little-endian 32-bit numbers.

    The tokenizer lower-cases, and its pieces cross neither white space nor the border between letters and other signs, so
    what lies between white space, and the runs of letters or of other signs in it, are encoded once each and remembered.
    Where a text has anything that could move a border (an apostrophe, signs that combine, names of special tokens), what
    lies between spaces, tabs and line ends is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.again: set[str] = set()  # of what is known, what a later batch had too

    def encoded(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(parts), 4096):
            own = parts[at : at + 4096]
            yield from ((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True))

    def encoded_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Runs of letters in one go: each is one word to the tokenizer, and its last piece says so."""
        for at in range(0, len(words), 512):
            own = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(own):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                yield from ((w, raw[i:j]) for w, i, j in zip(own, [0, *stops], stops, strict=False))
            else:
                yield from self.encoded(own)

    def learn(self, chunks: set[str]) -> None:
        """A chunk of one run is that run, so both are kept in one place; runs are encoded first, then chunks put together."""
        words = {c for c in chunks if c.isalpha()}
        mixed = {c: RUN.findall(c) for c in chunks.difference(words)}
        runs = set().union(*mixed.values())
        new = runs.difference(self.known)
        self.again.update(runs.difference(new))
        words.update(r for r in new if r.isalpha())
        self.known.update(self.encoded_words(list(words)))
        self.known.update(self.encoded([r for r in new if not r.isalpha()]))
        self.known.update((c, b"".join(map(self.known.__getitem__, own))) for c, own in mixed.items() if len(own) > 1)

    def forget(self) -> None:
        """Where too much is remembered, what no second batch had goes first."""
        if len(self.known) > REMEMBERED:
            self.known = {c: self.known[c] for c in self.again} if len(self.again) <= REMEMBERED // 2 else {}
            self.again = set()
        if len(self.odd) > REMEMBERED:
            self.odd.clear()

    def of(self, texts: list[str | None]) -> list[bytes]:
        self.forget()
        odd = [bool(t and ODD.search(t)) for t in texts]
        cut = [(SPACE.split(t) if o else t.lower().split()) if t else [] for t, o in zip(texts, odd, strict=True)]
        self.odd.update(self.encoded(list(set().union(*(c for c, o in zip(cut, odd, strict=True) if o)).difference(self.odd))))
        chunks = set().union(*(c for c, o in zip(cut, odd, strict=True) if not o))
        new = chunks.difference(self.known)
        self.again.update(chunks.difference(new))
        self.learn(new)
        return [b"".join(map((self.odd if o else self.known).__getitem__, c)) for c, o in zip(cut, odd, strict=True)]


def chunk_ids(path: str) -> ChunkIds:
    """One for each worker, so that later tasks find what earlier ones encoded."""
    return held(("packing", path), lambda: ChunkIds(path))


def cut_pieces(path: str, size: int):
    """(doc_id, text) to pieces of at most ``size`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(path)
        for batch in batches:
            for part in portions(batch):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), chunks.of(part.column(1).to_pylist()), strict=True):
                    ids += END_ID.to_bytes(4, "little")
                    for k, at_byte in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at_byte : at_byte + 4 * size]
                        rows.append((doc_id, k, at_byte // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Ties in length keep their order; of bins with equal room the
    one that came to have it last is taken."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_: list[list[int]] = [[] for _ in range(size + 1)]  # bins by room left
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            open_[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best bound of two families of dual-feasible functions, over every parameter that matters."""
    if not len(lengths):
        return 0
    return bound_of(np.bincount(lengths, minlength=size + 1).astype(np.int64), size)


def bound_of(counts: np.ndarray, size: int) -> int:
    """The bound for ``counts[n]`` pieces of each length n."""
    at = np.arange(size + 1)
    best = -(-int((counts * at).sum()) // size)
    above, mass = np.cumsum(counts[::-1])[::-1], np.concatenate([[0], np.cumsum(counts * at)])
    for e in np.flatnonzero(counts[: size // 2 + 1]).tolist():  # over size - e: 1; under e: 0; between: its share
        whole = int(above[size - e + 1]) if e else 0
        between = int(mass[size - e + 1] - mass[e])
        best = max(best, -(-(whole * size + between) // size))
    for k in range(1, 21):  # rounds to k-ths, save where the length is an exact (k + 1)-th
        x = at * (k + 1)
        weight = np.where(x % size == 0, at * k, (x // size) * size)
        best = max(best, -(-int((counts * weight).sum()) // (k * size)))
    return best


def pack_partition(size: int, keep_open: bool):
    """Packs one partition; frees what is better packed again with others, unless ``keep_open``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, size)
        gap = len(fills) - lower_bound(lengths, size)
        free = np.zeros(len(fills), bool)
        if not keep_open:
            room = size - fills
            # with a gap every bin with room is packed again; else the emptiest, which others may fill
            free = room > 0 if gap > 0 else (room > 0) & (room >= np.sort(room)[-min(len(room), 64)])
        return pdf.assign(bin=bins, offset=offsets, free=free[bins])[["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "free"]]

    return run


def certificate(packed: DataFrame, size: int = SEQUENCE) -> tuple[int, int]:
    """How many sequences ``packed`` (length, sequence_id) has, and the least number that any packing of its pieces needs."""
    counts = packed.groupBy("length").count().collect()  # at most ``size`` rows
    weights = np.zeros(size + 1, np.int64)
    for r in counts:
        weights[r["length"]] = r["count"]
    return packed.where("offset = 0").count(), bound_of(weights, size)


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Packs every text of ``docs`` (doc_id, text) into sequences of at most ``size`` ids.

    A document is its ids and an end id; only longer ones are cut. Returns one row for each piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. ``certificate`` tells how far it is from the best possible.

    Pieces are dealt to partitions at random. Rounds of exchange go on while they save one in ten thousand (``GAIN``), and are undone where they don't; a single partition has
    no other to exchange with.

    Null and empty texts: one piece of one id. Null or repeated doc_ids: each row is packed by itself. Very long texts: as many
    whole pieces as they have. Ties in length go by doc_id and piece. Empty table: no rows. Other columns are not read.
    """
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialize(docs.mapInArrow(cut_pieces(path, size), PIECES), "packing-pieces")
    done = [pieces.where(F.col("length") == size).select(*pieces.columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(F.col("length") < size)
    kept, freed = None, None  # the last packing, and how many sequences it freed
    for k in count():
        parts = max(1, -(-rest.count() // PARTITION_PIECES))
        last = parts == 1
        # the place of a row in the written table deals repeated rows apart
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), F.lit(parts)))
        placed = materialize(dealt.groupBy("part").applyInPandas(pack_partition(size, last), PLACED), f"packing-{k}")
        placed = placed.withColumn("sequence_id", -(F.col("part") * PART_BINS + F.col("bin") + F.lit(k) * ROUND_BINS) - 1)
        made = placed.where("offset = 0").count()
        if freed is not None and freed - made < max(1, GAIN * freed):  # packing them again did not help
            done.append(kept)
            break
        done.append(placed.where("not free"))
        freed = placed.where("free and offset = 0").count()
        if last or not freed:
            break
        kept = placed.where("free")
        rest = kept.select(*pieces.columns)
    out = [d.select(*pieces.columns, "sequence_id", "offset") for d in done]
    return reduce(DataFrame.unionByName, out)
