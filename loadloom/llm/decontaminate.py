"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

The automaton's letters are words: each word of the benchmark has a number, any other word is 0. A text is scanned once,
and the words that a window covers are mapped back to code-point offsets of the text as it came.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from loadloom.llm.text import held, portions
from loadloom.session import materialize

#: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII becomes a space.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: There is one automaton up to so many characters of benchmark text, about half a GB in a task; more text has one for each block of
#: so many, and they are never held together.
BLOCK_CHARS = 4_000_000
#: Texts hit by later blocks of which every task is told; more are joined by a shuffle.
BROADCAST_TEXTS = 100_000
HITS = "hits array<struct<first:int,last:int>>, items array<string>"
SCANNED = f"doc_id long, mark_a long, mark_b long, text string, n_words long, {HITS}"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` words; the whole of a shorter item; none of an empty one."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Automaton:
    """Finds every occurrence of every window of the items."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in windows(normal_words(text), size):
                owners.setdefault(tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in w), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in owners.items():
            self.machine.add_word(key, (len(key), sorted(own)))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, last) and the items that occur."""
        runs: list[list[int]] = []
        found: set[str] = set()
        if self.empty or not words:
            return [], found
        get = self.ids.get
        for last, (n, own) in self.machine.iter(tuple([get(w, 0) for w in words])):
            found.update(own)
            first = last - n + 1
            while runs and first <= runs[-1][1] + 1:
                first = min(first, runs.pop()[0])
            runs.append([first, last])
        return [(a, b) for a, b in runs], found


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(a + b):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(x, y) for x, y in out]


def automaton(items, size: int) -> Automaton:
    """A worker that runs several tasks builds it once."""
    own, built = items.value, held("automaton", dict)
    if id(own) not in built or built[id(own)][0] is not own or built[id(own)][1] != size:
        built.clear()
        built[id(own)] = (own, size, Automaton(own, size))
    return built[id(own)][2]


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def scanner(items, size: int):
    """Appends n_words, hits and items to batches whose last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, size)
        for batch in (p for b in batches for p in portions(b, b.num_columns - 1)):
            counts, hits, owners = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = normal_words(text)
                runs, found = machine.scan(words)
                counts.append(len(words))
                hits.append([{"first": a, "last": b} for a, b in runs])
                owners.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(hits, RUNS), pa.array(owners, pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "hits", "items"])

    return run


def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes in what later blocks found (more_hits, more_items) and adds where hit runs start and end in the text, in code points; end
    is exclusive. Columns: doc_id, text, n_words, hits, items, more_hits, more_items."""
    for batch in batches:
        ids, texts, counts, hits, items, more_hits, more_items = (c for c in batch.columns)
        all_hits, spans, all_items = [], [], []
        for text, own, names, more, others in zip(*(c.to_pylist() for c in (texts, hits, items, more_hits, more_items)), strict=True):
            runs = [(h["first"], h["last"]) for h in own]
            if more:
                runs = merged(runs, [(h["first"], h["last"]) for h in more])
            at = [m.span() for m in WORD.finditer(text)] if runs else []
            all_hits.append([{"first": a, "last": b} for a, b in runs])
            spans.append([{"start": at[a][0], "end": at[b][1]} for a, b in runs])
            all_items.append(sorted({*names, *(others or ())}))
        yield pa.RecordBatch.from_arrays(
            [ids, counts, pa.array(all_hits, RUNS), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(all_items, pa.list_(pa.string()))],
            names=["doc_id", "n_words", "hits", "spans", "items"],
        )


def text_marks() -> list[Column]:
    """128 bits that stand for a text."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("mark_a"), F.xxhash64(F.lit(1), text).alias("mark_b")]


def later_hits(docs: DataFrame, blocks: Iterator, size: int) -> DataFrame | None:
    """(mark_a, mark_b, more_hits, more_items) of the texts of ``docs`` in which items of ``blocks`` occur; None without blocks.

    Each block is a scan of its own, whose few hits are written, so no two automata are ever held together.
    """
    found = []
    for own in blocks:
        scanned = docs.select(*text_marks(), F.col("text").cast("string")).mapInArrow(scanner(own, size), f"mark_a long, mark_b long, text string, n_words long, {HITS}")
        found.append(materialize(scanned.where(F.size("hits") > 0).select("mark_a", "mark_b", "hits", "items").dropDuplicates(["mark_a", "mark_b"]), "decontaminate-hits"))
    if not found:
        return None
    both = reduce(DataFrame.unionByName, found).groupBy("mark_a", "mark_b")  # what is gathered is bounded by the text itself
    return materialize(both.agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items")), "decontaminate-texts")


def item_blocks(items: DataFrame) -> Iterator:
    """Broadcasts of (item_id, text), each of at most about ``BLOCK_CHARS`` characters."""
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in own.toLocalIterator()])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Finds the windows of ``size`` words of ``items`` (item_id, text) in ``docs`` (doc_id, text).

    Returns one row for each row of ``docs``: doc_id, n_words, hits (runs of hit words, from 0, both ends included), spans
    (the same as code-point offsets of the text), items (ids of the items that occur, sorted as strings). Items go to
    the tasks in blocks of about ``BLOCK_CHARS`` characters; more blocks mean more scans of ``docs``, one after another.

    Null or empty texts and texts without words: no words, no hits. Null item ids or texts: no windows. Repeated documents
    are each returned; repeated items count once by id. Empty tables: no rows, or no hits. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), *text_marks(), F.col("text").cast("string"))
    blocks = item_blocks(items)
    found = docs.mapInArrow(scanner(next(blocks), size), SCANNED)
    more = later_hits(docs, blocks, size)
    if more is None:
        found = found.withColumns({"more_hits": F.lit(None).cast("array<struct<first:int,last:int>>"), "more_items": F.lit(None).cast("array<string>")})
    else:
        found = found.join(F.broadcast(more) if more.count() <= BROADCAST_TEXTS else more, ["mark_a", "mark_b"], "left")
    found = found.select("doc_id", "text", "n_words", "hits", "items", "more_hits", "more_items")
    return found.mapInArrow(offsets, "doc_id long, n_words long, hits array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>, items array<string>")


def dropper(items, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, size)
        for batch in (p for b in batches for p in portions(b, b.schema.get_field_index("text"))):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not machine.scan(normal_words(t))[1] for t in texts], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` (any columns, one of them text) in which no window of ``items`` occurs, unchanged; without a shuffle of texts
    unless there are several blocks of items and very many texts are hit by the later ones."""
    blocks = item_blocks(items)
    kept = docs.mapInArrow(dropper(next(blocks), size), docs.schema)
    more = later_hits(docs, blocks, size)
    if more is not None:
        a, b = text_marks()
        hit = more.select(F.col("mark_a").alias("_hit_a"), F.col("mark_b").alias("_hit_b"))
        kept = kept.join(F.broadcast(hit) if hit.count() <= BROADCAST_TEXTS else hit, (a == F.col("_hit_a")) & (b == F.col("_hit_b")), "left_anti")
    return kept
