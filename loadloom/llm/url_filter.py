"""URL filters by a cascade of Bloom filters.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that level 0 wrongly takes for listed ones, level 2
the listed keys that level 1 wrongly takes, and so on until a level makes no mistake. Over the corpus's own keys, which
are all known when the cascade is built, a key's membership is then exact: it is listed if the first level without it is
an odd one, or if all have it and their number is odd. No table is joined when urls are judged.

Level 0 is sized by how many keys of the corpus there are to a listed one, so that its mistakes are about as many as the
listed keys; the levels after it shrink. The bits of a level are set in the tasks and merged by word, so the driver
gets the filters alone, never keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loadloom.llm.text import mix
from loadloom.session import materialize

PROBES = 4
BITS_A_KEY = 8
#: Bits of a level 0 (64 MB). Lists that need more are cut by hash into several cascades.
MOST_BITS = 1 << 29
#: First letters of keys: rules, and hosts that are listed for blocking.
RULE, HOST = "r", "h"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    """A host with all its subdomains, and how the url's path must start."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; none of an empty host."""
    labels = F.split(host, r"\.", -1)
    whole = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(whole)


def url_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys that a rule could have for this url, the longest host first, then the longest path, and those that a listed host could
    have. ``lengths``: of rules' paths."""
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]), lambda p: p.isNotNull())
    rules = F.flatten(F.transform(suffixes(host), lambda h: F.transform(starts, lambda p: F.concat(F.lit(RULE), h, p))))
    return F.concat(rules, F.transform(suffixes(host), lambda h: F.concat(F.lit(HOST), h)))


class Bloom(NamedTuple):
    """A filter over 64-bit hashes; each level mixes its own number in, so keys that meet in one part in the next."""

    bits: np.ndarray
    level: int

    @staticmethod
    def places(hashes: np.ndarray, size: int, level: int) -> Iterator[np.ndarray]:
        """Double hashing: the two halves of a 64-bit hash, the second made odd."""
        h = mix(hashes.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield (a + np.uint64(i) * b) & np.uint64(size - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in Bloom.places(hashes, len(self.bits) * 8, self.level):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def member(levels: Sequence[Bloom], hashes: np.ndarray) -> np.ndarray:
    """Whether keys are listed, by the first level that does not have them."""
    listed = np.full(len(hashes), len(levels) % 2 == 1)
    open_ = np.ones(len(hashes), bool)
    for k, level in enumerate(levels):
        out = open_ & ~level.has(hashes)
        listed[out] = k % 2 == 1
        open_ &= ~out
    return listed


def marker(levels, column: int):
    """Appends for each list of key hashes which of them are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            listed = member(levels.value, flat) if len(flat) else np.empty(0, bool)
            starts = np.concatenate([[0], np.cumsum(np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64))]).astype(np.int32)
            marks = pa.ListArray.from_arrays(pa.array(starts), pa.array(listed))
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "listed"])

    return run


def bit_words(size: int, level: int):
    """The words of a filter of ``size`` bits that a task's hashes (h) set, and their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.sort(np.concatenate(list(Bloom.places(batch.column(0).to_numpy().astype(np.int64), size, level))))
                word = at >> np.uint64(6)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def build_level(hashes: DataFrame, level: int, bits_a_key: float) -> Bloom:
    """A filter over ``hashes`` (h). The driver gets at most a number for each 64 of its bits."""
    size = 1 << max(6, math.ceil(hashes.count() * bits_a_key - 1).bit_length())
    merged = hashes.mapInArrow(bit_words(size, level), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[merged.column(0).to_numpy()] = merged.column(1).to_numpy().view(np.uint64)
    return Bloom(words.astype("<u8").view(np.uint8), level)


def first_bits(listed: int, others: int) -> float:
    """Bits a key with which level 0, probed ``PROBES`` times, makes about as many mistakes as there are listed keys."""
    rate = min(0.5, max(1, listed) / max(1, others))
    return max(BITS_A_KEY, -PROBES / math.log1p(-(rate ** (1 / PROBES))))


def having(keys: DataFrame, levels: Sequence[Bloom]) -> DataFrame:
    """The rows of ``keys`` (h and any columns) that the last of ``levels`` has."""
    sent = keys.sparkSession.sparkContext.broadcast(list(levels[-1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy().astype(np.int64)
            yield batch.filter(pa.array(sent.value[0].has(h)))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(universe: DataFrame, listed: DataFrame, others: int | None = None) -> tuple[str, list[Bloom]]:
    """A seed and the levels for ``listed`` (key) over ``universe`` (key); both may repeat keys and hold nulls, which are left out.

    ``others``: about how many distinct keys the universe has; it sizes level 0 alone. Keys are held by their 64-bit hashes;
    should a listed and an unlisted key of the universe share one, the next seed is tried.
    """
    seed = ""
    listed, universe = listed.where("key is not null").select("key").distinct(), universe.where("key is not null").select("key")
    if others is None:
        others = universe.agg(F.approx_count_distinct("key")).first()[0]
    while True:
        h = F.xxhash64(F.lit(seed), F.col("key")).alias("h")
        mine = materialize(listed.select("key", h), "url-listed")
        levels = [build_level(mine.select("h"), 0, first_bits(mine.count(), others))]
        passed = having(universe.select("key", h), levels).distinct()
        theirs = materialize(passed.join(mine.select("key"), "key", "left_anti"), "url-mistakes")
        if theirs.select("h").join(mine.select("h"), "h", "left_semi").isEmpty():
            break
        seed += "+"
    own, other = mine.select("h"), theirs.select("h")
    while not other.isEmpty():
        levels.append(build_level(other, len(levels), BITS_A_KEY))
        own, other = other, materialize(having(own, levels), "url-level")
    return seed, levels


def filter_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """Judges every url of ``pages`` (page_id, url): by the longest rule that fits, else by the listed hosts.

    ``listed`` (key): hosts to block with their subdomains. Rules and listed hosts are the keys of one cascade over all keys
    of the corpus's urls. Returns page_id, host, path, rule (null if none fits), verdict (allow or block).

    Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end. Null or
    no ``://``: both empty, no rule, allowed. Of rules that fit, the one with the longest host, then the longest path, wins; of
    rules with the same host and path, the first. Repeated rows are each judged. Empty tables: no rows. Only the two columns
    are read.
    """
    spark = pages.sparkSession
    rules = list({r.text: r for r in reversed(rules)}.values())
    sizes = sorted({len(r.path) for r in rules} | {0}, reverse=True)
    parts = pages.select(F.col("page_id").cast("long"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    keyed = parts.withColumn("keys", url_keys(F.col("host"), F.col("path"), sizes))
    wanted = listed.select(F.concat(F.lit(HOST), F.col("key").cast("string")).alias("key")).where("key is not null")
    if rules:
        wanted = wanted.unionByName(spark.createDataFrame([(RULE + r.text,) for r in rules], "key string"))
    wanted = materialize(wanted.distinct(), "url-wanted")
    universe = keyed.select(F.explode("keys").alias("key"))
    n, others = wanted.count(), universe.agg(F.approx_count_distinct("key")).first()[0]
    pieces = max(1, math.ceil(n * first_bits(n, others) / MOST_BITS))
    found = keyed.withColumn("listed", F.transform("keys", lambda k: F.lit(False)))
    for p in range(pieces):  # one, unless the list is very long
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces)) == p  # noqa: B023, E731
        seed, levels = build_cascade(universe.where(part(F.col("key"))), wanted.where(part(F.col("key"))), others // pieces)
        hashed = found.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(F.lit(seed), k))).withColumnRenamed("listed", "before")  # noqa: B023
        marked = hashed.mapInArrow(marker(spark.sparkContext.broadcast(levels), 5), "page_id long, host string, path string, keys array<string>, before array<boolean>, hashes array<long>, listed array<boolean>")
        found = marked.select("page_id", "host", "path", "keys", F.zip_with(F.zip_with("before", "listed", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "keys", lambda m, k: m.a | (m.b & part(k))).alias("listed"))
    hits = F.transform(F.filter(F.arrays_zip("keys", "listed"), lambda x: x.listed), lambda x: x["keys"])
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else F.lit(None).cast("map<string,string>")
    rule = F.substring(F.try_element_at(F.filter(hits, lambda k: k.startswith(RULE)), F.lit(1)), 2, 1 << 30)
    found = found.select("page_id", "host", "path", rule.alias("rule"), F.exists(hits, lambda k: k.startswith(HOST)).alias("blocked"))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))).when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
