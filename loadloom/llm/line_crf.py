"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's features are its own and its neighbours' shapes; a transition weight makes neighbouring labels agree or not.
Forward-backward gives each line's chance to be good, and a document's quality is the mean of these, weighted by the lines'
lengths. Lines of a labelled document learn with its label.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Labelled documents that the field is fitted to: those with the least hashed ids, wherever they are.
SAMPLE = 4000
STEPS, RATE, PENALTY = 250, 0.1, 1e-3
#: The signs of each class of characters that lines are described by.
CLASSES = ("#*$%&<>=~^_{}[]\\@/+", "!?", "|", "0123456789", ".,;:'\"()-")
#: Scales of the shares of these classes.
SCALES = np.array([10.0, 10.0, 10.0, 5.0, 10.0])
OWN = 14
WIDTH = 3 * OWN + 1


@functools.cache
def class_table() -> np.ndarray:
    """For each code point a bit for each class, then for letters and for upper case."""
    bits = np.zeros(0x110000, np.uint8)
    for k, signs in enumerate(CLASSES):
        bits[[ord(c) for c in signs]] |= 1 << k
    for at in range(0, len(bits), 1 << 14):  # in parts, which keeps workers small
        part = bits[at : at + (1 << 14)]
        points = [chr(at + k) for k in range(len(part))]
        part |= np.fromiter(map(str.isalpha, points), np.uint8, len(part)) << 5
        part |= np.fromiter(map(str.isupper, points), np.uint8, len(part)) << 6
    return bits


def line_features(lines: list[str], again: list[bool]) -> np.ndarray:
    """A row for each line, none of which is blank; ``again``: whether its text had the same line before."""
    if not lines:
        return np.zeros((0, OWN))
    chars = np.fromiter(map(len, lines), np.int64, len(lines))
    bits = class_table()[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.cumsum(chars) - chars
    count = lambda k: np.add.reduceat((bits >> k) & 1, starts, dtype=np.int64)
    shares = np.stack([count(k) for k in range(5)], 1) / chars[:, None] * SCALES
    letters, upper = np.maximum(np.add.reduceat(((bits >> 5) & 1), starts, dtype=np.int64), 1), np.add.reduceat((bits & 96) == 96, starts, dtype=np.int64)
    every = count(6)
    words = [x.split() for x in lines]
    n = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    longest = np.fromiter((max(map(len, w)) for w in words), np.int64, len(words))
    ends = np.fromiter((w[-1][-1] in ".!?:;\"'" for w in words), bool, len(words))
    begins = np.fromiter((w[0][0].isupper() for w in words), bool, len(words))
    return np.column_stack([
        np.log1p(n), shares[:, 0], np.where(chars < 40, upper / letters, every / chars) * 2, shares[:, 1:], chars / n / 10,
        1.0 - distinct / n, np.array(again, float), ends, begins, n < 4, longest > 40,
    ])


class Lines(NamedTuple):
    """Lines of many texts, one after another; ``counts`` has each text's number of them."""

    counts: np.ndarray
    features: np.ndarray
    lengths: np.ndarray


def lines_of(texts: list[str | None]) -> Lines:
    counts, lines, again = [], [], []
    for text in texts:
        own = [x for x in text.split("\n") if x.strip()] if text else []
        seen: set[str] = set()
        again += [x in seen or bool(seen.add(x)) for x in own]
        lines += own
        counts.append(len(own))
    return Lines(np.array(counts, np.int64), line_features(lines, again), np.fromiter(map(len, lines), np.float64, len(lines)))


def with_neighbours(lines: Lines) -> np.ndarray:
    """A line's features beside those of the lines before and after it in its text; zeros at the ends."""
    x, n = lines.features, len(lines.features)
    out = np.zeros((n, WIDTH))
    out[:, :OWN], out[:, -1] = x, 1.0
    ends = np.cumsum(lines.counts)
    first = np.zeros(n, bool)
    first[(ends - lines.counts)[lines.counts > 0]] = True
    inner = np.flatnonzero(~first)
    out[inner, OWN : 2 * OWN] = x[inner - 1]
    out[inner - 1, 2 * OWN : 3 * OWN] = x[inner]
    return out


class Field(NamedTuple):
    weights: np.ndarray
    turns: np.ndarray  # label before x label after
    mean: np.ndarray
    spread: np.ndarray
    prior: float

    def marginals(self, x: np.ndarray, counts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each line's chance to be good; with ``pairs`` also the summed chances of neighbouring labels, texts weighted by 1 / lines."""
        odds = x @ self.weights
        order = np.argsort(-counts, kind="stable")
        size, at = counts[order], (np.cumsum(counts) - counts)[order]
        steps = int(size[0]) if len(size) else 0
        live = [int(k) for k in np.searchsorted(-size, -np.arange(1, steps + 1), side="right")]  # texts with more than t lines
        t = self.turns
        forward, back = np.zeros((len(odds), 2)), np.zeros((len(odds), 2))
        for s in range(steps):
            now = at[: live[s]] + s
            if s == 0:
                forward[now, 1] = odds[now]
            else:
                a, b = forward[now - 1].T
                forward[now, 0] = np.logaddexp(a + t[0, 0], b + t[1, 0])
                forward[now, 1] = np.logaddexp(a + t[0, 1], b + t[1, 1]) + odds[now]
        for s in range(steps - 2, -1, -1):
            now = at[: live[s + 1]] + s
            a, b = back[now + 1, 0], back[now + 1, 1] + odds[now + 1]
            back[now, 0] = np.logaddexp(a + t[0, 0], b + t[0, 1])
            back[now, 1] = np.logaddexp(a + t[1, 0], b + t[1, 1])
        both = forward + back
        good = 1.0 / (1.0 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        totals = np.zeros((2, 2))
        if pairs:
            z = np.logaddexp(both[:, 0], both[:, 1])
            weight = np.repeat(1.0 / np.maximum(counts, 1), counts)
            ends = np.cumsum(counts)
            last = np.zeros(len(odds), bool)
            last[(ends - 1)[counts > 0]] = True
            i = np.flatnonzero(~last)
            for y in (0, 1):
                for v in (0, 1):
                    totals[y, v] = (np.exp(forward[i, y] + t[y, v] + v * odds[i + 1] + back[i + 1, v] - z[i]) * weight[i]).sum()
        return good, totals

    def scores(self, texts: list[str | None]) -> np.ndarray:
        lines = lines_of(texts)
        if not len(lines.features):
            return np.full(len(texts), self.prior)
        good, _ = self.marginals((with_neighbours(lines) - self.mean) / self.spread, lines.counts)
        owner = np.repeat(np.arange(len(texts)), lines.counts)
        weight = np.bincount(owner, lines.lengths, len(texts))
        mean = np.bincount(owner, lines.lengths * good, len(texts)) / np.maximum(weight, 1)
        return np.where(lines.counts > 0, np.clip(mean, 0.0, 1.0), self.prior)


def fit_field(lines: Lines, labels: np.ndarray) -> Field:
    """Gradient ascent (Adam) on the penalised likelihood, each text counting once however many lines it has."""
    prior = float(labels.mean()) if len(labels) else 0.5
    x = with_neighbours(lines)
    mean, spread = (x.mean(0), x.std(0)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    mean[-1], spread[-1] = 0.0, 1.0
    spread = np.where(spread > 1e-9, spread, 1.0)
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)), mean, spread, prior)
    if not len(x) or prior in (0.0, 1.0):
        return field._replace(weights=np.append(np.zeros(WIDTH - 1), 0.0 if prior == 0.5 else 20.0 * (prior - 0.5)))
    x = (x - mean) / spread
    y = np.repeat(labels, lines.counts).astype(float)
    weight = np.repeat(1.0 / np.maximum(lines.counts, 1), lines.counts)
    seen = np.zeros((2, 2))
    share = np.where(lines.counts > 0, (lines.counts - 1) / np.maximum(lines.counts, 1), 0.0)
    seen[0, 0], seen[1, 1] = share[labels == 0].sum(), share[labels == 1].sum()
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, STEPS + 1):
        field = field._replace(weights=theta[:WIDTH], turns=theta[WIDTH:].reshape(2, 2))
        good, pairs = field.marginals(x, lines.counts, pairs=True)
        slope = np.concatenate([x.T @ ((y - good) * weight), (seen - pairs).ravel()]) / len(labels) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field._replace(weights=theta[:WIDTH], turns=theta[WIDTH:].reshape(2, 2))


def sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lines_of([t]) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.features.tobytes() for x in found], pa.binary()), pa.array([x.lengths.tobytes() for x in found], pa.binary())], names=["quality", "features", "lengths"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted to at most ``sample`` labelled documents; ``docs`` and ``labels`` hold only what may be learned from."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.join(F.broadcast(chosen), "doc_id")  # chosen has at most ``sample`` rows
    texts = found.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.min("text").alias("text")).select("quality", "text")
    rows = texts.mapInArrow(sample_lines, "quality int, features binary, lengths binary").collect()
    features = [np.frombuffer(r["features"], np.float64).reshape(-1, OWN) for r in rows]
    lines = Lines(np.array([len(f) for f in features], np.int64), np.vstack([np.zeros((0, OWN)), *features]), np.concatenate([np.zeros(0), *(np.frombuffer(r["lengths"], np.float64) for r in rows)]))
    return fit_field(lines, np.array([r["quality"] for r in rows], np.int64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def scorer(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                s = field.value.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the columns held_out, score and predicted, in place of any so named.

    ``labels`` (doc_id, quality 0 or 1): learned from rows whose crc32(doc_id) mod 3 is not 1, at most ``sample`` of them. The
    score reads the text alone.

    Null and empty texts and texts without words: the share of good documents among those learned from. Without labels all
    scores are 0.5. Labels other than 0 and 1 are not learned; of several for one document the least counts, and of several
    texts the first in order. Repeated
    rows are each scored; null ids are held out. Empty table: no rows.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]).withColumn("text", F.col("text").cast("string"))
    labels = labels.select(F.col("doc_id").cast("long"), "quality").where(~held_out(F.col("doc_id").cast("long")))
    field = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col("doc_id").cast("long"), "text"), labels, sample))
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    scored = docs.mapInArrow(scorer(field), schema)
    return scored.withColumn("held_out", held_out(F.col("doc_id").cast("long"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
