"""Quality rules: simple counts, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and word pairs are hashed into buckets. Two multinomials over the buckets, one of trusted documents and one of all
documents, give each bucket a log-likelihood ratio; a document's ratio is the mean over its n-grams, so its length does not
matter. A document is kept if its ratio reaches a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.llm.columns import let

BUCKETS = 8192
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Trusted ids that are sent to every task (under 16 MB); more are joined by a shuffle of the documents' buckets, with the same result.
BROADCAST_IDS = 2_000_000
#: Mean log-likelihood ratio of an n-gram that a document must reach. Set once, by the labels of the 10,000-document table: no
#: document labelled good that passes the base rules lies below -0.034, of those labelled bad nineteen in twenty lie below -0.066.
THRESHOLD = -0.045


def _word_hashes(text: Column) -> Column:
    """64-bit hashes of the words in their order. Only the pieces before the first and after the last word can be empty."""
    return F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), lambda w: F.xxhash64(w))


def _bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _pairs(h: Column, of) -> Column:
    """``of`` the bucket of each pair of neighbours; pairs share the buckets of words."""
    return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)), lambda a, b: of(_bucket(F.xxhash64(a, b))))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), _word_hashes(text).alias("h"))


def repeat_words(found: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to ``h``: words in three-word windows that the text has twice or more, the first included.

    Windows are held by 64-bit hashes. In texts with a repeat, high bits of the hash and the window's place share a number;
    sorted, equal windows are neighbours, and the whole hashes of neighbours are compared.
    """
    starts = F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0)))
    found = found.withColumn("_grams", F.transform(starts, lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))))
    found = found.withColumn("_again", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    found = found.withColumn("_high", F.when(F.col("_again"), F.expr("-shiftleft(1L, length(bin(size(_grams))))")))
    found = found.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_grams", lambda g, i: g.bitwiseAND(F.col("_high")).bitwiseOR(i)))))
    place = lambda x: x.bitwiseAND(-1 - F.col("_high")).cast("int")
    alike = lambda x, y: F.coalesce((x.bitwiseAND(F.col("_high")) == y.bitwiseAND(F.col("_high"))) & (F.get("_grams", place(x)) == F.get("_grams", place(y))), F.lit(False))
    hit = F.filter("_sorted", lambda x, i: alike(x, F.get("_sorted", i - 1)) | alike(x, F.get("_sorted", i + 1)))
    found = found.withColumn("_hit", F.when(F.col("_again"), F.sort_array(F.transform(hit, place))))
    # each start covers three words, less what the next one covers
    covered = F.aggregate(F.transform("_hit", lambda p, i: F.coalesce(F.least(F.get("_hit", i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("long"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, ``h`` (word hashes), the base counts and the base verdict."""
    counted = repeat_words(hashed(docs)).select(
        "doc_id",
        "h",
        F.size("h").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bucket_counts(docs: DataFrame) -> list[int]:
    """Occurrences of n-grams in each bucket and one more. Each task sums first, so it sends ``BUCKETS`` rows at most."""
    pairs = hashed(docs).select(F.explode(F.arrays_zip(F.col("h").alias("a"), F.slice("h", 2, F.size("h")).alias("b"))).alias("p")).select("p.a", "p.b")
    both = pairs.select(F.explode(F.array(_bucket(F.col("a")), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b"))))).alias("bucket"))
    out = [1] * BUCKETS
    for r in both.groupBy("bucket").count().collect():  # at most BUCKETS rows, and the last words' missing pairs
        if r["bucket"] is not None:
            out[r["bucket"]] += r["count"]
    return out


def bucket_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log-likelihood ratio of each bucket, with one occurrence added to each; ``BUCKETS`` numbers for any input.

    The raw counts cover all documents, the trusted ones all of those that ``trusted`` (doc_id) names.
    """
    target = trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    few = target.count() <= BROADCAST_IDS
    own = _bucket_counts(docs.join(F.broadcast(target) if few else target, "doc_id", "left_semi"))
    raw = _bucket_counts(docs)
    a, b = sum(own), sum(raw)
    return [math.log(x / a) - math.log(y / b) for x, y in zip(own, raw, strict=True)]


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and verdict for every text of ``docs`` (doc_id, text); ``trusted`` (doc_id) names the trusted documents.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept.

    Null and empty texts and texts without words: all counts 0, base_failed, ratio 0, not kept. Repeated rows are each judged
    (and each counted). Without trusted documents every ratio is near 0. Null ids are judged, and never trusted. Empty
    table: no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = F.lit(",".join(f"{x:.9f}" for x in bucket_ratios(docs, trusted)))
    ratios = F.split(table, ",").cast("array<double>")  # a constant: folded once when the plan is made
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    total = add(F.transform("h", lambda x: F.get(ratios, _bucket(x)))) + add(_pairs(F.col("h"), lambda b: F.get(ratios, b)))
    ratio = F.when(F.col("n_words") > 0, F.round(total / (2 * F.col("n_words") - 1), 9)).otherwise(F.lit(0.0))
    judged = base_counts(docs).withColumn("ratio", ratio).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")
