"""Secret scans: known forms by pattern, unknown ones by a battery of randomness tests. DataFrame functions only.

A token that no pattern names is held against two hypotheses. Its encoding is inferred (hexadecimal, base 32, base 64) and
its symbols are tested for what random ones would do: chi-squared uniformity over the alphabet, runs above and below the
middle, and serial correlation. A token that looks random is then weighed against ordinary text: the chance that a text of
its length spreads so evenly over the alphabet is its p-value, so short tokens need to be very even. Benjamini-Hochberg
over all tokens of the corpus decides which p-values are small enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.llm.columns import let, matches, running
from loadloom.session import materialize

#: The base patterns. Kinds are in the order in which spans at one place are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")

#: '=' is padding at a token's end and else cuts, so the value of NAME=VALUE is a token of its own.
TOKEN = r"[A-Za-z0-9+/_-]{20,}(?:=++(?![A-Za-z0-9+/_-]))?"
#: Alphabets and, for ordinary text in them, the sum of squared symbol shares (English letters; a-f alike).
ENCODINGS = {
    "hex": (r"^[0-9A-Fa-f]+$", "0123456789abcdef", 1 / 6),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.0667),
    "base64": (r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.0667),
}
#: Upper 0.001 point of chi-squared with three degrees of freedom.
BATTERY_LIMIT = 16.266
BINS_A_DECADE = 10
MOST_BINS = 400


def _values(token: Column, name: str) -> Column:
    _, alphabet, _ = ENCODINGS[name]
    plain = F.translate(F.lower(token) if name == "hex" else token, "-_=", "+/")  # padding goes
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v).cast("double"))


def _p_value(v: Column, k: int, share: float) -> Column:
    """Chance that ordinary text is as even as symbols ``v``; 1 where the battery says that they are not random."""
    n = F.size(v).cast("double")

    def tests(counts: Column) -> Column:
        chi = _total(counts, lambda c: c * c) * k / n - n
        spread = 2 * (k - 1) * (n - 1) / n
        high = F.transform(v, lambda x: (x >= k // 2).cast("int"))
        ones = _total(high, lambda b: b)
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + _total(pairs, lambda p: ((p["a"] >= k // 2) != (p["b"] >= k // 2)).cast("int"))
        expected = 2 * ones * (n - ones) / n + 1
        runs_var = (expected - 1) * (expected - 2) / (n - 1)
        mean = _total(v, lambda x: x) / n
        square = _total(v, lambda x: (x - mean) * (x - mean))
        serial = _total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))
        z_runs = F.when(runs_var > 0, (runs - expected) / F.sqrt(runs_var)).otherwise(F.lit(10.0))
        z_serial = F.when(square > 0, (serial / square + 1 / n) * F.sqrt(n)).otherwise(F.lit(10.0))
        z_chi = (chi - (k - 1)) / F.sqrt(spread)
        extra = n * (k * share - 1)
        z_text = (chi - (k - 1) - extra) / F.sqrt(2 * (k - 1 + 2 * extra))
        tail = F.when(z_text < -1, F.exp(-z_text * z_text / 2) / (-z_text * math.sqrt(2 * math.pi))).otherwise(F.lit(1.0))
        return F.when(z_chi * z_chi + z_runs * z_runs + z_serial * z_serial <= BATTERY_LIMIT, F.least(tail, F.lit(1.0))).otherwise(F.lit(1.0))

    counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.size(F.filter(v, lambda x: x == i)))
    return let(counts, tests)


def token_p_value(token: Column) -> Column:
    """1 for tokens of digits or letters of one case only without any other sign of an encoding."""
    out = F.lit(1.0)
    for name in ("base64", "base32", "hex"):
        pattern, alphabet, share = ENCODINGS[name]
        test = let(_values(token, name), lambda v: _p_value(v, len(alphabet), share))  # noqa: B023
        out = F.when(F.translate(token, "-_", "+/").rlike(pattern), test).otherwise(out)
    return F.when(token.rlike("^[0-9]+$"), F.lit(1.0)).otherwise(out)


def bin_of(p: Column) -> Column:
    """Tenths of a decade that a p-value lies under 1."""
    return F.least(F.lit(MOST_BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_A_DECADE)).cast("int")


def least_bin(counts: dict[int, int], rate: float) -> int:
    """Benjamini-Hochberg on binned p-values: the lowest bin whose upper end is at most ``rate`` times the share of p-values in it or above."""
    total, above, cut = sum(counts.values()), 0, MOST_BINS + 1
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if b and 10 ** (-b / BINS_A_DECADE) <= rate * above / total:
            cut = b
    return cut


def apart(tokens: Column, base: Column) -> Column:
    """``tokens`` (start, end, value) that overlap no span of ``base``.

    Both are put in order of their starts. A token is apart if no base span up to it ends beyond its start and the next base
    span does not start before its end.
    """
    spans = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("token"), b["end"].alias("end"), F.lit(None).cast("string").alias("value"))),
        F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("token"), t["end"].alias("end"), t["value"].alias("value"))),
    )

    def judged(s: Column) -> Column:
        reached = running(F.transform(s, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(F.lit(0))), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(x["token"] == 0, x["start"]))), F.least))
        three = F.arrays_zip(s.alias("x"), reached.alias("reached"), ahead.alias("ahead"))
        alone = F.filter(three, lambda y: (y["x"]["token"] == 1) & (y["reached"] <= y["x"]["start"]) & F.coalesce(y["ahead"] >= y["x"]["end"], F.lit(True)))
        return F.transform(alone, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["value"].alias("value")))

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(let(F.sort_array(spans), judged))


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Spans of secrets in every text of ``docs`` (doc_id, text), with false discoveries among the random tokens held to ``rate``.

    Returns doc_id and ``spans``, an array of struct(start, order, end, kind) by start, then kind as listed in ``KINDS``; code
    points, end exclusive. The first three kinds are the base patterns: leftmost, non-overlapping in each kind, failing matches
    dropped. Random tokens that overlap one of these are not listed again.

    Null text is read as empty; no words or no secrets give an empty array. Repeated rows are each returned. Empty table: no
    rows. Very long texts are read whole, and their matches take n log n steps. Other columns are not read. The threshold comes
    from a histogram of p-values over all documents, one row for each tenth of a decade, so neither ties nor the number of
    tokens matter to it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    span = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("order"), m["end"].alias("end"), F.lit(KINDS[k]).alias("kind"))
    base = F.concat(
        F.transform(F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= LEAST_ASSIGNED), span(0)),
        F.transform(matches(text, ACCESS), span(1)),
        F.transform(matches(text, HEX), span(2)),
    )
    found = docs.select(F.col("doc_id").cast("long"), base.alias("base"), matches(text, TOKEN).alias("tokens"))
    scored = F.transform(
        apart(F.col("tokens"), F.col("base")),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), bin_of(token_p_value(t["value"])).alias("bin")),
    )
    found = materialize(found.select("doc_id", "base", scored.alias("tokens")), "secrets")
    bins = found.select(F.explode("tokens.bin").alias("bin")).groupBy("bin").count().collect()  # at most MOST_BINS + 1 rows
    cut = least_bin({r["bin"]: r["count"] for r in bins}, rate)
    random = F.transform(F.filter("tokens", lambda t: t["bin"] >= cut), span(3))
    return found.select("doc_id", F.sort_array(F.concat("base", random)).alias("spans"))
