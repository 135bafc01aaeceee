"""The thin queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.llm.decontaminate import decontaminate
from loadloom.llm.filter_audit import audit_filters
from loadloom.llm.language_id import identify_languages
from loadloom.llm.line_crf import classify
from loadloom.llm.manifest import manifest, verify
from loadloom.llm.near_dedup import near_groups
from loadloom.llm.ngram_join import ngram_join
from loadloom.llm.packing import pack
from loadloom.llm.pii import replace_entities
from loadloom.llm.quality_rules import base_counts, judge
from loadloom.llm.secrets import ASSIGN, find_secrets
from loadloom.llm.sharding import shard_documents
from loadloom.llm.url_filter import Rule, filter_urls
from loadloom.session import read_table, scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _links_sql(k: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of ``k``-word shingles are alike by ``percent``."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE
    WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i+{k - 1}], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= {percent} * (a.n + b.n - i)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS doc_id, u AS o FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.o = e.u),
c AS (SELECT doc_id, min(o) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id{more}
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


OP1_SQL = _links_sql(5, 75)

#: The rules of the contract and the hosts that are listed for blocking.
URL_RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
LISTED_HOSTS = tuple(f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string")
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES, listed)


OP2_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, s, v) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}),
l(h) AS (VALUES {", ".join(f"('{h}')" for h in LISTED_HOSTS)}),
m AS (
  SELECT *, (SELECT h || s FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) ORDER BY length(h) DESC, length(s) DESC LIMIT 1) AS rule
  FROM p)
SELECT page_id, host, path, rule, coalesce((SELECT v FROM r WHERE h || s = rule),
  CASE WHEN EXISTS (SELECT 1 FROM l WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where compaction put each document: its shard (named by the hashes of its doc_ids), the shard's tier and rows."""
    docs = read_table(spark, sf_dir, "documents")
    store = shard_documents(docs, f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}")
    held = store.read().select("doc_id", "_shard", "_tier")
    named = held.groupBy("_shard").agg(F.bit_xor(F.xxhash64("doc_id")).alias("shard"), F.count("*").alias("shard_rows"))
    return held.join(named, "_shard").select("doc_id", "shard", F.col("_tier").alias("tier"), "shard_rows")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g, least(len(w), 10) AS k FROM b),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, k WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON bw.k = dw.k AND bw.g = array_to_string(dw.w[dw.i:dw.i+dw.k-1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(o.n, 0)::BIGINT AS n_items,
  sha256(coalesce(o.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id
"""

def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern part of the secret scan, which SQL can say."""
    return op8_secret_scan(spark, sf_dir).drop("spans")


_ASSIGN = ASSIGN.replace("'", "''")
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, p.v, p.e - length(p.v) AS s, p.e FROM (SELECT doc_id, unnest(list_transform(range(1, len(v) + 1),
 lambda i: {{'v': v[i], 'e': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x)))}})) AS p
 FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS v FROM d) WHERE len(v) > 0)"""
    for order, (kind, pattern) in enumerate((("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]{14,}"), ("hex", "[0-9a-f]{16,}")))
)
SECRET_BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_SPANS}),
k AS (SELECT * FROM m WHERE kind <> 'assign' OR length(regexp_extract(v, '{_ASSIGN}', 1)) >= 12),
c AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS told FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(told, '')) AS base_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judge(read_table(spark, sf_dir, "documents"), trusted).drop("ratio")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counting part of the quality rules, which SQL can say."""
    return base_counts(read_table(spark, sf_dir, "documents")).drop("h")


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l.x) - len(list_distinct(l.x)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id
"""


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("filter")


_FIVE = ", ".join(f"('{c}', {k})" for k, c in enumerate("ABCDE"))
OP11_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM t LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
f(l, k) AS (VALUES {_FIVE}),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, i::INT AS step, 1 << ks[i] AS bit, list_sum([0] || list_transform(ks[1:i-1], lambda k: 1 << k))::INT AS earlier FROM o, range(1, 6) r(i)),
x AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (earlier | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (WHERE mask & earlier > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM x
"""


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))


OP12_SQL = _links_sql(3, 85, ", coalesce(c.c, d.doc_id) = d.doc_id AS kept")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = verify(manifest(read_table(spark, sf_dir, "documents")))
    return told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _op13_sql(levels: int) -> str:
    """Both trees level by level, for up to 16 ** ``levels`` rows a source and sources."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c:
      list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, c)), 4294967295), 4294967295)"""

    def tree(name: str, first: str) -> str:
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}s{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS a FROM {name}{k})""")
            out.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY 1, 2)")
        return ",\n".join(out)

    def fold(name: str, start: str) -> str:
        out = [f"{name}f0 AS ({start})"]
        for k in range(levels):
            out.append(f"""{name}f{k + 1} AS (SELECT f.* REPLACE (f.i // 16 AS i, f.p || s.b || s.a AS p, CASE WHEN s.n > 1 THEN sha256(s.b || f.h || s.a) ELSE f.h END AS h)
  FROM {name}f{k} f JOIN {name}s{k} s ON f.tree IS NOT DISTINCT FROM s.tree AND f.i = s.i)""")
        return ",\n".join(out)

    return f"""
WITH d AS (SELECT doc_id, source AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(LOWERED)} END AS other FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{tree("t", "SELECT tree, i, n, leaf AS h FROM r")},
u AS (SELECT tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{levels}),
{tree("u", "SELECT 0 AS tree, i, n, h FROM u")},
{fold("t", "SELECT doc_id, tree, leaf, i, coalesce(other, leaf) AS h, '' AS p FROM r")},
{fold("u", f"SELECT f.doc_id, f.leaf, u.h AS subroot, 0 AS tree, u.i, f.h, f.p FROM tf{levels} f JOIN u ON u.source IS NOT DISTINCT FROM f.tree")}
SELECT doc_id, leaf, subroot, (SELECT h FROM u{levels}) AS root, sha256(p) AS proof_sha256, h AS folded_root, h = (SELECT h FROM u{levels}) AS verified FROM uf{levels}
"""


OP13_SQL = _op13_sql(5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_filter_audit": op11_filter_audit,
    "op12_near_dedup": op12_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "secret_base": secret_base,
    "quality_base": quality_base,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_near_dedup": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
    "secret_base": SECRET_BASE_SQL,
    "quality_base": QUALITY_BASE_SQL,
}
