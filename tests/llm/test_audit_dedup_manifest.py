"""Filter audit, SetSketch near-duplicates and the Merkle manifest against brute force: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.llm import filter_audit, manifest, near_dedup, ngram_join

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and i > first[t]
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), e)
        failed.append((s or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out, shapley = [], {}
    for part in {p for p, *_ in failed}:
        own = [r for r in failed if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, f, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, shapley[r[0], r[3]]) for r in out)


def audit_rows(rng):
    base = [text_of(rng, 250), text_of(rng, 20), "same " * 300, "A B C " * 90, text_of(rng, 210) + " 5%", "", None, " \n", "É" * 5000, text_of(rng, 9000)]
    rows = [(i, rng.choice(base), rng.choice(["x", "y", None, ""])) for i in range(60)]
    return rows + [(3, base[0], "x"), (3, base[0], "x"), (3, base[1], "y"), (None, base[0], "x"), (None, None, None), (100, base[8], "y"), (101, base[9], None)]


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(4)
    rows = audit_rows(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 70, 2)] + [(4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, quality int, mask string")
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == [c.split()[0] for c in filter_audit.AUDIT.split(", ")]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_filter_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a $", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), labels).collect() == []
    assert sorted(map(tuple, filter_audit.audit_filters(docs, labels).collect())) == brute_audit([(1, "a $", None)], [])


def test_plain_changes_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in filter_audit.plain_changes(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert len(seen) == len(list(filter_audit.plain_changes(n))) + 1 == len(list(itertools.permutations(range(n))))


def test_diagram_keeps_its_counts_under_swaps_and_shares_nodes():
    rng = random.Random(2)
    counts = {m: (rng.randrange(3), 0, 0) for m in range(32)}
    diagram = filter_audit.Diagram(counts, 5)
    for _ in range(40):
        diagram.swap(rng.randrange(4))
        for level, nodes in enumerate(diagram.levels):
            assert len(set(nodes.values())) == len(nodes) or level == 0
        chosen, node = 0, diagram.root
        for level, variable in enumerate(diagram.order):
            high = rng.random() < 0.5
            node = diagram.levels[level].get(node, (0, 0))[high]
            chosen |= high << variable
        assert diagram.weight[node] == counts[chosen]
        assert diagram.weight[diagram.root][0] == sum(w[0] for w in counts.values())


def shingles(text, k=3):
    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_dedup(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]
    return sorted((str(i), n, str(c), i is not None and i == c) for i, n, c in out)


def dedup_rows():
    rng = random.Random(8)
    out = []
    for _ in range(14):
        words = text_of(rng, rng.choice([4, 40, 90, 300])).split()
        for _ in range(rng.choice([1, 3, 8])):
            out.append(" ".join(words))
            for _ in range(max(1, len(words) // 80)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    shared = text_of(rng, 60)
    out += [shared + " " + text_of(rng, n) for n in (5, 6, 7, 30, 31)] + [shared] * 3
    out += ["", None, " \n\t ", "one", "one two", "One TWO", "one two three", text_of(rng, 7000), "É\x0bx\x1cy z"]
    return list(enumerate(out)) + [(7, out[7]), (7, "another text for a repeated id " * 3), (None, out[0]), (None, None), (None, "lone " + text_of(rng, 50))]


@pytest.mark.parametrize("chunk", [1024, 2])
def test_near_groups_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rows = dedup_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, digest int")
    got = [(str(r[0]), r[1], str(r[2]), r[3]) for r in near_dedup.near_groups(docs).collect()]
    assert sorted(got) == brute_dedup(rows)


def test_near_groups_of_nothing(spark):
    docs = spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")
    assert near_dedup.near_groups(docs.limit(0)).collect() == []
    assert sorted(map(tuple, near_dedup.near_groups(docs).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    a, b = draw(300), draw(5000)
    of_a, of_b, of_both = near_dedup.registers_of([a, b, np.union1d(a, b)])
    assert (near_dedup.merged(of_a, of_b) == of_both).all()
    for asked, sizes in ((0.85, (400, 400)), (0.5, (300, 400)), (0.0, (50, 60)), (0.9, (95, 100))):
        common = round(asked * sum(sizes) / (1 + asked))
        pairs = []
        for _ in range(200):
            u = draw(sum(sizes) - common)
            pairs += [u[: sizes[0]], u[sizes[0] - common :]]
        r = near_dedup.registers_of(pairs)
        x, y = r[::2], r[1::2]
        found = near_dedup.similarity(np.full(200, sizes[0] / sum(sizes)), (x > y).sum(1), (x < y).sum(1))
        assert abs(found.mean() - common / (sum(sizes) - common)) < 0.012
        if asked >= 0.85:
            assert all(near_dedup.may_link(sizes[0], x[i], np.array(sizes[1:]), y[i : i + 1], 85)[0] for i in range(200))
            assert (x.view(np.uint64) == y.view(np.uint64)).any(1).all()
        elif asked < 0.3:
            assert not any(near_dedup.may_link(sizes[0], x[i], np.array(sizes[1:]), y[i : i + 1], 85)[0] for i in range(200))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_siblings(levels, at):
    for level in levels[:-1]:
        start = at // 16 * 16
        yield "".join(level[start:at]), "".join(level[at + 1 : start + 16])
        at //= 16


def brute_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r[0] is not None, r[0] or 0, brute_leaf(r), r) for r in rows if r[1] == s), key=lambda x: x[:3]) for s in sources}
    trees = {s: brute_tree([x[2] for x in own[s]]) for s in sources}
    top = brute_tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, leaf, r) in enumerate(own[s]):
            proof = [*brute_siblings(trees[s], at), *brute_siblings(top, k)]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = brute_leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for before, after in proof:
                node = sha(before + node + after)
            out.append((str(r[0]), leaf, trees[s][-1][0], top[-1][0], sha("".join(b + a for b, a in proof)), node, node == top[-1][0]))
    return sorted(out)


def proved(docs):
    rows = manifest.verify(manifest.manifest(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((str(r[0]), *r[1:]) for r in rows)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node int"


@pytest.mark.parametrize("sizes", [{"hot": 1500, "a": 256, "b": 257, "c": 17, "d": 16, "e": 1, None: 5, "": 2}, {"only": 1}, {None: 300}, {f"s{i:03}": 1 for i in range(300)}])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["Mixed Case é", "lower", None, "", "X" * 50])
            rows.append((rng.randrange(10**6), source, rng.choice(["en", None]), rng.choice([None, 7]), text))
    if len(rows) > 100:
        rows += [rows[0], rows[0], (rows[0][0], *rows[0][1:4], "other"), (None, rows[0][1], None, None, None), (5, rows[0][1], "en", 3, "Long " * 100_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA).repartition(3)
    assert proved(docs) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert proved(spark.createDataFrame([], SCHEMA)) == []


def test_manifest_tells_which_rows_were_changed(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", None, None, "Text A") for i in range(200)], SCHEMA.split(", tree")[0])
    got = manifest.verify(manifest.manifest(docs))
    assert got.where(F.col("verified") == F.col("other_leaf").isNotNull()).count() == 0
    assert got.where("not verified").count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200))
    assert got.select("root").distinct().count() == 1
