"""Merkle manifests, prefix-hash fingerprints and document-tree search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import lexical_tree, merkle_manifest, prefix_hash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- manifest --------------------------------------------------------------------------------


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def paths(nodes, arity):
    """Root, and for each node its siblings per level as (left, right)."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a - a % arity
            found[i].append((nodes[run:a], nodes[a + 1 : run + arity]))
        nodes = [sha(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [a // arity for a in at]
    return nodes[0], found


def brute_manifest(rows, tampered, arity=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {}
    for g in keys:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[g] = (ordered, *paths([leaf(r) for r in ordered], arity))
    root, above = paths([done[g][1] for g in keys], arity)
    out = []
    for g, up in zip(keys, above):
        ordered, subroot, below = done[g]
        for r, own in zip(ordered, below):
            node = leaf(tampered(r))
            for left, right in own + up:
                node = sha(*left, node, *right)
            flat = "".join(x for left, right in own + up for x in left + right)
            out.append((r[0], leaf(r), subroot, root, sha(flat), node, node == root))
    return sorted(out, key=repr)


def changed(r):
    hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    return (*r[:4], r[4] + 1) if hit else r


def spark_manifest(docs, arity=2):
    hit = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    rows = merkle_manifest.manifest(docs, {"n_chars": F.when(hit, docs["n_chars"] + 1).otherwise(docs["n_chars"])}, arity=arity)
    return sorted((tuple(r) for r in merkle_manifest.verified(rows).collect()), key=repr)


@pytest.mark.parametrize(("n", "arity"), [(1, 2), (2, 2), (7, 2), (37, 2), (37, 3), (40, 5)])
def test_manifest_equals_brute_force(spark, n, arity):
    draw = random.Random(n)
    rows = [(i, f"text {i} é", draw.choice(["en", "en", "de", "Ü", None]), None if i % 9 == 3 else "s", None if i % 5 == 4 else i) for i in range(n)]
    draw.shuffle(rows)
    assert spark_manifest(documents(spark, rows), arity) == brute_manifest(rows, changed, arity)


def test_manifest_of_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (3, "b", "en", "s", 1), (4, "x" * 200_000, "", "", 2**40)]
    more = [(*r, 5, "e", "f", 1, "h", b"p", "r") for r in rows]
    docs = documents(spark, more, ", gid long, node string, entry string, idx long, _group string, proof binary, found string")
    got = spark_manifest(docs)
    assert got == brute_manifest(rows, changed)
    assert spark_manifest(documents(spark, [])) == []


def test_hot_group_is_dealt_over_partitions(spark):
    rows = [(i, "t", "en", "s", i) for i in range(3000)] + [(i, "t", f"l{i % 7}", "s", i) for i in range(3000, 3100)]
    placed = merkle_manifest.placed(documents(spark, rows).withColumn("node", F.lit("x")).select("doc_id", "lang", "node"), "lang", ["doc_id"])
    got = {r.doc_id: r for r in placed.withColumn("p", F.spark_partition_id()).collect()}
    assert [got[i].idx for i in range(3000)] == list(range(3000)) and {got[i].n for i in range(3000)} == {3000}
    assert sorted({r.gid for r in got.values()}) == list(range(8)) and got[0].gid == 0


# ---- fingerprints ----------------------------------------------------------------------------


def slow_prefixes(text):
    out, power = [0], 1
    for c in text:
        out.append((out[-1] + (ord(c) + 1) * power) % prefix_hash.PRIME)
        power = power * prefix_hash.BASE % prefix_hash.PRIME
    return out


@pytest.mark.parametrize("n", [0, 1, 33, 5000, prefix_hash.BLOCK, 2 * prefix_hash.BLOCK + 77])
def test_prefix_hashes_equal_the_plain_recurrence(n):
    text = "".join(random.Random(n).choices("ab é中\U0010ffff", k=n))
    at = np.unique(np.array([0, n // 3, n // 2, n]))
    want = slow_prefixes(text)
    assert prefix_hash.prefixes(prefix_hash.code_points(text), at).tolist() == [want[i] for i in at]


def test_spans_and_longest_common_extensions():
    draw = random.Random(5)
    a = "".join(draw.choices("abc", k=400))
    b = "".join(draw.choices("abc", k=50)) + a[100:300] + "".join(draw.choices("abc", k=90))
    x, y = prefix_hash.PrefixArray(a), prefix_hash.PrefixArray(b)
    for _ in range(300):
        i, j, n = draw.randrange(400), draw.randrange(340), draw.randrange(60)
        assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert x.extension(i, y, j) == want
    assert x.extension(100, y, 50) >= 200


def like(a, b):
    return prefix_hash.likeness(prefix_hash.sample(prefix_hash.code_points(a)), prefix_hash.sample(prefix_hash.code_points(b)))


def test_likeness_finds_equal_spans_at_the_start_the_end_and_between():
    draw = random.Random(1)
    text = "".join(draw.choices("abcdefghij ", k=4000))
    other = "".join(draw.choices("klmnopqrst ", k=4000))
    assert like(text, text) == 1.0 and like("", "") == 1.0 and like(text, "") == 0.0
    assert like(text, other) < 0.05
    assert 0.7 < like(text, text[:3000] + other[:1000]) <= 0.76
    assert 0.7 < like(text, other[:1000] + text[1000:]) <= 0.76
    assert like(text, text[:2000] + "an insertion" + text[2000:]) > 0.9
    assert like(text, text[:1000] + other[:100] + text[1100:3000] + other[:100] + text[3100:]) > 0.8
    assert like(text, other) == like(other, text)
    for n in (1, 2, 5, 32, 33, 34, 1055, 1056):
        size, whole, forward, backward = sampled = prefix_hash.sample(prefix_hash.code_points(text[:n]))
        again = prefix_hash.unpacked(prefix_hash.packed(sampled))
        assert again[:2] == (size, whole) and (again[2] == forward).all() and (again[3] == backward).all()
        assert len(forward) <= prefix_hash.SAMPLES + 1 and n // prefix_hash.stride(n) <= prefix_hash.SAMPLES


def brute_fingerprints(rows, key):
    rows = sorted(rows, key=key)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        mark = lambda t: prefix_hash.packed(prefix_hash.sample(prefix_hash.code_points(t)))
        out.append((doc_id, len(text), sha(edited), mark(text), mark(edited), like(text, edited), like(text, after)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 2, 9, 60])
def test_edited_texts_follow_the_next_document_in_any_buckets(spark, buckets):
    draw = random.Random(buckets)
    rows = [(i * 7 % 101, "".join(draw.choices("abé \U0001f600", k=draw.randrange(300)))) for i in range(101)]
    rows[5], rows[6] = (rows[5][0], None), (rows[6][0], "z" * 70_000)
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(7)
    got = sorted((tuple(r) for r in prefix_hash.edited_fingerprints(docs, buckets=buckets).collect()), key=repr)
    assert got == brute_fingerprints(rows, lambda r: r[0])


def test_fingerprints_of_ties_null_ids_single_and_empty_tables(spark):
    def got(rows, **options):
        docs = spark.createDataFrame([(*r, 1, 2, "x", True) for r in rows], "doc_id long, text string, _id long, _hash long, _text string, _guest boolean")
        return prefix_hash.edited_fingerprints(docs, **options).collect()

    assert got([]) == []
    (one,) = got([(1, "abcdefgh")])
    assert one.edited_sha256 == sha("abcdefab") and one.near_next == 1.0 and one.n_chars == 8
    # One id with many different texts, as well as equal rows: cut by the hash of the text, each text once in a cycle.
    rows = [(7, f"text number {i % 40} " * 3) for i in range(80)] + [(None, "last of all"), (1, "first")]
    out = got(rows, buckets=12)
    assert len(out) == 82 and sum(r.doc_id == 7 for r in out) == 80
    before = [r for r in out if r.doc_id is None]
    assert before[0].edited_sha256 == sha("last of a" + "fi")
    texts = {prefix_hash.packed(prefix_hash.sample(prefix_hash.code_points(t))) for _, t in rows}
    assert {r.fingerprint for r in out} == texts
    assert sum(r.near_next == 1.0 for r in out) >= 40


# ---- search ----------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=20):
    found = [(i, t) for i, text in docs if (t := terms(text))]
    total, length = len(found), sum(len(t) for _, t in found)
    df = defaultdict(int)
    for _, t in found:
        for x in set(t):
            df[x] += 1
    out = []
    for item_id, text in items:
        ranked = []
        for doc_id, t in found:
            m = 75 + 25 * len(t) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 12 * m)) for x in terms(text) if x in df)
            if score > 0:
                ranked.append((-score, doc_id))
        out += [(item_id, k + 1, i, -s) for k, (s, i) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def collected(docs, items, **options):
    return sorted(tuple(r) for r in lexical_tree.search(docs, items, **options).collect())


@pytest.mark.parametrize(("seed", "top", "size"), [(1, 20, 256 << 10), (2, 3, 300), (3, 500, 256 << 10)])
def test_search_equals_brute_force(spark, monkeypatch, seed, top, size):
    monkeypatch.setattr(lexical_tree, "LEAF", 4)
    draw = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["é", "ß中", "A1", "x_y"]
    text = lambda k: draw.choice([" ", "-", "\n"]).join(draw.choices(pool, weights=[1 / (i + 1) for i in range(64)], k=k))
    docs = [(i, text(draw.randrange(60))) for i in range(400)] + [(400 + i, "w1 w2 copy copy") for i in range(90)]
    items = [(i, text(12)) for i in range(30)]
    got = collected(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top=top, broadcast_bytes=size)
    assert got == brute_search(docs, items, top)


def test_bounds_cover_every_document_below_and_walks_leave_nodes_out():
    draw = random.Random(4)
    n, v = 3000, 200
    lists = [sorted(set(min(v - 1, int(draw.expovariate(0.03))) for _ in range(30))) for _ in range(n)]
    edges = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = np.concatenate(lists)
    counts = np.array([draw.randint(1, 5) for _ in flat])
    m = np.array([draw.randint(75, 400) for _ in range(n)])
    tree = lexical_tree.Tree(np.arange(n), m, edges, flat, counts, np.arange(v))
    leaves = [k for k, c in enumerate(tree.children) if not c]
    assert sorted((tree.low[k], tree.high[k]) for k in leaves)[0][0] == 0 and sum(tree.high[k] - tree.low[k] for k in leaves) == n
    assert max(tree.high[k] - tree.low[k] for k in leaves) <= lexical_tree.LEAF
    for k in range(len(tree.low)):
        a, z = tree.low[k], tree.high[k]
        assert (tree.most[k] == tree.cells[a:z].max(axis=0)).all() and tree.least_m[k] == tree.m[a:z].min()
    columns, weights = np.array([150, 170, 190, 3]), np.array([5000, 6000, 7000, 10])
    kept = tree.best(columns, weights, 5, [])
    tf = tree.cells[:, columns].astype(np.int64)
    every = ((1_000_000_000 * tf) // (1000 * tf + 12 * tree.m[:, None])) @ weights
    want = sorted(zip((-every).tolist(), tree.ids.tolist()))[:5]
    assert kept == want


def test_search_of_nulls_empty_texts_repeats_and_empty_tables(spark):
    kinds = "doc_id long, text string, n long, terms string, counts int, _id long, _item int, rank int, score long"
    row = lambda i, t: (i, t, 1, "t", 1, 1, 1, 1, 1)
    docs = [(1, None), (2, ""), (3, "!!"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha beta"), (6, "alpha " * 50_000), (7, "gamma")]
    items = [(1, "ALPHA alpha"), (2, None), (3, ""), (4, "unknown"), (5, "gamma, beta")]
    table = spark.createDataFrame([row(*d) for d in docs], kinds)
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, i long, t long")
    got = lexical_tree.search(table, asked).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.item_id, r.rank)):
        by[r.item_id].append((r.rank, r.doc_id, r.score))
    assert set(by) == {1, 5} and [x[0] for x in by[1]] == [1, 2, 3, 4]
    some = [(d if d is not None else 10**9, t) for d, t in docs]
    want = brute_search(some, [(i, t) for i, t in items])
    assert sorted((i, a, b if b is not None else 10**9, c) for i, x in by.items() for a, b, c in x) == want
    none = spark.createDataFrame([], kinds)
    assert lexical_tree.search(none, asked).collect() == [] and lexical_tree.search(table, asked.filter("false")).collect() == []
