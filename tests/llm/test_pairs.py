"""Joins, repeated passages and decontamination against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from panelspark.llm import decontaminate, signature_join, substring_dedup

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Near copies around the threshold, exact copies, shared passages, edge cases."""
    rng = random.Random(5)
    rows, passage = [], words_of(rng, 60)
    for g in range(12):
        base = words_of(rng, rng.choice((30, 90, 300)))
        for _ in range(rng.choice((2, 3, 9))):
            text = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 5))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                at = rng.randrange(len(text))
                text[at:at] = passage
            rows.append(" ".join(text))
    rows += [" ".join(words_of(rng, 20) + passage + words_of(rng, 20)) for _ in range(6)]
    rows += [rows[0], rows[0].upper(), "one two", "ONE\ttwo", "one", "", None, "  \n ", "a b c d", "a b c d e " * 40]
    rng.shuffle(rows)
    return [(i * 3 + 1, t, "s") for i, t in enumerate(rows)]


def sets_of(rows, k):
    out = []
    for doc_id, text, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()))
    return out


def brute_components(rows, k, percent):
    sets = sets_of(rows, k)
    comp = {d: d for d, _ in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    return {(d, len(s), top(d)) for d, s in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_join_equals_all_pairs(spark, corpus, k, percent):
    got = signature_join.join(spark.createDataFrame(corpus, SCHEMA), k, percent).collect()
    assert {tuple(r) for r in got} == brute_components(corpus, k, percent)
    assert len(got) == len(corpus)


def test_join_splits_large_groups_into_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(signature_join, "SIDE", 5)
    monkeypatch.setattr(signature_join, "PROMISING", 0)
    got = signature_join.join(spark.createDataFrame(corpus, SCHEMA).repartition(3), 4, 85)
    assert {tuple(r) for r in got.collect()} == brute_components(corpus, 4, 85)


def test_tree_walk_keeps_every_pair_above_the_threshold():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for _ in range(150):
        keep = rng.random(400) < rng.choice((0.5, 0.9, 0.97))
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)])))
    bits = signature_join.folded([signature_join.bitmap(s).tobytes() for s in sets])
    n, ids = np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = signature_join.Tree(ids, n, n.copy(), ids.copy(), bits)
    found = {tuple(sorted(p)) for a, b in signature_join.walk(tree, tree, 85) for p in zip(tree.node[a].tolist(), tree.node[b].tolist())}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (n[i] + n[j] - both):
                assert (j, i) in found


def test_join_of_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert signature_join.join(empty).collect() == []
    rows = [(None, "a b c d e", None), (7, "a b c d e", None), (None, "q r s t u", "z"), (7, "a b c d e", None), (9, None, None)]
    got = sorted(map(tuple, signature_join.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (None, 2, None), (7, 2, 7), (9, 0, 9)], key=str)
    kept = signature_join.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", "a b c d e"), ("7", "a b c d e"), ("9", None), ("None", "q r s t u")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.comp for r in signature_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_repeats(rows, length):
    first, out = {}, []
    texts = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    for d, w in texts:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, d), d)
    for d, w in texts:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [2, 7, 50])
def test_removed_words_equal_brute_force(spark, corpus, length):
    got = substring_dedup.remove_repeats(spark.createDataFrame(corpus, SCHEMA), length).drop("kept_text")
    assert sorted(map(tuple, got.collect())) == brute_repeats(corpus, length)


def test_levels_double_until_nothing_survives(spark):
    rng = random.Random(1)
    long, short = words_of(rng, 45), words_of(rng, 12)
    rows = [(1, " ".join(long), "s"), (2, " ".join(["q"] + long), "s"), (3, " ".join(short), "s"), (4, " ".join(short + ["z"]), "s"), (5, "lone words", "s")]
    got = {r.doc_id: r.longest for r in substring_dedup.levels(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert got == {1: 40, 2: 40, 3: 10, 4: 10, 5: 0}


def test_repeats_of_nulls_ties_and_empty_tables(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "a b c d e f"
    rows = [(None, text, None), (4, text, None), (4, text, None), (5, None, None), (6, "", "x")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 3).collect()), key=str)
    assert got == sorted([(None, 6, 6), (4, 6, 0), (4, 6, 0), (5, 0, 0), (6, 0, 0)], key=str)


def items_of(rng):
    return [(i, " ".join(words_of(rng, n))) for i, n in enumerate((15, 15, 22, 40, 40, 59))] + [(90, "tiny item"), (91, None), (92, "")]


def brute_contaminated(docs, items, k=5, threshold=0.8):
    found = set()
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else Counter()
    for item, t in items:
        w, own = split(t), grams(split(t))
        for d, text, *_ in docs:
            v = split(text)
            for i in range(max(len(v) - len(w) + 1, 1)):
                other = grams(v[i : i + len(w)])
                both, total = sum((own & other).values()), sum((own | other).values())
                if total and Fraction(both, total) >= Fraction(str(threshold)):
                    found.add((d, item))
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items, docs = items_of(rng), []
    for i in range(60):
        text = words_of(rng, 80)
        if i % 2:
            part = items[rng.randrange(6)][1].split()
            for _ in range(i % 5):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(80)
            text[at:at] = [p.upper() if i % 3 else p + "," for p in part]
        docs.append((i, " ".join(text), "s"))
    docs += [(100, "a Tiny, item here", "s"), (101, None, "s"), (102, "", "s"), (103, items[0][1], "s"), (104, items[5][1] + " x", None), (None, items[2][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.search(spark.createDataFrame(docs, SCHEMA), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_contaminated(docs, items)
    small = decontaminate.search(spark.createDataFrame(docs, SCHEMA), bench, broadcast_bytes=200)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == brute_contaminated(docs, items)
    kept = decontaminate.clean(spark.createDataFrame(docs, SCHEMA), bench)
    bad = {d for d, _ in brute_contaminated(docs, items)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in docs if d not in bad)
    assert kept.columns == ["doc_id", "text", "source"]
    assert decontaminate.search(spark.createDataFrame([], SCHEMA), bench).collect() == []
    assert decontaminate.search(spark.createDataFrame(docs, SCHEMA), bench.limit(0)).collect() == []


def test_block_lists_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"t{rng.integers(10**9)}" for _ in range(30))) for i in range(40)]
    index = decontaminate.build_index(items)
    for _ in range(200):
        flips = np.zeros(128, np.uint8)
        flips[rng.choice(128, rng.integers(0, 60), replace=False)] = 1
        p = index.prints[rng.integers(40)] ^ np.packbits(flips).view(">u8").astype(np.uint64)
        near = np.flatnonzero(np.bitwise_count(index.prints ^ p).sum(axis=1) <= index.radius).tolist()
        assert decontaminate.candidates(index, p) == near


def test_fingerprints_of_similar_windows_stay_within_the_radius():
    rng = np.random.default_rng(4)
    missed, tried = 0, 400
    for _ in range(tried):
        a = rng.integers(0, 2**63, 45).astype(np.uint64)
        b = a.copy()
        b[rng.choice(45, 5, replace=False)] = rng.integers(0, 2**63, 5)
        away = np.bitwise_count(decontaminate.simhash(a) ^ decontaminate.simhash(b)).sum()
        missed += int(away > 31)
    assert missed <= tried * 0.01


def test_groups_of_copies_meet_their_first(spark):
    rows = [(i, "same words in every copy of it " * 3, "s") for i in range(300)]
    sizes = defaultdict(int)
    for r in signature_join.join(spark.createDataFrame(rows, SCHEMA)).collect():
        sizes[r.component_id] += 1
    assert sizes == {0: 300}


def test_members_leave_the_trees_where_no_pair_can_meet_first(spark):
    """With 100 shingles the first shared one of a pair has a place below 9 in the shorter set, and below 16 in the longer."""
    rows = [
        (1, 12, 10, 100, 1), (1, 12, 11, 100, 2),  # late in both
        (2, 8, 10, 100, 1), (2, 15, 11, 105, 2), (2, 15, 12, 99, 3), (2, 20, 13, 130, 4),  # a late one may be longer, by a little
        (3, 0, 10, 100, 1), (3, 0, 14, 90, 1),  # one component
    ]
    members = spark.createDataFrame(rows, "token long, pos int, node long, n int, comp long")
    assert sorted((r.token, r.node) for r in signature_join.paired(members, 85).collect()) == [(2, 10), (2, 11)]
