"""Repeated passages by level-wise doubling.

Level ``length / 2``: of every window of ``length`` words the word gram with the smallest hash is its
anchor, so equal windows have equal anchors at equal places and few grams leave a task. Anchors that
occur in one document only are dropped. Level ``length``: windows whose anchor survived are extended
to twice the anchor's length and compared by two independent 64-bit hashes of all their words, first
as whole runs that share an anchor and then, where a run is new, one by one.
``levels`` goes on doubling: a window of twice the length is a candidate when both halves survived.

A window counts as repeated when its words also start in a document with a smaller id, judged on the
input. Words are runs without space and tab to carriage return, unchanged. Null texts have no words.
Rows without an id come after all others; rows with one id never remove each other's words; repeated
rows get equal results. Nothing is collected per window or per document group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.session import stage_table

_NONE = np.uint64(2**64 - 1)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _id (null: last), _row (64-bit key of id and text), _text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    doc_id = docs[id_col].cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(common.LAST_ID)).alias("_id"), F.xxhash64(doc_id, text).alias("_row"), text.alias("_text"))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Word hashes, first words of all windows, and of each window the place and hash of its anchor."""
    word = common.span_hashes(data, starts, ends)
    first, row = common.gram_starts(bounds, length)
    if not len(first):
        return word, first, row, first, word[:0]
    grams = np.full(len(word), _NONE)
    at, _ = common.gram_starts(bounds, gram)
    grams[at] = common.span_hashes(word, at, at + gram)
    best, width, wanted = np.arange(len(word)), 1, length - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        other = best[np.minimum(np.arange(len(word)) + step, len(word) - 1)]
        best = np.where(grams[best] <= grams[other], best, other)
        width += step
    place = best[first]
    return word, first, row, place, grams


def _digests(length: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("_id", pa.int64()), ("_row", pa.int64()), ("gram", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                data, offsets = common.utf8(part.column("_text"))
                starts, ends, bounds = common.words(data, offsets)
                _, _, row, place, grams = anchors(data, starts, ends, bounds, length, gram)
                keep = np.ones(len(place), bool)
                keep[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
                row, found = row[keep], common.signed(grams[place[keep]])
                ids, keys = part.column("_id").to_numpy(), part.column("_row").to_numpy()
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
                none = pa.nulls(len(row), pa.int64())
                yield pa.record_batch([part.column("doc_id"), part.column("_id"), part.column("_row"), pa.nulls(len(sha), pa.int64()), pa.array(np.diff(bounds)), pa.array(sha)], schema=schema)
                yield pa.record_batch([none, pa.array(ids[row]), pa.array(keys[row]), pa.array(found), none, pa.nulls(len(row), pa.string())], schema=schema)

    return run


def _runs(length: int, gram: int):
    """Runs of neighbouring windows with one surviving anchor, hashed over all words they cover."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("_id", pa.int64()), ("_row", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                data, offsets = common.utf8(part.column("_text"))
                starts, ends, bounds = common.words(data, offsets)
                word, first, row, place, grams = anchors(data, starts, ends, bounds, length, gram)
                if not len(first):
                    continue
                alive = np.unique(part.column("grams").flatten().to_numpy())
                cut = np.ones(len(first), bool)
                cut[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(cut)
                n = np.diff(np.append(begin, len(first)))
                hit = np.isin(common.signed(grams[place[begin]]), alive)
                begin, n = begin[hit], n[hit]
                a, row = first[begin], row[begin]
                z = a + n - 1 + length
                second = common.span_hashes(data, starts, ends, 1)
                ids, keys = part.column("_id").to_numpy(), part.column("_row").to_numpy()
                yield pa.record_batch(
                    [
                        common.signed(common.span_hashes(word, a, z)), common.signed(common.span_hashes(second, a, z, 1)),
                        ids[row], keys[row], (a - bounds[row]).astype(np.int32), n.astype(np.int32),
                    ],
                    schema=schema,
                )

    return run


def _windows(length: int):
    """The single windows of given runs."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("_id", pa.int64()), ("_row", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                data, offsets = common.utf8(part.column("_text"))
                starts, ends, bounds = common.words(data, offsets)
                word, second = common.span_hashes(data, starts, ends), common.span_hashes(data, starts, ends, 1)
                runs = part.column("runs")
                row = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy())
                flat = runs.flatten()
                at, n = (flat.field(f).to_numpy().astype(np.int64) for f in ("at", "n"))
                each = np.repeat(np.arange(len(n)), n)
                first = at[each] + np.arange(int(n.sum())) - (np.cumsum(n) - n)[each] + bounds[row[each]]
                row = row[each]
                ids, keys = part.column("_id").to_numpy(), part.column("_row").to_numpy()
                yield pa.record_batch(
                    [
                        common.signed(common.span_hashes(word, first, first + length)), common.signed(common.span_hashes(second, first, first + length, 1)),
                        ids[row], keys[row], (first - bounds[row]).astype(np.int32),
                    ],
                    schema=schema,
                )

    return run


def _cut(length: int):
    schema = pa.schema([("_row", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone, sha, kept = batch.column("_row"), [], [], []
            for text, at in zip(batch.column("_text").to_pylist(), batch.column("at")):
                found = text.encode().split()
                edge = np.zeros(len(found) + 1, np.int64)
                begin, n = (at.values.field(f).to_numpy() for f in ("at", "n"))
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + n - 1 + length, -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = b" ".join(w for w, k in zip(found, keep) if k)
                gone.append(int((~keep).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.record_batch([keys, pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], schema=schema)

    return run


def first_seen(spans: DataFrame) -> DataFrame:
    """Spans with ``_first``, the smallest id that has the same words.

    The smallest ids are a table of their own, so Spark can split the spans of a frequent passage.
    """
    first = stage_table(spans.groupBy("h1", "h2").agg(F.min("_id").alias("_first")), "first")
    return spans.join(first, ["h1", "h2"])


def windows_of(runs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The windows of runs as rows h1, h2, _id, _row, at."""
    lists = runs.groupBy("_row").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    rows = texts.select("_id", "_row", "_text").join(lists, "_row").select("_id", "_row", "runs", "_text")
    return rows.mapInArrow(_windows(length), "h1 long, h2 long, _id long, _row long, at int")


def find(docs: DataFrame, length: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows, texts with surviving anchors, and the runs of windows around these."""
    if length < 2:
        raise ValueError("a window has at least two words")
    gram = length // 2
    rows = keyed(docs, id_col, text_col)
    first = stage_table(rows.mapInArrow(_digests(length, gram), "doc_id long, _id long, _row long, gram long, n_words long, sha string"), "anchors")
    grams = first.filter("gram IS NOT NULL").select("gram", "_id", "_row")
    shared = stage_table(grams.groupBy("gram").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).filter("a < b").select("gram"), "grams")
    alive = grams.join(shared, "gram").groupBy("_row").agg(F.collect_set("gram").alias("grams"))
    texts = stage_table(rows.join(alive, "_row").dropDuplicates(["_row"]), "passages")
    runs = texts.select("_id", "_row", "grams", "_text").mapInArrow(_runs(length, gram), "h1 long, h2 long, _id long, _row long, at int, n int")
    return first.filter("gram IS NULL").select("doc_id", "_row", "n_words", "sha"), texts.select("_id", "_row", "_text"), stage_table(runs, "runs")


def remove_repeats(docs: DataFrame, length: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, where words were removed, the kept text.

    A run that also starts in an earlier document is covered whole. Only the first occurrence of each
    run goes on to single windows, so a group of copies counts once; the earliest document with a
    window is always the first with that window's run, so no window loses its earliest place.
    """
    digests, texts, runs = find(docs, length, id_col=id_col, text_col=text_col)
    seen = stage_table(first_seen(runs).select("_row", "at", "n", (F.col("_id") > F.col("_first")).alias("known")), "known")
    windows = stage_table(windows_of(seen.filter("NOT known"), texts, length), "windows")
    single = first_seen(windows).filter("_id > _first").select("_row", "at", F.lit(1).alias("n"))
    covered = seen.filter("known").select("_row", "at", "n").unionByName(single)
    covered = covered.groupBy("_row").agg(F.collect_list(F.struct("at", "n")).alias("at"))
    cut = texts.join(covered, "_row").select("_row", "_text", "at").mapInArrow(_cut(length), "_row long, n_removed long, kept_sha256 string, kept string")
    return digests.join(cut, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.col("kept").alias("kept_text"),
    )


def levels(docs: DataFrame, length: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Longest repeated level per document: doc_id, longest (length, 2 * length, ... or 0).

    A window of twice the length is two neighbouring windows that both survived; its hash is made of
    theirs, so no text is read again. The loop ends when no candidate survives.
    """
    digests, texts, runs = find(docs, length, id_col=id_col, text_col=text_col)
    windows, size, found = windows_of(runs, texts, length), length, None
    while True:
        windows = stage_table(windows, f"windows-{size}")
        many = windows.groupBy("h1", "h2").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).filter("a < b").select("h1", "h2")
        alive = stage_table(windows.join(many, ["h1", "h2"]), f"level-{size}")
        if alive.isEmpty():
            break
        reached = alive.select("_row").distinct().withColumn("size", F.lit(size))
        found = reached if found is None else found.unionByName(reached)
        right = alive.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "_row", (F.col("at") - size).alias("at"))
        windows = alive.join(right, ["_row", "at"]).select(F.xxhash64("h1", "g1", "h2").alias("h1"), F.xxhash64("g2", "h2", "g1").alias("h2"), "_id", "_row", "at")
        size *= 2
    if found is None:
        return digests.select("doc_id", F.lit(0).alias("longest"))
    best = found.groupBy("_row").agg(F.max("size").alias("longest"))
    return digests.join(best, "_row", "left").select("doc_id", F.coalesce("longest", F.lit(0)).alias("longest"))
