"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers read a clause's token classes (insult, threat, target, negation, reported speech,
other): negation damps what follows within a few tokens, reported speech damps the rest of the
clause, a target strengthens it. They are composed into one machine; a clause scores the weights of
its matched words under the machine's factors, a document the saturating sum of its clauses, and a
one-variable logistic curve turns that into 0..1.

The insult lexicon (words and word stems) and its weights are learned from labelled rows by
sequential covering: a feature enters while toxic rows remain that fewer than two features explain.
Fitting uses at most ``sample`` labelled rows, chosen by a hash of the id; scoring reads every row.

Null and empty texts match nothing and get the curve's lowest score. Rows with null labels or ids do
not teach. Without toxic labels only the fixed threat words match. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import common  # noqa: F401

# Closed word classes of the grammar, in the corpus's languages.
THREATS = "kill hurt destroy beat shoot stab burn murder töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours u he she they them him her du dich dir ihr euch tu toi vous vosotros tú usted ustedes".split()
NEGATIONS = "not never no nor neither without isn't aren't don't nicht kein keine nie pas jamais sans nunca ni sin".split()
REPORTS = "said says wrote claimed quoted called reported told sagte schrieb behauptete dit écrit déclare dijo escribió".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")
STEMS = (4, 5, 6)
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult threat target negation report other".split()
CLASSES = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
REACH = 3
THREAT_WEIGHT = 1.0


@dataclass(frozen=True)
class Transducer:
    """Deterministic machine: arcs (state, class) -> (state, class written, factor); final factors."""

    arcs: dict
    final: dict
    start: object = 0

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds what this one writes into ``after``; factors multiply."""
        start = (self.start, after.start)
        arcs, final, todo = {}, {}, [start]
        while todo:
            state = todo.pop()
            if state in final:
                continue
            a, b = state
            final[state] = self.final[a] * after.final[b]
            for c in CLASSES:
                a2, mid, f = self.arcs[a, c]
                b2, out, g = after.arcs[b, mid]
                arcs[state, c] = ((a2, b2), out, f * g)
                todo.append((a2, b2))
        return Transducer(arcs, final, start)


def _machine(states: Iterable[int], arc, final=lambda s: 1.0) -> Transducer:
    states = list(states)
    return Transducer({(s, c): arc(s, c) for s in states for c in CLASSES}, {s: final(s) for s in states})


def negation(damping: float = 0.5) -> Transducer:
    def arc(s, c):
        if c == NEGATION:
            return REACH, c, 1.0
        return max(s - 1, 0), c, damping if s and c in (INSULT, THREAT) else 1.0

    return _machine(range(REACH + 1), arc)


def reported_speech(damping: float = 0.7) -> Transducer:
    return _machine((0, 1), lambda s, c: (int(s or c == REPORT), c, damping if s and c in (INSULT, THREAT) else 1.0))


def targeting(gain: float = 1.25) -> Transducer:
    return _machine((0, 1), lambda s, c: (int(s or c == TARGET), c, 1.0), lambda s: gain if s else 1.0)


def grammar() -> Transducer:
    return negation().compose(reported_speech()).compose(targeting())


@dataclass(frozen=True)
class Model:
    """Weights of learned words and stems, and the curve's slope and offset."""

    words: dict
    stems: dict
    slope: float = 1.0
    offset: float = -3.0


class Scorer:
    """Scores texts in a task: one scan for lexicon hits, then the machine on the clauses that have any."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.machine = model, grammar()
        self.classes = {w: c for ws, c in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in ws}
        self.scan = ahocorasick.Automaton()
        for key in {*model.words, *model.stems, *THREATS}:
            self.scan.add_word(key, len(key))
        self.scan.make_automaton()

    def weight(self, word: str) -> float:
        m = self.model
        if word in m.words:
            return m.words[word]
        return max((m.stems[word[:k]] for k in STEMS if word[:k] in m.stems), default=0.0)

    def clause(self, text: str) -> float:
        """The machine's weight of one lower-cased clause."""
        arcs, state, total = self.machine.arcs, self.machine.start, 0.0
        for word in WORD.findall(text):
            w = self.weight(word)
            c = INSULT if w > 0 else self.classes.get(word, OTHER)
            state, out, factor = arcs[state, c]
            total += factor * (w if out == INSULT else THREAT_WEIGHT if out == THREAT else 0.0)
        return total * self.machine.final[state]

    def raw(self, text: str | None) -> float:
        if not text:
            return 0.0
        text = text.lower()
        total, done = 0.0, 0
        for last, n in self.scan.iter(text):
            begin = last - n + 1
            if begin < done or begin and (text[begin - 1].isalpha() or text[begin - 1] == "'"):
                continue
            ends = CLAUSE_END.search(text, last)
            stop = ends.start() if ends else len(text)
            left = max(text.rfind(mark, done, begin) for mark in ".!?;:\n")
            total += self.clause(text[max(left + 1, done) : stop])
            done = stop
        return total

    def score(self, text: str | None) -> float:
        x = self.model.slope * min(self.raw(text), 50.0) + self.model.offset
        return 1.0 / (1.0 + math.exp(-x))


def text_features(text: str | None) -> set[str]:
    """Words, and stems written with a final ``*``."""
    found = {w for w in WORD.findall((text or "").lower()) if len(w) >= 3}
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update(text_features(text))
        keys = list({*toxic, *clean})
        yield pa.record_batch({"feature": pa.array(keys, pa.string()), "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})


def cover(rows: list[set[str]], counts: dict[str, tuple[int, int]], times: int = 2, least: int = 2) -> list[str]:
    """Features by greedy covering: each explains the most toxic rows that fewer than ``times`` chosen
    features explain, minus the clean rows it hits; longer features and whole words win ties."""
    having = defaultdict(set)
    for i, found in enumerate(rows):
        for f in found:
            having[f].add(i)
    left, chosen = [times] * len(rows), []
    gain = {f: len(ids) - counts[f][1] for f, ids in having.items()}
    rank = lambda f: (gain[f], not f.endswith("*"), len(f), f)
    while gain:
        best = max(gain, key=rank)
        if gain[best] < least:
            break
        chosen.append(best)
        del gain[best]
        for i in having[best]:
            left[i] -= 1
            if left[i] == 0:
                for f in rows[i]:
                    if f in gain:
                        gain[f] -= 1
    return chosen


def fit_curve(raw: list[float], toxic: list[int], ridge: float = 0.01, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with a ridge on the slope so separable rows stay finite."""
    groups = Counter(zip((min(r, 50.0) for r in raw), toxic))
    n = max(1, len(raw))
    slope, offset = 0.5, -2.0
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for (x, y), k in groups.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))
            v = p * (1 - p) * k
            g0, g1, h00, h01, h11 = g0 + k * (p - y), g1 + k * (p - y) * x, h00 + v, h01 + v * x, h11 + v * x * x
        g1, h11, h00 = g1 + ridge * n * slope * 0.01, h11 + ridge * n * 0.01, h00 + 1e-6 * n
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        offset, slope = offset - max(-2.0, min(2.0, d0)), max(0.05, slope - max(-1.0, min(1.0, d1)))
        if abs(d0) + abs(d1) < 1e-9:
            break
    return slope, offset


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8192, least: int = 3) -> Model:
    """Learns the lexicon and the curve from at most ``sample`` rows of ``labels`` (doc_id, toxic)."""
    pick = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna()
    pick = pick.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(pick), "_id")
    # One text per id, by a hash: as many rows as labels, however often an id occurs.
    rows = rows.groupBy("_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("_id", "t.text", "toxic")
    rows = rows.persist()
    try:
        size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
        if not n_toxic:
            return Model({}, {})
        counted = rows.select("text", "toxic").mapInArrow(_count, "feature string, toxic long, clean long")
        counted = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        least = min(least, max(1, n_toxic // 8))
        clear = counted.filter((F.col("toxic") >= least) & (F.col("clean") * (20.0 * n_toxic) <= F.col("toxic") * float(max(n_clean, 1))))
        counts = {r.feature: (r.toxic, r.clean) for r in clear.collect()}
        toxic_rows = [text_features(r.text) & counts.keys() for r in rows.filter("toxic = 1").select("text").toLocalIterator()]
        weights = {}
        for f in cover(toxic_rows, counts, least=least):
            t, c = counts[f]
            weights[f] = max(0.5, min(8.0, math.log((t + 0.5) * (n_clean + 1) / ((c + 0.5) * (n_toxic + 1)))))
        model = Model({f: w for f, w in weights.items() if f[-1] != "*"}, {f[:-1]: w for f, w in weights.items() if f[-1] == "*"})
        seen = raw_scores(rows, model, keep=("toxic",)).collect()
    finally:
        rows.unpersist()
    slope, offset = fit_curve([r.raw for r in seen], [r.toxic for r in seen])
    return Model(model.words, model.stems, slope, offset)


def _scored(model: Model, text_col: str, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        value = scorer.raw if raw else scorer.score
        for batch in batches:
            for part in common.text_slices(batch, text_col):
                out = pa.array([value(t) for t in part.column(text_col).to_pylist()], pa.float64())
                kept = [c for c in part.schema.names if c != text_col]
                yield pa.record_batch([part.column(c) for c in kept] + [out], names=[*kept, "raw" if raw else "score"])

    return run


def raw_scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    some = docs.select(*keep, docs["text"].cast("string").alias("_text"))
    return some.mapInArrow(_scored(model, "_text", True), ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in some.schema if f.name != "_text"] + ["raw double"]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    some = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    return some.mapInArrow(_scored(model, "_text", False), "doc_id long, score double")


def flag(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """All rows and columns of ``docs`` with a column ``score_col``, which ``docs`` must not have."""
    if score_col in docs.columns:
        raise ValueError(f"the documents have a column {score_col}; name another score_col")
    names = docs.columns
    # Columns are told apart by place, so no name of the caller's can clash.
    at = names.index(text_col)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    some = docs.toDF(*[f.name for f in fields])
    if docs.schema[at].dataType != T.StringType():
        some = some.withColumn("text", F.col(f"c{at}").cast("string"))
    else:
        some = some.withColumnRenamed(f"c{at}", "text")
        fields[at] = T.StructField("text", T.StringType())
    kept = [f.name for f in fields]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in common.text_slices(batch, "text"):
                out = pa.array([scorer.score(t) for t in part.column("text").to_pylist()], pa.float64())
                yield pa.record_batch([part.column(c) for c in kept] + [out], names=[*kept, "score"])

    return some.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())])).toDF(*names, score_col)
