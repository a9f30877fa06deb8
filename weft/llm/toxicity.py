"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read into classes: insult, threat, target, negation, reported speech, plain. Small weighted transducers read a clause's
classes and are composed: insult and threat weigh a hit, target raises one that is aimed at somebody, negation and reported speech
before it lower it. A clause's score is the weight of its best path, so a text is scored by its matched clauses rather than by
isolated words. Clauses without an insult or threat are accepted by no path and cost nothing.

What counts as an insult beyond the seed words is learned from labelled rows: words and word beginnings whose share of toxic texts
is far above chance (log-likelihood ratio). An arc says which events it stands for (a hit, one more, a threat, aimed, denied, told);
the events' weights, and the clause scores' weights in a text's score, are fitted by logistic regression, from prior weights. At most
SAMPLE_ROWS labelled rows are used; labels, language, source and id are never inputs of a score.

Defined cases: a text of any length is scored whole; a null or empty text has no clause and gets the score of a text without a match; without labelled rows of both
classes the seed words and prior weights stand; rows with equal ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import SAMPLE_ROWS, entering, forget, is_remainder, labelled, sliced, table, written

THRESHOLD = 0.7
#: Beginnings of words that can be learned, in characters; learned terms at most; toxic texts that must hold one.
PREFIXES = (4, 5, 6)
TERMS = 2_000
LEAST_TEXTS = 3

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:,\n]+")

PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {
    INSULT: "idiot idiots moron morons scum stupid pathetic loser losers worthless trash disgusting imbecile dumbass bastard",
    THREAT: "kill hurt destroy murder strangle stab shoot beat",
    TARGET: "you your yours you're he she him her they them their these those people tu vous du sie ihr ellos ustedes",
    NEGATION: "not no never isn aren wasn don doesn didn without neither nor nicht kein keine nie pas jamais ne nunca",
    REPORT: "said says wrote writes called calls quoted reported claims claimed asked according sagte dit dijo",
}


#: What arcs stand for, with their weights before labels. A learned weight keeps its sign.
EVENTS = {"hit": 1.0, "again": 0.5, "threat": 0.6, "aimed": 0.3, "denied hit": -0.4, "denied threat": -0.6, "told hit": -0.4, "told threat": -0.4}
HIT, AGAIN, THREATENS, AIMED, DENIED_HIT, DENIED_THREAT, TOLD_HIT, TOLD_THREAT = range(len(EVENTS))
ARC_PRIOR = np.array(list(EVENTS.values()))


@dataclass
class Transducer:
    """arcs: (state, class) -> [(state, events)]; a class without arcs at a state is read without an event and without a move."""

    arcs: dict[tuple[int, int], list[tuple[int, tuple[int, ...]]]]
    final: set[int]

    def step(self, state: int, kind: int) -> list[tuple[int, tuple[int, ...]]]:
        return self.arcs.get((state, kind), [(state, ())])

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes side by side; events add up, states pair."""
        ids: dict[tuple[int, int], int] = {(0, 0): 0}
        arcs: dict[tuple[int, int], list[tuple[int, tuple[int, ...]]]] = {}
        todo = [(0, 0)]
        while todo:
            pair = todo.pop()
            for kind in range(6):
                out = []
                for a, x in self.step(pair[0], kind):
                    for b, y in other.step(pair[1], kind):
                        if (a, b) not in ids:
                            ids[a, b] = len(ids)
                            todo.append((a, b))
                        out.append((ids[a, b], x + y))
                arcs[ids[pair], kind] = out
        return Transducer(arcs, {i for (a, b), i in ids.items() if a in self.final and b in other.final})

    def best(self, kinds: list[int], weights: np.ndarray = ARC_PRIOR) -> tuple[float, list[int]] | None:
        """The weight and the events of the best accepted path, None if there is none."""
        paths: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for kind in kinds:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for state, (weight, events) in paths.items():
                for to, more in self.step(state, kind):
                    w = weight + sum(weights[e] for e in more)
                    if to not in nxt or w > nxt[to][0]:
                        nxt[to] = (w, events + list(more))
            paths = nxt
        return max((x for s, x in paths.items() if s in self.final), key=lambda x: x[0], default=None)


def grammar() -> Transducer:
    hit = Transducer({(0, INSULT): [(1, (HIT,))], (1, INSULT): [(1, (AGAIN,))], (0, THREAT): [(0, ()), (1, (THREATENS,))]}, {1})
    aimed = Transducer({(0, TARGET): [(1, ())], (1, INSULT): [(2, (AIMED,))], (1, THREAT): [(2, (AIMED,))], (0, INSULT): [(3, ())], (3, TARGET): [(2, (AIMED,))]}, {0, 1, 2, 3})
    denied = Transducer({(0, NEGATION): [(1, ())], (1, INSULT): [(0, (DENIED_HIT,))], (1, THREAT): [(0, (DENIED_THREAT,))]}, {0, 1})
    told = Transducer({(0, REPORT): [(1, ())], (1, INSULT): [(0, (TOLD_HIT,))], (1, THREAT): [(0, (TOLD_THREAT,))]}, {0, 1})
    return hit.compose(aimed).compose(denied).compose(told)


@dataclass
class Lexicon:
    words: dict[str, int]
    starts: dict[str, int] = field(default_factory=dict)

    def kind(self, word: str) -> int:
        k = self.words.get(word)
        if k is None:
            for n in PREFIXES:
                if (k := self.starts.get(word[:n])) is not None:
                    return k
        return k or PLAIN


def seeds() -> Lexicon:
    return Lexicon({w: k for k, ws in SEEDS.items() for w in ws.split()})


FEATURES = 5


class Matcher:
    def __init__(self, lexicon: Lexicon, arcs: np.ndarray = ARC_PRIOR) -> None:
        self.lexicon, self.arcs, self.grammar, self.known = lexicon, arcs, grammar(), {}
        self.hits = {w for w, k in lexicon.words.items() if k in (INSULT, THREAT)}
        self.short = {s[: PREFIXES[0]] for s in lexicon.starts}

    def matched(self, text: str | None) -> tuple[list[tuple[float, list[int]]], int]:
        """(weight, events) of each clause with an insult or a threat that the grammar accepts, and the number of clauses."""
        low = (text or "").lower()
        words = set(WORD.findall(low))
        # a word that begins like a learned one, or is a seed; else no clause can match
        found = words & self.hits
        found.update(w for w in words if w[: PREFIXES[0]] in self.short and self.lexicon.kind(w) == INSULT)
        if not found:
            return [], 1
        hits, clauses = [], CLAUSE.split(low)
        for clause in clauses:
            kinds = [self.lexicon.kind(w) for w in WORD.findall(clause)]
            if INSULT in kinds or THREAT in kinds:
                key = bytes(k for k in kinds if k)  # plain words move no transducer
                if key not in self.known:
                    self.known[key] = self.grammar.best(list(key), self.arcs)
                if self.known[key] is not None:
                    hits.append(self.known[key])
        if len(self.known) > 100_000:
            self.known = {}
        return hits, len(clauses)

    def features(self, text: str | None) -> list[float]:
        """Of the matched clauses: whether there are any, log of the summed and of the best score, their share, and log of their number."""
        hits, clauses = self.matched(text)
        scores = [w for w, _ in hits if w > 0]
        if not scores:
            return [0.0] * FEATURES
        return [1.0, math.log1p(sum(scores)), math.log1p(max(scores)), len(scores) / clauses, math.log1p(len(scores))]

    def events(self, text: str | None) -> list[float]:
        """How often each event stands on the matched clauses' best paths, as logs."""
        counts = np.bincount([e for _, events in self.matched(text)[0] for e in events], minlength=len(EVENTS))
        return np.log1p(counts).tolist()


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the features, then the constant
    arcs: np.ndarray = field(default_factory=ARC_PRIOR.copy)


#: Before labels: no match scores 0.02, one clear clause 0.8.
PRIOR = np.array([3.5, 1.5, 1.2, 0.5, 0.0, -4.0])


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method; weights are pulled to `start`."""
    w = start.copy()
    x = np.column_stack([x, np.ones(len(x))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - start)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learned_terms(sample: DataFrame) -> dict[str, set[str]]:
    """Words and beginnings of words that mark toxic texts: {"word": .., "start": ..}."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall((text or "").lower()))
                (toxic if y else clean).update({f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in PREFIXES if len(w) >= n})
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "a", "b"])

    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {"word": set(), "start": set()}
    counts = sample.select("text", "y").mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST_TEXTS)
    p = n1 / (n1 + n0)
    n = F.col("a") + F.col("b")
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    # beginnings stand for several words, so weaker evidence does
    counts = counts.withColumn("g", 2 * (part(F.col("a"), p) + part(F.col("b"), 1 - p))).where((F.col("a") / n > 0.8) & (F.col("g") > F.when(F.col("term").startswith("w"), 20).otherwise(16)))
    rows = counts.orderBy(F.desc("g"), "term").limit(TERMS).collect()  # bounded by TERMS
    out: dict[str, set[str]] = {"word": set(), "start": set()}
    for r in rows:
        out["word" if r.term[0] == "w" else "start"].add(r.term[1:])
    return out


def train(sample: DataFrame) -> Model:
    """sample: (text, y), bounded; read twice."""
    lexicon = seeds()
    terms = learned_terms(sample)
    lexicon.words.update({w: INSULT for w in terms["word"]})
    lexicon.starts.update({s: INSULT for s in terms["start"]})

    def read(arcs: np.ndarray, what: str) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = getattr(Matcher(lexicon, arcs), what)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([of(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

        rows = sample.select("text", "y").mapInArrow(run, "x array<double>, y int").collect()  # bounded by the sample's rows
        rows.sort(key=lambda r: (r.y, r.x))  # the same order whatever the tasks'
        return np.array([r.x for r in rows]), np.array([r.y for r in rows], float)

    x, y = read(ARC_PRIOR, "events")
    if not 0 < y.sum() < len(y):
        return Model(lexicon, PRIOR)
    arcs = arc_weights(x, y)
    return Model(lexicon, logistic(*read(arcs, "features"), PRIOR), arcs)


def arc_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The events' weights by logistic regression, on the scale of a hit; those that change sign are none."""
    w = logistic(x, y, np.append(4 * ARC_PRIOR, -4.0), 4.0)[:-1]
    if w[HIT] <= 0:
        return ARC_PRIOR.copy()
    w = w / w[HIT]
    return np.where(np.sign(w) == np.sign(ARC_PRIOR), np.clip(w, -1.0, 1.0), 0.0)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score and predicted added (their columns of these names replaced)."""
    columns = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("toxicity")
        m = shared.value
        matcher = Matcher(m.lexicon, m.arcs)
        for batch in sliced(batches):
            x = np.array([matcher.features(t) for t in batch.column("_text").to_pylist()], float).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*columns, "score", "predicted"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns], "score double", "predicted int"])
    return docs.select(*columns, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("toxicity")
        m = shared.value
        matcher = Matcher(m.lexicon, m.arcs)
        for batch in sliced(batches):
            x = np.array([matcher.features(t) for t in batch.column(text_col).to_pylist()], float).reshape(-1, FEATURES)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def trained(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS) -> Model:
    """The model of a folder's labelled documents, without those held out."""
    sample = written(labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", ~is_remainder("doc_id", 3, 1), rows), "toxic-sample")
    model = train(sample)
    forget(sample)
    return model


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", is_remainder("doc_id", 3, 1).alias("held_out"))
    return scored(docs, trained(spark, sf_dir), keep=["doc_id", "held_out"])
