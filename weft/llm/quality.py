"""Document quality by Bradley-Terry pairwise ranking.

Each document is a vector of features of its whole text; every feature is cut at the quantiles of the training rows into steps, so
the learned score is a sum of step functions. Pairs of a good and a bad labelled document say which is preferred, and the weights
maximise the Bradley-Terry likelihood, that is, logistic loss on the difference of their features. Documents are then thresholded
by a quantile of the scores: the training rows' score at the share of bad ones becomes THRESHOLD, and scores go through a logistic
curve around it. Labels, language, source and id are never inputs.

All labelled rows and all pairs of theirs count, none are drawn. Features are written once and read again for each step of the fit.
Cuts are exact quantiles, selected digit by digit of the numbers' bits. Weights are whole multiples of GRID, so scores are too, and
sums over all pairs follow from how many rows of each class have each score, by a convolution. Newton's curvature takes scores by
CELLS, which changes its path but not where it ends. The driver holds counts of scores and sums over features, no rows.

Defined cases: a null or empty text has all features 0; without labelled rows of both classes every score is 0.5; rows with equal
ids are rows of their own, but in training one of them counts, that with the least hash of its text, and the largest of an id's labels; labels
other than 0 and 1 and null ids are left out of training; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import entering, forget, is_remainder, sliced, table, written

THRESHOLD = 0.3
STEPS = 12
#: Weights are whole multiples of this.
GRID = 1 / 1024
#: Cells of scores in Newton's curvature; its rounds at most, and the gain in mean loss under which they end.
CELLS, ROUNDS, GAIN = 64, 60, 1e-7
#: Bits of a number that each pass of the quantiles' selection settles.
DIGITS = (12, 9, 9, 9, 9, 8, 8)

MARKS = re.compile(r"[^\w\s]")
RUNS = re.compile(r"[^\w\s]{2,}")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")

NAMES = ("log_chars", "word_length", "upper", "digits", "marks", "mark_runs", "distinct_words", "distinct_lines", "longest_line", "compressed", "words_a_sentence", "capital_words", "long_words", "ends", "odd")


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, k = len(text), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    data = text.encode("utf-8", "surrogatepass")
    sentences = text.count(".") + text.count("!") + text.count("?")
    return [
        math.log1p(n),
        (n - k) / k,
        len(UPPER.findall(text)) / n,
        len(DIGIT.findall(text)) / n,
        len(MARKS.findall(text)) / n,
        len(RUNS.findall(text)) / k,
        len(distinct) / k**0.8,
        len(set(lines)) / len(lines),
        math.log1p(max(map(len, lines))),
        len(zlib.compress(data, 1)) / len(data),
        k / (sentences + 1),
        sum(w.isupper() for w in words) / k,
        sum(len(w) > 20 for w in words) / k,
        sum(w[-1] in ".!?" for w in words) / k,
        sum(c in text for c in "{}<>|\\^~=_") / 10,
    ]


@dataclass
class Model:
    cuts: np.ndarray  # features x STEPS
    weights: np.ndarray  # features * STEPS
    centre: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return steps(x, self.cuts) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.centre) / self.spread + shift, -30, 30)))


def steps(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (x[:, :, None] > cuts[None]).reshape(len(x), -1).astype(float)


def places(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of its feature's cuts each value is over."""
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)


def totals(rows: DataFrame, keys: str, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], kind: str = "long") -> list[np.ndarray]:
    """Columns of keys and sums: work makes them of each batch of rows (x, y), equal keys are summed up in Spark."""
    names = [*keys.split(), "n"]
    types = [pa.int64()] * (len(names) - 1) + [pa.int64() if kind == "long" else pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("quality")
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(work(x, batch.column(1).to_numpy(zero_copy_only=False)), types)], names)

    schema = ", ".join([*[f"{k} long" for k in names[:-1]], f"n {kind}"])
    got = rows.mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n")).toArrow()
    columns = [c.to_numpy() for c in got.columns]
    order = np.lexsort(columns[-2::-1])  # the same order whatever the tasks'
    return [c[order] for c in columns]


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (x + 0.0).view(np.uint64)  # no -0.0
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def numbers(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits).view(np.float64)


def exact_quantiles(rows: DataFrame, n: int, at: np.ndarray) -> np.ndarray:
    """features x len(at), as np.quantile gives them for all n rows (_x, y); each pass settles more bits of the values sought."""
    where = at * (n - 1)
    ranks = np.concatenate([np.floor(where), np.ceil(where)]).astype(np.int64)
    known = np.zeros((len(NAMES), len(ranks)), np.uint64)
    rest = np.tile(ranks, (len(NAMES), 1))  # rank among the values that begin with the known bits
    left = 64
    for size in DIGITS:
        left -= size
        starts = [np.unique(k) for k in known]

        def work(x: np.ndarray, _: np.ndarray, left: int = left, size: int = size, starts: list[np.ndarray] = starts) -> tuple[np.ndarray, ...]:
            out = []
            for f, start in enumerate(starts):
                bits = ordered_bits(np.ascontiguousarray(x[:, f])) >> np.uint64(left)
                bits = bits[np.isin(bits >> np.uint64(size), start)]
                found, count = np.unique(bits, return_counts=True)
                out.append((np.full(len(found), f), found.view(np.int64), count))
            return tuple(np.concatenate(c) for c in zip(*out))

        # 12 bits of a double are sign and exponent; the last pass has all 64, as signed numbers
        feature, bits, count = totals(rows, "f b", work)
        bits = bits.view(np.uint64)
        for f in range(len(NAMES)):
            mine = np.flatnonzero(feature == f)
            mine = mine[np.argsort(bits[mine])]
            b, c = bits[mine], count[mine]
            for k in range(len(ranks)):
                low, high = np.searchsorted(b >> np.uint64(size), known[f, k]), np.searchsorted(b >> np.uint64(size), known[f, k], "right")
                upto = np.cumsum(c[low:high])
                j = int(np.searchsorted(upto, rest[f, k], "right"))
                rest[f, k] -= upto[j - 1] if j else 0
                known[f, k] = b[low + j]
    low, high = np.split(numbers(known), 2, axis=1)
    return low + (high - low) * (where - np.floor(where))


def over(a: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each place i the sum over j of a[j] * kernel(GRID * (i - j)), by Fourier transforms."""
    n = len(a)
    size = 1 << (3 * n).bit_length()
    k = kernel(GRID * np.arange(1 - n, n))
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(k, size), size)[n - 1 : 2 * n - 1]


def logistic(s: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(s / 2)


@dataclass
class Scores:
    """How many rows of each class (0 bad, 1 good) have each score, from `low` on in multiples of GRID."""

    low: int
    counts: np.ndarray  # 2 x scores

    @classmethod
    def of(cls, rows: DataFrame, cuts: np.ndarray, weights: np.ndarray) -> Scores:
        def work(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
            found, count = np.unique(2 * whole_scores(x, cuts, weights) + y, return_counts=True)
            return found & 1, found >> 1, count

        y, s, n = totals(rows, "y s", work)
        counts = np.zeros((2, int(s.max() - s.min()) + 1))
        counts[y, s - s.min()] = n
        return cls(int(s.min()), counts)

    def loss(self) -> float:
        """The mean over all pairs."""
        bad, good = self.counts
        return float(good @ over(bad[::-1], lambda d: np.logaddexp(0, d))[::-1] / bad.sum() / good.sum())

    def pulls(self) -> np.ndarray:
        """2 x scores: a row's derivative of the mean loss by its score."""
        bad, good = self.counts
        return np.stack([over(good, logistic), -over(bad[::-1], logistic)[::-1]]) / bad.sum() / good.sum()

    def quantile(self, q: float, y: int | None = None) -> float:
        """As np.quantile, of class y or of all."""
        upto = np.cumsum(self.counts.sum(0) if y is None else self.counts[y])
        at = q * (upto[-1] - 1)
        a, b = (float(np.searchsorted(upto, k, "right")) for k in (math.floor(at), math.ceil(at)))
        return GRID * (self.low + a + (b - a) * (at - math.floor(at)))


def whole_scores(x: np.ndarray, cuts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of rows in multiples of GRID."""
    of = np.concatenate([np.zeros((len(cuts), 1), np.int64), weights.reshape(cuts.shape).cumsum(1)], 1)
    return sum(t[p] for t, p in zip(of, places(x, cuts).T))


def slopes(rows: DataFrame, cuts: np.ndarray, weights: np.ndarray, scores: Scores) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean loss over all pairs, exact, and its curvature with scores taken by cells."""
    k, pull, low = len(weights), scores.pulls(), scores.low
    n = scores.counts.shape[1]
    width = -(-n // CELLS)
    per_cell = np.add.reduceat(scores.counts, np.arange(0, n, width), axis=1)
    mid = GRID * width * np.arange(per_cell.shape[1])
    p = logistic(mid[:, None] - mid)
    bend = p * (1 - p) / scores.counts[0].sum() / scores.counts[1].sum()  # symmetric
    own = np.stack([bend @ per_cell[1], bend @ per_cell[0]])  # of a row of class y in a cell, over all rows of the other class

    def work(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        z, s = steps(x, cuts), whole_scores(x, cuts, weights) - low
        cell, (upper, right) = s // width, np.triu_indices(k)
        groups, at = np.unique(y * CELLS + cell, return_inverse=True)
        sums = (np.arange(len(groups))[:, None] == at).astype(float) @ z
        square = (z * own[y, cell][:, None]).T @ z
        parts = [(np.zeros(k, int), np.arange(k), pull[y, s] @ z), (np.ones(len(upper), int), upper * k + right, square[upper, right]), (np.full(sums.size, 2), (groups[:, None] * k + np.arange(k)).ravel(), sums.ravel())]
        return tuple(np.concatenate(c) for c in zip(*parts))

    kind, at, value = totals(rows, "kind at", work, "double")
    gradient, square, sums = np.zeros(k), np.zeros(k * k), np.zeros(2 * CELLS * k)
    for number, to in enumerate((gradient, square, sums)):
        to[at[kind == number]] = value[kind == number]
    square = square.reshape(k, k)
    bad, good = sums.reshape(2, CELLS, k)[:, : len(mid)]
    cross = good.T @ bend @ bad
    return gradient, square + np.triu(square, 1).T - cross - cross.T


def fit(rows: DataFrame) -> Model | None:
    """rows: (_x, y) with y 0 or 1, a table that rereads alike."""
    count = dict(rows.groupBy("y").count().collect())
    if not count.get(0) or not count.get(1):
        return None
    n = count[0] + count[1]
    cuts = exact_quantiles(rows, n, np.linspace(0.02, 0.98, STEPS))
    pull = 0.5 / max(10.0, count[0])  # a pair isn't an independent row: as strong as the rarer class's rows
    weights = np.zeros(cuts.size, np.int64)
    cost = lambda scores, w: scores.loss() + pull / 2 * GRID**2 * float(w @ w)
    scores = Scores.of(rows, cuts, weights)
    best = cost(scores, weights)
    for _ in range(ROUNDS):
        gradient, curvature = slopes(rows, cuts, weights, scores)
        gradient += pull * GRID * weights
        step = np.linalg.solve(curvature + pull * np.eye(len(weights)), gradient)
        while gradient @ step / 2 > GAIN:
            tried = weights - np.rint(step / GRID).astype(np.int64)
            scores_there = Scores.of(rows, cuts, tried)
            if (there := cost(scores_there, tried)) < best:
                break
            step = step / 2
        else:
            break
        weights, scores, best = tried, scores_there, there
    # between the classes' medians lies most of the curve
    spread = max(1e-3, abs(scores.quantile(0.5, 1) - scores.quantile(0.5, 0)) / 6)
    return Model(cuts, weights * GRID, scores.quantile(count[0] / n), spread)


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """docs' columns `keep` and the features _x of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("quality")
        for batch in sliced(batches):
            x = pa.array([features(t) for t in batch.column("_text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], x], [*keep, "_x"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep], "_x array<double>"])
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def train(rows: DataFrame) -> Model | None:
    """The model of labelled rows (text, y), all of them."""
    return trained(measured(rows.where("y in (0, 1)").select("text", F.col("y").cast("int")), ["y"]))


def trained(rows: DataFrame) -> Model | None:
    """The model of measured rows (_x, y), which are written, as each step of the fit reads them."""
    kept = written(rows.select("_x", "y"), "quality-rows")
    model = fit(kept)
    forget(kept)
    return model


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(_x, y) of all measured rows (doc_id, h, _x) that have a label, one for each id."""
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("_x", "h").alias("_x")).join(chosen, "doc_id").select("_x", "y")


def with_scores(rows: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """Measured rows' columns with score and predicted added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*columns, "score", "predicted"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns], "score double", "predicted int"])
    return rows.select(*columns, "_x").mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score and predicted added (their columns of these names replaced)."""
    columns = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    return with_scores(measured(docs, columns, text_col), model, columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", is_remainder("doc_id", 5, 0).alias("held_out"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = written(measured(docs, ["doc_id", "held_out", "h"]), "quality-features")
    model = trained(labelled(rows.where("not held_out"), table(spark, sf_dir, "labels")))
    return with_scores(rows, model, ["doc_id", "held_out"])
