"""Document quality by ordinal cumulative-link regression on graded ratings.

A rating has ordered grades 0 .. K-1. All grades share one weight for each hashed text feature; ordered thresholds cut
the score: P(grade > k) = sigmoid(score - threshold_k). That gives an expected grade and tail probabilities, and a
document is kept if the probability of at least `select_grade` reaches `select_probability`.

Features are hashed to 32 bits: the distinct lower-cased words without outer punctuation, and stepwise codes of rates
over the whole text (symbols, capitals, repeated neighbours, distinct words, lengths). Features in fewer than
`MIN_DOCS` training documents have no weight, so the rare words of very long texts add nothing.

The model is fitted on at most TRAIN_ROWS labelled documents, those with the smallest hashed ids; every document is
scored whole. Nulls and odd rows: a null or empty text has the rate codes of no words; null ids are scored but not
trained on; a label with a null or out of range grade is left out; an id rated twice counts with its smallest grade;
different texts under one id are trained on each, equal ones once;
without any labels, or with one grade only, every document gets that grade (no labels: the top one) and is judged by
it; repeated rows are scored alike; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, table

#: The documented bound of the training sample.
TRAIN_ROWS = 12_000
MIN_DOCS = 15
GRADES = 3

#: Outer punctuation, and the symbols that the symbol rate counts.
OUTER = ".,;:!?\"'()[]|#$%&*<>"
SYMBOLS = "#*$%&|<>"
#: Steps of the rate codes: a rate sets the code of every step that it reaches.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)


def features_of(text: str) -> set[int]:
    """The hashed features of a text."""
    whole = text.split()
    words = text.lower().split()
    n = len(words)
    distinct = set(words)
    found = {w.strip(OUTER) for w in distinct}
    found.discard("")
    some = max(n, 1)
    rates = {
        "symbols": sum(map(text.count, SYMBOLS)) / some,
        "shouts": text.count("!!") / some,
        "capitals": sum(map(str.isupper, whole)) / some,
        "bars": words.count("|") / some,
        "echoes": sum(map(eq, words, islice(words, 1, None))) / some,
        "sameness": 1 - len(distinct) / some,
    }
    codes = [f"~{name}~{step}" for name, rate in rates.items() for step in STEPS if rate >= step]
    codes += [f"~length~{k}" for k in range(1, n.bit_length() + 1)]
    codes.append(f"~wide~{min(len(text) // some, 20)}")
    return set(map(crc32, map(str.encode, found))) | set(map(crc32, map(str.encode, codes)))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: dict[int, float]
    thresholds: list[float]

    def score(self, text: str) -> float:
        get = self.weights.get
        return sum(w for w in map(get, features_of(text)) if w is not None)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= K-1) in columns."""
        return sigmoid(np.asarray(score)[:, None] - np.asarray(self.thresholds)[None, :])


@dataclass
class Design:
    """Training rows as one flat list of feature positions, and their grades."""

    index: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    grades: np.ndarray
    width: int
    cuts: int

    @classmethod
    def of(cls, rows: list[np.ndarray], grades: np.ndarray, width: int, grade_count: int) -> Design:
        """`rows` hold positions below `width`, at least one each."""
        lengths = np.array([len(r) for r in rows])
        return cls(np.concatenate(rows), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths, np.asarray(grades), width, grade_count - 1)

    def likelihood(self, params: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood with the ridge penalty, and its gradient.

        params: the weights, the first threshold, and the logarithms of the steps to the next ones, which keep them ordered.
        """
        y, cuts, n = self.grades, self.cuts, len(self.grades)
        w, free = params[: self.width], params[self.width :]
        gaps = np.exp(free[1:])
        theta = np.concatenate([[free[0]], free[0] + np.cumsum(gaps)])
        eta = np.add.reduceat(w[self.index], self.starts)
        lower, upper = y > 0, y < cuts
        above = np.where(lower, sigmoid(eta - theta[np.maximum(y - 1, 0)]), 1.0)
        over = np.where(upper, sigmoid(eta - theta[np.minimum(y, cuts - 1)]), 0.0)
        p = np.maximum(above - over, 1e-12)
        d_above, d_over = above * (1 - above) / p, over * (1 - over) / p
        slope = -(d_above - d_over) / n
        grad = np.zeros_like(params)
        grad[: self.width] = np.bincount(self.index, weights=np.repeat(slope, self.lengths), minlength=self.width) + ridge * w
        by_cut = np.zeros(cuts)
        np.add.at(by_cut, (y - 1)[lower], d_above[lower] / n)
        np.add.at(by_cut, y[upper], -d_over[upper] / n)
        grad[self.width] = by_cut.sum()
        grad[self.width + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        return float(-np.log(p).mean() + ridge / 2 * (w @ w)), grad


def fit_ordinal(rows: list[np.ndarray], grades: list[int], grade_count: int = GRADES, min_docs: int = MIN_DOCS, ridge: float = 1e-4, lasso: float = 1.5e-3, rounds: int = 300, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with ridge and lasso penalties, by full-batch proximal Adam. The lasso leaves most words without weight."""
    cuts = grade_count - 1
    if len(set(grades)) < 2:
        top = grades[0] if grades else cuts
        return OrdinalModel({}, [-20.0 if k < top else 20.0 for k in range(cuts)])
    flat = np.concatenate([np.asarray(r, np.uint32) for r in rows])
    sizes = np.array([len(r) for r in rows])
    found, seen = np.unique(flat, return_counts=True)
    kept = found[seen >= min_docs]
    at = np.searchsorted(kept, flat).astype(np.int32)
    known = kept[np.minimum(at, len(kept) - 1)] == flat if len(kept) else np.zeros(len(flat), bool)
    del flat, found, seen
    held = np.add.reduceat(np.append(known, False), np.cumsum(sizes) - sizes, dtype=np.int64) * (sizes > 0)
    # a constant stands at the end of each row, so that none is empty
    lengths = held + 1
    index = np.full(lengths.sum(), len(kept), np.int32)
    free = np.ones(len(index), bool)
    free[np.cumsum(lengths) - 1] = False
    index[free] = at[known]
    design = Design(index, np.cumsum(lengths) - lengths, lengths, np.asarray(grades), len(kept) + 1, cuts)
    width = design.width
    share = np.clip([(design.grades > k).mean() for k in range(cuts)], 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    params = np.zeros(width + cuts)
    params[width] = first[0]
    params[width + 1 :] = np.log(np.maximum(np.diff(first), 1e-2))
    moment, spread = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        _, grad = design.likelihood(params, ridge)
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.999 * spread + 0.001 * grad * grad
        step = rate * min(1.0, 2 * (1 - t / (rounds + 1))) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
        params -= step * moment / (1 - 0.9**t)
        words = slice(0, width - 1)
        params[words] = np.sign(params[words]) * np.maximum(np.abs(params[words]) - step[words] * lasso, 0)
    w, free = params[:width], params[width:]
    theta = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))]) - w[-1]
    return OrdinalModel({int(f): float(x) for f, x in zip(kept, w) if x}, theta.tolist())


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating: 0 low quality, 1 good but toxic, 2 good and not toxic."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def training_rows(docs: DataFrame, rated: DataFrame, grade_count: int, max_rows: int) -> tuple[list[int], list[np.ndarray]]:
    """Grades and features of at most `max_rows` rated documents, in one order on every run.

    A document is an id with a text (told by its hash), so different texts under one id each count once.
    """
    one = rated.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grade_count - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    named = docs.select("doc_id", F.xxhash64("text").alias("content")).distinct().join(one, "doc_id")
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id", "content").limit(max_rows)
    texts = docs.select("doc_id", F.xxhash64("text").alias("content"), "text").join(F.broadcast(sample), ["doc_id", "content"])  # at most max_rows keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2):
            found = [np.fromiter(features_of(t.as_py() or ""), np.uint32) for t in batch.column(2)]
            for own in found:
                own.sort()
            ends = np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), lists], ["doc_id", "content", "grade", "features"])

    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "content", "text", F.col("grade").cast("int").alias("grade"))
    featured = texts.mapInArrow(run, "doc_id long, content long, grade int, features array<int>").dropDuplicates(["doc_id", "content"])
    rows: list[tuple[int, int, int, np.ndarray]] = []
    for batch in featured.toArrow().to_batches():  # at most max_rows rows, some hundred numbers each
        lists = batch.column(3)
        flat, ends = lists.values.to_numpy().view(np.uint32), lists.offsets.to_numpy()
        rows += [(*x, flat[ends[k] : ends[k + 1]]) for k, x in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3))))]
    rows.sort(key=lambda x: x[:2])
    return [x[2] for x in rows], [x[3] for x in rows]


def train(docs: DataFrame, rated: DataFrame, grade_count: int = GRADES, max_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on the whole texts of at most `max_rows` rated documents; `rated` has (doc_id, grade)."""
    grades, features = training_rows(docs, rated, grade_count, max_rows)
    return fit_ordinal(features, grades, grade_count)


#: A document is kept if it has the top grade with at least this probability.
SELECT_PROBABILITY = 0.65


def _tails(spread, texts: pa.Array) -> np.ndarray:
    """Tail probabilities of texts by a broadcast model."""
    return spread.value.tails(np.array([spread.value.score(t.as_py() or "") for t in texts], float))


def score_documents(docs: DataFrame, model: OrdinalModel, select_grade: int = GRADES - 1, select_probability: float = SELECT_PROBABILITY) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, ..., kept for every document."""
    cuts = len(model.thresholds)
    spread = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    names = [f"p_at_least_{k}" for k in range(1, cuts + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            tails = _tails(spread, batch.column(1))
            columns = [batch.column(0), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, k]) for k in range(cuts)), pa.array(tails[:, select_grade - 1] >= select_probability)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", *names, "kept"])

    shape = "doc_id long, expected_grade double, " + "".join(f"{n} double, " for n in names) + "kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def select_documents(docs: DataFrame, model: OrdinalModel, select_grade: int = GRADES - 1, select_probability: float = SELECT_PROBABILITY) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, at):
            yield batch.filter(pa.array(_tails(spread, batch.column(at))[:, select_grade - 1] >= select_probability))

    return docs.mapInArrow(run, docs.schema)


def rated_documents(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, rated_documents(table(spark, sf_dir, "labels"))))
