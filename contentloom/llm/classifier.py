"""Quality classifier: supervised subword embeddings.

A document is the bag of its words, of the character n-grams of each word (its ends marked) and
of its word pairs. Every feature is hashed to a learned vector; a document is the mean of the
vectors of its features and a softmax over the classes is put on that mean. Vectors and output
layer are trained together by plain stochastic gradient descent in numpy.

Training takes a bounded sample: for each class the ``per_class`` documents with the smallest
hash of their id, among those of at most ``max_chars`` code points. Everything else reads all
rows and whole texts.

As the layers after the vectors are linear, the difference of the two outputs is a mean of one
number for each feature. Scoring uses these numbers, a table of fixed size that is sent to every
task, and adds them up over stretches of the text.

Defined cases: a null text is the empty one, and an empty text has no features, so its score is
that of the bias alone. Rows are scored one by one: repeated rows get equal scores, a null id
is passed through. Ids with labels that contradict each other, and null labels, are not learned
from. Without two classes to learn from, every score is the share of label 1 (0.5 without any
label).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentloom.llm.texts import in_batches, narrow

BUCKETS = 1 << 18
#: Code points looked at at once, more if a word is longer.
STRETCH = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return (mixed >> np.uint64(46)).astype(np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def _stretch_features(points: np.ndarray, seen_first: bool) -> np.ndarray:
    """Buckets of a stretch of whole words. If its first word was the last of the stretch before,
    only its pair with the next word counts."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    padded = np.concatenate([[0], np.where(space, 0, points), [0]]).astype(np.uint64)
    # One mark between words.
    x = padded[np.append(True, (padded[1:] != 0) | (padded[:-1] != 0))]
    if len(x) > 1 and x[-1] == 0 and x[-2] == 0:
        x = x[:-1]
    marks = np.flatnonzero(x == 0)
    if len(marks) < 2:
        return np.zeros(0, np.int64)
    run = np.cumsum(x * _powers(_BASE, len(x)))
    words = (run[marks[1:]] - run[marks[:-1]]) * _powers(_BACK, len(x))[marks[:-1]]
    first = 1 if seen_first else 0
    inner = x != 0
    start = marks[first]
    y, inside = x[start:], inner[start:]
    threes = ((y[:-2] * _BASE + y[1:-1]) * _BASE + y[2:])[inside[1:-1]]
    fours = (((y[:-3] * _BASE + y[1:-2]) * _BASE + y[2:-1]) * _BASE + y[3:])[inside[1:-2] & inside[2:-1]]
    pairs = (words[:-1] * _BASE + words[1:]) * _BASE
    # A word that follows itself is one and the same pair for all words.
    pairs[words[:-1] == words[1:]] = 1
    return _bucket(np.concatenate([words[first:], threes, fours, pairs]))


def features(text: str):
    """Buckets of a text's features, a stretch of the text at a time."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) <= STRETCH:
        yield _stretch_features(points, False)
        return
    space = (points == 32) | ((points >= 9) & (points <= 13))
    starts = np.append(np.flatnonzero(~space & np.append(True, space[:-1])), len(points))
    at = 0
    while at < len(starts) - 1:
        # Up to a word's start; the next stretch repeats the last word, for its pair.
        to = min(max(int(np.searchsorted(starts, starts[at] + STRETCH)), at + 2), len(starts) - 1)
        yield _stretch_features(points[starts[at] : starts[to]], at > 0)
        at = to if to == len(starts) - 1 else to - 1


@dataclass
class Model:
    """One number for each feature and the bias, as differences of the outputs of class 1 and 0."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        """Probability of class 1."""
        total, n = 0.0, 0
        for found in features(text):
            total, n = total + float(self.weights[found].sum()), n + len(found)
        return float(1 / (1 + np.exp(-(total / max(n, 1) + self.bias))))


def train(
    texts: list[str], labels: list[int], dims: int = 16, passes: int = 5, least_steps: int = 6000, rate: float = 1.0, seed: int = 7
) -> Model:
    """Learn vectors and output layer by stochastic gradient descent, one document a step, in
    ``passes`` over the sample and ``least_steps`` steps at least."""
    if len(set(labels)) < 2:
        share = min(max(sum(labels) / len(labels), 0.01), 0.99) if labels else 0.5
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    docs = []
    for text in texts:
        ids, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *features(text)]), return_counts=True)
        docs.append((ids, (counts / max(counts.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    out, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    passes = max(passes, -(-least_steps // len(docs)))
    step, steps = 0, passes * len(docs)
    for _ in range(passes):
        for at in rng.permutation(len(docs)):
            ids, share = docs[at]
            mean = share @ vectors[ids]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[at]] -= 1  # the gradient of the logits
            now = rate * (1 - step / steps)
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            # A feature's share falls with the number of features; the step makes up for half of it.
            vectors[ids] -= now * np.sqrt(len(ids)) * np.outer(share, back)
            step += 1
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int
) -> tuple[list[str], list[int]]:
    """At most ``per_class`` labelled documents of each class, none of them held out."""
    by_id = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("low"), F.max(label).cast("int").alias("high"))
        .where("low = high")
        .select("doc_id", F.col("low").alias("label"), F.xxhash64("doc_id").alias("draw"))
    )
    short = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    # Bounded before any text moves: a third of all rows may share one id, so one text of each.
    chosen = [by_id.where(F.col("label") == c).orderBy("draw", "doc_id").limit(per_class) for c in (0, 1)]
    rows = (
        short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
        .groupBy("doc_id", "label", "draw")
        .agg(F.min("text").alias("text"))
        .orderBy("draw", "doc_id")
        .collect()
    )
    return [r.text for r in rows], [r.label for r in rows]


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, max_chars: int = 20_000, **options
) -> Model:
    return train(*training_sample(docs, labels, label, per_class, max_chars), **options)


def score(
    spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``score`` of every row, from its whole text."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        model = shared.value
        for batch in batches:
            for part in in_batches(batch, 1):
                values = pa.array([model.score(text) for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=["id", "score"])

    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(scored, f"id {dict(rows.dtypes)['id']}, score double")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns. Rows are judged one
    by one, so nothing is joined or shuffled."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([model.score(t or "") >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
