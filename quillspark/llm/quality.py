"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled class is web text of any quality.  A small
network on features of the whole text minimises the non-negative unbiased risk

    pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)]),      l(z) = log(1 + exp(-z)),

where pi is the class prior, estimated as the share of label 1 among labelled training rows.  When the
second term falls below zero its gradient is reversed, which undoes overfitting to the positives.

The features are shapes (shares of kinds of characters, repetition, word lengths) and the words themselves: each
one-word and two-word gram of the text adds 1 or -1, by its hash, to one of NGRAM_FEATURES places, and the row is scaled to length 1.

Fitting takes bounded samples (POSITIVES and UNLABELLED doc_ids, those with the smallest hash; of rows with equal doc_ids one stands for all);
scoring goes over every whole text.  Labels come only from rows whose crc32(doc_id as text) mod 5 isn't 0.
Labels, lang, source and doc_id are never inputs of a score.

Edge cases: null and empty texts are scored like any other, by features that are all zero; repeated
label rows count once (the smallest label); without usable labels every score is 0.5; an empty table
gives no rows; a null doc_id has a null held_out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import BYTE_VALUES, NOT_SPACE, Words, slices

#: Rows that fitting takes at most.
POSITIVES, UNLABELLED = 10_000, 20_000
FOLDS, THRESHOLD = 5, 0.3
HIDDEN, STEPS, RATE, SEED = 24, 400, 0.02, 7

_CLASSES = [b"#*$%&<>", b"|", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"\n"]
N_SHAPES, NGRAM_FEATURES = 20, 128
N_FEATURES = N_SHAPES + NGRAM_FEATURES
#: Standardised n-gram places count this much beside a shape, since each tells little.
NGRAM_SCALE = 0.25


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for k, chars in enumerate(_CLASSES):
        table[list(chars)] = k
    return table


_CLASS_OF = _class_table()


def ngram_features(words: Words) -> np.ndarray:
    """A row of NGRAM_FEATURES of length 1 for each text, or zeros without words: its one- and two-word grams, letters A-Z lowered, in signed places by hash."""
    n = len(words.bounds) - 1
    single = words.hashes()
    double, bounds = words.shingles(single, 2)
    out = np.zeros(n * NGRAM_FEATURES)
    for grams, text in ((single, words.text_of()), (double, np.repeat(np.arange(n), np.diff(bounds)))):
        place = text * NGRAM_FEATURES + (grams >> np.uint64(33)).astype(np.int64) % NGRAM_FEATURES
        out += np.bincount(place, 1.0 - 2.0 * (grams & np.uint64(1)), n * NGRAM_FEATURES)
    out = out.reshape(n, NGRAM_FEATURES)
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each text: shares of character classes, repetition, word lengths, then its n-grams."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = _CLASS_OF[data]
    counts = np.zeros((n, len(_CLASSES)))
    for k in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        counts[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    words = Words(data, offsets, NOT_SPACE)
    hashes, text, per = words.hashes(BYTE_VALUES), words.text_of(), words.counts().astype(float)
    again = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n) if len(words) else np.zeros(n)
    keys = np.sort((text.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=n) if len(words) else np.zeros(n)
    length = (words.ends - words.starts).astype(float)
    total, squares = (np.bincount(text, x, n) if len(words) else np.zeros(n) for x in (length, length**2))
    some, letters = np.maximum(per, 1), np.maximum(counts[:, 3] + counts[:, 4], 1)
    shares = np.stack([counts[:, 0] / np.maximum(size, 1), counts[:, 1] / some, counts[:, 2] / some, counts[:, 3] / letters, counts[:, 5] / np.maximum(size, 1), counts[:, 6] / some, counts[:, 7] / some, again / some], 1)
    mean = total / some
    rest = np.stack([np.log1p(per), mean, np.sqrt(np.maximum(squares / some - mean**2, 0)), np.where(per > 0, np.log(np.maximum(distinct, 1) / some), 0)], 1)
    return np.concatenate([shares, np.sqrt(shares), rest, ngram_features(words)], 1)


class Network:
    """One hidden layer of rectified units; ``score`` is in 0 to 1."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    @staticmethod
    def constant() -> Network:
        return Network(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(1)])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        h = np.maximum(x @ a + b, 0)
        return h @ c + d[0], h

    def score(self, x: np.ndarray) -> np.ndarray:
        z, _ = self.forward(np.clip((x - self.mean) / self.scale, -8, 8))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the outputs z, of which those marked positive are trusted and others unlabelled, and the
    direction to descend: its gradient, or that of minus the second part where this is below zero."""
    n_p, n_u = positive.sum(), (~positive).sum()
    sig = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    minus = np.logaddexp(0, z)  # l(-z)
    wrong = minus[~positive].mean() - prior * minus[positive].mean()
    as_positive = np.where(positive, prior * (sig - 1) / n_p, 0)
    as_negative = np.where(positive, -prior * sig / n_p, sig / n_u)
    return prior * np.logaddexp(0, -z)[positive].mean() + max(0.0, wrong), as_positive + as_negative if wrong >= 0 else -as_negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimise the non-negative risk by Adam on whole samples; deterministic."""
    if not len(positive) or not len(unlabelled):
        return Network.constant()
    both = np.concatenate([positive, unlabelled])
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    scale[N_SHAPES:] /= NGRAM_SCALE
    x = np.clip((both - mean) / scale, -8, 8)
    p = np.arange(len(both)) < len(positive)
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    net = Network(mean, scale, [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)])
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    for step in range(1, STEPS + 1):
        z, h = net.forward(x)
        _, g = risk(z, p, prior)
        a, _, c, _ = net.weights
        gh = np.outer(g, c) * (h > 0)
        grads = [x.T @ gh + 1e-4 * a, gh.sum(0), h.T @ g + 1e-4 * c, np.array([g.sum()])]
        rate = RATE * (1 - step / (STEPS + 1))
        for w, gr, (m, v) in zip(net.weights, grads, moments, strict=True):
            m += 0.1 * (gr - m)
            v += 0.001 * (gr**2 - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on bounded samples: only their doc_ids are broadcast, and only their features reach the driver."""
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.filter("label_id is not null and quality is not null").filter(fold("label_id") != 0).groupBy("label_id").agg(F.min("quality").alias("quality"))
    share = usable.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    if not share:
        return Network.constant()
    positives = usable.filter("quality = 1").orderBy(F.xxhash64("label_id"), "label_id").limit(POSITIVES).select("label_id", F.lit(True).alias("positive"))
    rows = _text_rows(docs)
    unlabelled = rows.select(F.col("doc_id").alias("label_id")).filter("label_id is not null").filter(fold("label_id") != 0).distinct().orderBy(F.xxhash64("label_id", F.lit(1)), "label_id").limit(UNLABELLED).select("label_id", F.lit(False).alias("positive"))
    sample = rows.join(F.broadcast(positives.union(unlabelled)), F.col("doc_id") == F.col("label_id")).select("doc_id", "positive", "text")

    def run(batches):
        for b in batches:
            for first, end, data, offsets in slices(b.column(2)):
                x = features(data, offsets).astype("<f4")
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, end - first) for c in (0, 1)), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "positive", "x"])

    got = sample.mapInArrow(run, "doc_id long, positive boolean, x binary").groupBy("doc_id", "positive").agg(F.min("x").alias("x")).collect()  # POSITIVES + UNLABELLED rows at most
    got.sort(key=lambda r: (r.positive, r.x))
    side = [np.array([np.frombuffer(r.x, "<f4") for r in got if r.positive is k], float).reshape(-1, N_FEATURES) for k in (True, False)]
    return fit(*side, float(share))


def scored(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches):
        for b in batches:
            for first, end, data, offsets in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(model.score(features(data, offsets)))], ["doc_id", "score"])

    got = _text_rows(docs).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, all columns kept, in one pass over them."""
    model, columns, place = train(docs, labels), docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            for first, end, data, offsets in slices(b.column(place)):
                keep = pa.array(model.score(features(data, offsets)) >= THRESHOLD)
                yield b.slice(first, end - first).filter(keep)

    return docs.select(*columns).mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
