"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.features import NAMES, Counted, base_counts, statistics
from chronoloom.llm.labelled import SAMPLE, held_out, in_order, labelled_sample

LOG2_WORDS = 14
FACTORS = 8
EPOCHS = 6
BATCH = 64
RATE = 0.08
CHUNK = 256  # documents that are scored at once


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  # one for each feature
    factors: np.ndarray  # FACTORS for each feature
    mean: np.ndarray  # of the dense statistics
    scale: np.ndarray


def hashed_words(words: Counted, log2_words: int = LOG2_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, each once, and values of a text's words; the values' squares sum to 1.

    Words of one number are one feature, so a text has at most 2**log2_words of them, however long it is.
    """
    n = len(words.distinct)
    number = np.fromiter(map(zlib.crc32, words.distinct), np.int64, n) & (2**log2_words - 1)
    at, back = np.unique(number, return_inverse=True)
    return at, np.sqrt(np.bincount(back, words.freq, len(at)) / max(1, len(words.codes)))


def described(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words, their values, and the dense part: statistics, then log n_chars as metadata (0 for null)."""
    base, words = base_counts(text)
    return *hashed_words(words), [*statistics(text, base, words), float(np.log1p(max(0, n_chars or 0)))]


def rows_of(parts: list, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and row starts of some documents; the dense features follow the hashed ones."""
    dense = np.clip((np.array([p[2] for p in parts]) - mean) / scale, -4, 4)
    own = np.arange(dense.shape[1]) + 2**LOG2_WORDS
    at = np.concatenate([x for p in parts for x in (p[0], own)])
    value = np.concatenate([x for p, d in zip(parts, dense) for x in (p[1], d)])
    starts = np.cumsum([0, *(len(p[0]) + len(own) for p in parts[:-1])])
    return at, value, starts


def raw_scores(model: Model, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw scores, the factor sums, and each entry's factors times its value.

    Half of (sum of v x)^2 minus the sum of (v x)^2 is the sum over all pairs, so time is linear in the entries.
    """
    vx = model.factors[at] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat(vx * vx, starts, axis=0)
    linear = np.add.reduceat(model.weights[at] * value, starts)
    return model.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, vx


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(parts: list, labels: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over small batches; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    dense = np.array([p[2] for p in parts]) if parts else np.zeros((0, len(NAMES) + 1))
    n_features = 2**LOG2_WORDS + len(NAMES) + 1
    if not len(dense):
        zero = np.zeros(len(NAMES) + 1)
        return Model(0.0, np.zeros(n_features), np.zeros((n_features, FACTORS)), zero, zero + 1)
    model = Model(0.0, np.zeros(n_features), rng.normal(0, 0.02, (n_features, FACTORS)), dense.mean(0), dense.std(0) + 1e-6)
    bias, bias_g = 0.0, 1e-6
    weight_g, factor_g = np.full(n_features, 1e-6), np.full((n_features, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(parts))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            at, value, starts = rows_of([parts[k] for k in some], model.mean, model.scale)
            raw, sums, vx = raw_scores(model, at, value, starts)
            error = (logistic(raw + bias) - labels[some]) / len(some)
            row = np.repeat(np.arange(len(some)), np.diff([*starts, len(at)]))
            e = error[row] * value
            uniq, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, e) + 1e-6 * model.weights[uniq]
            gv = np.zeros((len(uniq), FACTORS))
            np.add.at(gv, back, e[:, None] * (sums[row] - vx))
            gv += 1e-5 * model.factors[uniq]
            weight_g[uniq] += g * g
            factor_g[uniq] += gv * gv
            model.weights[uniq] -= RATE * g / np.sqrt(weight_g[uniq])
            model.factors[uniq] -= 0.3 * RATE * gv / np.sqrt(factor_g[uniq])
            bias_g += error.sum() ** 2
            bias -= RATE * error.sum() / bias_g**0.5
    return Model(float(bias), model.weights, model.factors, model.mean, model.scale)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fits on at most `most` labelled documents outside the held-out third; features are made in tasks.

    The driver gets at most `most` rows of at most 2**LOG2_WORDS features of 8 bytes.
    """
    sample = labelled_sample(docs, labels, most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, value, dense = described(row["text"], row["n_chars"])
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": row["doc_id"], "at": at.astype(np.int32).tobytes(), "value": value.astype(np.float32).tobytes(), "dense": dense, "label": int(row["quality"])}],
                    schema=out,
                )

    out = pa.schema([("doc_id", pa.int64()), ("at", pa.binary()), ("value", pa.binary()), ("dense", pa.list_(pa.float64())), ("label", pa.int32())])
    rows = in_order(sample).mapInArrow(features, "doc_id long, at binary, value binary, dense array<double>, label int").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["at"], r["value"]))
    parts = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64), r["dense"]) for r in rows]
    return fit(parts, np.array([float(r["label"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text, n_chars).

    Null and empty texts have no words and all statistics 0, and get the score that the model gives to that. A null n_chars
    counts as 0, a missing column as the text's length. A null doc_id is not held out. Rows that repeat are scored each. Other
    columns are not read.
    """
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    wanted = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", n_chars.cast("long").alias("n_chars"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                parts = [described(t, n) for t, n in zip(some.column("text").to_pylist(), some.column("n_chars").to_pylist())]
                value = logistic(raw_scores(model, *rows_of(parts, model.mean, model.scale))[0])
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return wanted.mapInArrow(scored, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose score is at least 0.5, in one pass over them."""
    columns = docs.columns
    n_chars = F.col("n_chars") if "n_chars" in columns else F.length("text")
    length = "_" + max([*columns, "n"], key=len)  # no column has this name
    wanted = docs.withColumn(length, n_chars.cast("long"))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                parts = [described(t, n) for t, n in zip(some.column("text").to_pylist(), some.column(length).to_pylist())]
                raw = raw_scores(model, *rows_of(parts, model.mean, model.scale))[0]
                yield some.filter(pa.array(raw >= 0)).select(columns)

    return wanted.mapInArrow(good, docs.schema)
