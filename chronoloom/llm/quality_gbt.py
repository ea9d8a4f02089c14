"""Quality rules: gradient-boosted trees over document statistics, as flat arrays, some features monotonic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.features import NAMES, base_counts, statistics
from chronoloom.llm.labelled import SAMPLE, in_order, labelled_sample

# The score may only fall as these rise.
FALLING = ("symbol_share", "mark_share", "upper_share", "dup_line_share", "repeat_share", "longest_run_share")
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 60, 4, 32, 0.2, 1.0, 10
LEAST_WORDS, MOST_REPEATED = 20, 30  # fixed values: the base rules' limits
CHUNK = 512


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees: a row goes left where its feature is <= threshold; leaves point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float


def fit(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = ()) -> Trees:
    """Boosts the logistic loss with histogram trees; features in `falling` get scores that never rise with them.

    A split on such a feature is allowed only if the left leaf value is at least the right one, and the values below it are
    bounded by their middle on both sides.
    """
    n, width = x.shape if x.size else (0, len(NAMES))
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)] if n else []
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else None
    raw = np.full(n, base)
    for _ in range(TREES if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        open_ = [(len(nodes) - 1, np.arange(n), -np.inf, np.inf, 0)]
        while open_:
            node, rows, low, high, depth = open_.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value = float(np.clip(-g / (h + RIDGE), low, high))
            nodes[node][4] = value * RATE
            raw_rows = rows
            best = (1e-6, -1, -1, 0.0, 0.0)
            if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
                for j in range(width):
                    b, size = binned[rows, j], len(cuts[j]) + 1
                    gs, hs, ns = np.bincount(b, grad[rows], size).cumsum()[:-1], np.bincount(b, hess[rows], size).cumsum()[:-1], np.bincount(b, minlength=size).cumsum()[:-1]
                    vl, vr = np.clip(-gs / (hs + RIDGE), low, high), np.clip(-(g - gs) / (h - hs + RIDGE), low, high)
                    gain = -(gs * vl + 0.5 * (hs + RIDGE) * vl**2) - ((g - gs) * vr + 0.5 * (h - hs + RIDGE) * vr**2) + (g * value + 0.5 * (h + RIDGE) * value**2)
                    fine = (ns >= LEAST_ROWS) & (len(rows) - ns >= LEAST_ROWS)
                    if j in falling:
                        fine &= vl >= vr
                    if fine.any() and (k := int(np.where(fine, gain, -1).argmax())) is not None and gain[k] > best[0] and fine[k]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            if best[1] < 0:
                raw[raw_rows] += nodes[node][4]
                continue
            _, j, k, vl, vr = best
            left = binned[rows, j] <= k
            bounds = ((low, high), (low, high))
            if j in falling:
                mid = (vl + vr) / 2
                bounds = ((mid, high), (low, mid))
            nodes[node][:4] = [j, float(cuts[j][k]), len(nodes), len(nodes) + 1]
            for part, (a, b) in zip((rows[left], rows[~left]), bounds):
                nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
                open_.append((len(nodes) - 1, part, a, b, depth + 1))
    table = np.array(nodes).reshape(-1, 5)
    ints = [np.array(roots, np.int64), table[:, 0].astype(np.int64)]
    return Trees(*ints, table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], base)


def raw_scores(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Sums the leaves' values; all rows step down all trees at once."""
    node = np.broadcast_to(trees.roots, (len(x), len(trees.roots))).copy()
    row = np.arange(len(x))[:, None]
    for _ in range(DEPTH if len(trees.roots) else 0):
        node = np.where(x[row, trees.feature[node]] <= trees.threshold[node], trees.left[node], trees.right[node])
    return trees.base + trees.value[node].sum(axis=1)


def described(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    base, words = base_counts(text)
    return base, statistics(text, base, words)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees:
    """Fits on at most `most` labelled documents outside the held-out third; statistics are made in tasks."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [described(t)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("quality").cast(pa.int32())], names=["doc_id", "x", "label"])

    sample = in_order(labelled_sample(docs, labels, most))
    rows = sample.mapInArrow(features, "doc_id long, x array<double>, label int").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES))
    return fit(x, np.array([float(r["label"] > 0) for r in rows]), tuple(NAMES.index(f) for f in FALLING))


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of every row of `docs`.

    A document is kept if the base rules pass (at least 20 words, at most 30 % of them in repeated windows) and the trees'
    score is at least 0.5. Null and empty texts have all counts 0 and fail. Rows that repeat are judged each. Columns other than
    doc_id and text are not read.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                found = [described(t) for t in some.column("text").to_pylist()]
                base = np.array([b for b, _ in found], np.int64)
                score = 1 / (1 + np.exp(-raw_scores(trees, np.array([x for _, x in found]))))
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
                counts = [pa.array(base[:, j]) for j in range(5)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *counts, pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)], names=names)

    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = ["doc_id", *longs, "base_failed", "kept", "score"]
    kinds = [*[T.StructField(c, T.LongType()) for c in longs], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())]
    return docs.select("doc_id", "text").mapInArrow(judged, T.StructType([docs.schema["doc_id"], *kinds]))
