"""Runs of repeated words in texts, by divide and conquer over the numbers of their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import words

LEAST_TIMES, LEAST_WORDS = 4, 6  # a run has that many times its period, and that many words, at least
GRAM = 4  # words; every run repeats one of as many at the distance of its period
FOUND = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def z_function(s: list[int]) -> list[int]:
    """For each position, how many elements from there on equal those from the beginning on; the first is the whole length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


def crossing(left: list[int], right: list[int]) -> np.ndarray:
    """(start, end, period) of the repetitions of left + right that have a whole period in `right`, are LEAST_TIMES periods long
    and lie on both sides of the middle; start and end count from the middle.

    With period q, the words from the middle on agree with those q further on for z(right)[q] words, and those before the middle
    with those q further on as far as the reversed text agrees with the reversed left half.
    """
    m = len(right)
    if m < 2 or not left:
        return np.zeros((0, 3), np.int64)
    back = left[::-1]
    q = np.arange(1, m)
    ahead = np.array(z_function(right), np.int64)[1:]
    # reversed right half, then reversed left half: before the word q behind the middle, at m - q
    behind = np.array(z_function([*back, -1, *right[::-1], *back]), np.int64)[len(back) + 1 + m - q]
    fits = (behind > 0) & (behind + q + ahead >= np.maximum(LEAST_TIMES * q, LEAST_WORDS))
    return np.stack([-behind[fits], (q + ahead)[fits], q[fits]], 1)


def next_gram(ids: np.ndarray) -> np.ndarray:
    """For each position, how far on the same GRAM words come again; a huge number where they don't."""
    never = np.iinfo(np.int64).max
    n = len(ids) - GRAM + 1
    out = np.full(max(len(ids), 0), never, np.int64)
    if n < 2:
        return out
    rank = ids.astype(np.int64)
    width = 1
    while width < GRAM:  # ranks of twice as many words
        rank = rank[: len(rank) - width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(rank, return_inverse=True)[1]
        width *= 2
    order = np.argsort(rank, kind="stable")
    same = rank[order[1:]] == rank[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period.

    A run is a maximal stretch of smallest period q and of max(LEAST_WORDS, LEAST_TIMES * q) words or more. Segments are halved;
    Z-functions at the middle find what crosses it, with a whole period on either side. What touches an end of its segment and
    would go on beyond it is part of a run that crosses the middle of a larger segment, and is found there whole. Of periods of
    one interval the smallest stays. A segment is passed over if none of its GRAM words come again within a quarter of it, or if it
    lies inside a run of period q that was found and they don't come again within a third of q: then it can't hold another run.
    """
    n = len(ids)
    again = next_gram(ids)
    if not (again < n).any():
        return []
    s = ids.tolist()
    best: dict[tuple[int, int], int] = {}
    inside_to, inside_period = np.zeros(n, np.int64), np.zeros(n, np.int64)
    segments = [(0, n)]
    while segments:
        deeper = []
        for lo, hi in segments:
            if hi - lo < LEAST_WORDS:
                continue
            nearest = int(again[lo:hi].min())
            if LEAST_TIMES * nearest > hi - lo or inside_to[lo] >= hi and (LEAST_TIMES - 1) * nearest >= inside_period[lo]:
                continue
            mid = (lo + hi) // 2
            left, right = s[lo:mid], s[mid:hi]
            forward = crossing(left, right)
            backward = crossing(right[::-1], left[::-1])
            found = np.concatenate([forward, np.stack([-backward[:, 1], -backward[:, 0], backward[:, 2]], 1)])
            found[:, :2] += mid
            for start, end, q in found[np.argsort(found[:, 2], kind="stable")].tolist():
                if start and s[start - 1] == s[start - 1 + q] or end < n and s[end] == s[end - q]:
                    continue
                if best.setdefault((start, end), q) == q:
                    at = slice(start, end)
                    longer = inside_to[at] < end
                    inside_period[at][longer] = q
                    inside_to[at][longer] = end
            deeper += [(lo, mid), (mid, hi)]
        segments = deeper
    return sorted((start, end - start, q) for (start, end), q in best.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def numbered(text: list[bytes]) -> np.ndarray:
    """Words as numbers, in the order of their first coming."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in text], np.int64)


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, `runs` (see runs_of; starts and lengths in words) and `collapsed`: the text's kept words joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`. A null, empty or blank text has no runs and collapses to an empty text. Every row gives a row,
    repeated ones and rows without a key too; other columns are left out. A text of any length is one row of one task.
    """
    names = ["runs", "collapsed"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for value in batch.column("_text").to_pylist():
                own = (value or "").encode().split()  # of bytes: at these white space characters alone
                runs = runs_of(numbered(own))
                if runs:
                    own = [w for w, stays in zip(own, kept_words(len(own), runs).tolist()) if stays]
                found.append([{"start": a, "length": b, "period": q} for a, b, q in runs])
                left.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found, kind), pa.array(left, pa.string())], names=["_key", *names])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = rows.mapInArrow(work, f"_key {docs.schema[key].dataType.simpleString()}, {FOUND}")
    return out.select(F.col("_key").alias(key), *names)


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the texts of about a tenth of the documents end in a loop of their own words.

    With h the crc32 of the id and g = h div 10: if 10 divides h, the words from number g mod n on go round with a period of
    1 + (n - g mod n) div (3 + g mod 8). A text without words, and that of a row without an id, stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words(F.col("text"))).alias("_w"))
    held = held.withColumns({"_n": F.size("_w"), "_g": F.floor(F.col("_h") / 10)})
    held = held.withColumn("_a", F.when(F.col("_n") > 0, (F.col("_g") % F.greatest("_n", F.lit(1))).cast("int")))
    held = held.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    place = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i)
    looped = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", place(i))), " ")
    return held.select("doc_id", F.when(F.col("_a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def longest_of(runs: Column) -> Column:
    """Of runs by start, then period, the first of greatest length / period, compared without division; null if there is none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def run_digest(docs: DataFrame) -> DataFrame:
    """Runs of documents whose texts loop (with_loops): their number, the greatest one, and digests of all runs and of the text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = collapse_runs(with_loops(docs)).withColumn("_best", longest_of(F.col("runs")))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
