"""Panels from streams: windowed sums with a watermark, a running AR(1) estimate and a running state-space filter a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.functions import statespace
from chronoloom.functions.spec import Spec

FILTER_NAMES = ["key", "until", "n_obs", "loglike", "scale", "mean", "variance"]


def stream_buckets(events: DataFrame, ids: list[str], when: str, width: str, late: str, value: str) -> DataFrame:
    """ids, bucket (start of the window), y: sums of `value` in windows of `width`; events later than `late` are dropped."""
    summed = events.withWatermark(when, late).groupBy(*ids, F.window(when, width)).agg(F.sum(value).alias("y"))
    return summed.select(*ids, F.col("window.start").alias("bucket"), "y")


def running_ar1(rows: DataFrame, key: str) -> DataFrame:
    """For each series, after each micro-batch: key, n_obs, phi, scale, forecast of the next value.

    `rows` is a stream of key, t and y whose rows of a series come in the order of t over the micro-batches; within one they are
    sorted. The state of a series is four sums and its last value, so it stays small however long the stream.
    """

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, yb, bb, yy, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        new = pd.concat(list(batches)).sort_values("t")["y"].to_numpy(float)
        new = new[np.isfinite(new)]
        if len(new):
            before = np.concatenate([[last], new[:-1]])
            known = slice(0 if n else 1, None)  # the very first value has none before it
            yb, bb, yy = yb + float(new[known] @ before[known]), bb + float(before[known] @ before[known]), yy + float(new[known] @ new[known])
            n, last = n + len(new), float(new[-1])
            state.update((n, yb, bb, yy, last))
        phi = yb / bb if bb > 0 else float("nan")
        scale = (yy - phi * yb) / (n - 1) if n > 1 else float("nan")
        yield pd.DataFrame([[name[0], n, phi, scale, phi * last]], columns=["key", "n_obs", "phi", "scale", "forecast"])

    kind = rows.schema[key].dataType.simpleString()
    return (
        rows.select(F.col(key).alias("key"), "t", "y")
        .groupBy("key")
        .applyInPandasWithState(
            update, f"key {kind}, n_obs long, phi double, scale double, forecast double", "n long, yb double, bb double, yy double, last double", "update", GroupStateTimeout.NoTimeout
        )
    )


class FilterProcessor(StatefulProcessor):
    """A state-space filter a series: state mean, its covariance and the likelihood's sums, and the rows that wait for the watermark."""

    def __init__(self, spec: Spec, params: list[float]) -> None:
        self.spec, self.params = spec, params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filtered = handle.getValueState("filtered", "n long, a array<double>, p array<double>, log_f double, quad double")
        self.waiting = handle.getMapState("waiting", "ts long", "y double")
        t, z, r = statespace.matrices(self.spec, np.array([self.params], float).reshape(1, -1))
        sigma2 = 1.0 if self.spec.concentrate_scale else self.params[-1]
        self.t, self.z, self.rqr = t[0], z, np.outer(r[0], r[0]) * sigma2
        first, burn = statespace.start(self.spec, t, self.rqr[None])
        self.first, self.burn = first[0], int(burn[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rows wait until the watermark has passed them, for one that is late may still come before them."""
        latest = None
        for batch in rows:
            for ts, y in zip(batch["ms"].tolist(), batch["y"].tolist()):
                self.waiting.updateValue((ts,), (y,))
                latest = ts if latest is None else max(latest, ts)
        if latest is not None:
            self.handle.registerTimer(latest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        ripe = sorted((at[0], value[0]) for at, value in self.waiting.iterator() if at[0] <= until)
        if not ripe:
            return
        for ts, _ in ripe:
            self.waiting.removeKey((ts,))
        n, a, p, log_f, quad = self.filtered.get() if self.filtered.exists() else (0, None, None, 0.0, 0.0)
        k = self.spec.n_states
        a = np.zeros(k) if a is None else np.array(a)
        p = self.first if p is None else np.array(p).reshape(k, k)
        for _, y in ripe:
            if y is None or not np.isfinite(y):
                continue  # as if the row had not come
            pz = p @ self.z
            f, v = float(self.z @ pz), y - float(self.z @ a)
            if n >= self.burn:
                log_f, quad = log_f + float(np.log(f)), quad + v * v / f
            a, p = self.t @ (a + pz / f * v), self.t @ (p - np.outer(pz, pz) / f) @ self.t.T + self.rqr
            n += 1
        self.filtered.update((n, a.tolist(), p.ravel().tolist(), log_f, quad))
        used = n - self.burn
        free = self.spec.concentrate_scale
        scale = (quad / used if used > 0 else float("nan")) if free else float(self.params[-1])
        value = float("nan")
        if used > 0 and (scale > 0 or not free):
            value = -0.5 * (used * (np.log(2 * np.pi * scale) + 1) + log_f) if free else -0.5 * (used * np.log(2 * np.pi) + log_f + quad)
        variance = float(self.z @ p @ self.z) * (scale if free else 1.0)
        yield pd.DataFrame([[key[0], pd.Timestamp(ripe[-1][0], unit="ms"), n, value, scale, float(self.z @ a), variance]], columns=FILTER_NAMES)


def running_filter(rows: DataFrame, key: str, when: str, late: str, spec: Spec, params: list[float]) -> DataFrame:
    """For each series, whenever the watermark has passed some of its rows: key, until, n_obs, loglike, scale, mean and variance of the next value.

    `rows` is a stream of the key, the time `when` (a timestamp; of equal ones in a series the last to come counts) and y. Rows up
    to `late` behind are put where they belong; later ones are dropped. Rows whose y is no number are left out. What is kept of a
    series is a mean and a covariance of the state and the rows that wait, so it stays as small however long the stream. The session
    needs RocksDB as its state store; with regressors there is no such filter.
    """
    if spec.n_exog:
        raise ValueError("a running filter takes no regressors")
    spec.check_params(params)
    told = rows.select(F.col(key).alias("key"), F.col(when).alias("ts"), F.unix_millis(F.col(when).cast("timestamp")).alias("ms"), F.col("y").cast("double").alias("y"))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, until timestamp, n_obs long, loglike double, scale double, mean double, variance double"
    grouped = told.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithStateInPandas(FilterProcessor(spec, params), schema, "Append", "EventTime")
