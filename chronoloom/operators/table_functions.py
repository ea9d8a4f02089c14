"""Forecasts as a table function for SQL: FROM series, LATERAL sarimax_forecast(y, params, order, seasonal, steps, alpha)."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from chronoloom.functions import statespace
from chronoloom.functions.spec import MOST_STEPS, Spec
from chronoloom.operators.sarimax import SERIES_ERRORS, _problem

NAME = "sarimax_forecast"
RESULT = T.StructType([T.StructField("h", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("mean", "variance", "ci_lower", "ci_upper")], T.StructField("error", T.StringType())])


class Forecast:
    """h, mean, variance, ci_lower, ci_upper, error of the next steps of one series under the diffuse start, without regressors.

    `order` is (p, d, q), `seasonal` (P, D, Q, s), both arrays of constants, as are steps and alpha; a series that can't be
    forecast is one row with `error`. Types and constants are checked when the query is analysed, before it runs.
    """

    @staticmethod
    def analyze(y: AnalyzeArgument, params: AnalyzeArgument, order: AnalyzeArgument, seasonal: AnalyzeArgument, steps: AnalyzeArgument, alpha: AnalyzeArgument) -> AnalyzeResult:
        for name, given in (("y", y), ("params", params)):
            if not isinstance(given.dataType, T.ArrayType) or not isinstance(given.dataType.elementType, (T.DoubleType, T.FloatType)):
                raise ValueError(f"{name} must be an array of double")
        for name, given, size in (("order", order, 3), ("seasonal", seasonal, 4)):
            if not isinstance(given.dataType, T.ArrayType):
                raise ValueError(f"{name} must be an array of {size} integers")
            if given.isConstantExpression and given.value is not None and len(given.value) != size:
                raise ValueError(f"{name} must have {size} numbers")
        if steps.isConstantExpression and not 0 <= (steps.value or 0) <= MOST_STEPS:
            raise ValueError(f"forecast steps requested {steps.value} exceeds maximum {MOST_STEPS}")
        if alpha.isConstantExpression and not 0 < float(alpha.value or 0) < 1:
            raise ValueError("alpha must be between 0 and 1")
        return AnalyzeResult(schema=RESULT)

    def eval(self, y: list, params: list, order: list, seasonal: list, steps: int, alpha: float) -> Iterator[tuple]:
        try:
            spec = Spec.of(tuple(order), tuple(seasonal)).diffuse()
            problem = _problem(spec, y, None, 1)
            if problem is None and params is None:
                problem = "no parameters for this series"
            if problem is not None:
                raise ValueError(problem)
            spec.check_params(params)
            mean, var, problems = statespace.forecast(spec, np.array(y, float)[None], np.array(params, float)[None], int(steps))
            if problems[0] or not np.isfinite(mean).all():
                raise ValueError(problems[0] or "forecasts are not finite")
        except SERIES_ERRORS as e:
            yield None, None, None, None, None, str(e)
            return
        half = NormalDist().inv_cdf(1 - float(alpha) / 2) * np.sqrt(var[0])
        for h, (m, v, w) in enumerate(zip(mean[0].tolist(), var[0].tolist(), half.tolist()), 1):
            yield h, m, v, m - w, m + w, None


def register(spark: SparkSession, name: str = NAME) -> None:
    """Makes the table function known to SQL under a name."""
    spark.udtf.register(name, udtf(Forecast))
