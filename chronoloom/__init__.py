"""Panels of univariate time series on Spark: seasonal ARIMA by maximum likelihood."""

__version__ = "0.1.0"
