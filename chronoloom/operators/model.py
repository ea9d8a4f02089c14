"""A model over a panel and what it has fitted: one object for all series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.spec import Spec
from chronoloom.operators import sarimax
from chronoloom.operators.series import with_interval
from chronoloom.sources.panel import to_arrays

INFERENCE = ("none", "hessian", "opg", "both")


class SarimaxPanel:
    """SARIMAX(order)(seasonal) for every series of a long panel (ids, t, y, regressors).

    The panel is packed to one row a series in each job. Options are those of Spec. An empty panel gives empty results.
    """

    def __init__(self, panel: DataFrame, ids: list[str], order: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 0), exog: list[str] | None = None, **options):
        self.ids, self.exog = ids, exog or []
        self.spec = Spec.of(order, seasonal, n_exog=len(self.exog), **options)
        self.series = to_arrays(panel, ids, self.exog)

    @property
    def n_exog(self) -> int:
        return len(self.exog)

    def nobs(self) -> DataFrame:
        return self.series.select(*self.ids, F.size("y").cast("long").alias("n_obs"))

    def loglike(self, params: DataFrame | list[float]) -> DataFrame:
        """ids, loglike, error at given parameters; a series without a finite one has an error."""
        return sarimax.loglike(self.series, self.ids, self.spec, params)

    def fit(self, method: str = "lbfgsb", maxiter: int | None = None, start_params: list[float] | None = None) -> FittedPanel:
        return FittedPanel(self, sarimax.fit(self.series, self.ids, self.spec, method, maxiter, start_params))


class FittedPanel:
    """The fits of a SarimaxPanel and what follows from them.

    `fits` has the columns of sarimax.FIT_COLUMNS. It is persisted, as all that follows reads it, and made anew where an
    executor that held a part is lost; unpersist() lets it go. Series whose fit failed have an error in every result.
    """

    def __init__(self, model: SarimaxPanel, fits: DataFrame):
        self.model, self.fits = model, fits.persist()

    def unpersist(self) -> None:
        self.fits.unpersist()

    @property
    def param_names(self) -> list[str]:
        return self.model.spec.names

    def params(self) -> DataFrame:
        """ids, idx, name, coef."""
        names = F.array(*[F.lit(n) for n in self.param_names]).cast("array<string>")
        rows = self.fits.select(*self.model.ids, F.posexplode(F.arrays_zip(names.alias("name"), F.col("params").alias("coef"))).alias("idx", "_p"))
        return rows.where("_p.coef is not null").select(*self.model.ids, "idx", "_p.name", "_p.coef")

    def forecast(self, steps: int = 1, alpha: float = 0.05, future: DataFrame | None = None) -> DataFrame:
        m = self.model
        return sarimax.forecast(m.series, m.ids, m.spec, self.fits, steps, alpha, future)

    get_forecast = forecast

    def conf_int(self, forecasts: DataFrame, alpha: float = 0.05) -> DataFrame:
        """Forecasts with the intervals of another level."""
        return with_interval(forecasts, alpha)

    def resid(self) -> DataFrame:
        """ids, t and the standardized residual."""
        m = self.model
        return sarimax.residuals(m.series, m.ids, m.spec, self.fits).select(*m.ids, "t", F.col("standardized_residual").alias("resid"), "error")

    def parameter_summary(self, alpha: float = 0.05, inference: str = "hessian") -> DataFrame:
        """The rows of sarimax.parameter_summary; with inference `none`, coefficients alone and status skipped."""
        if inference not in INFERENCE:
            raise ValueError(f"inference must be one of {', '.join(INFERENCE)}, not {inference}")
        if not 0 < alpha < 1:
            raise ValueError("alpha must be between 0 and 1")
        m = self.model
        if inference != "none":
            return sarimax.parameter_summary(m.series, m.ids, m.spec, self.fits, alpha, inference)
        nothing = [F.lit(None).cast("double").alias(c) for c in ("std_err", "z", "p_value", "ci_lower", "ci_upper")]
        return self.params().select("*", *nothing, F.lit("skipped").alias("inference_status"), F.lit(None).cast("string").alias("inference_message"))

    def summary(self, alpha: float = 0.05, inference: str = "hessian") -> DataFrame:
        """parameter_summary beside each series' loglike, scale, aic, bic, n_obs, converged and method."""
        told = self.fits.select(*self.model.ids, "loglike", "scale", "aic", "bic", "n_obs", "converged", "method", "error")
        return told.join(self.parameter_summary(alpha, inference), self.model.ids, "left")
