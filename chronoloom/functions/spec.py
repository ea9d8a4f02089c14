"""The orders and options of a seasonal ARIMA model with regressors."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The largest orders that are accepted.
LIMITS = {"p": ("AR order", 20), "q": ("MA order", 20), "d": ("differencing order", 3), "P": ("seasonal AR order", 4), "Q": ("seasonal MA order", 4), "D": ("seasonal differencing order", 2), "s": ("seasonal period", 365), "n_exog": ("number of regressors", 100)}
MOST_STATES = 1024
MOST_STEPS = 10_000


@dataclass(frozen=True)
class Spec:
    p: int = 1
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0
    n_exog: int = 0
    concentrate_scale: bool = True
    enforce_stationarity: bool = True
    enforce_invertibility: bool = True

    def __post_init__(self) -> None:
        for name, (label, most) in LIMITS.items():
            value = getattr(self, name)
            if not isinstance(value, int) or value < 0:
                raise ValueError(f"{label} {name} must be a whole number of at least 0")
            if value > most:
                raise ValueError(f"{label} {name}={value} exceeds maximum {most}")
        if (self.P or self.D or self.Q) and self.s < 2:
            raise ValueError("seasonal order requires seasonal period s >= 2")
        if self.n_states > MOST_STATES:
            raise ValueError(f"state dimension {self.n_states} exceeds maximum {MOST_STATES}")

    @classmethod
    def of(cls, order, seasonal=(0, 0, 0, 0), **options) -> Spec:
        return cls(*order, *seasonal, **options)

    def diffuse(self) -> Spec:
        """As forecasts and residuals take a model: no constraints, every state starts diffuse."""
        return replace(self, enforce_stationarity=False, enforce_invertibility=False)

    @property
    def n_ar(self) -> int:
        return self.p + self.s * self.P

    @property
    def n_ma(self) -> int:
        return self.q + self.s * self.Q

    @property
    def n_arma_states(self) -> int:
        return max(self.n_ar, self.n_ma + 1)

    @property
    def n_diff(self) -> int:
        return self.d + self.s * self.D

    @property
    def n_states(self) -> int:
        return self.n_diff + self.n_arma_states

    @property
    def burn(self) -> int:
        """Observations that the likelihood leaves to the diffuse start."""
        return self.n_diff if self.enforce_stationarity else self.n_states

    @property
    def blocks(self) -> dict[str, slice]:
        """Where each kind of parameter is in a flat vector."""
        out, at = {}, 0
        sizes = (("exog", self.n_exog), ("ar", self.p), ("ma", self.q), ("sar", self.P), ("sma", self.Q), ("sigma2", int(not self.concentrate_scale)))
        for name, size in sizes:
            out[name] = slice(at, at + size)
            at += size
        return out

    @property
    def n_params(self) -> int:
        return self.blocks["sigma2"].stop

    @property
    def n_estimated(self) -> int:
        """Parameters that information criteria count; the scale is always one of them."""
        return self.n_exog + self.p + self.q + self.P + self.Q + 1

    @property
    def least_obs(self) -> int:
        return max(self.n_params, self.n_states + 1) + 1

    @property
    def names(self) -> list[str]:
        seasonal = [f"{kind}.S.L{i * self.s}" for kind, n in (("ar", self.P), ("ma", self.Q)) for i in range(1, n + 1)]
        plain = [f"{kind}.L{i}" for kind, n in (("ar", self.p), ("ma", self.q)) for i in range(1, n + 1)]
        return [*[f"x{j}" for j in range(1, self.n_exog + 1)], *plain, *seasonal, *([] if self.concentrate_scale else ["sigma2"])]

    def check_params(self, params) -> None:
        if len(params) != self.n_params:
            raise ValueError(f"parameter length mismatch: expected {self.n_params}, got {len(params)}")
        if not self.concentrate_scale and not params[-1] > 0:
            raise ValueError("variance sigma2 must be positive")
