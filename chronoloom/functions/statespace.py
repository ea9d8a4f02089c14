"""State-space likelihood of many parameter points at once; the helper that tasks run on arrays.

The leading axis of every array is a point: a series with a parameter vector. All points step through time together, so a
gradient, a Hessian or a whole batch of series is one pass.
"""

from __future__ import annotations

import numpy as np

from chronoloom.functions.spec import Spec

KAPPA = 1e6  # variance of a diffuse start
# A point's covariances count as settled once a step changes none of their elements by more than this part of the largest: the
# whole matrix is compared, so that a season still on its way through the state is seen. Looked at every few steps.
SETTLE_CLOSE, SETTLE_EVERY = 1e-13, 8


def polynomial(coefs: np.ndarray, seasonal: np.ndarray, s: int, sign: float) -> np.ndarray:
    """(1 + sign c1 L + ...) (1 + sign C1 L^s + ...) by point, lowest power first."""
    b, p, big = len(coefs), coefs.shape[1], seasonal.shape[1]
    out = np.zeros((b, p + s * big + 1))
    plain = np.concatenate([np.ones((b, 1)), sign * coefs], axis=1)
    out[:, : p + 1] = plain
    for i in range(big):
        out[:, s * (i + 1) : s * (i + 1) + p + 1] += sign * seasonal[:, i : i + 1] * plain
    return out


def to_stationary(x: np.ndarray) -> np.ndarray:
    """Maps any reals to the coefficients of a stationary AR polynomial, through partial autocorrelations."""
    r = x / np.sqrt(1 + x * x)
    out = np.zeros_like(x)
    for k in range(x.shape[1]):
        head = out[:, :k].copy()
        out[:, :k] = head + r[:, k : k + 1] * head[:, ::-1]
        out[:, k] = r[:, k]
    return -out


def from_stationary(coefs: np.ndarray) -> np.ndarray:
    """The inverse of to_stationary; partial autocorrelations beyond the border are pulled just inside."""
    out, now = np.zeros_like(coefs), -coefs.copy()
    for k in reversed(range(coefs.shape[1])):
        r = np.clip(now[:, k], -0.9999, 0.9999)
        out[:, k] = r / np.sqrt(np.maximum(1 - r * r, 1e-15))
        head = now[:, :k]
        now = (head - r[:, None] * head[:, ::-1]) / np.maximum(1 - r * r, 1e-15)[:, None]
    return out


def constrained(spec: Spec, x: np.ndarray) -> np.ndarray:
    out = x.copy()
    for name, cut in spec.blocks.items():
        if name in ("ar", "sar") and spec.enforce_stationarity:
            out[:, cut] = to_stationary(x[:, cut])
        elif name in ("ma", "sma") and spec.enforce_invertibility:
            out[:, cut] = -to_stationary(x[:, cut])
        elif name == "sigma2":
            out[:, cut] = np.exp(np.clip(x[:, cut], -50, 300))
    return out


def unconstrained(spec: Spec, params: np.ndarray) -> np.ndarray:
    out = params.copy()
    for name, cut in spec.blocks.items():
        if name in ("ar", "sar") and spec.enforce_stationarity:
            out[:, cut] = from_stationary(params[:, cut])
        elif name in ("ma", "sma") and spec.enforce_invertibility:
            out[:, cut] = from_stationary(-params[:, cut])
        elif name == "sigma2":
            out[:, cut] = np.log(params[:, cut])
    return out


def matrices(spec: Spec, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition (by point), design, and selection (by point).

    The state holds d integrated levels, then the last s values of each of D seasonal levels, then the ARMA block in companion form.
    """
    cut = spec.blocks
    ar = polynomial(params[:, cut["ar"]], params[:, cut["sar"]], spec.s, -1.0)
    ma = polynomial(params[:, cut["ma"]], params[:, cut["sma"]], spec.s, 1.0)
    k, first = spec.n_states, spec.n_diff
    season = spec.d - 1 + spec.s * np.arange(1, spec.D + 1)  # a season back, by level
    t, z, r = np.zeros((len(params), k, k)), np.zeros(k), np.zeros((len(params), k))
    z[first] = 1
    t[:, : spec.d, : spec.d] = np.triu(np.ones((spec.d, spec.d)))
    t[:, : spec.d, first] = 1
    z[: spec.d] = 1
    z[season] = 1
    t[:, : spec.d, season] = 1
    for i, oldest in enumerate(season):
        newest = oldest - spec.s + 1
        inside = np.arange(newest, oldest)
        t[:, inside + 1, inside] = 1
        t[:, newest, season[i:]] = 1
        t[:, newest, first] = 1
    t[:, first : first + spec.n_ar, first] = -ar[:, 1:]
    inner = np.arange(first, k - 1)
    t[:, inner, inner + 1] = 1
    r[:, first : first + ma.shape[1]] = ma
    return t, z, r


def stationary_cov(t: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solves P = T P T' + Q by doubling; and which points have a finite, positive solution.

    A solution that isn't positive gets a ridge of 1e-10; it counts if that makes it so.
    """
    p, a = q.copy(), t.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            p = p + a @ p @ a.transpose(0, 2, 1)
            a = a @ a
            if not (np.abs(a).max(initial=0) > 1e-18):
                break
        good = np.isfinite(p).all(axis=(1, 2)) & (np.abs(a).max(axis=(1, 2), initial=0) < 1e-6)
        at = np.flatnonzero(good)
        least = np.linalg.eigvalsh(p[at])[:, 0]
        p[at[least <= 0]] += 1e-10 * np.eye(p.shape[1])
        good[at] = least > -1e-10 * np.maximum(1, np.abs(p[at]).max(axis=(1, 2), initial=0))  # as exact as the sums are
    return p, good


def start(spec: Spec, t: np.ndarray, rqr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first state's covariance, and the observations that each point leaves out of its likelihood."""
    p = np.broadcast_to(KAPPA * np.eye(spec.n_states), t.shape).copy()
    burn = np.full(len(t), spec.n_states)
    if spec.enforce_stationarity:
        cut = slice(spec.n_diff, None)
        inner, good = stationary_cov(t[:, cut, cut], rqr[:, cut, cut])
        at = np.flatnonzero(good)
        p[at, cut, cut] = inner[at]
        burn[at] = spec.n_diff
    return p, burn


def run_filter(spec: Spec, y: np.ndarray, params: np.ndarray, exog: np.ndarray | None = None, store: bool = False) -> dict:
    """Runs the filter over y (points, n); exog is (points, n, regressors). Returns the sums, and with `store` the rows.

    A point with a prediction variance of 0 or less after its burn-in, or with numbers that aren't finite, is marked bad;
    `bad_at` is the first such time, n where there is none, and failure() says why.
    """
    t, z, r = matrices(spec, params)
    b, n = y.shape
    y = y - np.einsum("bnj,bj->bn", exog, params[:, spec.blocks["exog"]]) if spec.n_exog else y
    sigma2 = np.ones(b) if spec.concentrate_scale else params[:, -1]
    rqr = r[:, :, None] * r[:, None, :] * sigma2[:, None, None]
    p, burn = start(spec, t, rqr)
    a, t_t = np.zeros((b, spec.n_states)), t.transpose(0, 2, 1).copy()
    log_f, quad, bad, bad_at = np.zeros(b), np.zeros(b), n <= burn, np.full(b, n)
    v_all, f_all = (np.zeros((b, n)), np.zeros((b, n))) if store else (None, None)
    at = np.flatnonzero(z)
    moving = np.arange(b)  # points whose covariances still change, with these
    p_of, t_of, t_t_of, rqr_of, burn_of = p, t, t_t, rqr, burn
    f, gain, log_now, bad_now = np.ones(b), np.zeros((b, spec.n_states)), np.zeros(b), np.zeros(b, bool)
    with np.errstate(all="ignore"):
        for i in range(n):
            if len(moving):
                pz = p_of[:, :, at].sum(axis=2)
                f_of = pz[:, at].sum(axis=1)
                fine = f_of > 0
                gain_of = np.where(fine[:, None], pz / f_of[:, None], 0.0)
                after = t_of @ (p_of - gain_of[:, :, None] * pz[:, None, :]) @ t_t_of + rqr_of
                f[moving], gain[moving], log_now[moving], bad_now[moving] = f_of, gain_of, np.log(np.where(fine, f_of, 1.0)), ~fine
                if i % SETTLE_EVERY == 0:
                    calm = np.abs(after - p_of).max(axis=(1, 2)) <= SETTLE_CLOSE * np.abs(after).max(axis=(1, 2))
                    calm &= fine & (i >= burn_of)
                    p_of = after
                    if calm.any():
                        p[moving] = p_of
                        moving = moving[~calm]
                        p_of, t_of, t_t_of, rqr_of, burn_of = p[moving], t[moving], t_t[moving], rqr[moving], burn[moving]
                else:
                    p_of = after
            v = y[:, i] - a[:, at].sum(axis=1)
            a = np.einsum("bij,bj->bi", t, a + gain * v[:, None])
            counted = i >= burn
            if bad_now.any():
                bad_at = np.where(counted & bad_now, np.minimum(bad_at, i), bad_at)
            log_f += np.where(counted, log_now, 0.0)
            quad += np.where(counted, v * v / np.where(bad_now, 1.0, f), 0.0)
            if store:
                v_all[:, i], f_all[:, i] = v, f
        p[moving] = p_of
        used = np.maximum(n - burn, 1)
        if spec.concentrate_scale:
            scale = quad / used
            loglike = -0.5 * used * (np.log(2 * np.pi) + np.log(np.maximum(scale, 1e-300)) + 1) - 0.5 * log_f
        else:
            scale = sigma2
            loglike = -0.5 * (used * np.log(2 * np.pi) + log_f + quad)
    bad |= (bad_at < n) | ~np.isfinite(loglike)
    return {"loglike": np.where(bad, np.nan, loglike), "scale": scale, "burn": burn, "bad_at": bad_at, "v": v_all, "f": f_all, "a": a, "p": p, "t": t, "at": at, "rqr": rqr}


def failure(out: dict, i: int, n: int) -> str | None:
    """Why point i of a run over n values has no likelihood; None where it has one."""
    if np.isfinite(out["loglike"][i]):
        return None
    if n <= out["burn"][i]:
        return f"not enough observations: {n} <= {out['burn'][i]} that the start leaves out"
    if out["bad_at"][i] < n:
        return f"prediction variance is not positive at t={out['bad_at'][i]}"
    return "likelihood sums are not finite"


def loglike(spec: Spec, y: np.ndarray, params: np.ndarray, exog: np.ndarray | None = None) -> np.ndarray:
    return run_filter(spec, y, params, exog)["loglike"]


def forecast(spec: Spec, y: np.ndarray, params: np.ndarray, steps: int, exog: np.ndarray | None = None, future: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Mean and variance of the next `steps` values of each point, and why it has none; future is (points, steps, regressors).

    With the scale concentrated out, state covariances are in units of it; else they hold the variance already.
    """
    out = run_filter(spec, y, params, exog)
    a, p, t, at = out["a"], out["p"], out["t"], out["at"]
    unit = out["scale"] if spec.concentrate_scale else np.ones(len(y))
    mean, var = np.zeros((len(y), steps)), np.zeros((len(y), steps))
    for h in range(steps):
        mean[:, h] = a[:, at].sum(axis=1)
        var[:, h] = np.maximum(0, p[:, :, at].sum(axis=2)[:, at].sum(axis=1) * unit)
        a = np.einsum("bij,bj->bi", t, a)
        p = t @ p @ t.transpose(0, 2, 1) + out["rqr"]
    if spec.n_exog:
        mean += np.einsum("bnj,bj->bn", future[:, :steps], params[:, spec.blocks["exog"]])
    return mean, var, [failure(out, i, y.shape[1]) for i in range(len(y))]


def residuals(spec: Spec, y: np.ndarray, params: np.ndarray, exog: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors, and the same over their standard deviations (0 where the variance is not positive)."""
    out = run_filter(spec, y, params, exog, store=True)
    var = out["f"] * (out["scale"][:, None] if spec.concentrate_scale else 1.0)
    with np.errstate(all="ignore"):
        return out["v"], np.where(var > 0, out["v"] / np.sqrt(np.maximum(var, 1e-300)), 0.0)
