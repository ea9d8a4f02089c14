"""The exact likelihood of stationary ARMA series without a loop over time; the helper that fit tasks run on arrays.

With e = T(w) - G c, where T is the filter phi(L) / theta(L) from a zero past, c is what the past adds to the first max(p, q)
values and G the filter's response to it, both the sum of squares and the determinant of the exact Gaussian likelihood follow from
c's covariance, which the state-space form's stationary start has. The filter 1 / theta(L) is a product of Fourier transforms. Where
neither polynomial goes beyond one lag, and series are short or points many, points take one pass over time together.
"""

from __future__ import annotations

import numpy as np

from chronoloom.functions.spec import Spec
from chronoloom.functions.statespace import matrices, polynomial

DAMPING = 27.0  # exp(-DAMPING) is the weight of what wraps around in the transforms
MOST_NUMBERS = 1 << 22  # in one pass
CACHED_NUMBERS = 1 << 17  # in one pass over time, so that they stay in a core's cache
FEWEST_POINTS, SHORT = 32, 256  # a pass over time pays for so many points, and does for any number of such short series


def usable(spec: Spec) -> bool:
    """Whether a model's likelihood is that of its differences, and its moving average can be inverted."""
    return spec.enforce_stationarity and (spec.enforce_invertibility or not (spec.q or spec.Q))


def doubled_cov(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P = T P T' + Q by doubling, not finite where it does not settle."""
    p, a = q.copy(), t.copy()
    for _ in range(60):
        p = p + a @ p @ a.transpose(0, 2, 1)
        a = a @ a
        if not (np.abs(a).max(initial=0) > 1e-16):
            return p
    p[np.abs(a).max(axis=(1, 2)) > 1e-6] = np.nan
    return p


def responses(ma: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The response of 1 / theta(L) to a unit impulse, and to x (points, n), from a zero past."""
    n = x.shape[1]
    size = 1 << int(4 * max(n, ma.shape[1]) - 1).bit_length()
    damp = np.exp(-DAMPING / size * np.arange(size))
    inverse = 1 / np.fft.rfft(ma * damp[: ma.shape[1]], size)
    both = np.fft.irfft(np.stack([inverse, np.fft.rfft(x * damp[:n], size) * inverse]), size)[:, :, :n] / damp[:n]
    return both[0], both[1]


def first_order(spec: Spec, w: np.ndarray, length: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares and log-determinant by point where no lag is beyond the first: c is one number, and its variance known."""
    n, cut = w.shape[1], spec.blocks
    phi = params[:, cut["ar"]][:, 0] if spec.p else np.zeros(len(w))
    theta = params[:, cut["ma"]][:, 0] if spec.q else np.zeros(len(w))
    x = w.T.copy()
    x[1:] -= phi * w.T[:-1]
    known = np.arange(n)[:, None] < length
    ends = ~known.all(axis=1)
    quad, gram, met = np.zeros((3, len(w)))
    a, h = np.zeros(len(w)), np.ones(len(w))
    for t in range(n):
        if t:
            a *= -theta
            h *= -theta
        a += x[t]
        if ends[t]:
            a *= known[t]
            h *= known[t]
        quad += a * a
        gram += h * h
        met += h * a
    past = (phi + theta) ** 2 / (1 - phi * phi)
    system = 1 + past * gram
    log_det = np.where(np.isfinite(system) & (system > 0), np.log(system), np.nan)
    return quad - past * met * met / system, log_det


def by_transform(spec: Spec, w: np.ndarray, length: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares and log-determinant by point for any orders."""
    cut = spec.blocks
    ar = polynomial(params[:, cut["ar"]], params[:, cut["sar"]], spec.s, -1.0)
    ma = polynomial(params[:, cut["ma"]], params[:, cut["sma"]], spec.s, 1.0)
    n, m = w.shape[1], max(ar.shape[1], ma.shape[1]) - 1
    x = w.copy()
    for i in np.flatnonzero(ar[:, 1:].any(axis=0)) + 1:
        x[:, i:] += ar[:, i : i + 1] * w[:, : n - i]
    known = np.arange(n) < length[:, None]
    moving = ma.shape[1] > 1
    h, a = responses(ma, x) if moving else (None, x)
    a = a * known
    quad, log_det = (a * a).sum(axis=1), np.zeros(len(w))
    if m and n:
        t, _, r = matrices(spec, params)
        rr = r[:, :, None] * r[:, None, :]
        past = (doubled_cov(t, rr) - rr)[:, :m, :m]
        if moving:
            padded = np.concatenate([np.zeros((len(w), m)), h], axis=1)
            g = np.lib.stride_tricks.sliding_window_view(padded, m, axis=1)[:, 1 : n + 1, ::-1] * known[:, :, None]
            gram, met = g.transpose(0, 2, 1) @ g, (g * a[:, :, None]).sum(axis=1)
        else:
            first = min(m, n)
            gram = np.zeros((len(w), m, m))
            gram[:, np.arange(first), np.arange(first)] = known[:, :first]
            met = np.zeros((len(w), m))
            met[:, :first] = a[:, :first]
        system = np.eye(m) + past @ gram
        good = np.isfinite(system).all(axis=(1, 2))
        system[~good] = np.eye(m)
        sign, log_det = np.linalg.slogdet(system)
        quad = quad - (met * np.linalg.solve(system, (past @ met[:, :, None]))[:, :, 0]).sum(axis=1)
        log_det = np.where(good & (sign > 0), log_det, np.nan)
    return quad, log_det


def arma_loglike(spec: Spec, w: np.ndarray, length: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and scale by point; rows of w (points, n) have `length` values and zeros behind. Orders d and D are 0."""
    step = max(1, MOST_NUMBERS // (max(w.shape[1], 1) * (spec.n_arma_states + 6)))
    by_time = max(spec.n_ar, spec.n_ma) == 1 and (w.shape[1] <= SHORT or min(len(w), step) >= FEWEST_POINTS)
    if by_time:
        step = min(step, max(8 * FEWEST_POINTS, CACHED_NUMBERS // max(w.shape[1], 1)))
    if len(w) > step:
        parts = [arma_loglike(spec, w[i : i + step], length[i : i + step], params[i : i + step]) for i in range(0, len(w), step)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    with np.errstate(all="ignore"):
        quad, log_det = (first_order if by_time else by_transform)(spec, w, length, params)
        if spec.concentrate_scale:
            scale = quad / length
            value = -0.5 * length * (np.log(2 * np.pi) + np.log(np.maximum(scale, 1e-300)) + 1) - 0.5 * log_det
        else:
            scale = params[:, -1]
            value = -0.5 * (length * np.log(2 * np.pi * scale) + log_det + quad / scale)
        return np.where(np.isfinite(value) & (quad >= 0), value, np.nan), scale
