"""Maximum likelihood for a batch of series, all series in step; the helper that fit tasks run."""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np

from chronoloom.functions import exact
from chronoloom.functions.spec import Spec
from chronoloom.functions.statespace import constrained, failure, loglike, run_filter, unconstrained

METHODS = {"lbfgsb": "bfgs", "lbfgsb-strict": "bfgs", "lbfgsb_single": "bfgs", "lbfgs": "multi", "bfgs": "bfgs", "lbfgsb-multi": "multi", "nelder-mead": "nm", "nm": "nm"}
DEFAULT_MAXITER = 500
MOST_POINTS = 1 << 22  # of points times squared states in one pass
SEASONAL_GRID = (-0.3, -0.6, -0.9)  # starts of the first seasonal moving average
SIMPLEX_STEPS = 200


def differenced(y: np.ndarray, spec: Spec) -> np.ndarray:
    out = np.diff(y, spec.d, axis=1)
    for _ in range(spec.D):
        out = out[:, spec.s :] - out[:, : -spec.s]
    return out


def burg(y: np.ndarray, p: int) -> np.ndarray | None:
    """AR coefficients of a demeaned series by Burg's method; None if it is too short, constant or at the stationary border."""
    if len(y) <= p:
        return None
    y = y - y.mean()
    f, b, a = y[1:].copy(), y[:-1].copy(), np.zeros(0)
    for _ in range(p):
        den = f @ f + b @ b
        k = 2 * (f @ b) / den if den > 1e-15 else 1.0
        if not abs(k) < 1:
            return None
        a = np.concatenate([a - k * a[::-1], [k]])
        f, b = (f - k * b)[1:], (b - k * f)[:-1]
    return a


def autocovariances(y: np.ndarray, most: int, step: int = 1) -> np.ndarray:
    """Lags 0, step, ..., most * step around the mean, divided by n; 0 where the series is too short."""
    c = y - y.mean()
    return np.array([c[: len(c) - k] @ c[k:] if k < len(c) else 0.0 for k in (step * i for i in range(most + 1))]) / len(c)


def yule_walker(acov: np.ndarray) -> np.ndarray:
    """AR coefficients of order len(acov) - 1 from autocovariances, order by order; zeros for a constant series."""
    a, left = np.zeros(0), acov[0]
    for k in range(1, len(acov)):
        if not left > 1e-15:
            return np.zeros(len(acov) - 1)
        reflection = (acov[k] - a @ acov[k - 1 : 0 : -1]) / left
        a = np.concatenate([a - reflection * a[::-1], [reflection]])
        left *= 1 - reflection**2
    return a


def innovations(acov: np.ndarray) -> np.ndarray:
    """MA coefficients of order len(acov) - 1 from autocovariances by that many rounds of the innovations algorithm."""
    q = len(acov) - 1
    if not acov[0] > 1e-15:
        return np.zeros(q)
    var, theta = np.full(q + 1, acov[0]), np.zeros((q + 1, q + 1))  # theta[n, j] weighs the error j back in round n
    for n in range(1, q + 1):
        for k in range(n):
            known = sum(theta[k, k - j] * theta[n, n - j] * var[j] for j in range(k))
            theta[n, n - k] = (acov[n - k] - known) / var[k]
        var[n] = max(acov[0] - sum(theta[n, n - j] ** 2 * var[j] for j in range(n)), 1e-15)
    return np.clip(theta[q, 1:], -0.99, 0.99)


def moment_starts(spec: Spec, w: np.ndarray) -> dict[str, np.ndarray]:
    """Starts without a regression: Burg, else Yule-Walker, for the AR part; innovations of what that leaves for the MA part.

    The seasonal parts likewise, from seasonal lags of the same series.
    """
    found = {}
    for ar, ma, p, q, step in (("ar", "ma", spec.p, spec.q, 1), ("sar", "sma", spec.P, spec.Q, spec.s)):
        a = burg(w, p) if ar == "ar" else None
        a = yule_walker(autocovariances(w, p, step)) if a is None else a
        rest = w.copy()
        for k, coef in enumerate(a, 1):
            rest[k * step :] -= coef * w[: len(w) - k * step]
        rest = rest[p * step :]
        found[ar], found[ma] = a, innovations(autocovariances(rest, q, step)) if len(rest) else np.zeros(q)
    return found


def start_values(spec: Spec, y: np.ndarray, x: np.ndarray | None) -> np.ndarray:
    """Regressors by least squares on differences, then Hannan-Rissanen: a long autoregression stands in for the errors.

    A pure AR model, and a series too short or too even for that, takes moment_starts.
    """
    out = np.zeros(spec.n_params)
    w = differenced(y[None], spec)[0]
    if len(w) < 3:
        if not spec.concentrate_scale:
            out[-1] = 1.0
        return out
    if spec.n_exog:
        dx = np.stack([differenced(x[None, :, j], spec)[0] for j in range(spec.n_exog)], 1)
        beta = np.linalg.lstsq(dx, w, rcond=None)[0]
        out[spec.blocks["exog"]] = beta
        w = w - dx @ beta
    lags = {"ar": range(1, spec.p + 1), "ma": range(1, spec.q + 1), "sar": [spec.s * i for i in range(1, spec.P + 1)], "sma": [spec.s * i for i in range(1, spec.Q + 1)]}
    most = max([0, *[k for some in lags.values() for k in some]])
    long = min(max(10, 2 * most), len(w) // 3)
    pure = not (spec.q or spec.P or spec.Q)
    a = burg(w, long) if not pure and len(w) - long - most > 2 * spec.n_params + 2 else None
    if a is None:
        for name, value in moment_starts(spec, w).items():
            out[spec.blocks[name]] = value
    else:
        e = w.copy()
        for k in range(1, long + 1):
            e[long:] -= a[k - 1] * w[long - k : len(w) - k]
        rows = np.arange(long + most, len(w))
        columns = [(w if name in ("ar", "sar") else e)[rows - k] for name, some in lags.items() for k in some]
        gram = np.stack(columns, 1)
        fit = np.linalg.lstsq(np.vstack([gram, 1e-3 * np.linalg.norm(gram) / len(columns) ** 0.5 * np.eye(len(columns)) * 1e-2]), np.concatenate([w[rows], np.zeros(len(columns))]), rcond=None)[0]
        at = 0
        for name, some in lags.items():
            out[spec.blocks[name]] = np.clip(fit[at : at + len(some)], -0.95, 0.95)
            at += len(some)
    if not spec.concentrate_scale:
        out[-1] = max(float(w @ w) / len(w), 1e-6)
    return out


class Data:
    """Series (rows, n), their regressors (rows, n, regressors) or None, and their lengths; behind a length are zeros."""

    def __init__(self, y: np.ndarray, exog: np.ndarray | None, length: np.ndarray):
        self.y, self.exog, self.length = y, exog, length

    def __getitem__(self, rows) -> Data:
        return Data(self.y[rows], None if self.exog is None else self.exog[rows], self.length[rows])

    def differenced(self, spec: Spec) -> Data:
        length = self.length - spec.n_diff
        w = differenced(self.y, spec)
        known = np.arange(w.shape[1]) < length[:, None]
        exog = None if self.exog is None else np.stack([differenced(self.exog[:, :, j], spec) * known for j in range(spec.n_exog)], 2)
        return Data(w * known, exog, length)


def likelihood(spec: Spec, x: np.ndarray, data: Data) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and scale at parameters x; with d and D 0 in closed form where that holds, else by the filter."""
    if exact.usable(spec) and not spec.n_diff:
        w = data.y if data.exog is None else data.y - np.einsum("bnj,bj->bn", data.exog, x[:, spec.blocks["exog"]])
        return exact.arma_loglike(spec, w, data.length, x)
    out = run_filter(spec, data.y, x, data.exog)
    return out["loglike"], out["scale"]


def cost(spec: Spec, x: np.ndarray, data: Data, rows: np.ndarray | None = None) -> np.ndarray:
    """Minus the log-likelihood by point in unconstrained space; a huge number where there is none. Points are of data[rows] in order."""
    step = max(1, MOST_POINTS // spec.n_states**2)
    if exact.usable(spec) and not spec.n_diff:
        step = max(1, min(step, MOST_POINTS // max(data.y.shape[1], 1)))  # series repeat for their points: only those of a pass at a time
    of = [slice(i, i + step) for i in range(0, len(x), step)]
    parts = [likelihood(spec, constrained(spec, x[some]), data[some if rows is None else rows[some]])[0] for some in of]
    value = -np.concatenate(parts)
    return np.where(np.isfinite(value), value, 1e300)


def gradient(spec: Spec, x: np.ndarray, data: Data) -> np.ndarray:
    """Central differences: two points for each parameter and series, all in one pass."""
    b, p = x.shape
    h = 1e-5 * np.maximum(1, np.abs(x))
    moved = x[:, None, None, :] + np.stack([np.eye(p), -np.eye(p)], 1) * h[:, None, None, :]
    value = cost(spec, moved.reshape(-1, p), data, np.repeat(np.arange(b), 2 * p)).reshape(b, p, 2)
    out = (value[:, :, 0] - value[:, :, 1]) / (2 * h)
    return np.where(np.abs(out) < 1e200, out, 0.0)


def bounded(spec: Spec, x: np.ndarray) -> np.ndarray:
    """Keeps lag coefficients that have no transform inside +-0.999."""
    out = x.copy()
    for name, cut in spec.blocks.items():
        free = name in ("ar", "sar") and not spec.enforce_stationarity or name in ("ma", "sma") and not spec.enforce_invertibility
        if free:
            out[:, cut] = np.clip(out[:, cut], -0.999, 0.999)
    return out


def bfgs(spec: Spec, x: np.ndarray, data: Data, maxiter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BFGS with backtracking, all series in step. Returns points, costs, iterations, converged."""
    b, p = x.shape
    x = bounded(spec, x)
    value, grad = cost(spec, x, data), gradient(spec, x, data)
    unit = np.eye(p)
    inverse = unit / np.maximum(1, np.linalg.norm(grad, axis=1))[:, None, None]
    n_iter, done, good, fresh = np.zeros(b, np.int64), np.zeros(b, bool), np.zeros(b, bool), np.ones(b, bool)
    slow = np.zeros(b, np.int64)
    for _ in range(maxiter):
        flat = np.abs(grad).max(axis=1, initial=0) < 1e-5 * np.maximum(1, np.abs(value) / 100)
        good |= flat & ~done
        done |= flat
        live = np.flatnonzero(~done)
        if not len(live):
            break
        n_iter[live] += 1
        some = data[live]
        move = -np.einsum("bij,bj->bi", inverse[live], grad[live])
        slope = (move * grad[live]).sum(axis=1)
        up = slope >= 0
        move[up], slope[up] = -grad[live][up], -(grad[live][up] ** 2).sum(axis=1)
        size = np.minimum(1.0, 5.0 / np.maximum(np.abs(move).max(axis=1), 1e-300))
        new_x, new_value = x[live].copy(), value[live].copy()
        open_ = np.ones(len(live), bool)
        for _ in range(25):
            k = np.flatnonzero(open_)
            if not len(k):
                break
            tried = bounded(spec, x[live[k]] + size[k, None] * move[k])
            got = cost(spec, tried, some, k)
            fits = got <= value[live[k]] + 1e-4 * size[k] * slope[k]
            new_x[k[fits]], new_value[k[fits]] = tried[fits], got[fits]
            open_[k[fits]] = False
            size[k[~fits]] *= 0.4
        new_grad = gradient(spec, new_x, some)
        s, u = new_x - x[live], new_grad - grad[live]
        su = (s * u).sum(axis=1)
        at = np.flatnonzero(su > 1e-12 * np.linalg.norm(s, axis=1) * np.linalg.norm(u, axis=1))
        rows, s, u, su = live[at], s[at], u[at], su[at]
        now = np.where(fresh[rows, None, None], unit * (su / np.maximum((u * u).sum(axis=1), 1e-300))[:, None, None], inverse[rows])
        left = unit - s[:, :, None] * u[:, None, :] / su[:, None, None]
        inverse[rows] = left @ now @ left.transpose(0, 2, 1) + s[:, :, None] * s[:, None, :] / su[:, None, None]
        fresh[rows] = False
        # A likelihood that rises towards the border of its region creeps for ever; ten such steps in a row end it, unconverged.
        gain = value[live] - new_value
        slow[live] = np.where(gain < 1e-6 * np.maximum(1, np.abs(value[live])), slow[live] + 1, 0)
        small = gain < 1e-9 * np.maximum(1, np.abs(value[live]))
        settled = small & (~open_ | fresh[live])
        reset = live[open_ & ~fresh[live]]
        inverse[reset], fresh[reset] = unit * 0.1, True
        good[live] |= settled
        done[live] |= settled | (slow[live] >= 10)
        x[live], value[live], grad[live] = new_x, new_value, new_grad
    return x, value, n_iter, good


def nelder_mead(spec: Spec, x: np.ndarray, data: Data, maxiter: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nelder-Mead, all series in step; all trial points of a step are one pass. `maxiter` can be given by series."""
    b, p = x.shape
    most = np.broadcast_to(maxiter, b)

    def costs(z: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return cost(spec, bounded(spec, z.reshape(-1, p)), data, np.repeat(rows, z.shape[1])).reshape(z.shape[:2])

    moves = np.where(np.abs(x) > 1e-8, 0.05 * x, 0.00025)
    simplex = np.concatenate([x[:, None], x[:, None] + np.eye(p) * moves[:, :, None]], axis=1)
    value, n_iter, fine = costs(simplex, np.arange(b)), np.zeros(b, np.int64), np.zeros(b, bool)
    for n in range(1, int(most.max(initial=0)) + 1):
        live = np.flatnonzero(~fine & (most >= n))
        if not len(live):
            break
        n_iter[live] = n
        order = np.argsort(value[live], axis=1, kind="stable")
        simplex[live] = np.take_along_axis(simplex[live], order[:, :, None], axis=1)
        value[live] = np.take_along_axis(value[live], order, axis=1)
        with np.errstate(over="ignore"):
            fine[live] = value[live].std(axis=1) < 1e-6
        live = live[~fine[live]]
        if not len(live):
            continue
        some, of, at = simplex[live], value[live], np.arange(len(live))
        middle = some[:, :-1].mean(axis=1)
        tried = middle[:, None] + np.array([[1.0], [2.0], [0.5], [-0.5]]) * (middle - some[:, -1])[:, None]
        got = costs(tried, live)
        first = got[:, 0]
        k = np.where(first < of[:, 0], np.where(got[:, 1] < first, 1, 0), np.where(first < of[:, -2], 0, np.where(first < of[:, -1], 2, 3)))
        taken = (k < 2) | (got[at, k] < np.minimum(first, of[:, -1]))
        some[taken, -1], of[taken, -1] = tried[at, k][taken], got[at, k][taken]
        if not taken.all():
            some[~taken] = some[~taken, :1] + 0.5 * (some[~taken] - some[~taken, :1])
            of[~taken] = costs(some[~taken], live[~taken])
        simplex[live], value[live] = some, of
    best = value.argmin(axis=1)
    return bounded(spec, simplex[np.arange(b), best]), value.min(axis=1), n_iter, fine


def restarts(spec: Spec) -> int:
    """Perturbed starts by the number of parameters: 3 for four or more, one for each beyond the first below; 2 at least if seasonal."""
    by_size = min(max(spec.n_params - 1, 0), 3)
    return max(by_size, 2) if spec.P or spec.Q else by_size


def further_starts(spec: Spec, x: np.ndarray, data: Data, many: bool) -> list[np.ndarray]:
    """Second starts in unconstrained space: zero lag coefficients; with `many`, seasonal moving averages and perturbations.

    Perturbations are as many as the parameters call for, and seeded by the series' own values, so they do not depend on what else
    is in the batch.
    """
    keep = np.isin(np.arange(spec.n_params), np.r_[spec.blocks["exog"], spec.blocks["sigma2"]])
    out = [np.where(keep, x, 0.0)]
    if many and spec.Q:
        for theta in SEASONAL_GRID:
            params = np.zeros((1, spec.n_params))
            params[0, spec.blocks["sma"].start] = theta
            params[0, spec.blocks["sigma2"]] = 1.0
            out.append(np.where(keep, x, unconstrained(spec, params)))
    if many:
        n = restarts(spec)
        draws = np.array([np.random.default_rng(zlib.crc32(data.y[i, : data.length[i]].tobytes())).normal(0, 0.5, (n, spec.n_params)) for i in range(len(x))])
        out += [x + np.where(keep, 0.0, draws[:, k]) for k in range(n)]
    return out


def search(spec: Spec, x: np.ndarray, data: Data, method: str, maxiter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, iterations and convergence by a method; all its runs share `maxiter` iterations a series.

    lbfgs and lbfgsb-multi try every further start, the latter polishes the best point by Nelder-Mead; lbfgsb tries a zero start
    where there are moving averages, and goes on by Nelder-Mead where it did not converge. The others are one run.
    """
    kind = METHODS[method]
    if kind == "nm":
        x, _, n_iter, good = nelder_mead(spec, x, data, maxiter)
        return x, n_iter, good
    x, value, n_iter, good = bfgs(spec, x, data, maxiter)
    others = further_starts(spec, x, data, True) if kind == "multi" else further_starts(spec, x, data, False) if method == "lbfgsb" and (spec.q or spec.Q) else []
    for other in others:
        open_ = np.flatnonzero(n_iter < maxiter)
        if not len(open_):
            break
        x2, v2, n2, g2 = bfgs(spec, other[open_], data[open_], int(maxiter - n_iter[open_].min()))
        n_iter[open_] += n2
        better = v2 < value[open_] - 1e-8
        at = open_[better]
        x[at], value[at], good[at] = x2[better], v2[better], g2[better]
    again = np.flatnonzero((n_iter < maxiter) & ((method == "lbfgsb-multi") | ((method == "lbfgsb") & ~good)))
    if len(again):
        x2, v2, n2, g2 = nelder_mead(spec, x[again], data[again], np.minimum(maxiter - n_iter[again], SIMPLEX_STEPS))
        n_iter[again] += n2
        better = v2 <= value[again]
        x[again[better]] = x2[better]
        good[again] |= g2
    return x, np.minimum(n_iter, maxiter), good


def fit(spec: Spec, y: np.ndarray, exog: np.ndarray | None = None, method: str = "lbfgsb", maxiter: int | None = None, starts: np.ndarray | None = None, length: np.ndarray | None = None) -> list[dict]:
    """Fits every row of y (series, n). One result a series: params, loglike, scale, aic, bic, n_iter, converged, method.

    Where exact.usable(spec) holds, series can have different lengths, given by `length`, with zeros behind.
    """
    if method not in METHODS:
        raise RuntimeError(f"optimization failed: unknown method {method}")
    maxiter = DEFAULT_MAXITER if maxiter is None else maxiter
    b, n = y.shape
    data = Data(y, exog, np.full(b, n) if length is None else length)
    sizes = data.length.tolist()
    begin = starts if starts is not None else np.array([start_values(spec, y[i, : sizes[i]], None if exog is None else exog[i, : sizes[i]]) for i in range(b)]).reshape(b, spec.n_params)
    # Once the diffuse start is left out, the likelihood is that of the differences, with far fewer states.
    inner, inner_data = (replace(spec, d=0, D=0), data.differenced(spec)) if spec.enforce_stationarity else (spec, data)
    name = method
    if spec.p >= 3 and not (spec.q or spec.P or spec.Q or spec.n_exog) and spec.concentrate_scale and starts is None and method == "lbfgsb":
        params, n_iter, done, name = begin, np.zeros(b, np.int64), np.ones(b, bool), "burg-direct"
    elif maxiter == 0 or not spec.n_params:
        params, n_iter, done = begin, np.zeros(b, np.int64), np.full(b, maxiter > 0)
    else:
        x, n_iter, done = search(inner, unconstrained(spec, begin), inner_data, method, maxiter)
        params = constrained(spec, x)
    value, scale = likelihood(inner, params, inner_data) if exact.usable(spec) else likelihood(spec, params, data)
    k = spec.n_estimated

    def problem(i: int) -> str | None:
        if np.isfinite(value[i]):
            return None if scale[i] > 0 else "the scale is zero"
        out = run_filter(spec, y[i : i + 1, : sizes[i]], params[i : i + 1], None if exog is None else exog[i : i + 1, : sizes[i]])
        return failure(out, 0, sizes[i]) or "no finite likelihood"

    problems = [problem(i) for i in range(b)]
    return [
        {
            "params": params[i].tolist(), "loglike": float(value[i]), "scale": float(scale[i]), "aic": float(2 * k - 2 * value[i]),
            "bic": float(k * np.log(sizes[i]) - 2 * value[i]), "n_obs": sizes[i], "n_params": k, "n_iter": int(n_iter[i]), "converged": bool(done[i]), "method": name,
            "error": problems[i] and f"optimization failed: {problems[i]}",
        }
        for i in range(b)
    ]


def _in_parts(run, spec: Spec, points: int, y: np.ndarray, params: np.ndarray, exog: np.ndarray | None) -> list[np.ndarray | None]:
    """run(y, params, exog) over as many series at a time as a pass has room for, with `points` points each."""
    step = max(1, MOST_POINTS // (points * max(spec.n_states**2, y.shape[1] * (1 + spec.n_exog))))
    told = []
    for i in range(0, len(y), step):
        told += list(run(y[i : i + step], params[i : i + step], None if exog is None else exog[i : i + step]))
    return [m if np.isfinite(m).all() else None for m in told]


def _repeated(a: np.ndarray | None, times: int) -> np.ndarray | None:
    return None if a is None else np.repeat(a, times, 0)


def hessians(spec: Spec, y: np.ndarray, params: np.ndarray, exog: np.ndarray | None) -> list[np.ndarray | None]:
    """Second differences of the log-likelihood at every series' parameters, all points of all series in one pass."""
    k = params.shape[1]
    unit = np.eye(k)
    moves = [np.zeros(k), *[sign * unit[i] for i in range(k) for sign in (1, -1)]]
    pairs = [(i, j) for i in range(k) for j in range(i)]
    for i, j in pairs:
        moves += [a * unit[i] + b * unit[j] for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
    moves = np.array(moves)

    def run(y, params, exog):
        h = np.maximum(1e-5, 1e-4 * np.maximum(1, np.abs(params)))
        points = (params[:, None] + moves * h[:, None]).reshape(-1, k)
        value = loglike(spec, _repeated(y, len(moves)), points, _repeated(exog, len(moves))).reshape(len(y), -1)
        out = np.zeros((len(y), k, k))
        for i in range(k):
            out[:, i, i] = (value[:, 1 + 2 * i] - 2 * value[:, 0] + value[:, 2 + 2 * i]) / h[:, i] ** 2
        for m, (i, j) in enumerate(pairs):
            v = value[:, 1 + 2 * k + 4 * m :][:, :4].T
            out[:, i, j] = out[:, j, i] = (v[0] - v[1] - v[2] + v[3]) / (4 * h[:, i] * h[:, j])
        return out

    return _in_parts(run, spec, len(moves), y, params, exog)


def hessian(spec: Spec, y: np.ndarray, params: np.ndarray, exog: np.ndarray | None) -> np.ndarray | None:
    """hessians() of one series."""
    return hessians(spec, y[None], params[None], None if exog is None else exog[None])[0]


def score_outers(spec: Spec, y: np.ndarray, params: np.ndarray, exog: np.ndarray | None) -> list[np.ndarray | None]:
    """The sums over every series' values of the outer products of their log-densities' gradients, all points in one pass.

    A concentrated scale is that of the whole series at each point, so its own movement counts. Gradients are central differences.
    """
    k = params.shape[1]

    def run(y, params, exog):
        h = 1e-5 * np.maximum(1, np.abs(params))
        moves = np.vstack([np.eye(k), -np.eye(k)])
        points = (params[:, None] + moves * h[:, None]).reshape(-1, k)
        out = run_filter(spec, _repeated(y, 2 * k), points, _repeated(exog, 2 * k), store=True)
        f = out["f"] * (out["scale"][:, None] if spec.concentrate_scale else 1.0)
        counted = np.arange(y.shape[1]) >= out["burn"][:, None]
        with np.errstate(all="ignore"):
            density = np.where(counted, -0.5 * (np.log(2 * np.pi * f) + out["v"] ** 2 / f), 0.0)
        density = np.where(np.isfinite(out["loglike"])[:, None], density, np.nan).reshape(len(y), 2, k, -1)
        scores = (density[:, 0] - density[:, 1]) / (2 * h[:, :, None])
        return scores @ scores.transpose(0, 2, 1)

    return _in_parts(run, spec, 2 * k, y, params, exog)
