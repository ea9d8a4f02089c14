"""The likelihood and its helpers against published values and closed forms."""

import numpy as np
import pytest

from chronoloom.functions import estimate, exact
from chronoloom.functions import statespace as ss
from chronoloom.functions.spec import Spec
from chronoloom.operators import sarimax


def recursion(n, seed, coefs, legacy_first=1):
    np.random.seed(seed)
    e = np.random.randn(n)
    y = np.zeros(n)
    for t in range(legacy_first, n):
        y[t] = sum(c * y[t - k] for k, c in coefs.items()) + e[t - legacy_first]
    return y


def arma11():
    np.random.seed(42)
    e = np.random.randn(200)
    y = np.zeros(200)
    for t in range(1, 200):
        y[t] = 0.5 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    return y


def walk():
    np.random.seed(123)
    return np.cumsum(np.random.randn(300))


# Published parameters, log-likelihood, scale, AIC and BIC.
GOLDEN = [
    (recursion(200, 42, {1: 0.7}), (1, 0, 0), (0, 0, 0, 0), [0.6495192514842368], -268.3094933235068, 0.8542580528195881, 540.6189866470136, 547.2156213801096),
    (arma11(), (1, 0, 1), (0, 0, 0, 0), [0.4085292198994813, 0.33890835236729095], -268.78727295808716, 0.8582807021715679, 543.5745459161743, 553.4694980158184),
    (walk(), (1, 1, 1), (0, 0, 0, 0), [-0.67348292724661, 0.7277085023684363], -431.35538537623546, 1.0485467911902246, 868.7107707524709, 879.812101472643),
    (recursion(200, 99, {1: 0.5, 4: 0.4}, 4), (1, 0, 0), (1, 0, 0, 4), [0.7635486045775044, 0.2288213874765316], -290.74241130042174, 1.065333995828285, 587.4848226008435, 597.3797747004876),
]
# Parameters and log-likelihoods under the diffuse start.
DIFFUSE = [([0.6527425084139002], -267.19228070), ([0.41390307727487496, 0.33603638737455516], -266.87450273), ([-0.6441303822894944, 0.7000629128883827], -429.13454956), ([0.7671699347442852, 0.2322174491752982], -285.31691158)]


@pytest.mark.parametrize("case", range(4))
def test_loglike_at_published_parameters(case):
    y, order, seasonal, params, ll, scale, *_ = GOLDEN[case]
    out = ss.run_filter(Spec.of(order, seasonal), y[None], np.array([params]))
    assert out["loglike"][0] == pytest.approx(ll, abs=1e-6)
    assert out["scale"][0] == pytest.approx(scale, abs=1e-6)
    params, ll = DIFFUSE[case]
    assert ss.loglike(Spec.of(order, seasonal).diffuse(), y[None], np.array([params]))[0] == pytest.approx(ll, abs=1e-6)


@pytest.mark.parametrize("case", range(4))
@pytest.mark.parametrize("method", ["lbfgsb", "nelder-mead"])
def test_fit_finds_published_optimum(case, method):
    y, order, seasonal, params, ll, _, aic, bic = GOLDEN[case]
    got = estimate.fit(Spec.of(order, seasonal), y[None], method=method)[0]
    assert got["params"] == pytest.approx(params, abs=1e-2)
    assert got["loglike"] == pytest.approx(ll, abs=1e-4)
    assert (got["aic"], got["bic"]) == (pytest.approx(aic, abs=1e-3), pytest.approx(bic, abs=2e-2))  # the published BIC leaves out differenced rows
    assert got["converged"]


def test_a_batch_fits_like_its_members():
    y = np.array([recursion(120, i, {1: 0.7}) for i in range(8)])
    spec = Spec.of((1, 0, 1))
    for one, many in zip([estimate.fit(spec, row[None])[0] for row in y], estimate.fit(spec, y)):
        assert many["loglike"] == pytest.approx(one["loglike"], abs=1e-6)


def test_settled_covariances_change_nothing(monkeypatch):
    y, spec, p = walk()[None], Spec.of((1, 1, 1)), np.array([[-0.6, 0.7]])
    settled = ss.loglike(spec, y, p)[0]
    monkeypatch.setattr(ss, "SETTLE_CLOSE", -1.0)
    assert settled == pytest.approx(ss.loglike(spec, y, p)[0], abs=1e-7)


def test_transforms_go_back_and_forth():
    x = np.random.default_rng(1).normal(size=(50, 5))
    ar = ss.to_stationary(x)
    assert ss.from_stationary(ar) == pytest.approx(x, abs=1e-8)
    for row in ar:
        assert np.abs(np.roots([1, *-row])).max() < 1


def test_polynomials_multiply():
    got = ss.polynomial(np.array([[0.5, 0.2]]), np.array([[0.4, -0.1]]), 4, -1.0)[0]
    assert got == pytest.approx(np.convolve([1, -0.5, -0.2], [1, 0, 0, 0, -0.4, 0, 0, 0, 0.1]))


def test_stationary_covariance_solves_its_equation():
    cov, good = ss.stationary_cov(np.array([[[0.8]], [[1.0]]]), np.ones((2, 1, 1)))
    assert cov[0, 0, 0] == pytest.approx(1 / (1 - 0.64)) and list(good) == [True, False]
    t, _, r = ss.matrices(Spec.of((2, 0, 2)), np.array([[0.5, 0.2, 0.4, 0.1]]))
    q = r[:, :, None] * r[:, None, :]
    p, _ = ss.stationary_cov(t, q)
    assert p == pytest.approx(t @ p @ t.transpose(0, 2, 1) + q)


def test_forecast_of_ar1_is_its_closed_form_and_variance_rises():
    y, phi = recursion(200, 42, {1: 0.7}), 0.65
    mean, var, _ = ss.forecast(Spec.of((1, 0, 0)).diffuse(), y[None], np.array([[phi]]), 5)
    scale = ((y[1:] - phi * y[:-1]) ** 2).mean()
    assert mean[0] == pytest.approx([phi**h * y[-1] for h in range(1, 6)], abs=1e-6)
    assert var[0] == pytest.approx([scale * (1 - phi ** (2 * h)) / (1 - phi**2) for h in range(1, 6)], rel=1e-5)
    _, var, _ = ss.forecast(Spec.of((1, 1, 1), (1, 1, 1, 12)).diffuse(), walk()[None], np.array([[0.3, -0.4, 0.2, -0.5]]), 30)
    assert (np.diff(var[0]) >= -1e-9).all()


def test_a_given_scale_enters_variances_once():
    y = recursion(200, 42, {1: 0.7})[None]
    free, given = Spec.of((1, 0, 0)).diffuse(), Spec.of((1, 0, 0), concentrate_scale=False).diffuse()
    scale = ss.run_filter(free, y, np.array([[0.65]]))["scale"][0]
    a, b = ss.forecast(free, y, np.array([[0.65]]), 3)[1], ss.forecast(given, y, np.array([[0.65, scale]]), 3)[1]
    assert a == pytest.approx(b, rel=1e-3)


def test_special_paths():
    y = recursion(200, 42, {1: 0.7})[None]
    got = estimate.fit(Spec.of((3, 0, 0)), y)[0]
    assert (got["method"], got["n_iter"], got["converged"]) == ("burg-direct", 0, True)
    got = estimate.fit(Spec.of((1, 0, 1)), y, maxiter=0)[0]
    assert got["n_iter"] == 0 and not got["converged"]
    with pytest.raises(RuntimeError):
        estimate.fit(Spec.of((1, 0, 0)), y, method="newton")


def test_regression_finds_its_slope():
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.5 * y[t - 1] + 0.5 * rng.normal()
    got = estimate.fit(Spec.of((1, 0, 0), n_exog=1), (y + 2 * x)[None], x[None, :, None])[0]
    assert got["params"][0] == pytest.approx(2, abs=0.1) and got["params"][1] == pytest.approx(0.5, abs=0.15)


def test_hessian_of_a_likelihood_is_negative():
    y, *_ = GOLDEN[1]
    h = estimate.hessian(Spec.of((1, 0, 1)), y, np.array(GOLDEN[1][3]), None)
    assert (np.linalg.eigvalsh(h) < 0).all()


@pytest.mark.parametrize(
    ("order", "seasonal", "params"),
    [
        ((1, 0, 0), (0, 0, 0, 0), [0.6]), ((0, 0, 1), (0, 0, 0, 0), [0.999]), ((2, 0, 2), (0, 0, 0, 0), [0.5, 0.2, 0.4, 0.1]), ((0, 0, 1), (0, 0, 1, 12), [-0.6, -0.9]),
        ((1, 0, 1), (1, 0, 1, 12), [0.3, -0.4, 0.2, -0.5]), ((3, 0, 0), (1, 0, 0, 4), [0.2, 0.1, -0.3, 0.5]),
    ],
)
def test_likelihood_without_a_loop_is_the_filters(order, seasonal, params):
    rows = np.random.default_rng(2).normal(size=(3, 90))
    length = np.array([90, 77, 60])
    padded = rows * (np.arange(90) < length[:, None])
    spec = Spec.of(order, seasonal)
    got, scale = exact.arma_loglike(spec, padded, length, np.tile(params, (3, 1)))
    for i, n in enumerate(length):
        want = ss.run_filter(spec, rows[i : i + 1, :n], np.array([params]))
        assert got[i] == pytest.approx(want["loglike"][0], abs=1e-6) and scale[i] == pytest.approx(want["scale"][0], rel=1e-8)
    given = Spec.of(order, seasonal, concentrate_scale=False)
    one = exact.arma_loglike(given, rows[:1], length[:1], np.array([[*params, 1.7]]))[0][0]
    assert one == pytest.approx(ss.loglike(given, rows[:1], np.array([[*params, 1.7]]))[0], abs=1e-6)


def test_series_of_different_lengths_fit_like_alone():
    rows = [recursion(n, n, {1: 0.6, 2: 0.2}) for n in (90, 95, 99)]
    padded = np.array([np.r_[y, np.zeros(99 - len(y))] for y in rows])
    for spec in (Spec.of((2, 0, 1)), Spec.of((1, 1, 1)), Spec.of((0, 1, 1), (0, 1, 1, 4))):
        many = estimate.fit(spec, padded, method="lbfgsb-multi", length=np.array([90, 95, 99]))
        for y, got in zip(rows, many):
            one = estimate.fit(spec, y[None], method="lbfgsb-multi")[0]
            assert (got["loglike"], got["n_obs"]) == (pytest.approx(one["loglike"], abs=1e-6), len(y))


def test_more_starts_are_never_worse():
    y = recursion(200, 7, {1: 0.5})[None]
    spec = Spec.of((1, 0, 1), (0, 0, 1, 4))
    plain, multi, restarted = (estimate.fit(spec, y, method=m)[0] for m in ("lbfgsb-strict", "lbfgsb-multi", "lbfgs"))
    assert min(multi["loglike"], restarted["loglike"]) >= plain["loglike"] - 1e-6 and multi["n_iter"] <= 500


def test_two_seasonal_differences():
    y = np.cumsum(np.random.default_rng(3).normal(size=80)) + np.arange(80) % 4
    spec, p = Spec.of((1, 1, 0), (0, 2, 1, 4)), np.array([[0.3, -0.4]])
    w = estimate.differenced(y[None], spec)
    inner = Spec.of((1, 0, 0), (0, 0, 1, 4))
    assert ss.loglike(spec, y[None], p)[0] == pytest.approx(exact.arma_loglike(inner, w, np.array([w.shape[1]]), p)[0][0], abs=1e-3)
    assert np.isfinite(ss.forecast(spec.diffuse(), y[None], p, 6)[0]).all() and estimate.fit(spec, y[None])[0]["error"] is None


def counted(monkeypatch, module, name):
    """A list of the numbers of points of every call of module.name from now on."""
    calls, real = [], getattr(module, name)

    def call(spec, first, *rest, **more):
        calls.append(len(first))
        return real(spec, first, *rest, **more)

    monkeypatch.setattr(module, name, call)
    return calls


def test_simplexes_of_a_batch_go_in_step(monkeypatch):
    y, spec = np.array([recursion(82, i, {1: 0.7}) + 3 for i in range(40)]), Spec.of((1, 0, 1))
    most = np.r_[0, 1, 5, np.full(37, 200)]
    data, x = estimate.Data(y, None, np.full(40, 82)), np.random.default_rng(1).normal(size=(40, 2))
    alone = [estimate.nelder_mead(spec, x[i : i + 1], data[i : i + 1], most[i : i + 1]) for i in range(40)]
    calls = counted(monkeypatch, estimate, "likelihood")
    many = estimate.nelder_mead(spec, x, data, most)
    for k in range(4):
        assert many[k].tolist() == [one[k].tolist()[0] for one in alone]
    assert many[3].sum() > 30 and not many[3][:3].any()
    assert len(calls) <= 1 + 2 * many[2].max()  # as many passes as the longest search takes, not as all of them do


@pytest.mark.parametrize(("order", "params"), [((1, 0, 0), [0.6]), ((0, 0, 1), [-0.999]), ((1, 0, 1), [0.9999, -0.98]), ((1, 0, 1), [-0.5, 0.3])])
def test_first_orders_in_one_pass_over_time(order, params, monkeypatch):
    rows, spec = np.random.default_rng(2).normal(size=(40, 90)) + 2, Spec.of(order)
    length = np.r_[1, 2, 60, np.full(37, 90)]
    padded = rows * (np.arange(90) < length[:, None])
    transforms = counted(monkeypatch, exact, "responses")
    got, scale = exact.arma_loglike(spec, padded, length, np.tile(params, (40, 1)))
    assert not transforms
    for i in (1, 2, 3, 39):
        want = ss.run_filter(spec, rows[i : i + 1, : length[i]], np.array([params]))
        assert got[i] == pytest.approx(want["loglike"][0], abs=1e-7) and scale[i] == pytest.approx(want["scale"][0], rel=1e-8)
    one, _ = exact.arma_loglike(spec, padded[:3], length[:3], np.tile(params, (3, 1)))
    assert one.tolist() == got[:3].tolist()  # what else is in the batch does not matter
    border = exact.arma_loglike(spec, padded[:3], length[:3], np.tile([1.0] * len(params), (3, 1)))[0]
    assert np.isnan(border).all() == (order[0] == 1)


def test_information_of_a_batch_takes_one_pass(monkeypatch):
    rng, spec = np.random.default_rng(4), Spec.of((1, 0, 1), n_exog=1)
    y, x, p = rng.normal(size=(30, 82)), rng.normal(size=(30, 82, 1)), np.c_[rng.normal(size=30), rng.uniform(-0.9, 0.9, (30, 2))]
    for kind, points in (("hessian", 1 + 2 * 3 + 4 * 3), ("opg", 2 * 3)):
        alone = [sarimax.INFORMATION[kind](spec, y[i : i + 1], p[i : i + 1], x[i : i + 1])[0] for i in range(30)]
        with monkeypatch.context() as m:
            calls = [counted(m, estimate, name) for name in ("loglike", "run_filter")]
            many = sarimax.INFORMATION[kind](spec, y, p, x)
        assert sum(calls, []) == [30 * points]
        assert all((a == b).all() for a, b in zip(many, alone))
        monkeypatch.setattr(estimate, "MOST_POINTS", 82 * 2 * points * 7)  # seven series a pass
        assert all((a == b).all() for a, b in zip(sarimax.INFORMATION[kind](spec, y, p, x), alone))
        monkeypatch.undo()
    y[3, 5] = np.nan
    assert [h is None for h in estimate.hessians(spec, y, p, x)] == [i == 3 for i in range(30)]
