import pytest

from chronoloom.functions.spec import Spec


@pytest.mark.parametrize(
    ("order", "seasonal", "message"),
    [
        ((21, 0, 0), (0, 0, 0, 0), "AR order p=21 exceeds maximum"), ((0, 0, 21), (0, 0, 0, 0), "MA order q=21 exceeds"), ((0, 4, 0), (0, 0, 0, 0), "d=4 exceeds"),
        ((1, 0, 0), (5, 0, 0, 4), "P=5 exceeds"), ((1, 0, 0), (1, 0, 0, 1), "requires seasonal period s >= 2"), ((1, 0, 0), (0, 1, 0, 0), "requires seasonal period"),
        ((1, 0, 0), (0, 0, 0, 366), "s=366 exceeds"), ((1, 0, 0), (0, 3, 0, 4), "D=3 exceeds"), ((1, 0, 0), (4, 0, 4, 365), "state dimension"),
    ],
)
def test_orders_out_of_range(order, seasonal, message):
    with pytest.raises(ValueError, match=message):
        Spec.of(order, seasonal)


def test_dimensions_and_names():
    spec = Spec.of((2, 1, 1), (1, 1, 2, 12), n_exog=1, concentrate_scale=False)
    assert (spec.n_ar, spec.n_ma, spec.n_diff, spec.n_states, spec.n_params, spec.n_estimated) == (14, 25, 13, 39, 8, 8)
    assert spec.names == ["x1", "ar.L1", "ar.L2", "ma.L1", "ar.S.L12", "ma.S.L12", "ma.S.L24", "sigma2"]
    assert Spec.of((20, 0, 0)).n_params == 20


def test_parameters_are_checked():
    with pytest.raises(ValueError, match="parameter length mismatch"):
        Spec.of((1, 0, 0)).check_params([0.1, 0.2])
    with pytest.raises(ValueError, match="variance sigma2 must be positive"):
        Spec.of((1, 0, 0), concentrate_scale=False).check_params([0.1, 0.0])
