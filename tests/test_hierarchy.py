"""Sums and forecasts over the levels of a panel's ids."""

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import hierarchy
from chronoloom.sources import panel

LEVELS = ["a", "b"]


@pytest.fixture(scope="module")
def leaves(spark):
    """Ids with a null, a name that two parents share, and a constant series."""
    rows = [(a, b, t, 5.0 if b == "flat" else float((t * 7 + i * 3) % 11)) for i, (a, b) in enumerate((("x", "u"), ("x", "flat"), ("y", "u"), (None, "v"), ("y", None))) for t in range(30)]
    return spark.createDataFrame(rows, "a string, b string, t int, y double")


def test_levels_add_up_and_null_ids_stay_apart(leaves):
    got = {(r.level, r.a, r.b, r.t): r.y for r in hierarchy.rolled_up(leaves, LEVELS, "t", "y").collect()}
    rows = leaves.collect()
    want = {}
    for r in rows:
        for key in ((0, None, None, r.t), (1, r.a, None, r.t), (2, r.a, r.b, r.t)):
            want[key] = want.get(key, 0.0) + r.y
    assert got == pytest.approx(want) and len(got) == 30 * (1 + 3 + 5)


def test_forecasts_below_add_up(leaves):
    nodes = hierarchy.rolled_up(leaves, LEVELS, "t", "y")
    ahead = hierarchy.ar1_with_mean(nodes, ["level", *LEVELS], 4)
    got = hierarchy.reconciled(ahead, nodes, LEVELS).collect()
    assert len(got) == 9 * 4
    for h in range(1, 5):
        at = [r for r in got if r.h == h]
        low = [r for r in at if r.level == 2]
        assert all(r.bottom_up == pytest.approx(r.mean) for r in low)
        (top,) = [r for r in at if r.level == 0]
        assert top.bottom_up == pytest.approx(sum(r.mean for r in low)) and top.top_down == pytest.approx(top.mean)
        for level in (1, 2):
            assert sum(r.top_down for r in at if r.level == level) == pytest.approx(top.mean)
        for r in at:
            if r.level == 1:
                assert r.bottom_up == pytest.approx(sum(s.mean for s in low if s.a == r.a))
        assert [r.mean for r in low if r.b == "flat"] == [5.0]


def test_empty_and_zero_panels(leaves):
    for rows in (leaves.where("false"), leaves.withColumn("y", F.lit(0.0))):
        nodes = hierarchy.rolled_up(rows, LEVELS, "t", "y")
        got = hierarchy.reconciled(hierarchy.ar1_with_mean(nodes, ["level", *LEVELS], 2), nodes, LEVELS).collect()
        assert all((r.mean, r.bottom_up, r.top_down) == (0.0, 0.0, None) for r in got)


def test_gaps_are_filled_over_the_whole_span(spark):
    rows = spark.sql("SELECT * FROM VALUES ('p', timestamp '2020-01-01', 1D), ('p', timestamp '2020-03-01', 2D), ('q', timestamp '2020-02-01', 3D) AS v(id, bucket, y)")
    got = sorted((r.id, r.bucket.month, r.y) for r in panel.gap_filled(rows, ["id"], "month", whole=True).collect())
    assert got == [("p", 1, 1.0), ("p", 2, 0.0), ("p", 3, 2.0), ("q", 1, 0.0), ("q", 2, 3.0), ("q", 3, 0.0)]
    assert panel.gap_filled(rows.where("false"), ["id"], "month", whole=True).collect() == []
