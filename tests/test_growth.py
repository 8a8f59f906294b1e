"""Work and memory of steps that grew too fast."""

import numpy as np
from pyspark.sql import functions as F

from echotide.operators import fit
from echotide.sources import tables

CURVE = "scan_id string, seg_id string, window_ix int, curve_name string, frame int, time_s double, value double"


def noisy(n, frames=60):
    y = np.random.default_rng(5).exponential(1.0, (n, frames))
    return np.tile(np.arange(frames) * 0.5, (n, 1)), y, np.full(n, frames)


def test_model_is_computed_once_a_step(monkeypatch):
    """Exponentials of curves are as many as steps, starts and results; there were three a step."""
    steps, models, solve, exp = [0], [0], np.linalg.solve, np.exp

    def solved(a, b):
        steps[0] += len(a)
        return solve(a, b)

    def raised(x, *args, **kw):
        models[0] += np.size(x) // 60 if np.ndim(x) == 2 else 0
        return exp(x, *args, **kw)

    monkeypatch.setattr(np.linalg, "solve", solved)
    monkeypatch.setattr(np, "exp", raised)
    fit.fit(*noisy(40))
    assert steps[0] > 40 * 100 and models[0] <= steps[0] + 40 * 11


def test_a_curve_alone_fits_as_among_others():
    t, y, n = noisy(30)
    assert np.array_equal(fit.fit(t, y, n), np.concatenate([fit.fit(t[k : k + 1], y[k : k + 1], n[k : k + 1]) for k in range(30)]), equal_nan=True)


def test_wide_curves_take_one_aggregation(spark):
    """Values of a frame meet before the shuffle, as one row of a column per curve; rows of a name each did not."""
    rows = [("s", "r", None, c, k, k * 0.5, v) for k in range(4) for c, v in (("a", float(k)), ("b", None), ("c", -1.0)) if (k, c) != (2, "a")]
    long = spark.createDataFrame(rows, CURVE)
    wide = tables.curves_wide(long, ["a", "b", "x.y"])
    assert [tuple(r) for r in wide.orderBy("frame").collect()] == [("s", "r", None, k, k * 0.5, None if k == 2 else float(k), None, None) for k in range(4)]
    plan = tables.curves_wide(long.where(F.col("frame") >= 0), ["a", "b"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") + plan.count("SortAggregate") == 2
