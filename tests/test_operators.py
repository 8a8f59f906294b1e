"""Operators against small NumPy definitions, properties and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echotide.functions import first_order
from echotide.operators import curves as C
from echotide.operators import fit, paramap, preprocess, quantify, windows

CURVE = "scan_id string, seg_id string, window_ix int, curve_name string, frame int, time_s double, value double"


def mask_table(spark, grid, seg="roi"):
    at = np.argwhere(np.ones_like(grid))
    names = ["ax", "sag", "cor"][: grid.ndim]
    return spark.createDataFrame([("s", seg, *map(int, p), int(grid[tuple(p)])) for p in at], "scan_id string, seg_id string, " + ", ".join(f"{c} int" for c in names) + ", m smallint")


def curve_table(spark, values, step=0.5, name="TIC", scan="s"):
    return spark.createDataFrame([(scan, "roi", None, name, i, i * step, None if v is None else float(v)) for i, v in enumerate(values)], CURVE)


def stats(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    return df.agg(*(c.alias(n) for n, c in first_order(F.col("value")).items())).first().asDict()


def test_first_order_by_definition(spark):
    v = np.array([1.0, 2.0, 2.5, 7.0, 3.0, 0.0, 4.25])
    s = stats(spark, v)
    p = v[v > 0] / v.sum()
    m = v - v.mean()
    expected = {"Mean": v.mean(), "Std": v.std(), "Max": 7, "Min": 0, "Median": 2.5, "Variance": v.var(), "Skewness": (m**3).mean() / v.var() ** 1.5, "Kurtosis": (m**4).mean() / v.var() ** 2 - 3, "Range": 7, "InterquartileRange": np.percentile(v, 75) - np.percentile(v, 25), "Entropy": -(p * np.log(p)).sum(), "Energy": (v**2).sum()}
    assert {k: pytest.approx(x) for k, x in expected.items()} == s


def test_first_order_edges(spark):
    flat = stats(spark, [3.0] * 5)
    assert (flat["Skewness"], flat["Kurtosis"]) == (0.0, 3.0) and flat["Entropy"] == pytest.approx(np.log(5))
    assert stats(spark, [1.0, -2.0, 4.0])["Entropy"] == -np.inf
    assert np.isnan(stats(spark, [0.0, 0.0])["Entropy"])
    assert np.isnan(stats(spark, [1.0, np.nan, 3.0])["Min"]) and np.isnan(stats(spark, [1.0, np.nan, 3.0])["Max"])


@pytest.mark.parametrize("shape, step", [((9, 11), (3, 2)), ((7, 6, 8), (2, 3, 2))])
def test_windows_by_brute_force(spark, shape, step):
    rng = np.random.default_rng(len(shape))
    grid = (rng.random(shape) < 0.5).astype(int)
    mask = mask_table(spark, grid)
    at = np.argwhere(grid > 0)
    starts = [range(a, z, s) for a, z, s in zip(at.min(0), at.max(0), step)]
    kept = []
    for where in np.array(np.meshgrid(*starts, indexing="ij")).reshape(len(shape), -1).T:
        part = grid[tuple(slice(w, w + s) for w, s in zip(where, step))]
        if (part == 1).mean() > 0.2:
            kept.append(tuple(map(int, where)))
    names = ["ax", "sag", "cor"][: len(shape)]
    found = windows.window_grid(mask, step)
    rows = sorted((r["window_ix"], *(r[f"{c}_start"] for c in names)) for r in found.collect())
    assert rows == [(i, *w) for i, w in enumerate(kept)]
    cells = {(r["window_ix"], *(r[c] for c in names)) for r in windows.window_cells(mask, found, step).collect()}
    assert cells == {(i, *map(int, p)) for i, w in enumerate(kept) for p in np.argwhere(np.ones(shape)) if all(a <= x <= a + s for a, x, s in zip(w, p, step))}


def test_window_edges(spark):
    thin = np.zeros((5, 5), int)
    thin[2] = 1
    assert windows.window_grid(mask_table(spark, thin), (2, 2)).count() == 0
    assert windows.window_grid(mask_table(spark, np.full((5, 5), 255)), (2, 2)).count() == 0
    with pytest.raises(ValueError):
        windows.steps([1, 1], [50, 50], [1, 1])
    assert windows.steps([3, 3], [50, 0], [0.5, 1.0]) == [3, 3]


def test_curves_of_a_constant(spark):
    grid = np.ones((6, 6), int)
    voxels = spark.createDataFrame([("s", f, x, y, 4.0) for f in range(3) for x in range(6) for y in range(6)], "scan_id string, frame int, ax int, sag int, value double")
    mask = mask_table(spark, grid)
    assert {r["value"] for r in C.roi_curves(voxels, mask, 2).collect()} == {4.0}
    w = C.window_curves(voxels, mask, (2, 2))
    assert {r["value"] for r in w.collect()} == {4.0}
    maps = paramap.paramap(quantify.first_order_full(w), mask, windows.window_grid(mask, (2, 2)), (2, 2), ["Mean_full_TIC"])
    assert {r["value"] for r in maps.collect()} == {4.0}
    assert {r["index"] for r in paramap.color_index(maps).collect()} == {None}
    empty = C.roi_curves(voxels, mask_table(spark, np.zeros((6, 6), int)), 2)
    assert [r["value"] for r in empty.collect()] == [None] * 3
    with pytest.raises(ValueError):
        C.roi_curves(voxels, mask, 2, [C.tic, C.tic])


def test_gaps(spark):
    filled = lambda v: [r["value"] for r in C.fill_gaps(curve_table(spark, v)).orderBy("frame").collect()]
    assert filled([None, 2, None, None, 5]) == [2, 2, 2, 2, 5]
    assert filled([None, None, 3]) == [None, None, 3]
    assert filled([1]) == [1]


def test_select_times(spark):
    c = curve_table(spark, range(10))
    assert [r["frame"] for r in quantify.select_times(c, 1.0, 2.0).orderBy("frame").collect()] == [2, 3, 4]
    assert quantify.select_times(c).count() == 10
    with pytest.raises(ValueError):
        quantify.select_times(c, 3, 2)
    with pytest.raises(Exception, match="beyond"):
        quantify.select_times(c, 0, 11).collect()


def test_dte_follows_slices(spark):
    for peak in (3, 8, 9, 14, 18):
        v = np.arange(20) % 7 + 0.0
        v[peak] = 50
        pre, post = max(peak - 5, 0), min(peak + 5, 19)
        a, b = v[pre - 4 : pre + 1], v[post : post + 5]
        expected = np.median(a) - np.median(b) if len(a) else None
        assert quantify.dte(curve_table(spark, v)).first()["value"] == expected


def test_wash_rates_and_sections(spark):
    v = [0, 1, 2, 3, 4, 3.5, 3, 2.5, 2]
    c = curve_table(spark, v)
    w = {r["key"]: r["value"] for r in quantify.wash_rates(c, quantify.observed_peaks(c)).collect()}
    assert w == {"WashInRate_TIC": pytest.approx(1.0), "WashOutRate_TIC": pytest.approx(-0.5)}
    first = curve_table(spark, [5, 1, 1, 1])
    w = {r["key"]: r["value"] for r in quantify.wash_rates(first, quantify.observed_peaks(first)).collect()}
    assert w["WashInRate_TIC"] is None
    failed = quantify.observed_peaks(c).withColumn("pe", F.lit(None).cast("int"))
    assert all(r["value"] is None for r in quantify.wash_rates(c, failed).collect())
    keys = {r["key"] for r in quantify.cmus_first_order(first, quantify.observed_peaks(first)).collect()}
    assert any(k.startswith("PostFlash_") for k in keys) and not any(k.startswith("WashIn_") for k in keys)


def test_fit_of_many_curves():
    """No start is right for all curves; none of 2,000 ends away from its curve."""
    rng = np.random.default_rng(1)
    t = np.tile(np.arange(120) * 0.5, (2000, 1))
    p = np.column_stack([np.full(2000, 10.0), rng.uniform(0.5, 2.5, 2000), rng.uniform(0.2, 0.9, 2000), rng.uniform(0, 3, 2000)])
    p[0, 1:] = 0.5, 0.5, 2.6875
    y = fit.model(t, p)
    shifted = (y - y.min(1, keepdims=True)) / np.ptp(y, axis=1)[:, None]
    found = fit.fit(t, y, np.full(2000, 120))
    assert np.abs(fit.model(t, found[:, [0, 5, 6, 4]]) - shifted).max() < 0.02


@settings(max_examples=25, deadline=None)
@given(st.floats(0.5, 2.5), st.floats(0.2, 0.9), st.floats(0.0, 3.0))
def test_fit_recovers_parameters(mu, sigma, t0):
    t = np.arange(120) * 0.5
    y = fit.model(t[None], np.array([[10.0, mu, sigma, t0]]))
    if y.argmax() == 0:
        return
    found = fit.fit(t[None], y, np.array([120]))[0]
    again = fit.model(t[None], np.array([[found[0], found[5], found[6], found[4]]]))
    shifted = (y - y.min()) / (y - y.min()).max()
    assert np.abs(again - shifted).max() < 0.02


def test_fit_edges():
    t = np.arange(10.0)[None]
    for y in (np.ones(10), np.zeros(10), np.arange(10.0)[::-1], np.array([np.nan] * 10)):
        assert np.isnan(fit.fit(t, y[None], np.array([10]))).all()
    assert np.isnan(fit.fit(t, np.arange(10.0)[None], np.array([1]))).all()


def test_fill_holes(spark):
    ring = np.array([[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 1, 0]])
    got = {(r["ax"], r["sag"]): r["m"] for r in preprocess.fill_holes(mask_table(spark, ring), 2).collect()}
    ring[2, 2] = 1
    assert got == {tuple(map(int, p)): int(ring[tuple(p)]) for p in np.argwhere(np.ones_like(ring))}
    tube = np.zeros((3, 3, 4), int)
    tube[:, :, 1:3] = 1
    tube[1, 1, :] = 0
    filled = preprocess.fill_holes(mask_table(spark, tube), 3)
    assert filled.where("ax = 1 and sag = 1 and cor = 1 and m = 1").count() == 1


@pytest.mark.parametrize("interp", ["nearest", "linear", "cubic"])
def test_resampling(spark, interp):
    rows = [("s", 0, x, y, 2.0 * x + 3.0 * y) for x in range(6) for y in range(5)]
    v = spark.createDataFrame(rows, "scan_id string, frame int, ax int, sag int, value double")
    same = preprocess.resample(v, [6, 5], (1, 1), (1, 1), interp)
    assert {(r["ax"], r["sag"]): pytest.approx(r["value"], abs=1e-9) for r in same.collect()} == {(x, y): z for _, _, x, y, z in rows}
    finer = preprocess.resample(v, [6, 5], (1, 1), (0.5, 1), interp)
    assert finer.count() == 60
    if interp == "linear":
        assert {r["value"] for r in finer.where("ax = 3 and sag = 1").collect()} == {6.0}
    assert preprocess.new_size(5, 1, 2) == 2 and preprocess.new_size(7, 1, 2) == 4
    with pytest.raises(ValueError):
        preprocess.resample(v, [6, 5], (1, 1), (1, 1), "quintic")


def test_standardize_constant(spark):
    v = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 5.0), ("b", 0, 1.0), ("b", 1, 3.0)], "scan_id string, frame int, value double")
    assert sorted((r["scan_id"], r["value"]) for r in preprocess.standardize(v).collect()) == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0)]


def test_infinite_window_values(spark):
    q = spark.createDataFrame([("s", "roi", i, "k", v) for i, v in enumerate([1.0, 4.0, float("inf"), float("-inf"), float("nan")])], "scan_id string, seg_id string, window_ix int, key string, value double")
    assert [r["value"] for r in paramap.finite_values(q).orderBy("window_ix").collect()] == [1.0, 4.0, 4.0, 1.0, None]


def test_power_spectrum_of_many_lines(spark):
    """Lines by hundreds, of unlike length, with gaps, nulls and samples beyond the transform, against NumPy."""
    from echotide.operators.spectrum import power_spectrum

    rng, n, rows, want = np.random.default_rng(5), 64, [], {}
    for scan, count in (("a", 150), ("b", 3)):
        powers = []
        for line in range(count):
            size = int(rng.integers(3, 90)) if line else 1
            x = rng.normal(size=size)
            rows += [(scan, line, k, None if k == 3 else float(v)) for k, v in enumerate(x)]
            w = np.hanning(size) if size > 1 else np.ones(1)
            x[3:4] = 0
            powers.append(np.abs(np.fft.fft((x * w / np.sqrt(np.mean(w**2)))[:n], n)) ** 2 * size**2)
        want[scan] = np.mean(powers, 0)[16:48]
    df = spark.createDataFrame(rows, "scan_id string, line int, sample int, value double").repartition(7)
    got = {(r["scan_id"], r["bin"]): r["power"] for r in power_spectrum(df, 0.25, 0.75, 1.0, n).collect()}
    assert len(got) == 2 * 32 and all(got[s, k + 16] == pytest.approx(v, rel=1e-9) for s, p in want.items() for k, v in enumerate(p))


def test_splines_by_solving(spark):
    """Coefficients from recursions solve the mirrored system; samples are met; a cell alone stays."""
    rng = np.random.default_rng(2)
    basis = lambda x: np.where(np.abs(x) < 1, 2 / 3 - x**2 + np.abs(x) ** 3 / 2, np.where(np.abs(x) < 2, (2 - np.abs(x)) ** 3 / 6, 0.0))
    for n in (1, 2, 3, 4, 17, 60):
        x = rng.normal(size=(5, n))
        m = np.zeros((n, n))
        for k in range(n):
            for j in range(k - 2, k + 3):
                spot = abs(j) if n > 1 else 0
                m[k, min(spot, abs(2 * (n - 1) - spot)) if n > 1 else 0] += basis(np.array(float(k - j)))
        assert preprocess.spline_coefficients(x) == pytest.approx(np.linalg.solve(m, x.T).T if n > 1 else x)
        assert preprocess.spline_values(x, 1.0, 1.0) == pytest.approx(x)
        assert preprocess.spline_values(x, 1.0, 0.37).shape == (5, preprocess.new_size(n, 1.0, 0.37))
