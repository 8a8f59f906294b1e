"""Shapes and filtered images against brute force over arrays."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.operators import imagefilters as I
from echotide.operators import shape as S
from echotide.operators import texture

KEYS = ["scan_id"]


def frame(spark, regions, values=None):
    dims = regions[0].ndim
    names = ["ax", "sag", "cor"][:dims]
    rows = [(str(k), *map(int, at), float(a[tuple(at)])) for k, a in enumerate(regions) for at in np.argwhere(a)]
    return spark.createDataFrame(rows, f"scan_id string, {', '.join(f'{c} int' for c in names)}, value double").repartition(3)


def regions(dims):
    rng = np.random.default_rng(1)
    shape = (9, 12) if dims == 2 else (7, 6, 8)
    ball = np.sum(np.indices((31,) * dims) ** 0 * (np.indices((31,) * dims) - 15) ** 2, 0) <= 13**2
    one = np.zeros(shape, bool)
    one[(3,) * dims] = True
    return [rng.random(shape) < 0.5, rng.random(shape) < 0.9, ball, np.ones(shape, bool), one]


def mesh_points(a):
    """Midpoints between cells inside and outside."""
    out = []
    for at in map(tuple, np.argwhere(a)):
        for k, way in itertools.product(range(a.ndim), (-1, 1)):
            to = tuple(x + way * (j == k) for j, x in enumerate(at))
            if not (all(0 <= x < n for x, n in zip(to, a.shape)) and a[to]):
                out.append([x + way / 2 * (j == k) for j, x in enumerate(at)])
    return np.array(out)


@pytest.mark.parametrize("dims,spacing", [(2, (1.0, 1.0)), (2, (0.5, 1.75)), (3, (1.0, 1.0, 1.0)), (3, (2.0, 0.75, 1.25))])
def test_shape(spark, dims, spacing):
    arrays = regions(dims)
    got = {int(r["scan_id"]): r for r in S.shape_features(frame(spark, arrays), dims, KEYS, spacing).collect()}
    table = {r[0]: r for r in S.mesh_table(dims, spacing)}
    assert sorted(got) == list(range(len(arrays)))
    for k, a in enumerate(arrays):
        r, scale = got[k], np.array(spacing)
        values = np.sort(np.linalg.eigvalsh(np.cov((np.argwhere(a) * scale).T, bias=True)))[::-1]
        lengths = [r[n] for n in ("MajorAxisLength", "MinorAxisLength", "LeastAxisLength")[:dims]]
        assert lengths == pytest.approx(4 * np.sqrt(np.maximum(values, 0)), rel=1e-6, abs=1e-5)
        assert r["Elongation"] == pytest.approx(math.sqrt(values[1] / values[0]), rel=1e-6) if values[0] > 0 else r["Elongation"] is None
        points = mesh_points(a) * scale
        far = lambda p: max((float(((p - x) ** 2).sum(1).max()) for x in p), default=0.0) ** 0.5
        assert r["MaximumDiameter" if dims == 2 else "Maximum3DDiameter"] == pytest.approx(far(points), rel=1e-9)
        if dims == 3:
            for axis, name in S.PLANES.items():
                j = ["ax", "sag", "cor"].index(axis)
                assert r[name] == pytest.approx(max(far(points[points[:, j] == v]) for v in np.unique(points[:, j])), rel=1e-9)
        # Blocks one by one, each with its own place.
        padded, size, content = np.pad(a, 1), 0.0, 0.0
        for at in itertools.product(*(range(n - 1) for n in padded.shape)):
            code = sum(int(padded[tuple(x + (c >> (dims - 1 - j) & 1) for j, x in enumerate(at))]) << c for c in range(1 << dims))
            _, s, m, *v = table[code]
            size, content = size + s, content + (m + (np.array(at) * scale) @ np.array(v)) / dims
        assert [r["Perimeter" if dims == 2 else "SurfaceArea"], r["MeshSurface" if dims == 2 else "MeshVolume"]] == pytest.approx([size, content], rel=1e-9)
    ball = got[2]
    if set(spacing) == {1.0}:
        assert ball["MeshSurface" if dims == 2 else "MeshVolume"] == pytest.approx((arrays[2]).sum(), rel=0.02) and ball["Sphericity"] > 0.9


def test_meshes_of_known_blocks():
    """A corner, an edge, a face; opposite corners apart; and each closed: of all cells a region's mesh holds its cells less what is cut off."""
    t = {r[0]: r for r in S.mesh_table(3, (1.0, 1.0, 1.0))}
    corner, edge, face = 3**0.5 / 8, 0.5**0.5, 1.0
    assert [t[c][1] for c in (0, 255, 1, 254, 3, 15)] == pytest.approx([0, 0, corner, corner, edge, face])
    assert t[1 | 128][1] == pytest.approx(2 * corner) and t[1 | 8][1] == pytest.approx(2 * corner)
    flat = {r[0]: r[1] for r in S.mesh_table(2, (1.0, 1.0))}
    assert [flat[c] for c in (0, 1, 3, 6, 9, 7, 15)] == pytest.approx([0, 0.5**0.5, 1, 2**0.5, 2**0.5, 0.5**0.5, 0])


def test_farthest_and_hull():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 700):
        p = rng.integers(-20, 20, (n, 2))
        far = max(((a - b) ** 2).sum() for a in p for b in p[: n if n < 100 else 50]) if n < 100 else max(((p - a) ** 2).sum(1).max() for a in p)
        assert S.farthest(p.astype(float), 8) == far == S.farthest(S.hull(p).astype(float))
    assert S.farthest(np.zeros((0, 2))) == 0 and len(S.hull(np.array([[1, 1], [1, 1], [2, 2], [3, 3]]))) == 2


def conv(a, axis, kernel, border):
    n, out = a.shape[axis], np.zeros(a.shape)
    x, y = np.moveaxis(a, axis, 0), np.moveaxis(out, axis, 0)
    for to in range(n):
        for k, w in kernel.items():
            y[to] += w * x[border(to + k, n)]
    return out


@pytest.mark.parametrize("dims", [2, 3])
def test_filters(spark, dims):
    rng = np.random.default_rng(6)
    a = np.where(rng.random((6, 7) if dims == 2 else (4, 5, 6)) < 0.7, rng.integers(-3, 9, (6, 7) if dims == 2 else (4, 5, 6)) + 0.5, 0.0)
    names, spacing = ["ax", "sag", "cor"][:dims], (1.0, 0.5, 2.0)[:dims]
    config = {"imageType": {"Original": {}, "Wavelet": {}, "LoG": {"sigma": [0.8, 2.0]}, **dict.fromkeys(("Square", "SquareRoot", "Logarithm", "Exponential", "Gradient"))}}
    made = I.images(frame(spark, [a]), dims, KEYS, config, a.shape, spacing)
    assert list(made) == I.names(config, dims) and len(made) == 2**dims + 8
    edge, top = (lambda at, n: min(max(at, 0), n - 1)), np.abs(a).max()
    wrap = lambda at, n: 0 if at % (n + n % 2) == n else at % (n + n % 2)
    want = {"original": a, "square": a * a / top, "squareroot": np.sign(a) * np.sqrt(np.abs(a) * top), "logarithm": np.sign(a) * np.log(np.abs(a) + 1) * top / np.log(top + 1), "exponential": np.exp(np.log(top) / top * a)}
    want["gradient"] = np.sqrt(sum(conv(a, k, {1: 0.5 / s, -1: -0.5 / s}, edge) ** 2 for k, s in enumerate(spacing)))
    for sigma in (0.8, 2.0):
        total = 0
        for k in range(dims):
            x = a
            for j, s in enumerate(spacing):
                x = conv(x, j, I.gaussian(sigma, s)[j == k], edge)
            total = total + x * sigma**2
        want[f"log-sigma-{str(sigma).replace('.', '-')}-mm-3D"] = total
    low = dict(zip(range(3, -3, -1), I.COIF1))
    high = dict(zip(range(3, -3, -1), [-w if k % 2 == 0 else w for k, w in enumerate(reversed(I.COIF1))]))
    order = ["ax", "cor", "sag"] if dims == 3 else ["sag", "ax"]
    for letters in itertools.product("LH", repeat=dims):
        x = a
        for c, letter in zip(order, letters):
            x = conv(x, names.index(c), low if letter == "L" else high, wrap)
        want[f"wavelet-{''.join(letters)}"] = x
    for name, image in made.items():
        got = {tuple(r[c] for c in names): r["value"] for r in image.collect()}
        assert set(got) == {tuple(map(int, x)) for x in np.argwhere(a)}
        assert all(v == pytest.approx(want[name][at], rel=1e-9, abs=1e-9) for at, v in got.items()), name
    assert sum(low.values()) == pytest.approx(2**0.5) and sum(high.values()) == pytest.approx(0, abs=1e-9)


def test_gaussians():
    for sigma, step in ((1.0, 1.0), (2.5, 0.7), (0.3, 1.0)):
        g, d = I.gaussian(sigma, step)
        assert sum(g.values()) == pytest.approx(1) and sum(d.values()) == pytest.approx(0, abs=1e-9) and sum(w * (k * step) ** 2 for k, w in d.items()) == pytest.approx(2)


def test_images_of_a_configuration(spark):
    """Names by image and class; shape of the original only; zeros stay; missing arguments raise."""
    a = np.arange(1.0, 43.0).reshape(6, 7)
    cells = frame(spark, [a * 5]).select("scan_id", F.lit("r").alias("seg_id"), F.lit(0).alias("frame"), "ax", "sag", "value")
    config = {"setting": {"binWidth": 2}, "imageType": {"Original": {}, "Square": {}, "Wavelet": {}}, "featureClass": {"firstorder": ["Mean", "Maximum"], "shape2D": ["Perimeter"], "glszm": ["ZonePercentage"]}}
    kind = texture.Radiomics([("c", config)], 0.0, 5.0, 1.0, 2, [6, 7], [1.0, 1.0])
    got = {r["curve_name"]: r["value"] for r in kind.curves(cells, 2, ["scan_id", "seg_id", "frame"]).collect()}
    assert set(got) == set(kind.names()) and len(got) == 6 * 3 + 1 and "c_wavelet-LH_firstorder_Mean" in got and "c_original_shape2D_Perimeter" in got
    assert got["c_original_firstorder_Maximum"] == got["c_square_firstorder_Maximum"] == 43
    for bad in ({"imageType": {"LoG": {}}}, {"featureClass": {"shape": None}}):
        with pytest.raises(ValueError):
            texture.Radiomics([("c", bad)], 0.0, 5.0).wanted()
    with pytest.raises(ValueError, match="size"):
        texture.Radiomics([("c", {"imageType": {"Gradient": {}}})], 0.0, 5.0).wanted()
    flat = frame(spark, [np.ones((2, 2))]).withColumn("value", F.lit(0.0))
    assert {n: {r["value"] for r in d.collect()} for n, d in I.images(flat, 2, KEYS, {"imageType": dict.fromkeys(("Square", "Logarithm", "Exponential"))}).items()} == {"square": {0.0}, "logarithm": {0.0}, "exponential": {1.0}}


def test_filters_add_in_a_fixed_order(spark, monkeypatch):
    """Every bit is the same however cells and lines are dealt out: a value halfway between two roundings follows from it."""
    a = np.random.default_rng(8).random((9, 8))
    high = [-w if k % 2 == 0 else w for k, w in enumerate(reversed(I.COIF1))]
    place = lambda n, k: [0 if at % (n + n % 2) == n else at % (n + n % 2) for at in range(3 - k, 3 - k + n)]
    want = {}
    for f, s in itertools.product("LH", repeat=2):
        first, second = ((I.COIF1, high)["LH".index(x)] for x in (f, s))
        x = sum(a[:, place(8, k)] * first[k] for k in reversed(range(6)))
        want[f"wavelet-{f}{s}"] = sum(x[place(9, k)] * second[k] for k in range(6))
    for parts, block in ((1, I.BLOCK), (5, I.BLOCK), (3, 20)):
        monkeypatch.setattr(I, "BLOCK", block)
        for name, image in I.wavelet(frame(spark, [a]).repartition(parts), 2, KEYS, a.shape).items():
            assert {(r["ax"], r["sag"]): r["value"] for r in image.collect()} == {at: want[name][at] for at in np.ndindex(a.shape)}
