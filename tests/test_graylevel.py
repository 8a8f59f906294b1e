"""Gray-level matrices and connected components against brute force over arrays."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.operators import components as C
from echotide.operators import graylevel as G
from echotide.operators import texture

KEYS = ["scan_id", "frame"]


def grids(dims, n=3, seed=0, levels=4):
    """Arrays of levels, 0 outside the mask."""
    rng = np.random.default_rng(seed)
    shape = (9, 11) if dims == 2 else (6, 5, 7)
    return [np.where(rng.random(shape) < 0.8, rng.integers(1, levels + 1, shape), 0) for _ in range(n)] + [np.ones(shape, int), np.pad(np.array([[2]] if dims == 2 else [[[2]]]), 2)]


def cells(spark, arrays):
    names = ["ax", "sag", "cor"][: arrays[0].ndim]
    rows = [("s", f, *map(int, at), int(a[tuple(at)]), int(a.max())) for f, a in enumerate(arrays) for at in np.argwhere(a)]
    return spark.createDataFrame(rows, f"scan_id string, frame int, {', '.join(f'{c} int' for c in names)}, level int, ng int").repartition(3)


def moves(dims, full=True):
    return [m for m in itertools.product((-1, 0, 1), repeat=dims) if any(m) and (full or sum(map(abs, m)) == 1)]


def inside(a, at):
    return all(0 <= x < n for x, n in zip(at, a.shape)) and a[at] > 0


def zones(a, full=True):
    """Sets of cells, by flooding."""
    left, out = {tuple(x) for x in np.argwhere(a)}, []
    while left:
        todo = [left.pop()]
        zone = set(todo)
        while todo:
            at = todo.pop()
            for m in moves(a.ndim, full):
                to = tuple(x + d for x, d in zip(at, m))
                if to in left and a[to] == a[at]:
                    left.discard(to)
                    zone.add(to)
                    todo.append(to)
        out.append(frozenset(zone))
    return out


def size_matrix(a, kind, step=None):
    """Counts by (level, size)."""
    out = {}
    if kind == "glszm":
        pairs = [(a[next(iter(z))], len(z)) for z in zones(a)]
    elif kind == "gldm":
        pairs = [(a[tuple(at)], 1 + sum(inside(a, to) and a[to] == a[tuple(at)] for m in moves(a.ndim) for to in [tuple(x + d for x, d in zip(at, m))])) for at in np.argwhere(a)]
    else:
        pairs = []
        for at in map(tuple, np.argwhere(a)):
            back = tuple(x - d for x, d in zip(at, step))
            if inside(a, back) and a[back] == a[at]:
                continue
            n = 1
            while inside(a, to := tuple(x + n * d for x, d in zip(at, step))) and a[to] == a[at]:
                n += 1
            pairs.append((a[at], n))
    for i, s in pairs:
        out[int(i), s] = out.get((int(i), s), 0) + 1
    return out


def size_features(m):
    """By definition, in the order of SIZES."""
    p = np.zeros((max(i for i, _ in m), max(s for _, s in m)))
    for (i, s), n in m.items():
        p[i - 1, s - 1] = n
    i, s, n = np.arange(1, p.shape[0] + 1.0)[:, None], np.arange(1, p.shape[1] + 1.0)[None], p.sum()
    q = p / n
    ent = -sum(x * math.log2(x) for x in q.ravel() if x)
    gl, sz = (q * i).sum(), (q * s).sum()
    return [(q / s**2).sum(), (q * s**2).sum(), (p.sum(1) ** 2).sum() / n, (p.sum(1) ** 2).sum() / n**2, (p.sum(0) ** 2).sum() / n, (p.sum(0) ** 2).sum() / n**2, n / (p * s).sum(), (q * (i - gl) ** 2).sum(), (q * (s - sz) ** 2).sum(), ent, (q / i**2).sum(), (q * i**2).sum(), (q / i**2 / s**2).sum(), (q * i**2 / s**2).sum(), (q * s**2 / i**2).sum(), (q * s**2 * i**2).sum()]


def directions(dims):
    return [m for m in moves(dims) if m > (0,) * dims]


@pytest.mark.parametrize("dims", [2, 3])
def test_matrices_of_sizes(spark, dims):
    arrays = grids(dims)
    df = cells(spark, arrays)
    for kind, table in (("glszm", G.glszm_features(df, dims, KEYS)), ("gldm", G.gldm_features(df, dims, KEYS)), ("glrlm", G.glrlm_features(df, dims, KEYS))):
        got = {r["frame"]: r for r in table.collect()}
        assert len(got) == len(arrays)
        for f, a in enumerate(arrays):
            want = np.mean([size_features(size_matrix(a, kind, step)) for step in (directions(dims) if kind == "glrlm" else [None])], 0)
            for name, value in zip(G.SIZES[kind], want):
                assert name is None or got[f][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (kind, f, name)


@pytest.mark.parametrize("dims", [2, 3])
def test_neighbourhoods(spark, dims):
    arrays = grids(dims, levels=3)
    got = {r["frame"]: r for r in G.ngtdm_features(cells(spark, arrays), dims, KEYS).collect()}
    for f, a in enumerate(arrays):
        by = {}
        for at in map(tuple, np.argwhere(a)):
            near = [a[to] for m in moves(dims) for to in [tuple(x + d for x, d in zip(at, m))] if inside(a, to)]
            if near:
                n, s = by.get(int(a[at]), (0, 0.0))
                by[int(a[at])] = (n + 1, s + abs(a[at] - np.mean(near)))
        if not by:
            assert f not in got  # a cell without neighbours has no matrix
            continue
        total = sum(n for n, _ in by.values())
        rows = [(i, n / total, s) for i, (n, s) in by.items()]
        pairs = list(itertools.product(rows, rows))
        ps, s = sum(p * s for _, p, s in rows), sum(s for *_, s in rows)
        apart = sum(abs(i * p - j * q) for (i, p, _), (j, q, _) in pairs)
        several = len(rows) > 1
        want = [1 / ps if ps else 1e6, sum(p * q * (i - j) ** 2 for (i, p, _), (j, q, _) in pairs) / (len(rows) * (len(rows) - 1)) * s / total if several else 0, ps / apart if several and apart else 0,
                sum(abs(i - j) * (p * x + q * y) / (p + q) for (i, p, x), (j, q, y) in pairs) / total, sum((p + q) * (i - j) ** 2 for (i, p, _), (j, q, _) in pairs) / s if s else 0]
        assert [got[f][n] for n in G.NGTDM] == pytest.approx(want, rel=1e-9)


def glcm_by_definition(a):
    """All features, means over directions with a pair; sums over whole matrices."""
    ng, out = int(a.max()), []
    for step in directions(a.ndim):
        p = np.zeros((ng, ng))
        for at in map(tuple, np.argwhere(a)):
            to = tuple(x + d for x, d in zip(at, step))
            if inside(a, to):
                p[a[at] - 1, a[to] - 1] += 1
                p[a[to] - 1, a[at] - 1] += 1
        if not p.any():
            continue
        p /= p.sum()
        i, j = np.arange(1, ng + 1.0)[:, None], np.arange(1, ng + 1.0)[None]
        px, py, k = p.sum(1), p.sum(0), np.abs(i - j)
        pd, ps = (np.array([p[sel(n)].sum() for n in range(2 * ng + 1)]) for sel in (lambda n: k == n, lambda n: i + j == n))
        h = lambda x, y=None: -sum(v * math.log2(w) for v, w in zip(x.ravel(), (x if y is None else y).ravel()) if v)
        n = np.arange(2 * ng + 1.0)
        u, var = (p * i).sum(), (p * (i - (p * i).sum()) ** 2).sum()
        hxy, hxy1, hxy2 = h(p), h(p, np.outer(px, py)), h(np.outer(px, py))
        da = (n * pd).sum()
        some = px > 0
        q = p[some][:, some]
        values = np.sort(np.linalg.eigvals((q[:, None, :] * q[None] / px[some][:, None, None] / py[some]).sum(2)).real)
        out.append([(p * i * j).sum(), u, (p * (i + j - 2 * u) ** 4).sum(), (p * (i + j - 2 * u) ** 3).sum(), (p * (i + j - 2 * u) ** 2).sum(), (p * k**2).sum(), ((p * i * j).sum() - u * u) / var if var else 1, da, h(pd), (pd * (n - da) ** 2).sum(),
                    (p**2).sum(), hxy, (hxy - hxy1) / max(h(px), h(py)) if h(px) else 0, math.sqrt(max(0, 1 - math.exp(-2 * (hxy2 - hxy)))), (p / (1 + k**2)).sum(), (p / (1 + k**2 / ng**2)).sum(), (p / (1 + k)).sum(), (p / (1 + k / ng)).sum(),
                    (p[k > 0] / k[k > 0] ** 2).sum(), p.max(), (n * ps).sum(), h(ps), var, math.sqrt(max(0, values[-2])) if len(values) > 1 else 1])
    return np.mean(out, 0)


@pytest.mark.parametrize("dims", [2, 3])
def test_cooccurrence(spark, dims):
    arrays = grids(dims)[:-1]
    got = {r["frame"]: r for r in G.glcm_features(cells(spark, arrays), dims, KEYS).collect()}
    for f, a in enumerate(arrays):
        assert [got[f][n] for n in G.GLCM] == pytest.approx(glcm_by_definition(a), rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("dims,full", [(2, True), (2, False), (3, True), (3, False)])
def test_components_for_any_tile(spark, dims, full):
    """Snakes and blocks over many tiles: the same sets of cells."""
    arrays = grids(dims, 2, seed=4, levels=2)
    snake = np.zeros((12, 13) if dims == 2 else (3, 12, 13), int)
    snake[..., ::2, :] = 1
    snake[..., 1::4, -1] = snake[..., 3::4, 0] = 1
    arrays.append(snake)
    df = cells(spark, arrays).repartition(2)
    want = {(f, z) for f, a in enumerate(arrays) for z in zones(a, full)}
    for tile in (1, 2, 5, None):
        if tile == 1 and dims == 3:
            continue
        by = {}
        for r in C.components(df, dims, KEYS, full, tile).collect():
            by.setdefault((r["frame"], r["zone"]), set()).add(tuple(r[c] for c in ["ax", "sag", "cor"][:dims]))
        assert {(f, frozenset(z)) for (f, _), z in by.items()} == want, tile
        assert C.components(df.limit(0), dims, KEYS, full, tile).count() == 0


def test_contract_a_chain_and_a_star(spark):
    n = 3000
    e = spark.range(n).selectExpr("'a' AS k", "id * 7919 % 3001 AS u", "(id + 1) * 7919 % 3001 AS v").unionByName(spark.range(1, n).selectExpr("'b' AS k", "id + 5 AS u", "cast(3 AS long) AS v"))
    got = C.contract(e, ["k"]).groupBy("k").agg(F.count("*"), F.countDistinct("u"), F.min("root"), F.max("root")).collect()
    assert sorted(map(tuple, got)) == [("a", n, n, 0, 0), ("b", n - 1, n - 1, 3, 3)]


def test_any_configuration_runs(spark):
    """A configuration without featureClass asks for every class, windows as keys too; unknown names raise."""
    arrays = [a * 30 for a in grids(2)[:2]]
    df = cells(spark, arrays).select(F.lit("s").alias("scan_id"), F.lit("r").alias("seg_id"), F.lit(1).alias("window_ix"), "frame", "ax", "sag", F.col("level").cast("double").alias("value"))
    kind = texture.Radiomics([("c", {"setting": {"binWidth": 3}})], 0.0, 5.0)
    rows = kind.curves(df, 2, ["scan_id", "seg_id", "window_ix", "frame"]).collect()
    names = kind.names()
    assert {r["curve_name"] for r in rows} == set(names) and len(rows) == 2 * len(names) and len(names) >= 18 + 24 + 16 + 16 + 14 + 5
    for config in ({"featureClass": {"shapes": None}}, {"featureClass": {"glrlm": ["Nothing"]}}, {"imageType": {"Wave": {}}}):
        with pytest.raises(ValueError, match="unknown"):
            texture.Radiomics([("c", config)], 0.0, 5.0).wanted()


@pytest.mark.parametrize("dims", [2, 3])
def test_holes_for_any_tile(spark, dims):
    from echotide.operators import preprocess

    rng = np.random.default_rng(8)
    masks = [rng.random((9, 8) if dims == 2 else (6, 5, 7)) < p for p in (0.45, 0.6)]
    ring = np.zeros((12, 12) if dims == 2 else (6, 6, 6), bool)
    ring[(slice(1, -1),) * dims] = True
    ring[(slice(2, -2),) * dims] = False
    rows = [("s", str(k), *map(int, at), int(m[tuple(at)])) for k, m in enumerate([*masks, ring]) for at in np.argwhere(np.ones_like(m))]
    names = ["ax", "sag", "cor"][:dims]
    df = spark.createDataFrame(rows, f"scan_id string, seg_id string, {', '.join(f'{c} int' for c in names)}, m smallint")
    want = {tuple(r) for r in preprocess.fill_holes(df, dims).collect()}
    assert sum(r[-1] for r in want) > sum(r[-1] for r in rows)
    for tile in (3, 64):
        got = preprocess.fill_holes(df, dims, one_task=0, tile=tile)
        assert {tuple(r) for r in got.collect()} == want and got.dtypes == preprocess.fill_holes(df, dims).dtypes
