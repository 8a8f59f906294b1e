"""Shape of regions: mesh surface and volume, principal axes, largest diameters, in 2-D and 3-D.

The mesh needs no positions: each block of 2 x 2 (x 2) cells has a code, its corners inside the region; a table made by a rule gives
a code's surface, its vector and its moment, and sums over a region's blocks give surface and volume by the divergence theorem.

The rule: mesh points are midpoints of block edges between inside and outside; on a block's face, an inside corner whose neighbours there are outside is cut off by
itself; loops of four and more points are fans of least area.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotide.schema import axes

#: Names of the features, by dimensions.
SHAPE = {
    2: ("MeshSurface", "PixelSurface", "Perimeter", "PerimeterSurfaceRatio", "Sphericity", "MaximumDiameter", "MajorAxisLength", "MinorAxisLength", "Elongation"),
    3: ("MeshVolume", "VoxelVolume", "SurfaceArea", "SurfaceVolumeRatio", "Sphericity", "Maximum3DDiameter", "Maximum2DDiameterSlice", "Maximum2DDiameterColumn", "Maximum2DDiameterRow", "MajorAxisLength", "MinorAxisLength", "LeastAxisLength", "Elongation", "Flatness"),
}
#: Names of the diameters within planes, by the axis that is fixed.
PLANES = {"sag": "Maximum2DDiameterSlice", "cor": "Maximum2DDiameterRow", "ax": "Maximum2DDiameterColumn"}


def _links(corners: Sequence[int], inside: set[int]) -> list[tuple]:
    """Pairs of crossed edges that the mesh joins on a face, whose corners are given in turn."""
    n = len(corners)
    ring = [frozenset((corners[k], corners[(k + 1) % n])) for k in range(n)]
    crossed = [e for e in ring if len(e & inside) == 1]
    if len(crossed) == 2:
        return [tuple(crossed)]
    return [(ring[k - 1], ring[k]) for k in range(n) if corners[k] in inside] if crossed else []


def _loops(links: list[tuple]) -> list[list]:
    """The closed paths that the links make; each edge is in two of them."""
    near: dict = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, seen = [], set()
    for start in near:
        path, at = [], start
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = next((x for x in near[at] if x not in seen), None)
        if path:
            out.append(path)
    return out


def mesh_table(dims: int, spacing: Sequence[float]) -> list[tuple]:
    """(code, size, moment, vector) of each block code: size is the mesh's length or area in the block, vector its normal times size, moment the sum of point times vector."""
    at = {k: np.array([(k >> (dims - 1 - a)) & 1 for a in range(dims)]) * np.array(spacing, float) for k in range(1 << dims)}
    faces = []
    for a, b in itertools.combinations(range(dims), 2):
        first, second = 1 << (dims - 1 - a), 1 << (dims - 1 - b)
        faces += [[c, c | first, c | first | second, c | second] for c in range(1 << dims) if not c & (first | second)]
    out = []
    for code in range(1 << (1 << dims)):
        inside = {k for k in range(1 << dims) if code >> k & 1}
        point = lambda e: sum(at[k] for k in e) / 2
        outward = lambda e: sum(at[k] * (-1 if k in inside else 1) for k in e)
        links = [x for f in faces for x in _links(f, inside)]
        size, moment, vector = 0.0, 0.0, np.zeros(dims)
        if dims == 2:
            pieces = [([point(a), point(b)], outward(a) + outward(b)) for a, b in links]
        else:
            pieces = []
            for loop in _loops(links):
                p = [point(e) for e in loop]
                fans = [[(p[k], p[(k + j) % len(p)], p[(k + j + 1) % len(p)]) for j in range(1, len(p) - 1)] for k in range(len(p))]
                area = lambda fan: sum(np.linalg.norm(np.cross(y - x, z - x)) for x, y, z in fan)
                way = sum(outward(e) for e in loop)
                pieces += [(list(t), way) for t in min(fans, key=lambda f: round(area(f), 12))]
        total = sum((np.cross(p[1] - p[0], p[2] - p[0]) for p, _ in pieces), np.zeros(3)) if dims == 3 else None
        for p, way in pieces:
            normal = np.array([-(p[1] - p[0])[1], (p[1] - p[0])[0]]) if dims == 2 else np.cross(p[1] - p[0], p[2] - p[0]) / 2
            if dims == 2:
                normal = normal * (1 if normal @ way > 0 else -1)
            else:
                loop = sum((np.cross(q[1] - q[0], q[2] - q[0]) for q, w in pieces if w is way), np.zeros(3))
                normal = normal * (1 if loop @ way > 0 else -1)
            size, moment, vector = size + float(np.linalg.norm(normal)), moment + float(sum(p) @ normal / len(p)), vector + normal
        out.append((code, size, moment, *map(float, vector)))
    return out


def blocks(cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
    """(keys, spatial columns, code) of the blocks that hold a cell: each cell is a corner of 2^dims of them."""
    names = axes(dims)
    corners = F.array(*(F.struct(F.lit(1 << k).alias("bit"), *(F.lit((k >> (dims - 1 - a)) & 1).alias(f"d_{c}") for a, c in enumerate(names))) for k in range(1 << dims)))
    sent = cells.select(*keys, *names, F.explode(corners).alias("o")).select(*keys, *((F.col(c) - F.col(f"o.d_{c}")).alias(c) for c in names), "o.bit")
    return sent.groupBy(*keys, *names).agg(F.sum("bit").cast("int").alias("code"))


def mesh(cells: DataFrame, dims: int, keys: Sequence[str], spacing: Sequence[float]) -> DataFrame:
    """(keys, size, content): the mesh's length or area, and what it holds."""
    names = axes(dims)
    table = cells.sparkSession.createDataFrame(mesh_table(dims, spacing), f"code int, size double, moment double, {', '.join(f'v_{c} double' for c in names)}")
    counted = blocks(cells, dims, keys).groupBy(*keys, "code").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"at_{c}") for c in names))
    away = sum((F.col(f"at_{c}") * s * F.col(f"v_{c}") for c, s in zip(names, spacing)), F.lit(0.0))
    return counted.join(F.broadcast(table), "code").groupBy(*keys).agg(F.sum(F.col("n") * F.col("size")).alias("size"), (F.sum(F.col("n") * F.col("moment") + away) / dims).alias("content"))


def moments(cells: DataFrame, dims: int, keys: Sequence[str], spacing: Sequence[float]) -> DataFrame:
    """(keys, n, l0, l1, ...): cells, and eigenvalues of their covariance, largest first, in closed form."""
    names = axes(dims)
    pairs = list(itertools.combinations_with_replacement(range(dims), 2))
    sums = cells.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(f"s{k}") for k, c in enumerate(names)), *(F.sum(F.col(names[a]).cast("long") * F.col(names[b])).alias(f"s{a}{b}") for a, b in pairs))
    n = F.col("n").cast("decimal(38,0)")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    # Differences of whole numbers first, so that regions far from the origin lose nothing.
    cov = sums.select(*keys, "n", *(((n * whole(f"s{a}{b}") - whole(f"s{a}") * whole(f"s{b}")).cast("double") / F.col("n") / F.col("n") * (spacing[a] * spacing[b])).alias(f"c{a}{b}") for a, b in pairs))
    c = lambda a, b: F.col(f"c{min(a, b)}{max(a, b)}")
    if dims == 2:
        mid, half = (c(0, 0) + c(1, 1)) / 2, F.sqrt(F.pow((c(0, 0) - c(1, 1)) / 2, F.lit(2)) + c(0, 1) * c(0, 1))
        return cov.select(*keys, "n", (mid + half).alias("l0"), F.greatest(F.lit(0.0), mid - half).alias("l1"))
    q = (c(0, 0) + c(1, 1) + c(2, 2)) / 3
    off = c(0, 1) * c(0, 1) + c(0, 2) * c(0, 2) + c(1, 2) * c(1, 2)
    p = F.sqrt((F.pow(c(0, 0) - q, F.lit(2)) + F.pow(c(1, 1) - q, F.lit(2)) + F.pow(c(2, 2) - q, F.lit(2)) + 2 * off) / 6)
    cov = cov.withColumns({"q": q, "p": p})
    q, p = F.col("q"), F.col("p")
    d = [c(k, k) - q for k in range(3)]
    det = d[0] * (d[1] * d[2] - c(1, 2) * c(1, 2)) - c(0, 1) * (c(0, 1) * d[2] - c(1, 2) * c(0, 2)) + c(0, 2) * (c(0, 1) * c(1, 2) - d[1] * c(0, 2))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / (2 * p * p * p)))) / 3
    cov = cov.withColumn("angle", F.when(p > 0, angle).otherwise(0.0))
    root = lambda k: F.greatest(F.lit(0.0), q + 2 * p * F.cos(F.col("angle") + k * 2 * np.pi / 3))
    return cov.select(*keys, "n", root(0).alias("l0"), root(2).alias("l1"), root(1).alias("l2"))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of whole-numbered points in the plane."""
    p = np.unique(points, axis=0).tolist()
    if len(p) < 3:
        return np.array(p)
    halves = []
    for order in (p, p[::-1]):
        side: list = []
        for x in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (x[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (x[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(x)
        halves += side[:-1]
    return np.array(halves)


def farthest(points: np.ndarray, size: int = 64) -> float:
    """The largest squared distance between points, by boxes: a pair of boxes that can't hold a larger one than is known isn't looked into."""
    def split(p: np.ndarray) -> list[np.ndarray]:
        todo, out = [p], []
        while todo:
            x = todo.pop()
            if len(x) <= size:
                out.append(x)
                continue
            axis = int(np.argmax(x.max(0) - x.min(0)))
            order = np.argsort(x[:, axis], kind="stable")
            todo += [x[order[: len(x) // 2]], x[order[len(x) // 2 :]]]
        return out

    if not len(points):
        return 0.0
    boxes = split(points)
    low, high = np.array([b.min(0) for b in boxes]), np.array([b.max(0) for b in boxes])
    best = 0.0
    for k, b in enumerate(boxes):
        reach = (np.maximum(high[k:] - low[k], high[k] - low[k:]) ** 2).sum(1)
        for j in np.argsort(-reach):
            if reach[j] <= best:
                break
            best = max(best, float(((b[:, None] - boxes[k + j][None]) ** 2).sum(2).max()))
    return best


def outline(cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
    """(keys, axis, plane, p0, p1, ...): mesh points in doubled coordinates, those that can be ends of a largest diameter in a plane.

    A plane fixes the coordinate of an axis; in 2-D there is one. Of the points on a line within a plane, only its ends are kept.
    """
    names, keys = axes(dims), list(keys)
    ways = F.array(*(F.struct(F.lit(way).alias("way"), F.lit(k).alias("along")) for k in range(dims) for way in (-1, 1)))
    put = [(2 * F.col(c) + F.when(F.col("o.along") == k, F.col("o.way")).otherwise(0)).alias(f"p{k}") for k, c in enumerate(names)]
    # A face between cells of the region is named by both, so it is met twice; one towards the outside once.
    met = cells.select(*keys, *names, F.explode(ways).alias("o")).select(*keys, *put).groupBy(*keys, *(f"p{k}" for k in range(dims))).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    at = [f"p{k}" for k in range(dims)]
    if dims == 2:
        ends = met.groupBy(*keys, "p0").agg(F.min("p1").alias("low"), F.max("p1").alias("high"))
        return ends.select(*keys, F.lit("").alias("axis"), F.lit(0).alias("plane"), "p0", F.explode(F.array("low", "high")).alias("p1"))
    parts = []
    for k, c in enumerate(names):
        line, free = [x for j, x in enumerate(at) if j != k]
        ends = met.groupBy(*keys, at[k], line).agg(F.min(free).alias("low"), F.max(free).alias("high"))
        parts.append(ends.withColumn(free, F.explode(F.array("low", "high"))).select(*keys, F.lit(c).alias("axis"), F.col(at[k]).alias("plane"), *at))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def diameters(cells: DataFrame, dims: int, keys: Sequence[str], spacing: Sequence[float]) -> DataFrame:
    """(keys, axis, diameter): the largest distance between mesh points, in all ('') and within planes that fix an axis.

    Planes are tasks of their own; the corners of their hulls, a plane's worth of lines at most, are what a region's largest diameter is looked for in.
    """
    keys, at = list(keys), [f"p{k}" for k in range(dims)]
    kinds, scale = dict(cells.dtypes), np.array(spacing, float) / 2
    ids = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def constant(t: pa.Table, n: int) -> list:
        return [pa.array([t.column(k)[0].as_py()] * n, t.schema.field(k).type) for k in keys]

    def plane(t: pa.Table) -> pa.Table:
        axis = t.column("axis")[0].as_py()
        p = np.stack([t.column(c).to_numpy() for c in at], 1).astype(np.int64)
        free = [k for k, c in enumerate(axes(dims)) if c != axis]
        corners = np.zeros((0, dims), np.int64)
        if len(p):
            flat = hull(p[:, free])
            corners = np.zeros((len(flat), dims), np.int64)
            corners[:, free] = flat
            fixed = [k for k in range(dims) if k not in free]
            corners[:, fixed] = p[0, fixed]
        reach = farthest(corners * scale)
        n = len(corners)
        return pa.table([*constant(t, n), pa.array([axis] * n), pa.array([reach] * n), *(pa.array(corners[:, k].astype(np.int32)) for k in range(dims))], names=[*keys, "axis", "reach", *at])

    def whole(t: pa.Table) -> pa.Table:
        return pa.table([*constant(t, 1), pa.array([""]), pa.array([farthest(np.stack([t.column(c).to_numpy() for c in at], 1) * scale)])], names=[*keys, "axis", "reach"])

    corners = outline(cells, dims, keys).groupBy(*keys, "axis", "plane").applyInArrow(plane, f"{ids}, axis string, reach double, {', '.join(f'{c} int' for c in at)}")
    if dims == 2:
        return corners.groupBy(*keys, "axis").agg(F.sqrt(F.max("reach")).alias("diameter"))
    most = corners.where("axis = 'ax'").select(*keys, *at).groupBy(*keys).applyInArrow(whole, f"{ids}, axis string, reach double")
    return corners.select(*keys, "axis", "reach").unionByName(most).groupBy(*keys, "axis").agg(F.sqrt(F.max("reach")).alias("diameter"))


def shape_features(cells: DataFrame, dims: int, keys: Sequence[str], spacing: Sequence[float]) -> DataFrame:
    """SHAPE of the region that each key's cells are. spacing is per axis in the order ax, sag, cor."""
    keys = list(keys)
    unit = float(np.prod(spacing))
    across = diameters(cells, dims, keys, spacing)
    pick = lambda axis, name: F.max(F.when(F.col("axis") == axis, F.col("diameter"))).alias(name)
    across = across.groupBy(*keys).agg(pick("", "MaximumDiameter" if dims == 2 else "Maximum3DDiameter"), *(pick(a, n) for a, n in PLANES.items() if dims == 3))
    both = mesh(cells, dims, keys, spacing).join(moments(cells, dims, keys, spacing), keys).join(across, keys)
    size, content = F.col("size"), F.col("content")
    length = lambda k: 4 * F.sqrt(f"l{k}")
    ratio = lambda k: F.when(F.col("l0") > 0, F.sqrt(F.col(f"l{k}") / F.col("l0")))
    made: dict[str, Column] = {"MajorAxisLength": length(0), "MinorAxisLength": length(1), "Elongation": ratio(1)}
    if dims == 2:
        made |= {"MeshSurface": content, "PixelSurface": F.col("n") * unit, "Perimeter": size, "PerimeterSurfaceRatio": size / content, "Sphericity": 2 * F.sqrt(np.pi * content) / size}
    else:
        made |= {"MeshVolume": content, "VoxelVolume": F.col("n") * unit, "SurfaceArea": size, "SurfaceVolumeRatio": size / content, "Sphericity": F.pow(36 * np.pi * content * content, F.lit(1 / 3)) / size, "LeastAxisLength": length(2), "Flatness": ratio(2)}
    return both.withColumns(made).select(*keys, *SHAPE[dims])
