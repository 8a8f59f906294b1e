"""Filtered images for radiomics: wavelets, Laplacian of Gaussian, gradient, and functions of intensity.

Images are sparse: cells that a table doesn't have are 0. Linear filters go axis by axis: each pass deals out lines of cells and adds
their sources in a fixed order. Results are given at the cells of the image.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotide.schema import axes

#: The low-pass decomposition filter of the wavelet coif1.
COIF1 = (-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539)
#: Deviations of a Gaussian up to which it is summed.
REACH = 4.0
#: Cells of lines that are filtered at a time.
BLOCK = 1 << 18
#: Names of types that a configuration may ask for.
TYPES = ("Original", "Wavelet", "LoG", "Square", "SquareRoot", "Logarithm", "Exponential", "Gradient")


def along(cells: DataFrame, dims: int, keys: Sequence[str], axis: str, n: int, border: Callable[[np.ndarray], np.ndarray], taps: Sequence[tuple[int, Sequence[float]]], sums: Mapping[str, tuple[str, int]]) -> DataFrame:
    """One pass along an axis of n cells, at the targets that have a source.

    taps: (offset of the source, weights), added in this order; border maps places outside to ones inside; sums: by name, the column
    and the number of the weight that it is summed with. A line of cells along the axis is a row, so lines are dealt out, and how they
    are dealt out changes no sum.
    """
    kinds, by = dict(cells.dtypes), [*keys, *(c for c in axes(dims) if c != axis)]
    columns = sorted({c for c, _ in sums.values()})
    point = F.struct(F.col(axis).cast("int").alias("at"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    lines = cells.where(F.col(axis).between(0, n - 1)).groupBy(*by).agg(F.collect_list(point).alias("__line"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(n, 1))
        for b in batches:
            for start in range(0, b.num_rows, step):
                points = b.column("__line").slice(start, step)
                flat, size = points.flatten(), len(points) * n
                spot = np.repeat(np.arange(len(points)) * n, np.diff(points.offsets.to_numpy())) + flat.field("at").to_numpy()
                grids = {c: np.bincount(spot, flat.field(c).to_numpy(), size).reshape(-1, n) for c in columns}
                there = (np.bincount(spot, minlength=size) > 0).reshape(-1, n)
                found, out = np.zeros_like(there), {name: np.zeros(there.shape) for name in sums}
                for offset, weights in taps:
                    source = border(np.arange(n) + offset)
                    found |= there[:, source]
                    moved = {c: g[:, source] for c, g in grids.items()}
                    for name, (c, k) in sums.items():
                        out[name] += moved[c] * weights[k]
                line, to = np.nonzero(found)
                own = b.select(by).take(pa.array(line + start))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in by), pa.array(to.astype(np.int32)), *(pa.array(x[found]) for x in out.values())], names=[*by, axis, *sums])

    return lines.mapInArrow(rows, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), f"`{axis}` int", *(f"`{name}` double" for name in sums)]))


def _nearest(n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Edges repeat."""
    return lambda at: np.clip(at, 0, n - 1)


def _around(n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The array repeats, after its first cell again where n is odd."""
    period = n + n % 2
    return lambda at: np.where(at % period == n, 0, at % period)


def wavelet_taps() -> list[tuple[int, tuple[float, float]]]:
    """Low-pass and high-pass weights by offset, from the highest down."""
    high = [-w if k % 2 == 0 else w for k, w in enumerate(reversed(COIF1))]
    return [(len(COIF1) // 2 - k, pair) for k, pair in enumerate(zip(COIF1, high))]


def wavelet(cells: DataFrame, dims: int, keys: Sequence[str], size: Sequence[int]) -> dict[str, DataFrame]:
    """One image a band, not decimated: L or H for each axis, in the order ax, cor, sag (sag, ax in 2-D). cells: keys, spatial columns, value.

    Whole-numbered images have values halfway between two roundings, whose last digit follows from the order of adding. It is fixed:
    from the lowest place up along the first axis, from the highest down along others, as DuckDB mostly adds for the SQL of the query.
    """
    order = ["ax", "cor", "sag"] if dims == 3 else ["sag", "ax"]
    bands, out, taps = ["value"], cells.select(*keys, *axes(dims), "value"), wavelet_taps()
    for c in order:
        n = size[axes(dims).index(c)]
        sums = {f"{'' if b == 'value' else b}{letter}": (b, k) for b in bands for k, letter in enumerate("LH")}
        out = along(out, dims, keys, c, n, _around(n), taps if c != order[0] else taps[::-1], sums)
        bands = list(sums)
    return {f"wavelet-{b}": _at(cells, out, dims, keys, F.col(b)) for b in bands}


def gaussian(sigma: float, step: float) -> tuple[dict[int, float], dict[int, float]]:
    """Weights of a Gaussian and of its second derivative at whole steps; the first sum to 1, the second to 0 and to 2 with squares of the place."""
    reach = max(1, math.ceil(REACH * sigma / step))
    g = {k: math.exp(-((k * step / sigma) ** 2) / 2) for k in range(-reach, reach + 1)}
    total = sum(g.values())
    g = {k: w / total for k, w in g.items()}
    d = {k: w * ((k * step) ** 2 / sigma**2 - 1) for k, w in g.items()}
    shift = sum(d.values())
    d = {k: w - shift * g[k] for k, w in d.items()}
    scale = 2 / sum(w * (k * step) ** 2 for k, w in d.items())
    return g, {k: w * scale for k, w in d.items()}


def log(cells: DataFrame, dims: int, keys: Sequence[str], size: Sequence[int], spacing: Sequence[float], sigma: float) -> DataFrame:
    """Laplacian of a Gaussian of sigma mm, times sigma squared; edges repeat."""
    names, out, terms = axes(dims), cells.select(*keys, *axes(dims), F.col("value").alias("s")), ["s"]
    for c, n, step in zip(names, size, spacing):
        g, d = gaussian(sigma, step)
        # s: smoothed so far; d: with one second derivative among the axes so far, summed over axes.
        met = along(out, dims, keys, c, n, _nearest(n), [(k, (g[k], d[k])) for k in g], {"s": ("s", 0), "d0": ("s", 1), **({"d1": ("d", 0)} if "d" in terms else {})})
        out, terms = met.withColumn("d", F.col("d0") + F.col("d1") if "d" in terms else F.col("d0")).drop("d0", "d1"), ["s", "d"]
    return _at(cells, out, dims, keys, F.col("d") * sigma**2)


def gradient(cells: DataFrame, dims: int, keys: Sequence[str], size: Sequence[int], spacing: Sequence[float]) -> DataFrame:
    """Magnitude of central differences by mm; edges repeat."""
    names, parts = axes(dims), None
    for k, (c, n, step) in enumerate(zip(names, size, spacing)):
        one = along(cells, dims, keys, c, n, _nearest(n), [(1, (0.5 / step,)), (-1, (-0.5 / step,))], {"g": ("value", 0)}).select(*keys, *names, F.lit(k).alias("__k"), "g")
        parts = one if parts is None else parts.unionByName(one)
    both = parts.groupBy(*keys, *names).agg(F.sum(F.col("g") * F.col("g")).alias("square"))
    return _at(cells, both, dims, keys, F.sqrt("square"))


def _at(cells: DataFrame, image: DataFrame, dims: int, keys: Sequence[str], value: Column) -> DataFrame:
    """The image at the cells of another one, 0 where it has none."""
    on = [*keys, *axes(dims)]
    return cells.select(*on).join(image.select(*on, value.alias("value")), on, "left").select(*on, F.coalesce("value", F.lit(0.0)).alias("value"))


def pointwise(cells: DataFrame, dims: int, keys: Sequence[str], kind: str) -> DataFrame:
    """Functions of intensity that keep the largest absolute value of a key's cells; an image of zeros stays."""
    x, top = F.col("value"), F.col("top")
    size = F.abs(x)
    f = {
        "Square": x * x / top, "SquareRoot": F.signum(x) * F.sqrt(size * top), "Logarithm": F.signum(x) * F.log1p(size) * top / F.log1p(top),
        "Exponential": F.exp(F.log(top) / top * x),
    }[kind]
    ends = cells.groupBy(*keys).agg(F.max(size).alias("top"))
    flat = 1.0 if kind == "Exponential" else 0.0
    return cells.join(ends, list(keys)).select(*keys, *axes(dims), F.when(top > 0, f).otherwise(flat).alias("value"))


def check(config: Mapping, spatial: bool = True) -> None:
    """ValueError for types that aren't known, or that lack what they need."""
    wanted = config.get("imageType") or {}
    if bad := set(wanted) - set(TYPES):
        raise ValueError(f"unknown radiomics image types: {', '.join(sorted(bad))}; known: {', '.join(TYPES)}")
    if "LoG" in wanted and not _sigmas(config):
        raise ValueError("LoG needs sigma, a list of lengths in mm")
    if not spatial and set(wanted) & {"Wavelet", "LoG", "Gradient"}:
        raise ValueError("filters along axes need the size of the image")


def _sigmas(config: Mapping) -> list[float]:
    own = ((config.get("imageType") or {}).get("LoG") or {}).get("sigma") or (config.get("setting") or {}).get("sigma") or []
    return [float(s) for s in (own if isinstance(own, (list, tuple)) else [own])]


def names(config: Mapping, dims: int) -> list[str]:
    """Names of the images that a configuration asks for: the original one by default."""
    out = []
    for kind in config.get("imageType") or ("Original",):
        if kind == "Wavelet":
            bands = [""]
            for _ in range(dims):
                bands = [b + letter for b in bands for letter in "LH"]
            out += [f"wavelet-{b}" for b in bands]
        elif kind == "LoG":
            out += [f"log-sigma-{str(s).replace('.', '-')}-mm-3D" for s in _sigmas(config)]
        else:
            out.append(kind.lower())
    return out


def images(cells: DataFrame, dims: int, keys: Sequence[str], config: Mapping, size: Sequence[int] = (), spacing: Sequence[float] = ()) -> dict[str, DataFrame]:
    """The images that a configuration asks for, by name. cells: keys, spatial columns, value; size and spacing in the order ax, sag, cor."""
    out = {}
    for kind in config.get("imageType") or ("Original",):
        if kind == "Wavelet":
            out |= wavelet(cells, dims, keys, size)
        elif kind == "LoG":
            out |= {f"log-sigma-{str(s).replace('.', '-')}-mm-3D": log(cells, dims, keys, size, spacing, s) for s in _sigmas(config)}
        elif kind == "Gradient":
            out["gradient"] = gradient(cells, dims, keys, size, spacing)
        elif kind == "Original":
            out["original"] = cells
        else:
            out[kind.lower()] = pointwise(cells, dims, keys, kind)
    return out
