"""Preprocessing of voxel and mask tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotide.functions import luma
from echotide.operators.components import components, cut_lineage
from echotide.schema import axes


def standardize(voxels: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    """z-scores over all voxels and frames of a scan, by the population deviation; where it is 0, only centred.

    Sums are taken map-side: one row per scan is joined back, however long the scan.
    """
    if bad := set(columns) - set(voxels.columns):
        raise ValueError(f"no such columns to standardize: {sorted(bad)}")
    stats = voxels.groupBy("scan_id").agg(*(f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))))
    out = voxels.join(stats, "scan_id")
    for c in columns:
        centred = F.col(c) - F.col(f"__mean_{c}")
        out = out.withColumn(c, F.when(F.col(f"__std_{c}") > 0, centred / F.col(f"__std_{c}")).otherwise(centred))
    return out.select(voxels.columns)


def new_size(size: int, old: float, new: float) -> int:
    """Cells of an axis after resampling, ties to even."""
    return int(np.rint(size * old / new))


def _targets(n: int, old: float, new: float, interp: str) -> list[tuple[int, int, float]]:
    """(target, source, weight) of an axis: at most two sources for a target, clamped to the edge."""
    out = []
    for i in range(new_size(n, old, new)):
        at = min(i * new / old, n - 1)
        if interp == "nearest":
            out.append((i, min(int(np.floor(i * new / old + 0.5)), n - 1), 1.0))
        else:
            low = int(np.floor(at))
            w = at - low
            out += [(i, low, 1.0 - w)] + ([(i, low + 1, w)] if w > 0 else [])
    return out


def resample(cells: DataFrame, shape: Sequence[int], old: Sequence[float], new: Sequence[float], interp: str = "linear", value: str = "value", keys: Sequence[str] = ("scan_id", "frame"), to_type: str | None = None) -> DataFrame:
    """cells (keys, spatial columns, value) on a grid of new spacing.

    shape, old and new are per axis in the order ax, sag, cor. nearest and linear are equi-joins on each
    axis's table of sources (as long as the axis, so it is broadcast) and a weighted sum per target.
    cubic solves the interpolating spline along each line of cells. to_type casts the result; integers are rounded to even first.
    """
    if interp not in ("nearest", "linear", "cubic"):
        raise ValueError("interp must be 'linear', 'nearest' or 'cubic'")
    names = axes(len(shape))
    if interp == "cubic":
        out = _cubic(cells, shape, old, new, value, keys)
    else:
        spark, out, weight = cells.sparkSession, cells, F.lit(1.0)
        for name, n, o, w in zip(names, shape, old, new):
            table = spark.createDataFrame(_targets(n, o, w, interp) or [(0, -1, 0.0)], f"__to_{name} int, {name} int, __w_{name} double")
            out = out.join(F.broadcast(table), name)
            weight = weight * F.col(f"__w_{name}")
        total = F.first(value, ignorenulls=True) if interp == "nearest" else F.sum(F.col(value) * weight)
        out = out.groupBy(*keys, *(F.col(f"__to_{c}").alias(c) for c in names)).agg(total.alias(value))
    if to_type:
        out = out.withColumn(value, (F.rint(value) if to_type in ("tinyint", "smallint", "int", "bigint") else F.col(value)).cast(to_type))
    return out


#: Pole of the filter that turns samples into coefficients of a cubic spline.
POLE = 3**0.5 - 2


def spline_coefficients(samples: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic spline through each row of samples, mirrored at both ends: two recursions along the rows."""
    n = samples.shape[1]
    if n < 2:
        return samples.astype(float)
    mirrored = np.concatenate((samples, samples[:, n - 2 : 0 : -1]), 1)
    out = np.empty(samples.shape)
    out[:, 0] = mirrored @ POLE ** np.arange(2 * n - 2) / (1 - POLE ** (2 * n - 2))
    for k in range(1, n):
        out[:, k] = samples[:, k] + POLE * out[:, k - 1]
    out[:, -1] = POLE / (POLE * POLE - 1) * (out[:, -1] + POLE * out[:, -2])
    for k in range(n - 2, -1, -1):
        out[:, k] = POLE * (out[:, k + 1] - out[:, k])
    return 6 * out


def spline_values(samples: np.ndarray, old: float, new: float) -> np.ndarray:
    """The cubic spline through each row of samples at a new spacing, held at the last sample beyond it."""
    n = samples.shape[1]
    c, at = spline_coefficients(samples), np.minimum(np.arange(new_size(n, old, new)) * new / old, n - 1)
    if n < 2:
        return np.repeat(c, len(at), 1)
    low, out = np.floor(at).astype(int), np.zeros((len(c), len(at)))
    for k in (-1, 0, 1, 2):
        x = np.abs(at - low - k)
        w = np.where(x < 1, 2 / 3 - x**2 + x**3 / 2, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))
        spot = np.abs(low + k)
        out += w * c[:, np.minimum(spot, np.abs(2 * (n - 1) - spot))]
    return out


def cubic_along(cells: DataFrame, axis: str, value: str, keys: Sequence[str]) -> DataFrame:
    """cells (keys, axis, value, and n, old, new of the axis) at the new spacing. A line along the axis is a row, so lines are dealt out, whatever frame they are of."""
    kinds = dict(cells.dtypes)
    lines = cells.groupBy(*keys).agg(F.first("__n").alias("__n"), F.first("__old").alias("__old"), F.first("__new").alias("__new"), F.collect_list(F.struct(F.col(axis).cast("int").alias("at"), F.col(value).cast("double").alias("v"))).alias("__line"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column("__line")
            flat, sizes = points.flatten(), np.diff(points.offsets.to_numpy())
            row, at, v = np.repeat(np.arange(b.num_rows), sizes), flat.field("at").to_numpy(), flat.field("v").to_numpy(zero_copy_only=False)
            kind = np.stack([b.column(c).to_numpy().astype(float) for c in ("__n", "__old", "__new")], 1)
            out: list = [None] * b.num_rows
            for n, old, new in np.unique(kind, axis=0).tolist():
                mine = np.flatnonzero((kind == (n, old, new)).all(1))
                place = np.full(b.num_rows, -1)
                place[mine] = np.arange(len(mine))
                grid, pick = np.zeros((len(mine), int(n))), place[row] >= 0
                grid[place[row[pick]], at[pick]] = v[pick]
                for k, line in zip(mine.tolist(), spline_values(grid, old, new)):
                    out[k] = line
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "__line"])

    done = lines.mapInArrow(rows, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__line array<double>"]))
    return done.select(*keys, F.posexplode("__line").alias(axis, value))


def _cubic(cells: DataFrame, shape: Sequence[int], old: Sequence[float], new: Sequence[float], value: str, keys: Sequence[str]) -> DataFrame:
    """Cubic B-spline interpolation, axis by axis."""
    names, out = axes(len(shape)), cells.select(*keys, *axes(len(shape)), value)
    for c, n, o, w in zip(names, shape, old, new):
        known = out.withColumns({"__n": F.lit(int(n)), "__old": F.lit(float(o)), "__new": F.lit(float(w))})
        out = cubic_along(known, c, value, [*keys, *(a for a in names if a != c)])
    return out.select(*keys, *names, value)


def to_pixel_type(voxels: DataFrame, pixel_type: str, value: str = "value") -> DataFrame:
    """Values as the pixel type (a NumPy name) can hold them: whole numbers are rounded to even and kept in its range."""
    if np.dtype(pixel_type).kind not in "iu":
        return voxels
    info = np.iinfo(pixel_type)
    return voxels.withColumn(value, F.least(F.greatest(F.rint(value), F.lit(float(info.min))), F.lit(float(info.max))))


def resample_scan(scan: DataFrame, new: Sequence[float]) -> DataFrame:
    """Scan metadata after resampling: the old spacing is kept, the new one set."""
    return scan.withColumn("original_pixdim", F.coalesce("original_pixdim", "pixdim")).withColumn("pixdim", F.array(*(F.lit(float(x)) for x in new)))


def resample_mask(mask: DataFrame, shape: Sequence[int], pixdim: Sequence[float], new: Sequence[float], original_pixdim: Sequence[float] | None = None, interp: str = "nearest") -> DataFrame:
    """A mask on the grid of its image: from the image's spacing before it was resampled, where it was."""
    return resample(mask, shape, original_pixdim or pixdim, new, interp, value="m", keys=("scan_id", "seg_id"), to_type="smallint")


def grayscale(frames: DataFrame, kind: str = "compat") -> DataFrame:
    """value from r, g, b."""
    return frames.withColumn("value", luma(F.col("r"), F.col("g"), F.col("b"), kind)).drop("r", "g", "b")


def transpose(cells: DataFrame, dims: int) -> DataFrame:
    """Spatial axes reversed."""
    names = axes(dims)
    return cells.withColumns({a: F.col(b) for a, b in zip(names, reversed(names))})


def max_projection(masks: DataFrame, dims: int = 3) -> DataFrame:
    """One mask from masks over time: 1 where any frame has a cell set."""
    return masks.groupBy("scan_id", "seg_id", *axes(dims)).agg((F.max("m") > 0).cast("smallint").alias("m"))


def crop(mask: DataFrame, axis: str, size: int) -> DataFrame:
    """Cells of an axis below a size."""
    return mask.where(F.col(axis) < size)


def _filled(mask: np.ndarray, axes: Sequence[int] | None = None) -> np.ndarray:
    """Background that no path of neighbouring background cells joins to the border becomes foreground.

    Paths and border are those of the given axes (all by default), other axes number slices. The outside spreads along
    a whole run of background in one array operation, so rounds count turns of a path, not its cells.
    """
    axes = range(mask.ndim) if axes is None else axes
    free = ~mask
    outside = np.zeros_like(free)
    for axis in axes:
        edge = np.moveaxis(outside, axis, 0)
        edge[0] = edge[-1] = True
    outside &= free
    while True:
        before = int(outside.sum())
        for axis in axes:
            for way in (1, -1):
                o, f = (np.moveaxis(x, axis, 0)[::way] for x in (outside, free))
                at = np.arange(len(o)).reshape(-1, *(1,) * (o.ndim - 1))
                seen, wall = (np.maximum.accumulate(np.where(x, at, -1), 0) for x in (o, ~f))
                o |= seen > wall
        if int(outside.sum()) == before:
            return ~outside


#: Cells up to which a mask is filled in one task; larger ones are filled tile by tile.
ONE_TASK = 1 << 24


def fill_holes(mask: DataFrame, dims: int, slicewise: bool = True, one_task: int = ONE_TASK, tile: int | None = None) -> DataFrame:
    """Holes of a mask filled: as a whole and then, in 3-D, slice by slice along each axis in turn.

    Masks of up to `one_task` cells are filled in a task each; where one is larger, all are filled by tiles.
    A mask that isn't a whole box has its border at the box's; cells that it lacks join nothing.
    """
    most = mask.groupBy("scan_id", "seg_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > one_task:
        return _filled_by_tiles(mask, dims, slicewise, tile)
    return _filled_in_tasks(mask, dims, slicewise)


def _filled_by_tiles(mask: DataFrame, dims: int, slicewise: bool, tile: int | None) -> DataFrame:
    """A component of the background, over tiles, is outside if it has a cell at the border of the mask's box."""
    names, roi = axes(dims), ["scan_id", "seg_id"]
    out = mask.select(*roi, *names, (F.col("m") > 0).cast("smallint").alias("m"))
    box = cut_lineage(out.groupBy(*roi).agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("min", F.min), ("max", F.max)))))
    for axis in (None, *(names if slicewise and dims == 3 else ())):
        within = [c for c in names if c != axis]
        # Slices are planes with the slice's number as a key.
        flat = dict(zip(axes(len(within)), within))
        keys = roi + ([f"__{axis}"] if axis else [])
        free = out.where("m = 0").select(*roi, *([F.col(axis).alias(f"__{axis}")] if axis else []), *(F.col(c).alias(a) for a, c in flat.items()), F.lit(0).alias("level"))
        found = components(free, len(within), keys, full=False, tile=tile).select(*keys, *(F.col(a).alias(c) for a, c in flat.items()), "zone")
        edge = reduce(lambda a, b: a | b, (F.col(c).isin(F.col(f"min_{c}"), F.col(f"max_{c}")) for c in within))
        marked = found.join(F.broadcast(box), roi).withColumn("edge", edge)
        outside = marked.groupBy(*keys, "zone").agg(F.max("edge").alias("outside")).where("outside")
        beyond = found.join(outside, [*keys, "zone"], "left_semi").select(*roi, *([F.col(f"__{axis}").alias(axis)] if axis else []), *within, F.lit(0).cast("smallint").alias("__out"))
        out = out.join(beyond, [*roi, *names], "left").select(*roi, *names, F.coalesce("__out", F.lit(1).cast("smallint")).cast("smallint").alias("m"))
    return out


def _filled_in_tasks(mask: DataFrame, dims: int, slicewise: bool) -> DataFrame:
    names = axes(dims)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        where = tuple((pdf[c] - pdf[c].min()).to_numpy() for c in names)
        # Cells that the table lacks are walls: no path leads through them.
        grid = np.ones([int(w.max()) + 1 for w in where], bool)
        grid[where] = pdf["m"] > 0
        grid = _filled(grid)
        for axis in range(dims) if slicewise and dims == 3 else ():
            grid = _filled(grid, [a for a in range(dims) if a != axis])
        return pdf.assign(m=grid[where].astype("int16"))

    kinds = dict(mask.dtypes)
    columns = ["scan_id", "seg_id", *names]
    return mask.select(*columns, "m").groupBy("scan_id", "seg_id").applyInPandas(fill, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "m smallint"]))


def bolus_mask(masks: DataFrame, image_size: int, crop_axis: str = "sag") -> DataFrame:
    """Mask of a bolus recording: maximum over time, cropped to the image, holes filled."""
    return fill_holes(crop(max_projection(masks, 3), crop_axis, image_size), 3)


def transformed(df: DataFrame, steps: Sequence) -> DataFrame:
    """df after each step (DataFrame to DataFrame) in turn."""
    return reduce(lambda d, f: d.transform(f), steps, df)


