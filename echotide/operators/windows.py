"""Regions of interest, their bounding boxes, and grids of spatial windows.

Windows on a grid need no range join: the windows that hold a coordinate follow from
its distance to the box's edge by integer division, so cells meet windows in an equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotide.schema import ROI, axes

#: A window is kept where more than this share of its cells is in the mask.
COVERAGE = 0.2


def in_roi(voxels: DataFrame, mask: DataFrame, dims: int) -> DataFrame:
    """Voxels inside each region, with its seg_id. A cell is inside where its mask is above 0."""
    cells = mask.where("m > 0").select("scan_id", "seg_id", *axes(dims))
    return voxels.join(cells, ["scan_id", *axes(dims)])


def bounding_box(mask: DataFrame, dims: int) -> DataFrame:
    """min_ and max_ of each axis over the cells of a region."""
    return mask.where("m > 0").groupBy(*ROI).agg(*(f(c).alias(f"{k}_{c}") for c in axes(dims) for k, f in (("min", F.min), ("max", F.max))))


def steps(lengths: Sequence[float], overlaps: Sequence[float], resolution: Sequence[float]) -> list[int]:
    """Cells between the starts of windows, per axis, from mm, per cent and mm per cell."""
    out = [int(n * (1 - o / 100) / r) for n, o, r in zip(lengths, overlaps, resolution)]
    if any(s < 1 for s in out):
        raise ValueError("a window step is below one cell: windows are too short, or overlap too much, for this resolution")
    return out


def dims_of(step: Sequence[int] | DataFrame) -> int:
    """Axes of window steps: cells per axis, or a table (scan_id, step_ per axis)."""
    return sum(c.startswith("step_") for c in step.columns) if isinstance(step, DataFrame) else len(step)


def _stepped(mask: DataFrame, step: Sequence[int] | DataFrame) -> DataFrame:
    """mask with step_ per axis: the same for all scans, or each scan's own."""
    if isinstance(step, DataFrame):
        return mask.join(step, "scan_id")
    return mask.withColumns({f"step_{c}": F.lit(int(s)) for c, s in zip(axes(len(step)), step)})


def window_grid(mask: DataFrame, step: Sequence[int] | DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Windows of each region: window_ix, start and end per axis, and k_ per axis, the place in the grid.

    Starts run from the box's lower edge to below its upper edge. A window stays where the mask equals 1 in
    more than `coverage` of the cells of [start, start + step), cut at the array's edge. mask is dense.
    """
    names = axes(dims_of(step))
    boxed = _stepped(mask, step).join(bounding_box(mask, len(names)), ROI)
    for c in names:
        off = F.col(c) - F.col(f"min_{c}")
        boxed = boxed.where(off >= 0).withColumn(f"k_{c}", F.floor(off / F.col(f"step_{c}")).cast("int"))
    starts = {c: F.col(f"min_{c}") + F.col(f"k_{c}") * F.col(f"step_{c}") for c in names}
    grid = boxed.groupBy(*ROI, *(f"k_{c}" for c in names)).agg(F.avg((F.col("m") == 1).cast("double")).alias("share"), *(F.first(f"{e}_{c}").alias(f"{e}_{c}") for c in names for e in ("min", "max", "step")))
    grid = grid.where(F.col("share") > coverage)
    for c in names:
        grid = grid.where(starts[c] < F.col(f"max_{c}"))
    grid = grid.select(*ROI, *(x for c in names for x in (F.col(f"k_{c}"), starts[c].alias(f"{c}_start"), (starts[c] + F.col(f"step_{c}")).alias(f"{c}_end"))))
    order = Window.partitionBy(*ROI).orderBy(*(f"{c}_start" for c in names))
    return grid.withColumn("window_ix", (F.row_number().over(order) - 1).cast("int"))


def _places(offset: Column, step: Column) -> Column:
    """Grid places whose box [start, start + step], both ends in, holds an offset from the first start."""
    k = F.floor(offset / step).cast("int")
    return F.when((offset % step == 0) & (k >= 1), F.array(k - 1, k)).otherwise(F.array(k))


def window_cells(mask: DataFrame, windows: DataFrame, step: Sequence[int] | DataFrame) -> DataFrame:
    """(scan_id, seg_id, window_ix, spatial columns): the cells of the array in each window.

    Boxes have both ends in, reach past the region, and are cut at the array's edge.
    """
    names = axes(dims_of(step))
    cells = _stepped(mask, step).join(bounding_box(mask, len(names)), ROI)
    for c in names:
        off = F.col(c) - F.col(f"min_{c}")
        cells = cells.where(off >= 0).withColumn(f"k_{c}", F.explode(_places(off, F.col(f"step_{c}"))))
    return cells.join(windows.select(*ROI, "window_ix", *(f"k_{c}" for c in names)), [*ROI, *(f"k_{c}" for c in names)]).select(*ROI, "window_ix", *names)


def window_columns(dims: int) -> Mapping[str, str]:
    """Names of window coordinates at the sinks."""
    words = {"ax": "Axial", "sag": "Sagittal", "cor": "Coronal"}
    return {f"{c}_{e}": f"Window-{words[c]} {e.title()} Pix" for e in ("start", "end") for c in axes(dims)}
