"""Time-intensity curves: masked aggregates per frame, over a region or its windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotide.functions import time_s
from echotide.operators.windows import dims_of, in_roi, window_cells, window_grid
from echotide.schema import CURVE_KEY, ROI, axes

#: A curve type: aggregates over the voxels of one frame, by curve name.
CurveType = Callable[[Column], dict[str, Column]]
#: A curve type that needs more than a frame's values: from cells, dimensions and keys to (keys, curve_name, value).
TableType = Callable[[DataFrame, int, Sequence[str]], DataFrame]


def tic(value: Column) -> dict[str, Column]:
    """Mean intensity."""
    return {"TIC": F.avg(value)}


def check_names(aggregates: Sequence[dict[str, Column]]) -> dict[str, Column]:
    """All aggregates by curve name; a name that two types give is an error."""
    out: dict[str, Column] = {}
    for group in aggregates:
        if twice := set(out) & set(group):
            raise ValueError(f"duplicate curve names: {sorted(twice)}")
        out |= group
    return out


def _long(wide: DataFrame, names: Sequence[str], rate: Column, window: Column) -> DataFrame:
    long = wide.unpivot(["scan_id", "seg_id", "window_ix", "frame"], list(names), "curve_name", "value") if "window_ix" in wide.columns else wide.withColumn("window_ix", window).unpivot(["scan_id", "seg_id", "window_ix", "frame"], list(names), "curve_name", "value")
    return long.select(*CURVE_KEY, "frame", time_s(F.col("frame"), rate).alias("time_s"), F.col("value").cast("double").alias("value"))


def roi_curves(voxels: DataFrame, mask: DataFrame, dims: int, types: Sequence[CurveType] = (tic,), rate: Column | float = 1.0, frames: DataFrame | None = None) -> DataFrame:
    """Curves of whole regions: one shuffle, partial sums first. A region without cells has null values in all frames.

    frames (scan_id, frame) names all frames, where known; they are looked up among the voxels otherwise.
    """
    aggregates = check_names([t(F.col("value")) for t in types])
    found = in_roi(voxels, mask, dims).groupBy("scan_id", "seg_id", "frame").agg(*(c.alias(n) for n, c in aggregates.items()))
    spine = (voxels.select("scan_id", "frame").distinct() if frames is None else frames).join(mask.select(*ROI).distinct(), "scan_id")
    wide = spine.join(found, ["scan_id", "seg_id", "frame"], "left")
    return _long(wide, list(aggregates), F.lit(rate), F.lit(None).cast("int"))


def window_curves(voxels: DataFrame, mask: DataFrame, step: Sequence[int] | DataFrame, types: Sequence[CurveType] = (tic,), rate: Column | float = 1.0) -> DataFrame:
    """Curves of each window of each region. Which cells a window has is settled before frames come in."""
    aggregates = check_names([t(F.col("value")) for t in types])
    cells = window_cells(mask, window_grid(mask, step), step)
    wide = voxels.join(cells, ["scan_id", *axes(dims_of(step))]).groupBy("scan_id", "seg_id", "window_ix", "frame").agg(*(c.alias(n) for n, c in aggregates.items()))
    return _long(wide, list(aggregates), F.lit(rate), F.col("window_ix"))


def _timed(found: DataFrame, rate: Column | float) -> DataFrame:
    return found.select(*CURVE_KEY, "frame", time_s(F.col("frame"), F.lit(rate)).alias("time_s"), F.col("value").cast("double").alias("value"))


@runtime_checkable
class FrameType(Protocol):
    """A curve type that looks at whole frames: names of its curves, and a TableType. With `around`, cells of a region's box that the mask doesn't hold come too, with m = 0."""

    def names(self) -> Sequence[str]: ...

    def curves(self, cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame: ...


@dataclass(frozen=True)
class FrameFunction:
    """A curve type that a user writes as a function of arrays: (frame, mask, **arguments) gives names and values, one value per name.

    Arrays are over the box of the region or window, in the order ax, sag, cor; cells that the image lacks are NaN and not in the mask. One task has one frame of
    one region at a time. A frame for which there is nothing to say gives no names.
    """

    function: Callable[..., tuple[Sequence[str], Sequence[float]]]
    curve_names: Sequence[str]
    arguments: Mapping = field(default_factory=dict)
    around: bool = True

    def names(self) -> list[str]:
        return list(self.curve_names)

    def curves(self, cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
        spatial, keys, known = axes(dims), list(keys), set(self.curve_names)
        kinds, function, arguments = dict(cells.dtypes), self.function, dict(self.arguments)
        inside = cells if "m" in cells.columns else cells.withColumn("m", F.lit(1))

        def frame(t: pa.Table) -> pa.Table:
            where = [t.column(c).to_numpy() for c in spatial]
            low = [int(w.min()) for w in where]
            at = tuple(w - a for w, a in zip(where, low))
            shape = [int(w.max()) + 1 for w in at]
            image, mask = np.full(shape, np.nan), np.zeros(shape, bool)
            image[at], mask[at] = t.column("value").to_numpy(zero_copy_only=False), t.column("m").to_numpy(zero_copy_only=False) > 0
            names, values = function(image, mask, **arguments)
            names = list(names)
            if len(names) != len(values) or len(set(names)) < len(names) or not set(names) <= known:
                raise ValueError(f"a curve type gave {names}; it has {sorted(known)}, one value each")
            ids = [pa.array([t.column(k)[0].as_py()] * len(names), t.schema.field(k).type) for k in keys]
            return pa.table([*ids, pa.array(names, pa.string()), pa.array([None if v is None else float(v) for v in values], pa.float64())], names=[*keys, "curve_name", "value"])

        plain = inside.select(*keys, *spatial, F.col("value").cast("double").alias("value"), "m")
        return plain.groupBy(*keys).applyInArrow(frame, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "curve_name string", "value double"]))


def roi_texture(voxels: DataFrame, mask: DataFrame, dims: int, texture: TableType, names: Sequence[str], rate: Column | float, frames: DataFrame, around: bool = False) -> DataFrame:
    """Curves (names) of whole regions by a type that looks at whole frames; a frame without a result has null. Cells equal to 1 count."""
    on = ["scan_id", *axes(dims)]
    held = mask.where("m = 1").select(*ROI, *axes(dims))
    if around:
        box = held.groupBy(*ROI).agg(*(f(c).alias(f"{k}_{c}") for c in axes(dims) for k, f in (("min", F.min), ("max", F.max))))
        within = reduce(lambda a, b: a & b, (F.col(c).between(F.col(f"min_{c}"), F.col(f"max_{c}")) for c in axes(dims)))
        cells = voxels.join(box, "scan_id").where(within).join(held.withColumn("m", F.lit(1)), [*ROI, *axes(dims)], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    else:
        cells = voxels.join(held, on)
    found = texture(cells, dims, [*ROI, "frame"])
    spine = frames.join(mask.select(*ROI).distinct(), "scan_id").withColumn("curve_name", F.explode(F.array(*map(F.lit, names))))
    return _timed(spine.join(found, [*ROI, "frame", "curve_name"], "left").withColumn("window_ix", F.lit(None).cast("int")), rate)


def window_texture(voxels: DataFrame, mask: DataFrame, step: Sequence[int] | DataFrame, texture: TableType, rate: Column | float) -> DataFrame:
    """Curves of each window by a type that looks at whole frames."""
    cells = voxels.join(window_cells(mask, window_grid(mask, step), step), ["scan_id", *axes(dims_of(step))])
    return _timed(texture(cells, dims_of(step), [*ROI, "window_ix", "frame"]), rate)


def fill_gaps(curves: DataFrame, key: Sequence[str] = CURVE_KEY) -> DataFrame:
    """A missing value repeats the last one; a missing first frame takes the value of the second."""
    order = Window.partitionBy(*key).orderBy("frame")
    last = F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return curves.withColumn("value", F.coalesce(last, F.when(F.row_number().over(order) == 1, F.lead("value").over(order))))


def duplicates(curves: DataFrame, key: Sequence[str] = CURVE_KEY) -> DataFrame:
    """Frames that a curve has more than once."""
    return curves.groupBy(*key, "frame").agg(F.count("*").alias("n")).where("n > 1")


def pack(curves: DataFrame) -> DataFrame:
    """One row per curve, with its points in order of frames."""
    return curves.groupBy(*CURVE_KEY).agg(F.array_sort(F.collect_list(F.struct("frame", "time_s", "value"))).alias("points"))


def mean_curve(curves: DataFrame, start: float = 0.0, end: float | None = None, name: str = "TIC") -> DataFrame:
    """Mean over windows of a curve at each frame, without NaN, within times."""
    picked = curves.where((F.col("curve_name") == name) & (F.col("time_s") >= start))
    picked = picked if end is None else picked.where(F.col("time_s") <= end)
    return picked.groupBy("scan_id", "seg_id", "frame", "time_s").agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("value"))
