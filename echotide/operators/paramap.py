"""Parametric maps: window results written back to the cells they cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotide.functions import finite
from echotide.operators.windows import dims_of, window_cells
from echotide.schema import ROI, axes

#: Names of the colour maps that parameters take in turn.
COLORMAPS = ["viridis", "magma", "plasma", "inferno", "cividis", "summer", "winter", "autumn", "spring", "cool", "hot", "bone", "copper", "jet"]


def finite_values(quants: DataFrame) -> DataFrame:
    """Infinite values replaced by the finite extreme of their key (0 where there is none); NaN becomes null."""
    ends = quants.groupBy("key").agg(F.min(finite(F.col("value"))).alias("low"), F.max(finite(F.col("value"))).alias("high"))
    inf = float("inf")
    value = F.when(F.col("value") == inf, F.coalesce("high", F.lit(0.0))).when(F.col("value") == -inf, F.coalesce("low", F.lit(0.0))).when(~F.isnan("value"), F.col("value"))
    return quants.join(ends, "key").withColumn("value", value).drop("low", "high")


def paramap(quants: DataFrame, mask: DataFrame, windows: DataFrame, step: Sequence[int] | DataFrame, params: Sequence[str] | None = None) -> DataFrame:
    """(scan_id, seg_id, param, cells, value): at each cell, the mean over windows that hold it; null where none has a value.

    Rows exist for all cells of the array that a window covers. All keys are mapped unless params are named.
    """
    chosen = quants if params is None else quants.where(F.col("key").isin(*params))
    cells = window_cells(mask, windows, step)
    return cells.join(finite_values(chosen), [*ROI, "window_ix"]).groupBy(*ROI, F.col("key").alias("param"), *axes(dims_of(step))).agg(F.avg("value").cast("float").alias("value"))


def trim(maps: DataFrame, mask: DataFrame, dims: int, params: Sequence[str] | None = None) -> DataFrame:
    """The map over all cells of the array, with values inside the region only. Parameters that aren't named are looked up in the map, which then is made twice."""
    cells = mask.select(*ROI, *axes(dims), "m")
    if params is None:
        named = cells.join(maps.select(*ROI, "param").distinct(), ROI)
    else:
        named = cells.withColumn("param", F.explode(F.array(*map(F.lit, params))))
    return named.join(maps, [*ROI, "param", *axes(dims)], "left").withColumn("value", F.when(F.col("m") > 0, F.col("value"))).drop("m")


def color_index(maps: DataFrame) -> DataFrame:
    """index: 0 to 255 between the least and largest value of a parameter; null where they are equal."""
    ends = maps.groupBy(*ROI, "param").agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    place = (F.lit(255.0) / (F.col("high") - F.col("low")) * (F.col("value").cast("double") - F.col("low"))).cast("int")
    return maps.join(ends, [*ROI, "param"]).withColumn("index", F.when(F.col("high") > F.col("low"), F.least(F.greatest(place, F.lit(0)), F.lit(255)))).drop("low", "high")


def colormap(position: int) -> str:
    """The colour map of the parameter at a position."""
    return COLORMAPS[position % len(COLORMAPS)]
