"""Curves and results as wide CSV or Parquet, and back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotide.operators.quantify import IDS, wide
from echotide.operators.windows import window_columns
from echotide.schema import axes, require

SCAN_NAME, SEG_NAME, WINDOW_INDEX, TIME = "Scan Name", "Segmentation Name", "Window Index", "Time Array"


def curves_wide(curves: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per frame, a column per curve; the first value there is counts. One aggregation, so that curves of a frame meet before the shuffle."""
    values = (F.first(F.when(F.col("curve_name") == n, F.col("value")), ignorenulls=True).alias(n) for n in names)
    return curves.groupBy("scan_id", "seg_id", "window_ix", "frame", "time_s").agg(*values)


def save_curves(curves: DataFrame, path: str, names: Sequence[str], windows: DataFrame | None = None) -> None:
    """Curves as CSV, a folder per window where there are windows: curves first, then names, window and time."""
    table = curves_wide(curves, names)
    extra = []
    if windows is not None:
        places = window_columns(3 if "cor_start" in windows.columns else 2)
        table = table.join(windows.select(*IDS, *places), IDS, "left")
        extra = [F.col(c).alias(n) for c, n in places.items()]
    out = table.select(*names, F.col("scan_id").alias(SCAN_NAME), F.col("seg_id").alias(SEG_NAME), F.col("window_ix").alias(WINDOW_INDEX), *extra, F.col("time_s").alias(TIME), F.col("window_ix").alias("window"))
    writer = out.write.option("header", True)
    (writer.partitionBy("window") if windows is not None else writer).csv(path)


def load_curves(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Curves from CSV, columns by name: all that aren't names, window or time, unless named. Frames are numbered by time."""
    raw = spark.read.option("header", True).csv(path)
    require(raw, SCAN_NAME, SEG_NAME, TIME)
    meta = {SCAN_NAME, SEG_NAME, WINDOW_INDEX, TIME, "window", *window_columns(3).values()}
    names = list(names or (c for c in raw.columns if c not in meta))
    base = raw.select(F.col(f"`{SCAN_NAME}`").alias("scan_id"), F.col(f"`{SEG_NAME}`").alias("seg_id"), (F.col(f"`{WINDOW_INDEX}`").cast("int") if WINDOW_INDEX in raw.columns else F.lit(None).cast("int")).alias("window_ix"), F.col(f"`{TIME}`").cast("double").alias("time_s"), *(F.col(f"`{n}`").cast("double").alias(n) for n in names))
    from pyspark.sql.window import Window

    order = Window.partitionBy("scan_id", "seg_id", "window_ix").orderBy("time_s")
    numbered = base.withColumn("frame", (F.row_number().over(order) - 1).cast("int"))
    return numbered.unpivot(["scan_id", "seg_id", "window_ix", "frame", "time_s"], names, "curve_name", "value").select("scan_id", "seg_id", "window_ix", "curve_name", "frame", "time_s", "value")


def save_quants(quants: DataFrame, path: str, keys: Sequence[str], windows: DataFrame | None = None) -> None:
    """Results as CSV: names, window coordinates, a column per key."""
    table = wide(quants, keys)
    places = window_columns(3 if windows is not None and "cor_start" in windows.columns else 2) if windows is not None else {}
    if windows is not None:
        table = table.join(windows.select(*IDS, *places), IDS, "left")
    table.select(F.col("scan_id").alias(SCAN_NAME), F.col("seg_id").alias(SEG_NAME), *(F.col(c).alias(n) for c, n in places.items()), *(F.col(f"`{k}`") for k in keys)).write.option("header", True).csv(path)


def save_paramap(maps: DataFrame, path: str) -> None:
    """Parametric maps as Parquet, a folder per parameter."""
    maps.write.partitionBy("param").parquet(path)


def load_paramap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def value_range(maps: DataFrame) -> DataFrame:
    """Least and largest value of each parameter, without NaN."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return maps.groupBy("param").agg(F.min(v).alias("low"), F.max(v).alias("high"))


def to_array(maps: DataFrame, param: str, shape: Sequence[int]) -> np.ndarray:
    """One map as an array for a viewer, NaN where it has no value. shape is in the order ax, sag, cor; it bounds what is collected."""
    names = axes(len(shape))
    out = np.full(shape, np.nan, np.float32)
    for r in maps.where(F.col("param") == param).select(*names, "value").toLocalIterator():
        if r["value"] is not None:
            out[tuple(r[c] for c in names)] = r["value"]
    return out if len(shape) == 2 else np.transpose(out, (1, 2, 0))


def export_image(voxels: DataFrame, mask: DataFrame, scan_id: str, pixdim: Sequence[float], path: str) -> None:
    """What a viewer needs beside maps: image, segmentation and pix_dims."""
    voxels.write.partitionBy("frame").parquet(f"{path}/image")
    mask.write.parquet(f"{path}/segmentation")
    voxels.sparkSession.range(1).select(F.lit(scan_id).alias("scan_id"), F.array(*(F.lit(float(x)) for x in pixdim)).alias("pixdim")).write.parquet(f"{path}/pix_dims")


def export_images(voxels: DataFrame, mask: DataFrame, scans: DataFrame, path: str) -> None:
    """The same of many scans."""
    voxels.write.partitionBy("scan_id", "frame").parquet(f"{path}/image")
    mask.write.partitionBy("scan_id").parquet(f"{path}/segmentation")
    scans.select("scan_id", "pixdim").write.parquet(f"{path}/pix_dims")
