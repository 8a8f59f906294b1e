"""Many scans as one plan: their metadata is a table, and whatever depends on a scan's shape or spacing is joined to it.

Axis tables, frames and window steps are rows by scan, made by column expressions from the metadata; nothing is done scan by scan on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotide.functions import time_s
from echotide.operators import preprocess
from echotide.schema import axes

#: Most kinds of geometry for which curve types that need an image's size are planned apart.
MOST_GEOMETRIES = 64


def _places(dims: int) -> dict[str, tuple[int, int]]:
    """Where shape and pixdim have each axis, counted from 1."""
    return {"ax": (2, 1), "sag": (3, 2)} if dims == 2 else {"ax": (3, 3), "sag": (1, 1), "cor": (2, 2)}


@dataclass(frozen=True)
class Study:
    """Scans of one rank: a row of metadata each (scan_id, shape, pixdim, frame_rate, original_pixdim, pixel_type), and all their voxels."""

    scans: DataFrame
    voxels: DataFrame
    dims: int

    def sizes(self, original: bool = False) -> DataFrame:
        """(scan_id, n_ and mm_ per axis, frames, frame_rate, pixel_type); mm before resampling if original."""
        pixdim = F.coalesce("original_pixdim", "pixdim") if original else F.col("pixdim")
        each = (c for name, (n, mm) in _places(self.dims).items() for c in (F.element_at("shape", n).alias(f"n_{name}"), F.element_at(pixdim, mm).alias(f"mm_{name}")))
        return self.scans.select("scan_id", *each, F.col("shape")[0 if self.dims == 2 else 3].alias("frames"), "frame_rate", "pixel_type")

    def frames(self) -> DataFrame:
        """(scan_id, frame): all frames of all scans."""
        return self.sizes().where("frames > 0").select("scan_id", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))

    def timed(self, curves: DataFrame) -> DataFrame:
        """curves with time by each scan's own rate."""
        rates = self.scans.select("scan_id", "frame_rate")
        return curves.join(rates, "scan_id").withColumn("time_s", time_s(F.col("frame"), F.col("frame_rate"))).select(curves.columns)


def study_of(scans: DataFrame, voxels: DataFrame) -> Study:
    """A study from tables of metadata and voxels; scans of different ranks are an error."""
    ranks = [r[0] for r in scans.select("spatial_dims").distinct().limit(2).collect()]
    if len(ranks) != 1:
        raise ValueError("scans of a study must be all 2-D or all 3-D over time" if ranks else "no scans")
    extra = {} if "original_pixdim" in scans.columns else {"original_pixdim": F.lit(None).cast("array<double>")}
    return Study(scans.withColumns(extra), voxels, ranks[0])


def _targets(sizes: DataFrame, axis: str, interp: str) -> DataFrame:
    """(scan_id, target, source, weight) of an axis of each scan. sizes: n_, mm_ and to_ of the axis."""
    n, old, new = F.col(f"n_{axis}"), F.col(f"mm_{axis}"), F.col(f"to_{axis}")
    count = F.rint(n * old / new).cast("int")
    spots = sizes.where(count > 0).withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    if interp == "nearest":
        return spots.select("scan_id", F.col("i").alias(f"__to_{axis}"), F.least(F.floor(F.col("i") * new / old + 0.5), n - 1).cast("int").alias(axis), F.lit(1.0).alias(f"__w_{axis}"))
    spots = spots.withColumn("at", F.least(F.col("i") * new / old, (n - 1).cast("double"))).withColumn("low", F.floor("at").cast("int"))
    far = F.col("at") - F.col("low")
    both = spots.withColumn("x", F.explode(F.array(F.struct(F.col("low").alias("s"), (1 - far).alias("w")), F.struct((F.col("low") + 1).alias("s"), far.alias("w")))))
    return both.where("x.w > 0").select("scan_id", F.col("i").alias(f"__to_{axis}"), F.col("x.s").alias(axis), F.col("x.w").alias(f"__w_{axis}"))


def _cubic(cells: DataFrame, sizes: DataFrame, names: Sequence[str], value: str, keys: Sequence[str]) -> DataFrame:
    """Interpolating splines along lines, each with its own scan's geometry."""
    out = cells.select(*keys, *names, value)
    for c in names:
        own = sizes.select("scan_id", F.col(f"n_{c}").cast("int").alias("__n"), F.col(f"mm_{c}").cast("double").alias("__old"), F.col(f"to_{c}").alias("__new"))
        out = preprocess.cubic_along(out.join(own, "scan_id"), c, value, [*keys, *(a for a in names if a != c)])
    return out.select(*keys, *names, value)


def resampled(cells: DataFrame, sizes: DataFrame, names: Sequence[str], interp: str, value: str = "value", keys: Sequence[str] = ("scan_id", "frame")) -> DataFrame:
    """cells on each scan's new grid. sizes (scan_id, n_, mm_ and to_ per axis) are the old cells and spacing and the new spacing."""
    if interp not in ("nearest", "linear", "cubic"):
        raise ValueError("interp must be 'linear', 'nearest' or 'cubic'")
    if interp == "cubic":
        return _cubic(cells, sizes, names, value, keys)
    out, weight = cells, F.lit(1.0)
    for c in names:
        out = out.join(_targets(sizes, c, interp), ["scan_id", c])
        weight = weight * F.col(f"__w_{c}")
    total = F.first(value) if interp == "nearest" else F.sum(F.col(value) * weight)
    return out.groupBy(*keys, *(F.col(f"__to_{c}").alias(c) for c in names)).agg(total.alias(value))


def _new(dims: int, spacing: Sequence[float]) -> dict[str, Column]:
    return {f"to_{name}": F.lit(float(spacing[mm - 1])) for name, (_, mm) in _places(dims).items()}


def _held(value: Column, kind: Column) -> Column:
    """Values as each scan's pixel type can hold them."""
    for name in ("uint8", "int8", "uint16", "int16", "uint32", "int32"):
        info = np.iinfo(name)
        value = F.when(kind == name, F.least(F.greatest(F.rint(value), F.lit(float(info.min))), F.lit(float(info.max)))).otherwise(value)
    return value


def resample(study: Study, spacing: Sequence[float], interp: str = "linear") -> Study:
    """All scans at one spacing, given in the order of the files' axes."""
    dims, names = study.dims, axes(study.dims)
    sizes = study.sizes().withColumns(_new(dims, spacing))
    voxels = study.voxels.drop("cor") if dims == 2 else study.voxels
    out = resampled(voxels, sizes, names, interp).join(sizes.select("scan_id", "pixel_type"), "scan_id")
    out = out.withColumn("value", _held(F.col("value"), F.col("pixel_type"))).drop("pixel_type")
    n = {name: F.rint(F.element_at("shape", at) * F.element_at("pixdim", mm) / float(spacing[mm - 1])).cast("int") for name, (at, mm) in _places(dims).items()}
    shape = F.array(F.element_at("shape", 1), n["ax"], n["sag"]) if dims == 2 else F.array(n["sag"], n["cor"], n["ax"], F.element_at("shape", 4))
    scans = study.scans.withColumns({"shape": shape, "original_pixdim": F.coalesce("original_pixdim", "pixdim"), "pixdim": F.array(*(F.lit(float(x)) for x in spacing[:dims]))})
    return replace(study, scans=scans, voxels=out)


def resample_masks(study: Study, mask: DataFrame, spacing: Sequence[float], interp: str = "nearest") -> DataFrame:
    """Masks on the grids of their scans, from the spacing before these were resampled."""
    names = axes(study.dims)
    own = mask.groupBy("scan_id").agg(*((F.max(c) + 1).alias(f"n_{c}") for c in names))
    sizes = own.join(study.sizes(original=True).select("scan_id", *(f"mm_{c}" for c in names)), "scan_id").withColumns(_new(study.dims, spacing))
    out = resampled(mask.select("scan_id", "seg_id", *names, "m"), sizes, names, interp, "m", ("scan_id", "seg_id"))
    return out.withColumn("m", F.rint("m").cast("smallint"))


def steps(study: Study, lengths: Sequence[float], overlaps: Sequence[float], resolution: Sequence[float] | None = None) -> DataFrame:
    """(scan_id, step_ per axis): cells between the starts of windows, by each scan's spacing. As for one scan, it is read in its own order unless resolution is given."""
    out = []
    for k, (c, mm, overlap) in enumerate(zip(axes(study.dims), lengths, overlaps)):
        r = F.lit(float(resolution[k])) if resolution else F.element_at("pixdim", k + 1)
        step = (F.lit(mm * (1 - overlap / 100)) / r).cast("int")
        out.append(F.when(step >= 1, step).otherwise(F.raise_error(F.concat(F.lit("a window step is below one cell: windows are too short, or overlap too much, for the resolution of "), F.col("scan_id"))).cast("int")).alias(f"step_{c}"))
    return study.scans.select("scan_id", *out)


@dataclass(frozen=True)
class PerGeometry:
    """A curve type over whole frames that depends on an image's size and spacing: one of its kind for each geometry in a study."""

    parts: Sequence[tuple[DataFrame, object]]

    def names(self) -> list[str]:
        return self.parts[0][1].names()

    def curves(self, cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, (t.curves(cells.join(scans, "scan_id", "left_semi"), dims, keys) for scans, t in self.parts))


def per_geometry(study: Study, make) -> PerGeometry:
    """make(spacing, size), both in the order ax, sag, cor, for each geometry; few are expected, as after resampling."""
    names = axes(study.dims)
    columns = [*(f"mm_{c}" for c in names), *(f"n_{c}" for c in names)]
    sizes = study.sizes()
    found = sizes.select(*columns).distinct().orderBy(*columns).limit(MOST_GEOMETRIES + 1).collect()
    if len(found) > MOST_GEOMETRIES:
        raise ValueError(f"more than {MOST_GEOMETRIES} geometries in a study; run it in parts")
    parts = []
    for g in found:
        same = reduce(lambda a, b: a & b, (F.col(c) == g[c] for c in columns))
        parts.append((sizes.where(same).select("scan_id"), make([g[f"mm_{c}"] for c in names], [g[f"n_{c}"] for c in names])))
    return PerGeometry(parts)
