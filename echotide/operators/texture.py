"""Texture curves: discretised intensities, first-order features and gray-level co-occurrence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotide.operators import graylevel, imagefilters, shape
from echotide.operators.components import cut_lineage
from echotide.schema import axes


def discretize(voxels: DataFrame, width: float, low: float = 0.0) -> DataFrame:
    """level: floor((value - low) / width) + 1 where the mask is 1, else 0. voxels has m."""
    return voxels.withColumn("level", F.when(F.col("m") == 1, F.floor((F.col("value") - low) / width) + 1).otherwise(0).cast("int"))


def phantom_voxel(voxels: DataFrame, dims: int) -> DataFrame:
    """The origin's value becomes 0, and it joins the mask."""
    origin = F.lit(True)
    for c in axes(dims):
        origin = origin & (F.col(c) == 0)
    return voxels.withColumn("value", F.when(origin, 0.0).otherwise(F.col("value"))).withColumn("m", F.when(origin, 1).otherwise(F.col("m")).cast("smallint"))


def offsets(dims: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite neighbours."""
    out = [()]
    for _ in range(dims):
        out = [(*o, d) for o in out for d in (-1, 0, 1)]
    return [o for o in out if o > (0,) * dims]


def glcm(levels: DataFrame, dims: int, distance: int = 1, keys: Sequence[str] = ("scan_id", "seg_id", "frame"), by_angle: bool = False) -> DataFrame:
    """(keys, i, j, p): shares of pairs of levels of neighbouring cells of the mask, both ways round.

    Neighbours meet in an equi-join on shifted coordinates. by_angle makes a matrix of each direction, numbered by angle.
    """
    keys = [*keys, "angle"] if by_angle else list(keys)
    inside = levels.where("m = 1").select(*(k for k in keys if k != "angle"), *axes(dims), "level")
    shifts = F.array(*(F.struct(*(F.lit(d * distance).alias(f"d_{c}") for c, d in zip(axes(dims), o))) for o in offsets(dims)))
    left = inside.withColumnRenamed("level", "i").select("*", F.posexplode(shifts).alias("angle", "o")).withColumns({c: F.col(c) + F.col(f"o.d_{c}") for c in axes(dims)}).drop("o")
    pairs = left.join(inside.withColumnRenamed("level", "j"), [*(k for k in keys if k != "angle"), *axes(dims)]).groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))
    total = both.groupBy(*keys).agg(F.sum("n").alias("total"))
    return both.join(total, list(keys)).select(*keys, "i", "j", (F.col("n") / F.col("total")).alias("p"))


def glcm_features(matrix: DataFrame, keys: Sequence[str] = ("scan_id", "seg_id", "frame")) -> DataFrame:
    """Contrast, JointEnergy, JointEntropy, Idm and DifferenceAverage of each matrix."""
    d, p = F.col("i") - F.col("j"), F.col("p")
    return matrix.groupBy(*keys).agg(
        F.sum(d * d * p).alias("glcm_Contrast"),
        F.sum(p * p).alias("glcm_JointEnergy"),
        (-F.sum(p * F.log2(p))).alias("glcm_JointEntropy"),
        F.sum(p / (1 + d * d)).alias("glcm_Idm"),
        F.sum(F.abs(d) * p).alias("glcm_DifferenceAverage"),
    )


def radiomics_first_order(value: Column) -> dict[str, Column]:
    """A curve type: first-order features of the voxels of a frame."""
    return {"firstorder_Mean": F.avg(value), "firstorder_Variance": F.var_pop(value), "firstorder_Energy": F.sum(value * value), "firstorder_Range": F.max(value) - F.min(value)}


#: Names of the features of each class of a radiomics configuration.
FIRST_ORDER = ("10Percentile", "90Percentile", "Energy", "Entropy", "InterquartileRange", "Kurtosis", "Maximum", "MeanAbsoluteDeviation", "Mean", "Median", "Minimum", "Range", "RobustMeanAbsoluteDeviation", "RootMeanSquared", "Skewness", "TotalEnergy", "Uniformity", "Variance")
CLASSES = {"firstorder": FIRST_ORDER, "glcm": graylevel.GLCM, **{k: tuple(n for n in names if n) for k, names in graylevel.SIZES.items()}, "ngtdm": graylevel.NGTDM}
#: Features of cells (keys, spatial columns, level, ng), by class.
MATRICES = {"glrlm": graylevel.glrlm_features, "glszm": graylevel.glszm_features, "gldm": graylevel.gldm_features, "ngtdm": graylevel.ngtdm_features}


def first_order_features(levels: DataFrame, keys: Sequence[str], width: float, volume: float) -> DataFrame:
    """FIRST_ORDER of the levels inside the mask, from a histogram per key; width is that of the bins of Entropy and Uniformity."""
    x, n, of = F.col("level"), F.col("n"), Window.partitionBy(*keys)
    bins = F.floor(x / width)
    share = lambda p: F.expr(f"percentile(level, {p}, n)")
    hist = levels.where("m = 1").groupBy(*keys, "level").agg(F.count("*").alias("n"))
    hist = hist.withColumns({"count": F.sum(n).over(of), "mean": F.sum(x * n).over(of) / F.sum(n).over(of), "low": share(0.1).over(of), "high": share(0.9).over(of), "bin": F.sum(n).over(Window.partitionBy(*keys, bins))})
    middle = F.when(x.between(F.col("low"), F.col("high")), n)
    hist = hist.withColumn("center", F.sum(middle * x).over(of) / F.sum(middle).over(of))
    moment = lambda k: F.sum(n * F.pow(x - F.col("mean"), F.lit(k))) / F.sum(n)
    in_bin = F.col("bin") / F.col("count")
    out = hist.groupBy(*keys).agg(
        share(0.1).alias("10Percentile"), share(0.9).alias("90Percentile"), F.sum(n * x * x).cast("double").alias("Energy"),
        (-F.sum(n / F.col("count") * F.log2(in_bin))).alias("Entropy"), (share(0.75) - share(0.25)).alias("InterquartileRange"),
        moment(4).alias("m4"), moment(3).alias("m3"), F.max(x).cast("double").alias("Maximum"), (F.sum(n * F.abs(x - F.col("mean"))) / F.sum(n)).alias("MeanAbsoluteDeviation"),
        F.first("mean").alias("Mean"), share(0.5).alias("Median"), F.min(x).cast("double").alias("Minimum"), (F.max(x) - F.min(x)).cast("double").alias("Range"),
        (F.sum(middle * F.abs(x - F.col("center"))) / F.sum(middle)).alias("RobustMeanAbsoluteDeviation"), F.sqrt(F.sum(n * x * x) / F.sum(n)).alias("RootMeanSquared"),
        F.sum(n / F.col("count") * in_bin).alias("Uniformity"), moment(2).alias("Variance"))
    flat = F.col("Variance") == 0
    return out.withColumns({"Kurtosis": F.when(flat, 0.0).otherwise(F.col("m4") / F.pow("Variance", F.lit(2))), "Skewness": F.when(flat, 0.0).otherwise(F.col("m3") / F.pow("Variance", F.lit(1.5))), "TotalEnergy": F.col("Energy") * volume}).select(*keys, *FIRST_ORDER)


#: From so many classes of features on, an image is written once rather than made anew for each.
MANY = 3


@dataclass(frozen=True)
class Radiomics:
    """A curve type over whole frames: features of the discretised intensities, by configuration (name, its entries).

    dims, and size and spacing in the order ax, sag, cor, are the image's; filters along axes need its size. A configuration without
    featureClass asks for all classes (shape in 3-D only), one without imageType for the original image.
    """

    configs: Sequence[tuple[str, Mapping]]
    min_intensity: float
    binwidth: float
    volume: float = 1.0
    dims: int = 2
    size: Sequence[int] = ()
    spacing: Sequence[float] = ()

    def wanted(self) -> list[tuple[str, str, str, list[str]]]:
        """(configuration, image, class, features) of all that is asked for; unknown names raise ValueError. Shape is of the region, so of no filtered image."""
        every = {**CLASSES, **({"shape": shape.SHAPE[3]} if self.dims == 3 else {})}
        known = {**every, **({"shape2D": shape.SHAPE[2]} if self.dims == 2 else {})}
        out = []
        for name, config in self.configs:
            imagefilters.check(config, bool(self.size))
            for kind, features in (config.get("featureClass") or dict.fromkeys(every)).items():
                if kind not in known:
                    raise ValueError(f"unknown radiomics class: {kind}; known: {', '.join(sorted(known))}")
                if bad := set(features or ()) - set(known[kind]):
                    raise ValueError(f"unknown {kind} features: {', '.join(sorted(bad))}; known: {', '.join(known[kind])}")
                images = ["original"] if kind.startswith("shape") else imagefilters.names(config, self.dims)
                out += [(name, i, kind, list(features or known[kind])) for i in images]
        return out

    def names(self) -> list[str]:
        """Names of the curves."""
        return [f"{name}_{image}_{kind}_{f}" for name, image, kind, features in self.wanted() for f in features]

    def curves(self, cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
        """(keys, curve_name, value) from cells (keys, spatial columns, value) of the mask.

        Each frame's first cell has the value 0 and counts as part of the mask. Features of co-occurrence and of runs are means over directions.
        """
        names, keys = axes(dims), list(keys)
        spacing = list(self.spacing) or [1.0] * dims
        origin = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in names])
        corner = cells.select(*keys).distinct().select(*keys, *(F.lit(0).alias(c) for c in names), F.lit(0.0).alias("value"))
        cells = cells.where(~origin).select(*keys, *names, F.col("value").cast("double").alias("value")).unionByName(corner)
        levels = discretize(cells.withColumn("m", F.lit(1)), self.binwidth, self.min_intensity).select(*keys, *names, F.col("level").cast("double").alias("value"))
        wanted = self.wanted()
        if len(wanted) >= MANY:
            levels = cut_lineage(levels)
        made = {name: imagefilters.images(levels, dims, keys, config, self.size, spacing) for name, config in self.configs}
        for name, images in made.items():
            for image, d in images.items():
                if d is not levels and sum(w[:2] == (name, image) for w in wanted) >= MANY:
                    images[image] = cut_lineage(d)
        widths = {name: float((config.get("setting") or {}).get("binWidth", 25)) for name, config in self.configs}
        out = None
        for name, image, kind, features in wanted:
            source = made[name].get(image, levels).select(*keys, *names, F.col("value").alias("level"), F.lit(1).alias("m"))
            if kind == "firstorder":
                table = first_order_features(source, keys, widths[name], self.volume)
            elif kind.startswith("shape"):
                table = shape.shape_features(source, dims, keys, spacing)
            else:
                gray = graylevel.gray_levels(source, dims, keys, widths[name])
                table = graylevel.glcm_features(gray, dims, keys, features=features) if kind == "glcm" else MATRICES[kind](gray, dims, keys)
            part = table.select(*keys, *(F.col(f"`{f}`").cast("double").alias(f"{name}_{image}_{kind}_{f}") for f in features))
            part = part.unpivot(keys, part.columns[len(keys) :], "curve_name", "value")
            out = part if out is None else out.unionByName(part)
        return without_diagnostics(out)


def without_diagnostics(features: DataFrame) -> DataFrame:
    """Rows of features (curve_name, value) that are numbers and no diagnostics."""
    return features.where(~F.contains("curve_name", F.lit("diagnostics")) & F.col("value").cast("double").isNotNull())
