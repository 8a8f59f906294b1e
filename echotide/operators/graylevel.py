"""Gray-level matrices of the cells of a mask, and their features: run lengths, zone sizes, dependences, neighbourhoods, co-occurrence.

All take cells (keys, spatial columns, level), level from 1, and give one row of features per key. Matrices are long tables (keys, level, size, n).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotide.operators.components import components, neighbours
from echotide.schema import axes

#: Names of the features of matrices of sizes, by class, in the order of _size_features.
SIZES = {
    "glrlm": ("ShortRunEmphasis", "LongRunEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "RunLengthNonUniformity", "RunLengthNonUniformityNormalized", "RunPercentage", "GrayLevelVariance", "RunVariance", "RunEntropy", "LowGrayLevelRunEmphasis", "HighGrayLevelRunEmphasis", "ShortRunLowGrayLevelEmphasis", "ShortRunHighGrayLevelEmphasis", "LongRunLowGrayLevelEmphasis", "LongRunHighGrayLevelEmphasis"),
    "glszm": ("SmallAreaEmphasis", "LargeAreaEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "SizeZoneNonUniformity", "SizeZoneNonUniformityNormalized", "ZonePercentage", "GrayLevelVariance", "ZoneVariance", "ZoneEntropy", "LowGrayLevelZoneEmphasis", "HighGrayLevelZoneEmphasis", "SmallAreaLowGrayLevelEmphasis", "SmallAreaHighGrayLevelEmphasis", "LargeAreaLowGrayLevelEmphasis", "LargeAreaHighGrayLevelEmphasis"),
    "gldm": ("SmallDependenceEmphasis", "LargeDependenceEmphasis", "GrayLevelNonUniformity", None, "DependenceNonUniformity", "DependenceNonUniformityNormalized", None, "GrayLevelVariance", "DependenceVariance", "DependenceEntropy", "LowGrayLevelEmphasis", "HighGrayLevelEmphasis", "SmallDependenceLowGrayLevelEmphasis", "SmallDependenceHighGrayLevelEmphasis", "LargeDependenceLowGrayLevelEmphasis", "LargeDependenceHighGrayLevelEmphasis"),
}
NGTDM = ("Coarseness", "Contrast", "Busyness", "Complexity", "Strength")
GLCM = ("Autocorrelation", "JointAverage", "ClusterProminence", "ClusterShade", "ClusterTendency", "Contrast", "Correlation", "DifferenceAverage", "DifferenceEntropy", "DifferenceVariance", "JointEnergy", "JointEntropy", "Imc1", "Imc2", "Idm", "Idmn", "Id", "Idn", "InverseVariance", "MaximumProbability", "SumAverage", "SumEntropy", "SumSquares", "MCC")
#: Coarseness where no neighbourhood differs from its cell.
MOST_COARSE = 1e6


def gray_levels(levels: DataFrame, dims: int, keys: Sequence[str], width: float) -> DataFrame:
    """Cells of the mask (m = 1) with level counted in bins of a width from the lowest bin of each key, from 1, and ng, the highest."""
    bins = levels.where("m = 1").select(*keys, *axes(dims), F.floor(F.col("level") / width).cast("long").alias("level"))
    ends = bins.groupBy(*keys).agg(F.min("level").alias("low"), F.max("level").alias("high"))
    return bins.join(ends, list(keys)).select(*keys, *axes(dims), (F.col("level") - F.col("low") + 1).cast("int").alias("level"), (F.col("high") - F.col("low") + 1).cast("int").alias("ng"))


def _size_features(matrix: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Features of a matrix (keys, level, size, n) of counts."""
    i, s, n, total = (F.col(c).cast("double") for c in ("level", "size", "n", "total"))
    row, column = (F.sum("n").over(Window.partitionBy(*keys, c)).alias(c) for c in ("level", "size"))
    wide = matrix.withColumns({"total": F.sum("n").over(Window.partitionBy(*keys)), "row": row, "column": column})
    # Variances from whole numbers, so that nothing is lost by taking one sum from another.
    spread = lambda c: (F.sum(F.col("n") * F.col(c) * F.col(c)) * F.sum("n") - F.sum(F.col("n") * F.col(c)) * F.sum(F.col("n") * F.col(c))).cast("double") / F.sum("n") / F.sum("n")
    features = (
        F.sum(n / (s * s) / total), F.sum(n * s * s / total), F.sum(n * F.col("row") / total), F.sum(n * F.col("row") / total / total), F.sum(n * F.col("column") / total), F.sum(n * F.col("column") / total / total),
        F.sum("n") / F.sum(F.col("n") * F.col("size")), spread("level"), spread("size"), -F.sum(n / total * F.log2(n / total)), F.sum(n / (i * i) / total), F.sum(n * i * i / total),
        F.sum(n / (s * s * i * i) / total), F.sum(n * i * i / (s * s) / total), F.sum(n * s * s / (i * i) / total), F.sum(n * s * s * i * i / total),
    )
    return wide.groupBy(*keys).agg(*(f.alias(name) for f, name in zip(features, SIZES[kind]) if name))


def glrlm(cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
    """(keys, angle, level, size, n): runs of equal levels of neighbouring cells along each direction, by length.

    A cell's place on its line through a direction and the line's number follow from its coordinates; among a line's
    cells of one level, place - row_number is the same within a run. Each direction is one shuffle by line.
    """
    names, keys = axes(dims), list(keys)
    lines = []
    for angle, step in enumerate(neighbours(dims)):
        lead = next(k for k, d in enumerate(step) if d)
        place = F.col(names[lead])
        lines.append(F.struct(F.lit(angle).alias("angle"), place.alias("place"), *((F.col(c) - place * d).alias(f"line_{c}") for c, d in zip(names, step))))
    on = [*keys, "angle", *(f"line_{c}" for c in names), "level"]
    laid = cells.select(*keys, "level", F.explode(F.array(*lines)).alias("l")).select(*keys, "level", "l.*")
    runs = laid.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*on).orderBy("place"))).groupBy(*on, "run").agg(F.count("*").alias("size"))
    return runs.groupBy(*keys, "angle", "level", "size").agg(F.count("*").alias("n"))


def glrlm_features(cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
    """Means over directions."""
    per = _size_features(glrlm(cells, dims, keys), [*keys, "angle"], "glrlm")
    return per.groupBy(*keys).agg(*(F.avg(f).alias(f) for f in SIZES["glrlm"]))


def glszm(cells: DataFrame, dims: int, keys: Sequence[str], tile: int | None = None) -> DataFrame:
    """(keys, level, size, n): connected zones of equal level, by cells."""
    zones = components(cells, dims, keys, tile=tile).groupBy(*keys, "zone", "level").agg(F.count("*").alias("size"))
    return zones.groupBy(*keys, "level", "size").agg(F.count("*").alias("n"))


def glszm_features(cells: DataFrame, dims: int, keys: Sequence[str], tile: int | None = None) -> DataFrame:
    return _size_features(glszm(cells, dims, keys, tile), keys, "glszm")


def surroundings(cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
    """(keys, spatial columns, level, around): each cell of the mask with the levels of its neighbours in the mask, 8 or 26 at most.

    Each cell sends itself to its neighbours' places; what meets at a place is one group of bounded size.
    """
    names, keys = axes(dims), list(keys)
    steps = neighbours(dims)
    steps = [(0,) * dims, *steps, *(tuple(-d for d in s) for s in steps)]
    moves = F.array(*(F.struct(*(F.lit(d).alias(f"d_{c}") for c, d in zip(names, s)), F.lit(not any(s)).alias("own")) for s in steps))
    sent = cells.select(*keys, *names, "level", F.explode(moves).alias("o")).select(*keys, *((F.col(c) + F.col(f"o.d_{c}")).alias(c) for c in names), "level", "o.own")
    met = sent.groupBy(*keys, *names).agg(F.max(F.when(F.col("own"), F.col("level"))).alias("level"), F.collect_list(F.when(~F.col("own"), F.col("level"))).alias("around"))
    return met.where("level is not null")


def gldm(cells: DataFrame, dims: int, keys: Sequence[str], alpha: int = 0) -> DataFrame:
    """(keys, level, size, n): cells by level and by 1 + their neighbours whose level is within alpha."""
    alike = F.size(F.filter("around", lambda x: F.abs(x - F.col("level")) <= alpha)) + 1
    return surroundings(cells, dims, keys).groupBy(*keys, "level", alike.alias("size")).agg(F.count("*").alias("n"))


def gldm_features(cells: DataFrame, dims: int, keys: Sequence[str], alpha: int = 0) -> DataFrame:
    return _size_features(gldm(cells, dims, keys, alpha), keys, "gldm")


def ngtdm(cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
    """(keys, level, n, s): cells with a neighbour, by level, and how far their neighbours' means are from them in sum."""
    mean = F.aggregate("around", F.lit(0.0), lambda a, x: a + x) / F.size("around")
    return surroundings(cells, dims, keys).where(F.size("around") > 0).groupBy(*keys, "level").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("level") - mean)).alias("s"))


def ngtdm_features(cells: DataFrame, dims: int, keys: Sequence[str]) -> DataFrame:
    """Features of pairs of levels: a key's levels, as many as it has bins, are compared within one row."""
    share = ngtdm(cells, dims, keys).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    per = share.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count("*").alias("levels"), F.sum("s").alias("s"), F.sum(F.col("p") * F.col("s")).alias("ps"),
        F.collect_list(F.struct(F.col("level").cast("double").alias("i"), "p", "s")).alias("rows"))
    over = lambda f: F.aggregate("rows", F.lit(0.0), lambda a, x: a + F.aggregate("rows", F.lit(0.0), lambda b, y: b + f(x, y)))
    apart = over(lambda x, y: F.abs(x["i"] * x["p"] - y["i"] * y["p"]))
    several = F.col("levels") > 1
    return per.select(
        *keys, F.when(F.col("ps") == 0, MOST_COARSE).otherwise(1 / F.col("ps")).alias("Coarseness"),
        F.when(several, over(lambda x, y: x["p"] * y["p"] * F.pow(x["i"] - y["i"], F.lit(2))) / (F.col("levels") * (F.col("levels") - 1)) * F.col("s") / F.col("total")).otherwise(0.0).alias("Contrast"),
        F.when(several & (apart > 0), F.col("ps") / apart).otherwise(0.0).alias("Busyness"),
        (over(lambda x, y: F.abs(x["i"] - y["i"]) * (x["p"] * x["s"] + y["p"] * y["s"]) / (x["p"] + y["p"])) / F.col("total")).alias("Complexity"),
        F.when(F.col("s") == 0, 0.0).otherwise(over(lambda x, y: (x["p"] + y["p"]) * F.pow(x["i"] - y["i"], F.lit(2))) / F.col("s")).alias("Strength"))


def cooccurrence(cells: DataFrame, dims: int, keys: Sequence[str], distance: int = 1) -> DataFrame:
    """(keys, angle, level, other, n): pairs of cells at a distance in each direction, both ways round. Neighbours meet in an equi-join on shifted coordinates."""
    names, keys = axes(dims), list(keys)
    shifts = F.array(*(F.struct(F.lit(a).alias("angle"), *(F.lit(d * distance).alias(f"d_{c}") for c, d in zip(names, s))) for a, s in enumerate(neighbours(dims))))
    sent = cells.select(*keys, *names, F.col("level").alias("other"), F.explode(shifts).alias("o")).select(*keys, "o.angle", *((F.col(c) + F.col(f"o.d_{c}")).alias(c) for c in names), "other")
    one = sent.join(cells.select(*keys, *names, "level"), [*keys, *names]).groupBy(*keys, "angle", F.least("level", "other").alias("a"), F.greatest("level", "other").alias("b")).agg(F.count("*").alias("n"))
    # A pair of equal levels counts twice in its one entry, any other once in each of two.
    return one.withColumn("e", F.explode(F.expr("if(a = b, array(struct(a as level, b as other, 2 * n as n)), array(struct(a as level, b as other, n as n), struct(b as level, a as other, n as n)))"))).select(*keys, "angle", "e.*")


def second_correlation(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, MCC): the second largest absolute eigenvalue of each symmetric matrix scaled by its marginals; 1 where it has one level.

    A row holds one matrix, at most the square of its levels.
    """
    packed = matrix.groupBy(*keys).agg(F.collect_list("level").alias("level"), F.collect_list("other").alias("other"), F.collect_list("n").alias("n"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for level, other, n in zip(*(b.column(c).to_pylist() for c in ("level", "other", "n"))):
                _, at = np.unique(np.array(level + other), return_inverse=True)
                p = np.zeros((at.max() + 1,) * 2)
                p[at[: len(level)], at[len(level) :]] = n
                scale = np.sqrt(p.sum(1))
                values = np.sort(np.abs(np.linalg.eigvalsh(p / scale / scale[:, None])))
                out.append(float(values[-2]) if len(values) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.float64())], names=[*keys, "MCC"])

    kinds = dict(matrix.dtypes)
    return packed.mapInArrow(rows, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "MCC double"]))


def glcm_features(cells: DataFrame, dims: int, keys: Sequence[str], distance: int = 1, features: Sequence[str] = GLCM) -> DataFrame:
    """Means over directions that have a pair. cells also have ng, the highest level. MCC, which takes another pass, is computed if it is asked for."""
    each = [*keys, "angle"]
    top = cells.groupBy(*keys).agg(F.max("ng").alias("ng"))
    matrix = cooccurrence(cells, dims, keys, distance)
    i, j, p = F.col("level").cast("double"), F.col("other").cast("double"), F.col("p")
    of = lambda *c: F.sum("p").over(Window.partitionBy(*each, *c))
    away, both = F.abs(i - j), i + j
    wide = matrix.join(top, list(keys)).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*each)))
    wide = wide.withColumns({"mean": F.sum(i * p).over(Window.partitionBy(*each)), "px": of("level"), "away": away, "both": both}).withColumns({"pd": of("away"), "ps": of("both")})
    away, c, ng = F.col("away"), F.col("both") - 2 * F.col("mean"), F.col("ng").cast("double")
    entropy = lambda x: -F.sum(p * F.log2(x))
    deviation = F.sum(p * F.pow(i - F.col("mean"), F.lit(2)))
    per = wide.groupBy(*each).agg(
        F.sum(p * i * j).alias("Autocorrelation"), F.sum(p * i).alias("JointAverage"), F.sum(p * F.pow(c, F.lit(4))).alias("ClusterProminence"), F.sum(p * F.pow(c, F.lit(3))).alias("ClusterShade"), F.sum(p * c * c).alias("ClusterTendency"),
        F.sum(p * away * away).alias("Contrast"), F.sum(p * (i - F.col("mean")) * (j - F.col("mean"))).alias("__shared"), F.sum(p * away).alias("DifferenceAverage"), entropy(F.col("pd")).alias("DifferenceEntropy"),
        F.sum(p * p).alias("JointEnergy"), entropy(p).alias("JointEntropy"), entropy(F.col("px")).alias("__hx"), F.sum(p / (1 + away * away)).alias("Idm"), F.sum(p / (1 + away * away / (ng * ng))).alias("Idmn"),
        F.sum(p / (1 + away)).alias("Id"), F.sum(p / (1 + away / ng)).alias("Idn"), F.sum(F.when(away > 0, p / (away * away)).otherwise(0.0)).alias("InverseVariance"), F.max("p").alias("MaximumProbability"),
        F.sum(p * F.col("both")).alias("SumAverage"), entropy(F.col("ps")).alias("SumEntropy"), deviation.alias("SumSquares"))
    hx, hxy = F.col("__hx"), F.col("JointEntropy")
    per = per.withColumns({
        "Correlation": F.when(F.col("SumSquares") == 0, 1.0).otherwise(F.col("__shared") / F.col("SumSquares")),
        "DifferenceVariance": F.col("Contrast") - F.col("DifferenceAverage") * F.col("DifferenceAverage"),
        # The entropy of independent marginals is the sum of theirs.
        "Imc1": F.when(hx == 0, 0.0).otherwise((hxy - 2 * hx) / hx),
        "Imc2": F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (2 * hx - hxy)))),
    })
    if "MCC" in features:
        per = per.join(second_correlation(matrix, each), each)
    return per.groupBy(*keys).agg(*(F.avg(f).alias(f) for f in GLCM if f in per.columns))
