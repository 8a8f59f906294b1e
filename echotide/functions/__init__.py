"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(x: Column, digits: int | None = None) -> Column:
    """x at the output boundary: NaN as null, rounded, no negative zero."""
    x = F.when(~F.isnan(x), x)
    return x if digits is None else F.round(x, digits) + F.lit(0.0)


def time_s(frame: Column, rate: Column) -> Column:
    """Seconds since frame 0; a missing or non-finite rate counts as one second a frame."""
    return frame * F.coalesce(finite(rate), F.lit(1.0))


#: Luma weights of red, green, blue. compat has red and blue exchanged, as images loaded from video had them.
LUMA = {"standard": (0.299, 0.587, 0.114), "compat": (0.114, 0.587, 0.299)}


def luma(r: Column, g: Column, b: Column, kind: str = "compat") -> Column:
    """Gray value of a colour, rounded."""
    wr, wg, wb = LUMA[kind]
    return F.round(r * wr + g * wg + b * wb)


def entropy(x: Column) -> Column:
    """Aggregate: entropy of the values as shares of their sum, in one pass.

    A zero adds nothing; a share below zero makes it -inf; a sum of zero makes it NaN.
    """
    total = F.sum(x)
    part = F.sum(F.when(x != 0, x * F.log(F.abs(x))).otherwise(0.0))
    mixed = (F.min(x) < 0) & (total > 0) | (F.max(x) > 0) & (total < 0)
    return F.when(total == 0, F.lit(float("nan"))).when(mixed, F.lit(float("-inf"))).otherwise(F.log(F.abs(total)) - part / total)


def nan_min(x: Column) -> Column:
    """Aggregate: minimum that is NaN where any value is."""
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(F.min(x))


def first_order(x: Column) -> dict[str, Column]:
    """The twelve aggregates of a curve's values, by name."""
    var, low, high = F.var_pop(x), nan_min(x), F.max(x)
    flat = var < 1e-10
    return {
        "Mean": F.avg(x),
        "Std": F.stddev_pop(x),
        "Max": high,
        "Min": low,
        "Median": F.median(x),
        "Variance": var,
        "Skewness": F.when(flat, 0.0).otherwise(F.skewness(x)),
        "Kurtosis": F.when(flat, 3.0).otherwise(F.kurtosis(x)),
        "Range": high - low,
        "InterquartileRange": F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)),
        "Entropy": entropy(x),
        "Energy": F.sum(x * x),
    }


def lognormal(x: Column, auc: Column, mu: Column, sigma: Column, t0: Column) -> Column:
    """Bolus model: a log-normal density times an area, 0 up to t0 and where it isn't finite."""
    s = x - t0
    y = auc / (s * sigma * F.sqrt(F.lit(2.0) * F.pi())) * F.exp(-F.pow(F.log(s) - mu, 2) / (2 * sigma * sigma))
    return F.when(s > 0, F.coalesce(finite(y), F.lit(0.0))).otherwise(0.0)
