"""Scalars from curves. Results are long: scan_id, seg_id, window_ix, key, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotide.functions import first_order
from echotide.schema import CURVE_KEY

IDS = CURVE_KEY[:3]


def long(wide: DataFrame, stats: Sequence[str], key: Column) -> DataFrame:
    """One row per statistic, named by key (an expression over stat and curve_name)."""
    rows = wide.select(*CURVE_KEY, F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats))).alias("s"))
    return rows.select(*IDS, "curve_name", F.col("s.stat").alias("stat"), F.col("s.value").alias("value")).withColumn("key", key).select(*IDS, "key", "value")


def check_range(start: float, end: float) -> None:
    if not 0 <= start < end:
        raise ValueError("times must satisfy 0 <= start_time < end_time")


def select_times(curves: DataFrame, start: float = 0.0, end: float | None = None) -> DataFrame:
    """Points with start <= time <= end; end defaults to the number of frames.

    Like the default, an end is held against the number of frames: curves with fewer raise.
    """
    if end is None:
        n = F.count("*").over(Window.partitionBy(*CURVE_KEY))
        return curves.withColumn("__n", n).where((F.col("time_s") >= start) & (F.col("time_s") <= F.col("__n"))).drop("__n")
    check_range(start, end)
    n = F.count("*").over(Window.partitionBy(*CURVE_KEY))
    held = F.when(n < end, F.raise_error(F.lit(f"end_time {end:g} is beyond a curve's number of frames"))).otherwise(n)
    return curves.withColumn("__n", held).where((F.col("time_s") >= start) & (F.col("time_s") <= end) & F.col("__n").isNotNull()).drop("__n")


def first_order_wide(curves: DataFrame, by: Sequence[str] = CURVE_KEY) -> DataFrame:
    """The twelve statistics of each curve, a column each."""
    return curves.groupBy(*by).agg(*(c.alias(n) for n, c in first_order(F.col("value")).items()))


def first_order_full(curves: DataFrame) -> DataFrame:
    wide = first_order_wide(curves)
    return long(wide, wide.columns[len(CURVE_KEY) :], F.concat("stat", F.lit("_full_"), "curve_name"))


def first_order_select(curves: DataFrame, start: float = 0.0, end: float | None = None) -> DataFrame:
    wide = first_order_wide(select_times(curves, start, end))
    return long(wide, wide.columns[len(CURVE_KEY) :], F.concat("stat", F.lit("_select_"), "curve_name"))


def matching(curves: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Curves whose name holds one of the patterns, in either case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(F.lower("curve_name"), F.lit(p.lower()))
    return curves.where(hit)


def flash_index(curves: DataFrame, tic_name: str = "TIC") -> DataFrame:
    """flash: the frame of the largest value of a curve, the first of equals; n: frames; pre, post: frames around it."""
    found = curves.where(F.col("curve_name") == tic_name).groupBy(*IDS).agg(F.max_by("frame", F.struct("value", -F.col("frame"))).alias("flash"), F.count("*").cast("int").alias("n"))
    return found.select(*IDS, "n", "flash", F.greatest(F.col("flash") - 5, F.lit(0)).alias("pre"), F.least(F.col("flash") + 5, F.col("n") - 1).alias("post"))


def _with(curves: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks of each scan, region and window beside its curves' points; window_ix may be null."""
    on = (F.col("c.scan_id") == F.col("m.scan_id")) & F.col("c.seg_id").eqNullSafe(F.col("m.seg_id")) & F.col("c.window_ix").eqNullSafe(F.col("m.window_ix"))
    return curves.alias("c").join(marks.alias("m"), on).select("c.*", *(f"m.{c}" for c in marks.columns if c not in IDS))


def dte(curves: DataFrame, tic_name: str = "TIC") -> DataFrame:
    """Median of five frames up to 5 before the flash, less that of five frames from 5 after it.

    A slice that would begin before frame 0 is empty, and the result null then.
    """
    at = _with(curves, flash_index(curves, tic_name))
    before = F.median(F.when((F.col("pre") >= 4) & F.col("frame").between(F.col("pre") - 4, F.col("pre")), F.col("value")))
    after = F.median(F.when(F.col("frame").between(F.col("post"), F.col("post") + 4), F.col("value")))
    wide = at.groupBy(*CURVE_KEY).agg((before - after).alias("DTE"))
    return long(wide, ["DTE"], F.concat("stat", F.lit("_"), "curve_name"))


def auc_no_fit(curves: DataFrame, tic_name: str = "TIC") -> DataFrame:
    """Area under a curve scaled to a maximum of 1, by trapezoids."""
    order = Window.partitionBy(*CURVE_KEY).orderBy("frame")
    strip = (F.col("time_s") - F.lag("time_s").over(order)) * (F.col("value") + F.lag("value").over(order)) / 2
    wide = curves.where(F.col("curve_name") == tic_name).withColumn("strip", strip).groupBy(*CURVE_KEY).agg((F.coalesce(F.sum("strip"), F.lit(0.0)) / F.max("value")).alias("AUC_NoFit"))
    return long(wide, ["AUC_NoFit"], F.concat("stat", F.lit("_"), "curve_name"))


def peaks(fits: DataFrame, tic_name: str = "TIC", suffix: str = "full") -> DataFrame:
    """(ids, pe): the peak's frame from a fit's PE_Ix key; null where the fit failed."""
    return fits.where(F.col("key") == f"PE_Ix_{suffix}_{tic_name}").select(*IDS, F.when(~F.isnan("value"), F.col("value")).cast("int").alias("pe"))


def observed_peaks(curves: DataFrame, tic_name: str = "TIC") -> DataFrame:
    """(ids, pe): the frame of the largest value itself."""
    return flash_index(curves, tic_name).select(*IDS, F.col("flash").alias("pe"))


def wash_rates(curves: DataFrame, peaks: DataFrame, n_frames: int | None = None) -> DataFrame:
    """Slopes by least squares on frames before the peak (of which there are more than 1), and from it on (if it isn't the last).

    n_frames cuts the curve; all frames count by default.
    """
    at = _with(curves, peaks)
    if n_frames is None:
        n = F.count("*").over(Window.partitionBy(*CURVE_KEY)).cast("int")
    else:
        n = F.lit(n_frames)
    at = at.withColumn("n", n)
    x = F.col("frame").cast("double")
    slope = lambda inside: F.regr_slope(F.when(inside, F.col("value")), F.when(inside, x))
    wide = at.groupBy(*CURVE_KEY).agg(F.first("pe").alias("pe"), F.first("n").alias("n"), slope(F.col("frame") < F.least("pe", "n")).alias("a"), slope((F.col("frame") >= F.col("pe")) & (F.col("frame") < F.col("n"))).alias("b"))
    wide = wide.select(*CURVE_KEY, F.when(F.col("pe") > 1, F.col("a")).alias("WashInRate"), F.when(F.col("pe") < F.col("n") - 1, F.col("b")).alias("WashOutRate"))
    return long(wide, ["WashInRate", "WashOutRate"], F.concat("stat", F.lit("_"), "curve_name"))


def cmus_first_order(curves: DataFrame, peaks: DataFrame, tic_name: str = "TIC") -> DataFrame:
    """First-order statistics before the peak, from it to 5 before the flash, and from 5 after the flash on.

    The peak is held below the last section's start; a failed fit (null) takes the frame just before that. Empty sections give no keys.
    """
    at = _with(_with(curves, flash_index(curves, tic_name)), peaks)
    pe = F.when(F.col("pe") < F.col("post"), F.greatest("pe", F.lit(0))).otherwise(F.col("post") - 1)
    frame = F.col("frame")
    sections = F.array_compact(F.array(
        F.when(frame < pe, F.lit("WashIn")),
        F.when((frame >= pe) & (frame < F.col("pre")), F.lit("WashOutPreFlash")),
        F.when(frame >= F.col("post"), F.lit("PostFlash")),
    ))
    wide = first_order_wide(at.withColumn("section", F.explode(sections)), [*CURVE_KEY, "section"])
    stats = wide.columns[len(CURVE_KEY) + 1 :]
    rows = wide.select(*CURVE_KEY, "section", F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats))).alias("s"))
    return rows.select(*IDS, F.concat_ws("_", "section", "s.stat", "curve_name").alias("key"), F.col("s.value").alias("value"))


def key_sets(quants: DataFrame) -> DataFrame:
    """The distinct sets of keys of the rows; one row says that all agree."""
    return quants.groupBy(*IDS).agg(F.sort_array(F.collect_set("key")).alias("keys")).select("keys").distinct()


def wide(quants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per scan, region and window, a column per key."""
    return quants.groupBy(*IDS).pivot("key", list(keys)).agg(F.first("value"))


def with_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Window coordinates beside rows that have a window; all are kept, also those that start at 0."""
    places = [c for c in windows.columns if c.endswith(("_start", "_end"))]
    return rows.join(windows.select(*IDS, *places), IDS, "left")
