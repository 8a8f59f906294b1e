"""Registered queries over the fixtures, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotide.functions import lognormal, number
from echotide.operators import curves as C
from echotide.operators import fit, graylevel, imagefilters, paramap, preprocess, quantify, shape, spectrum, texture, windows
from echotide.operators.components import scratch_folder
from echotide.plans import study
from echotide.sources import arrays, images, tables
from echotide.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Window steps of the fixtures, in cells.
STEP_2D, STEP_3D = (3, 3), (2, 2, 2)
START, END = 5.0, 20.0


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# Tables of the oracle ------------------------------------------------------------------

CINE2 = """
cells AS (SELECT (vec_id // 25)::INT AS ax, (vec_id % 25)::INT AS sag, (label < 5)::INT AS m, embedding FROM embeddings),
vox AS (SELECT ax, sag, m, (i - 1)::INT AS frame, floor((embedding[i]::DOUBLE + 1) * 100) AS value
        FROM cells, (SELECT unnest(generate_series(1, 64))::INT AS i))"""
CINE3 = """
cells AS (SELECT (vec_id % 10)::INT AS ax, (vec_id // 50)::INT AS sag, ((vec_id % 50) // 10)::INT AS cor, (label < 5)::INT AS m, embedding FROM embeddings),
vox AS (SELECT ax, sag, cor, m, (i - 1)::INT AS frame, floor((embedding[i]::DOUBLE + 1) * 100) AS value
        FROM cells, (SELECT unnest(generate_series(1, 64))::INT AS i))"""
BOX2 = """
box AS (SELECT min(ax) AS a0, max(ax) AS a1, min(sag) AS s0, max(sag) AS s1 FROM cells WHERE m > 0),
starts AS (SELECT a::INT AS ax_start, s::INT AS sag_start FROM (SELECT unnest(range(a0, a1, 3)) AS a FROM box), (SELECT unnest(range(s0, s1, 3)) AS s FROM box)),
kept AS (SELECT ax_start, sag_start FROM starts JOIN cells ON ax >= ax_start AND ax < ax_start + 3 AND sag >= sag_start AND sag < sag_start + 3
         GROUP BY ALL HAVING avg((m = 1)::INT) > 0.2),
win AS (SELECT (row_number() OVER (ORDER BY ax_start, sag_start) - 1)::INT AS window_ix, ax_start, sag_start, ax_start + 3 AS ax_end, sag_start + 3 AS sag_end FROM kept)"""
BOX3 = """
box AS (SELECT min(ax) AS a0, max(ax) AS a1, min(sag) AS s0, max(sag) AS s1, min(cor) AS c0, max(cor) AS c1 FROM cells WHERE m > 0),
starts AS (SELECT a::INT AS ax_start, s::INT AS sag_start, c::INT AS cor_start FROM (SELECT unnest(range(a0, a1, 2)) AS a FROM box), (SELECT unnest(range(s0, s1, 2)) AS s FROM box), (SELECT unnest(range(c0, c1, 2)) AS c FROM box)),
kept AS (SELECT ax_start, sag_start, cor_start FROM starts JOIN cells ON ax >= ax_start AND ax < ax_start + 2 AND sag >= sag_start AND sag < sag_start + 2 AND cor >= cor_start AND cor < cor_start + 2
         GROUP BY ALL HAVING avg((m = 1)::INT) > 0.2),
win AS (SELECT (row_number() OVER (ORDER BY ax_start, sag_start, cor_start) - 1)::INT AS window_ix, ax_start, sag_start, cor_start, ax_start + 2 AS ax_end, sag_start + 2 AS sag_end, cor_start + 2 AS cor_end FROM kept)"""
WINTIC2 = """
wintic AS (SELECT window_ix, frame, avg(value) AS value FROM win JOIN vox ON ax BETWEEN ax_start AND ax_end AND sag BETWEEN sag_start AND sag_end GROUP BY ALL)"""
CURVE = """
curve AS (SELECT user_id::VARCHAR AS scan_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame, value, event_type FROM events),
timed AS (SELECT *, frame * 0.5::DOUBLE AS time_s FROM curve)"""


def stats_sql(value: str = "value") -> str:
    """The twelve statistics, from raw moments where DuckDB's own differ."""
    var = f"var_pop({value})"
    third = f"(avg({value}*{value}*{value}) - 3*avg({value})*avg({value}*{value}) + 2*power(avg({value}), 3)) / power({var}, 1.5)"
    ent = f"ln(abs(sum({value}))) - sum(CASE WHEN {value} <> 0 THEN {value} * ln(abs({value})) ELSE 0 END) / sum({value})"
    return f"""
round(avg({value}), 6) + 0.0 AS "Mean", round(stddev_pop({value}), 6) + 0.0 AS "Std", round(max({value}), 6) + 0.0 AS "Max", round(min({value}), 6) + 0.0 AS "Min",
round(median({value}), 6) + 0.0 AS "Median", round({var}, 4) + 0.0 AS "Variance",
round(CASE WHEN {var} < 1e-10 THEN 0.0 ELSE {third} END, 5) + 0.0 AS "Skewness",
round(CASE WHEN {var} < 1e-10 THEN 3.0 ELSE kurtosis_pop({value}) END, 5) + 0.0 AS "Kurtosis",
round(max({value}) - min({value}), 6) + 0.0 AS "Range", round(quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25), 6) + 0.0 AS "InterquartileRange",
round(CASE WHEN sum({value}) = 0 THEN NULL WHEN min({value}) < 0 AND sum({value}) > 0 OR max({value}) > 0 AND sum({value}) < 0 THEN '-Infinity'::DOUBLE ELSE {ent} END, 6) + 0.0 AS "Entropy",
round(sum({value}*{value}), 4) + 0.0 AS "Energy\""""


DIGITS = {"Variance": 4, "Skewness": 5, "Kurtosis": 5, "Energy": 4}


def _stats(wide: DataFrame, *keys: str) -> DataFrame:
    return wide.select(*keys, *(number(F.col(s), DIGITS.get(s, 6)).alias(s) for s in wide.columns if s in _NAMES))


_NAMES = ["Mean", "Std", "Max", "Min", "Median", "Variance", "Skewness", "Kurtosis", "Range", "InterquartileRange", "Entropy", "Energy"]


# Curves ---------------------------------------------------------------------------------


def _roi(spark: SparkSession, d: str, dims: int) -> DataFrame:
    return C.roi_curves(X.cine(spark, d, dims), X.mask(spark, d, dims), dims, rate=0.5).select("frame", "time_s", number(F.col("value"), 6).alias("tic"))


@query("tic_roi_2d", f"WITH {CINE2} SELECT frame, frame * 0.5::DOUBLE AS time_s, round(avg(value), 6) AS tic FROM vox WHERE m > 0 GROUP BY frame")
def tic_roi_2d(spark, d):
    return _roi(spark, d, 2)


@query("tic_roi_3d", f"WITH {CINE3} SELECT frame, frame * 0.5::DOUBLE AS time_s, round(avg(value), 6) AS tic FROM vox WHERE m > 0 GROUP BY frame")
def tic_roi_3d(spark, d):
    return _roi(spark, d, 3)


@query("mask_bbox", f"WITH {CINE2} SELECT min(ax) AS min_ax, max(ax) AS max_ax, min(sag) AS min_sag, max(sag) AS max_sag FROM cells WHERE m > 0")
def mask_bbox(spark, d):
    return windows.bounding_box(X.mask(spark, d, 2), 2).select("min_ax", "max_ax", "min_sag", "max_sag")


@query("window_grid_2d", f"WITH {CINE2}, {BOX2} SELECT window_ix, ax_start, sag_start, ax_end, sag_end FROM win")
def window_grid_2d(spark, d):
    return windows.window_grid(X.mask(spark, d, 2), STEP_2D).select("window_ix", "ax_start", "sag_start", "ax_end", "sag_end")


@query("window_grid_3d", f"WITH {CINE3}, {BOX3} SELECT window_ix, ax_start, sag_start, cor_start, ax_end, sag_end, cor_end FROM win")
def window_grid_3d(spark, d):
    return windows.window_grid(X.mask(spark, d, 3), STEP_3D).select("window_ix", "ax_start", "sag_start", "cor_start", "ax_end", "sag_end", "cor_end")


@query("window_tic_2d", f"WITH {CINE2}, {BOX2}, {WINTIC2} SELECT window_ix, frame, round(value, 6) AS tic FROM wintic")
def window_tic_2d(spark, d):
    return C.window_curves(X.cine(spark, d, 2), X.mask(spark, d, 2), STEP_2D).select("window_ix", "frame", number(F.col("value"), 6).alias("tic"))


@query("window_tic_3d", f"""WITH {CINE3}, {BOX3} SELECT window_ix, frame, round(avg(value), 6) AS tic FROM win JOIN vox
ON ax BETWEEN ax_start AND ax_end AND sag BETWEEN sag_start AND sag_end AND cor BETWEEN cor_start AND cor_end GROUP BY ALL""")
def window_tic_3d(spark, d):
    return C.window_curves(X.cine(spark, d, 3), X.mask(spark, d, 3), STEP_3D).select("window_ix", "frame", number(F.col("value"), 6).alias("tic"))


@query("mean_window_tic", f"WITH {CINE2}, {BOX2}, {WINTIC2} SELECT frame, round(avg(value), 6) AS tic FROM wintic WHERE frame * 0.5 BETWEEN 5 AND 20 GROUP BY frame")
def mean_window_tic(spark, d):
    return C.mean_curve(C.window_curves(X.cine(spark, d, 2), X.mask(spark, d, 2), STEP_2D, rate=0.5), START, END).select("frame", number(F.col("value"), 6).alias("tic"))


@query("curve_fill", f"""WITH {CURVE}, kinds AS (SELECT DISTINCT event_type AS curve_name FROM events),
multi AS (SELECT scan_id, curve_name, frame, CASE WHEN event_type = curve_name THEN value END AS value FROM timed, kinds),
filled AS (SELECT scan_id, curve_name, frame, last_value(value IGNORE NULLS) OVER (PARTITION BY scan_id, curve_name ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
lead(value) OVER (PARTITION BY scan_id, curve_name ORDER BY frame) AS b FROM multi)
SELECT scan_id, curve_name, frame, coalesce(a, CASE WHEN frame = 0 THEN b END) AS value FROM filled""")
def curve_fill(spark, d):
    return C.fill_gaps(X.curves_multi(spark, d)).select("scan_id", "curve_name", "frame", "value")


@query("duplicate_curve_check", "SELECT user_id::VARCHAR AS scan_id, event_type AS curve_name, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS frame, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_curve_check(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("scan_id"), F.lit("roi").alias("seg_id"), F.lit(None).cast("int").alias("window_ix"), F.col("event_type").alias("curve_name"), F.unix_date(F.to_date("ts")).alias("frame"))
    return C.duplicates(e).select("scan_id", "curve_name", "frame", "n")


EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("curves_wide", f"""WITH {CURVE} SELECT scan_id, frame, time_s, {', '.join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in EVENT_KINDS)} FROM timed GROUP BY scan_id, frame, time_s""")
def curves_wide(spark, d):
    names = X.event_kinds(spark, d)
    return tables.curves_wide(X.curves_multi(spark, d), names).select("scan_id", "frame", "time_s", *names)


@query("curves_unpivot", f"""WITH {CURVE}, kinds AS (SELECT DISTINCT event_type AS curve_name FROM events)
SELECT scan_id, frame, curve_name, CASE WHEN event_type = curve_name THEN value END AS value FROM timed, kinds""")
def curves_unpivot(spark, d):
    names = X.event_kinds(spark, d)
    wide = tables.curves_wide(X.curves_multi(spark, d), names)
    return wide.unpivot(["scan_id", "frame"], names, "curve_name", "value")


# Quantification ---------------------------------------------------------------------------


@query("first_order_full", f"WITH {CURVE} SELECT scan_id, {stats_sql()} FROM timed GROUP BY scan_id")
def first_order_full(spark, d):
    return _stats(quantify.first_order_wide(X.curves(spark, d)), "scan_id")


@query("first_order_select", f"WITH {CURVE} SELECT scan_id, {stats_sql()} FROM timed WHERE time_s >= 5 AND time_s <= 20 GROUP BY scan_id")
def first_order_select(spark, d):
    return _stats(quantify.first_order_wide(quantify.select_times(X.curves(spark, d), START, END)), "scan_id")


@query("first_order_window", f"WITH {CINE2}, {BOX2}, {WINTIC2} SELECT window_ix, {stats_sql()} FROM wintic GROUP BY window_ix")
def first_order_window(spark, d):
    return _stats(quantify.first_order_wide(C.window_curves(X.cine(spark, d, 2), X.mask(spark, d, 2), STEP_2D)), "window_ix")


FLASH = f"""{CURVE},
flash AS (SELECT scan_id, arg_max(frame, (value, -frame)) AS flash, count(*)::INT AS n FROM timed GROUP BY scan_id),
marks AS (SELECT scan_id, n, flash, greatest(flash - 5, 0) AS pre, least(flash + 5, n - 1) AS post FROM flash),
pts AS (SELECT timed.*, n, flash, pre, post FROM timed JOIN marks USING (scan_id))"""


@query("dte", f"""WITH {FLASH} SELECT scan_id, round(median(value) FILTER (pre >= 4 AND frame BETWEEN pre - 4 AND pre) - median(value) FILTER (frame BETWEEN post AND post + 4), 6) + 0.0 AS dte FROM pts GROUP BY scan_id""")
def dte(spark, d):
    return quantify.dte(X.curves(spark, d)).select("scan_id", number(F.col("value"), 6).alias("dte"))


@query("auc_no_fit", f"""WITH {CURVE}, strips AS (SELECT scan_id, value, (time_s - lag(time_s) OVER w) * (value + lag(value) OVER w) / 2 AS strip FROM timed WINDOW w AS (PARTITION BY scan_id ORDER BY frame))
SELECT scan_id, round(coalesce(sum(strip), 0) / max(value), 6) + 0.0 AS auc FROM strips GROUP BY scan_id""")
def auc_no_fit(spark, d):
    return quantify.auc_no_fit(X.curves(spark, d)).select("scan_id", number(F.col("value"), 6).alias("auc"))


@query("wash_rates_argmax", f"""WITH {FLASH}, s AS (SELECT scan_id, any_value(flash) AS pe, any_value(n) AS n, regr_slope(value, frame::DOUBLE) FILTER (frame < flash) AS a, regr_slope(value, frame::DOUBLE) FILTER (frame >= flash) AS b FROM pts GROUP BY scan_id)
SELECT scan_id, round(CASE WHEN pe > 1 THEN a END, 6) + 0.0 AS wash_in, round(CASE WHEN pe < n - 1 THEN b END, 6) + 0.0 AS wash_out FROM s""")
def wash_rates_argmax(spark, d):
    c = X.curves(spark, d)
    w = quantify.wide(quantify.wash_rates(c, quantify.observed_peaks(c)), ["WashInRate_TIC", "WashOutRate_TIC"])
    return w.select("scan_id", number(F.col("WashInRate_TIC"), 6).alias("wash_in"), number(F.col("WashOutRate_TIC"), 6).alias("wash_out"))


@query("cmus_sections_argmax", f"""WITH {FLASH}, p AS (SELECT *, CASE WHEN flash < post THEN flash ELSE post - 1 END AS pe FROM pts),
parts AS (SELECT scan_id, 'WashIn' AS section, value FROM p WHERE frame < pe UNION ALL SELECT scan_id, 'WashOutPreFlash', value FROM p WHERE frame >= pe AND frame < pre
UNION ALL SELECT scan_id, 'PostFlash', value FROM p WHERE frame >= post)
SELECT scan_id, section || '_Mean_TIC' AS key, round(avg(value), 6) + 0.0 AS value FROM parts GROUP BY scan_id, section
UNION ALL SELECT scan_id, section || '_Energy_TIC', round(sum(value * value), 4) + 0.0 FROM parts GROUP BY scan_id, section
UNION ALL SELECT scan_id, section || '_Std_TIC', round(stddev_pop(value), 6) + 0.0 FROM parts GROUP BY scan_id, section""")
def cmus_sections_argmax(spark, d):
    c = X.curves(spark, d)
    q = quantify.cmus_first_order(c, quantify.observed_peaks(c)).where(F.col("key").rlike("_(Mean|Energy|Std)_TIC$"))
    return q.select("scan_id", "key", F.when(F.col("key").contains("_Energy_"), number(F.col("value"), 4)).otherwise(number(F.col("value"), 6)).alias("value"))


@query("keyset_check", f"""WITH {FLASH}, p AS (SELECT *, CASE WHEN flash < post THEN flash ELSE post - 1 END AS pe FROM pts),
keys AS (SELECT DISTINCT scan_id, 'WashIn_Mean_TIC' AS key FROM p WHERE frame < pe UNION SELECT scan_id, 'WashOutPreFlash_Mean_TIC' FROM p WHERE frame >= pe AND frame < pre UNION SELECT scan_id, 'PostFlash_Mean_TIC' FROM p WHERE frame >= post)
SELECT DISTINCT keys FROM (SELECT scan_id, string_agg(key, ',' ORDER BY key) AS keys FROM keys GROUP BY scan_id)""")
def keyset_check(spark, d):
    c = X.curves(spark, d)
    q = quantify.cmus_first_order(c, quantify.observed_peaks(c)).where(F.col("key").endswith("_Mean_TIC"))
    return quantify.key_sets(q).select(F.concat_ws(",", "keys").alias("keys"))


@query("quant_wide", f"""WITH {CURVE} SELECT scan_id, round(avg(value), 6) + 0.0 AS "Mean_full_TIC", round(max(value), 6) + 0.0 AS "Max_full_TIC", round(sum(value * value), 4) + 0.0 AS "Energy_full_TIC" FROM timed GROUP BY scan_id""")
def quant_wide(spark, d):
    w = quantify.wide(quantify.first_order_full(X.curves(spark, d)), ["Mean_full_TIC", "Max_full_TIC", "Energy_full_TIC"])
    return w.select("scan_id", *(number(F.col(k), 4 if "Energy" in k else 6).alias(k) for k in w.columns[3:]))


@query("lognormal_eval", f"""WITH {CURVE} SELECT scan_id, frame, round(CASE WHEN time_s > 2 THEN 12.5::DOUBLE / ((time_s - 2) * 0.6::DOUBLE * sqrt(2 * pi())) * exp(-power(ln(time_s - 2) - 1.5::DOUBLE, 2) / (2 * 0.6::DOUBLE * 0.6::DOUBLE)) ELSE 0 END, 6) + 0.0 AS y FROM timed""")
def lognormal_eval(spark, d):
    return X.curves(spark, d).select("scan_id", "frame", number(lognormal(F.col("time_s"), *(F.lit(v) for v in (12.5, 1.5, 0.6, 2.0))), 6).alias("y"))


@query("lognormal_fit_full")
def lognormal_fit_full(spark, d):
    return fit.lognormal_fit_full(X.curves(spark, d)).select("scan_id", "key", number(F.col("value")).alias("value"))


@query("lognormal_fit_select")
def lognormal_fit_select(spark, d):
    return fit.lognormal_fit_select(X.curves(spark, d), ["tic"], START, END).select("scan_id", "key", number(F.col("value")).alias("value"))


@query("wash_rates")
def wash_rates(spark, d):
    c = X.curves(spark, d)
    return quantify.wash_rates(c, quantify.peaks(fit.lognormal_fit_full(c))).select("scan_id", "key", number(F.col("value")).alias("value"))


@query("cmus_firstorder")
def cmus_firstorder(spark, d):
    c = X.curves(spark, d)
    return quantify.cmus_first_order(c, quantify.peaks(fit.lognormal_fit_full(c))).select("scan_id", "key", number(F.col("value")).alias("value"))


# Fits to curves whose parameters are known.
BOLUS = """
made AS (SELECT user_id::VARCHAR AS scan_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame,
  1 + user_id % 10 * 0.1::DOUBLE AS mu, 0.4::DOUBLE + user_id % 5 * 0.05::DOUBLE AS sigma, (user_id % 3 + 1)::DOUBLE AS t0 FROM events),
bolus AS (SELECT *, frame * 0.5::DOUBLE AS time_s, CASE WHEN frame * 0.5::DOUBLE > t0 THEN 12.5::DOUBLE / ((frame * 0.5::DOUBLE - t0) * sigma * sqrt(2 * pi()))
  * exp(-power(ln(frame * 0.5::DOUBLE - t0) - mu, 2) / (2 * sigma * sigma)) ELSE 0 END AS value FROM made)"""
BOLUS_FIT = """
one AS (SELECT scan_id, any_value(mu) AS mu, any_value(sigma) AS sigma, any_value(t0) AS t0, max(value) AS top, arg_max(frame, (value, -frame)) AS ix FROM picked GROUP BY scan_id),
keys AS (SELECT scan_id, unnest([{'k': 'AUC', 'v': 12.5::DOUBLE / top}, {'k': 'PE', 'v': 1.0::DOUBLE}, {'k': 'TP', 'v': exp(mu - sigma * sigma)}, {'k': 'MTT', 'v': exp(mu + sigma * sigma / 2)},
  {'k': 'T0', 'v': t0}, {'k': 'Mu', 'v': mu}, {'k': 'Sigma', 'v': sigma}, {'k': 'PE_Ix', 'v': ix::DOUBLE}]) AS x FROM one)"""


def _fit_sql(part: str, where: str = "") -> str:
    return f"WITH {BOLUS}, picked AS (SELECT * FROM bolus {where}), {BOLUS_FIT} SELECT scan_id, x.k || '_{part}_TIC' AS key, round(x.v, 5) + 0.0 AS value FROM keys"


@query("lognormal_fit_full_known", _fit_sql("full"))
def lognormal_fit_full_known(spark, d):
    return fit.lognormal_fit_full(X.boluses(spark, d)).select("scan_id", "key", number(F.col("value"), 5).alias("value"))


@query("lognormal_fit_select_known", _fit_sql("select", "WHERE time_s <= 20"))
def lognormal_fit_select_known(spark, d):
    return fit.lognormal_fit_select(X.boluses(spark, d), ["tic"], 0.0, END).select("scan_id", "key", number(F.col("value"), 5).alias("value"))


BOLUS_PEAK = f"""{BOLUS}, flash AS (SELECT scan_id, arg_max(frame, (value, -frame)) AS flash, count(*)::INT AS n FROM bolus GROUP BY scan_id),
pts AS (SELECT bolus.*, n, flash, greatest(flash - 5, 0) AS pre, least(flash + 5, n - 1) AS post FROM bolus JOIN flash USING (scan_id))"""


@query("wash_rates_known", f"""WITH {BOLUS_PEAK}, s AS (SELECT scan_id, any_value(flash) AS pe, any_value(n) AS n, regr_slope(value, frame::DOUBLE) FILTER (frame < flash) AS a, regr_slope(value, frame::DOUBLE) FILTER (frame >= flash) AS b FROM pts GROUP BY scan_id)
SELECT scan_id, round(CASE WHEN pe > 1 THEN a END, 6) + 0.0 AS wash_in, round(CASE WHEN pe < n - 1 THEN b END, 6) + 0.0 AS wash_out FROM s""")
def wash_rates_known(spark, d):
    c = X.boluses(spark, d)
    w = quantify.wide(quantify.wash_rates(c, quantify.peaks(fit.lognormal_fit_full(c))), ["WashInRate_TIC", "WashOutRate_TIC"])
    return w.select("scan_id", number(F.col("WashInRate_TIC"), 6).alias("wash_in"), number(F.col("WashOutRate_TIC"), 6).alias("wash_out"))


@query("cmus_sections_known", f"""WITH {BOLUS_PEAK}, p AS (SELECT *, CASE WHEN flash < post THEN flash ELSE post - 1 END AS pe FROM pts),
parts AS (SELECT scan_id, 'WashIn' AS section, value FROM p WHERE frame < pe UNION ALL SELECT scan_id, 'WashOutPreFlash', value FROM p WHERE frame >= pe AND frame < pre
UNION ALL SELECT scan_id, 'PostFlash', value FROM p WHERE frame >= post)
SELECT scan_id, section || '_Mean_TIC' AS key, round(avg(value), 6) + 0.0 AS value FROM parts GROUP BY scan_id, section""")
def cmus_sections_known(spark, d):
    c = X.boluses(spark, d)
    q = quantify.cmus_first_order(c, quantify.peaks(fit.lognormal_fit_full(c))).where(F.col("key").endswith("_Mean_TIC"))
    return q.select("scan_id", "key", number(F.col("value"), 6).alias("value"))


# Preprocessing ------------------------------------------------------------------------------


@query("standardize", f"WITH {CINE2} SELECT frame, ax, sag, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0.0 AS z FROM vox")
def standardize(spark, d):
    return preprocess.standardize(X.cine(spark, d, 2)).select("frame", "ax", "sag", number(F.col("value"), 6).alias("z"))


def _axis_sql(name: str, size: str, old: float, new: float, interp: str) -> str:
    """Targets, sources and weights of an axis."""
    at = f"(i * {new}::DOUBLE / {old}::DOUBLE)"
    n = f"(SELECT max({name}) + 1 FROM cells)"
    grid = f"SELECT unnest(range(0, round_even({n} * {old}::DOUBLE / {new}::DOUBLE, 0)::BIGINT)) AS i"
    if interp == "nearest":
        return f"to_{name} AS (SELECT i::INT AS t_{name}, least(floor({at} + 0.5), {n} - 1)::INT AS {name}, 1.0::DOUBLE AS w_{name} FROM ({grid}))"
    c = f"least({at}, ({n} - 1)::DOUBLE)"
    return f"to_{name} AS (SELECT i::INT AS t_{name}, floor({c})::INT AS {name}, 1 - ({c} - floor({c})) AS w_{name} FROM ({grid}) UNION ALL SELECT i::INT, floor({c})::INT + 1, {c} - floor({c}) FROM ({grid}) WHERE {c} > floor({c}))"


def _resample_sql(dims: int, interp: str, old, new, value="value", keys="frame, ", source="vox") -> str:
    names = ["ax", "sag", "cor"][:dims]
    parts = ", ".join(_axis_sql(c, c, o, n, interp) for c, o, n in zip(names, old, new))
    joins = " ".join(f"JOIN to_{c} USING ({c})" for c in names)
    total = f"any_value({value})" if interp == "nearest" else f"sum({value} * {' * '.join(f'w_{c}' for c in names)})"
    out = f"{total}::SMALLINT AS m" if value == "m" else f"round({total}, 6) + 0.0 AS value"
    return f"WITH {CINE2 if dims == 2 else CINE3}, {parts} SELECT {keys}{', '.join(f't_{c} AS {c}' for c in names)}, {out} FROM {source} {joins} GROUP BY {keys}{', '.join(f't_{c}' for c in names)}"


OLD, NEW = (1.0, 1.0, 1.0), (1.5, 0.8, 0.75)


def _resampled(spark, d, dims, interp, new=NEW):
    out = preprocess.resample(X.cine(spark, d, dims, whole=interp != "cubic"), X.shape(spark, d, dims), OLD[:dims], new[:dims], interp)
    return out.select("frame", *["ax", "sag", "cor"][:dims], number(F.col("value"), 6).alias("value"))


for _dims in (2, 3):
    for _interp in ("nearest", "linear"):
        query(f"resample_{_interp}_{_dims}d", _resample_sql(_dims, _interp, OLD, NEW))(lambda spark, d, dims=_dims, interp=_interp: _resampled(spark, d, dims, interp))


def _cubic_axis_sql(name: str, old: float, new: float) -> str:
    """Weights of an axis: its spline's coefficients are the samples, mirrored without end, times powers of sqrt(3) - 2."""
    n = f"(SELECT max({name}) + 1 FROM cells)"
    grid = f"SELECT i, least(i * {new}::DOUBLE / {old}::DOUBLE, ({n} - 1)::DOUBLE) AS x FROM (SELECT unnest(range(0, round_even({n} * {old}::DOUBLE / {new}::DOUBLE, 0)::BIGINT)) AS i)"
    near = f"SELECT i, x, floor(x)::BIGINT + k AS c, abs(x - floor(x) - k) AS far FROM ({grid}), (SELECT unnest([-1, 0, 1, 2]) AS k)"
    wide = f"SELECT i, CASE WHEN far < 1 THEN 2 / 3::DOUBLE - far * far + far * far * far / 2 WHEN far < 2 THEN power(2 - far, 3) / 6 ELSE 0 END AS b, j, (c + j + 1000 * 2 * ({n} - 1)) % (2 * ({n} - 1)) AS spot FROM ({near}), (SELECT unnest(range(-40, 41)) AS j)"
    return f"to_{name} AS (SELECT i::INT AS t_{name}, least(spot, 2 * ({n} - 1) - spot)::INT AS {name}, sum(b * sqrt(3::DOUBLE) * power(sqrt(3::DOUBLE) - 2, abs(j))) AS w_{name} FROM ({wide}) GROUP BY ALL)"


def _cubic_sql(dims: int, new=NEW) -> str:
    names = ["ax", "sag", "cor"][:dims]
    steps, source, done = [], "vox", ["frame"]
    for k, c in enumerate(names):
        rest = names[k + 1 :]
        kept = ", ".join([*done, f"t_{c}", *rest])
        steps.append(f"step{k} AS (SELECT {kept}, sum(value * w_{c}) AS value FROM {source} JOIN to_{c} USING ({c}) GROUP BY {kept})")
        source, done = f"step{k}", [*done, f"t_{c}"]
    axes = ", ".join(_cubic_axis_sql(c, o, n) for c, o, n in zip(names, OLD, new))
    return f"WITH {CINE2 if dims == 2 else CINE3}, {axes}, {', '.join(steps)} SELECT frame, {', '.join(f't_{c} AS {c}' for c in names)}, round(value, 6) + 0.0 AS value FROM {source}"


#: A spacing at which no value lies halfway between two roundings.
UNEVEN = (1.3717, 0.7331, 0.9177)


@query("resample_cubic_3d", _cubic_sql(3, UNEVEN))
def resample_cubic_3d(spark, d):
    return _resampled(spark, d, 3, "cubic", UNEVEN)


@query("resample_cubic_2d", _cubic_sql(2))
def resample_cubic_2d(spark, d):
    return _resampled(spark, d, 2, "cubic")


@query("resample_mask", _resample_sql(2, "nearest", OLD, NEW, "m", "", "cells"))
def resample_mask(spark, d):
    return preprocess.resample_mask(X.mask(spark, d, 2), X.shape(spark, d, 2), OLD[:2], NEW[:2]).select("ax", "sag", "m")


@query("grayscale", "SELECT l_orderkey, l_linenumber, round(0.114::DOUBLE * l_quantity::INT + 0.587::DOUBLE * round(l_discount * 100)::INT + 0.299::DOUBLE * round(l_tax * 100)::INT) AS value FROM lineitem")
def grayscale(spark, d):
    return preprocess.grayscale(X.rgb(spark, d))


def _moving_mask(spark, d):
    """A mask that changes over time: a cell is set where the intensity is high."""
    v = X.cine(spark, d, 3)
    return v.select("scan_id", F.lit("roi").alias("seg_id"), "frame", "ax", "sag", "cor", (F.col("value") > 108).cast("smallint").alias("m"))


@query("max_projection", f"WITH {CINE3} SELECT ax, sag, cor, (max((value > 108)::INT) > 0)::SMALLINT AS m FROM vox GROUP BY ax, sag, cor")
def max_projection(spark, d):
    return preprocess.max_projection(_moving_mask(spark, d), 3).select("ax", "sag", "cor", "m")


@query("crop_mask", f"WITH {CINE2} SELECT ax, sag, m::SMALLINT AS m FROM cells WHERE sag < 20")
def crop_mask(spark, d):
    return preprocess.crop(X.mask(spark, d, 2), "sag", 20).select("ax", "sag", "m")


@query("transpose", f"WITH {CINE2} SELECT frame, sag AS ax, ax AS sag, value FROM vox")
def transpose(spark, d):
    return preprocess.transpose(X.cine(spark, d, 2), 2).select("frame", "ax", "sag", "value")


HOLES = """WITH RECURSIVE cells AS (SELECT (vec_id // 25)::INT AS ax, (vec_id % 25)::INT AS sag, (label < 7)::INT AS m FROM embeddings),
ends AS (SELECT max(ax) AS a1, max(sag) AS s1 FROM cells),
outside AS (SELECT ax, sag FROM cells, ends WHERE m = 0 AND (ax IN (0, a1) OR sag IN (0, s1))
  UNION SELECT c.ax, c.sag FROM outside o JOIN cells c ON abs(c.ax - o.ax) + abs(c.sag - o.sag) = 1 WHERE c.m = 0)
SELECT c.ax, c.sag, (o.ax IS NULL)::SMALLINT AS m FROM cells c LEFT JOIN outside o USING (ax, sag)"""


@query("fill_holes", HOLES)
def fill_holes(spark, d):
    m = X.table(spark, d, "embeddings").select(F.lit("cine").alias("scan_id"), F.lit("roi").alias("seg_id"), F.expr("vec_id div 25").cast("int").alias("ax"), (F.col("vec_id") % 25).cast("int").alias("sag"), (F.col("label") < 7).cast("smallint").alias("m"))
    return preprocess.fill_holes(m, 2).select("ax", "sag", "m")


@query("fill_holes_tiles", HOLES)
def fill_holes_tiles(spark, d):
    """As fill_holes, where masks are larger than tasks."""
    m = X.table(spark, d, "embeddings").select(F.lit("cine").alias("scan_id"), F.lit("roi").alias("seg_id"), F.expr("vec_id div 25").cast("int").alias("ax"), (F.col("vec_id") % 25).cast("int").alias("sag"), (F.col("label") < 7).cast("smallint").alias("m"))
    return preprocess.fill_holes(m, 2, one_task=0, tile=8).select("ax", "sag", "m")


def _filled_sql(number: int, axis: str | None) -> str:
    """mask{number} from the mask before it: what its border doesn't reach, in all of it or in its slices along an axis."""
    names = [c for c in ("ax", "sag", "cor") if c != axis]
    border = " OR ".join(f"m.{c} IN (0, max_{c})" for c in names)
    near = f"abs(m.{names[0]} - o.{names[0]})" + "".join(f" + abs(m.{c} - o.{c})" for c in names[1:]) + " = 1" + (f" AND m.{axis} = o.{axis}" if axis else "")
    before = f"mask{number - 1}"
    return f"""outside{number} AS (SELECT m.ax, m.sag, m.cor FROM {before} m, ends WHERE m = 0 AND ({border})
  UNION SELECT m.ax, m.sag, m.cor FROM outside{number} o JOIN {before} m ON {near} WHERE m.m = 0),
mask{number} AS (SELECT m.ax, m.sag, m.cor, (o.ax IS NULL)::SMALLINT AS m FROM {before} m LEFT JOIN outside{number} o USING (ax, sag, cor))"""


BOLUS_MASK = f"""WITH RECURSIVE {CINE3.strip()}, mask0 AS (SELECT ax, sag, cor, (max((value > 108)::INT) > 0)::SMALLINT AS m FROM vox WHERE sag < 8 GROUP BY ax, sag, cor),
ends AS (SELECT max(ax) AS max_ax, max(sag) AS max_sag, max(cor) AS max_cor FROM mask0),
{", ".join(_filled_sql(k, axis) for k, axis in enumerate((None, "ax", "sag", "cor"), 1))}
SELECT ax, sag, cor, m FROM mask4"""


@query("bolus_mask", BOLUS_MASK)
def bolus_mask(spark, d):
    return preprocess.bolus_mask(_moving_mask(spark, d), 8).select("ax", "sag", "cor", "m")


@query("largest_file_pick", "SELECT doc_id, source AS path, n_chars AS length FROM documents WHERE source LIKE 'src1%' ORDER BY n_chars DESC, source LIMIT 1")
def largest_file_pick(spark, d):
    return images.largest_file(X.files(spark, d), "src1").select("doc_id", "path", "length")


# Texture and spectra ---------------------------------------------------------------------------


RADIOMICS = f"""WITH {CINE2}, lev AS (SELECT frame, ax, sag, (floor(((CASE WHEN ax = 0 AND sag = 0 THEN 0 ELSE value END) - 80) / 5) + 1)::INT AS level FROM vox WHERE m = 1 OR (ax = 0 AND sag = 0)),
hist AS (SELECT frame, level, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY frame))::DOUBLE AS total FROM lev GROUP BY frame, level),
parts AS (SELECT frame, 'firstorder_Mean' AS name, avg(level) AS value FROM lev GROUP BY frame UNION ALL SELECT frame, 'firstorder_Energy', sum(level * level)::DOUBLE FROM lev GROUP BY frame
  UNION ALL SELECT frame, 'firstorder_90Percentile', quantile_cont(level::DOUBLE, 0.9) FROM lev GROUP BY frame UNION ALL SELECT frame, 'firstorder_Entropy', -sum(n / total * log2(n / total)) FROM hist GROUP BY frame
  UNION ALL SELECT frame, 'firstorder_Uniformity', sum(power(n / total, 2)) FROM hist GROUP BY frame),
dirs(angle, da, ds) AS (VALUES (0, 0, 1), (1, 1, -1), (2, 1, 0), (3, 1, 1)),
pairs AS (SELECT a.frame, angle, avg(power(a.level - b.level, 2)) AS contrast, avg(abs(a.level - b.level)) AS away FROM lev a, dirs JOIN lev b ON b.frame = a.frame AND b.ax = a.ax + da AND b.sag = a.sag + ds GROUP BY a.frame, angle),
every AS (FROM parts UNION ALL SELECT frame, 'glcm_Contrast', avg(contrast) FROM pairs GROUP BY frame UNION ALL SELECT frame, 'glcm_DifferenceAverage', avg(away) FROM pairs GROUP BY frame)
SELECT frame, frame * 0.5::DOUBLE AS time_s, 'r_original_' || name AS curve_name, round(value, 6) + 0.0 AS value FROM every"""


@query("radiomics_curves", RADIOMICS)
def radiomics_curves(spark, d):
    config = {"setting": {"binWidth": 1}, "featureClass": {"firstorder": ["Mean", "Energy", "90Percentile", "Entropy", "Uniformity"], "glcm": ["Contrast", "DifferenceAverage"]}}
    cine = X.cine(spark, d, 2)
    kind = texture.Radiomics([("r", config)], 80.0, 5.0)
    found = C.roi_texture(cine, X.mask(spark, d, 2), 2, kind.curves, kind.names(), 0.5, cine.select("scan_id", "frame").distinct())
    return found.select("frame", "time_s", "curve_name", number(F.col("value"), 6).alias("value"))


def _levels(spark, d):
    both = X.cine(spark, d, 2).join(X.mask(spark, d, 2), ["scan_id", "ax", "sag"])
    return texture.discretize(texture.phantom_voxel(both, 2), 5.0, 80.0)


PHANTOM = f"""{CINE2}, ph AS (SELECT frame, ax, sag, CASE WHEN ax = 0 AND sag = 0 THEN 0 ELSE value END AS value, CASE WHEN ax = 0 AND sag = 0 THEN 1 ELSE m END AS m FROM vox),
lev AS (SELECT frame, ax, sag, m, value, CASE WHEN m = 1 THEN floor((value - 80) / 5) + 1 ELSE 0 END::INT AS level FROM ph)"""


@query("phantom_voxel", f"WITH {PHANTOM} SELECT frame, ax, sag, value, m::SMALLINT AS m FROM ph")
def phantom_voxel(spark, d):
    both = X.cine(spark, d, 2).join(X.mask(spark, d, 2), ["scan_id", "ax", "sag"])
    return texture.phantom_voxel(both, 2).select("frame", "ax", "sag", "value", "m")


@query("discretize_binwidth", f"WITH {PHANTOM} SELECT frame, ax, sag, level FROM lev")
def discretize_binwidth(spark, d):
    return _levels(spark, d).select("frame", "ax", "sag", "level")


@query("glcm_contrast", f"""WITH {PHANTOM}, off AS (SELECT * FROM (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) t(da, ds)),
inside AS (SELECT * FROM lev WHERE m = 1),
pairs AS (SELECT a.frame, a.level AS i, b.level AS j FROM inside a, off, inside b WHERE b.frame = a.frame AND b.ax = a.ax + da AND b.sag = a.sag + ds),
both_ways AS (SELECT * FROM pairs UNION ALL SELECT frame, j, i FROM pairs),
p AS (SELECT frame, i, j, count(*) / sum(count(*)) OVER (PARTITION BY frame) AS p FROM both_ways GROUP BY frame, i, j)
SELECT frame, round(sum((i - j) * (i - j) * p), 6) + 0.0 AS contrast, round(sum(p * p), 6) + 0.0 AS energy, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY frame""")
def glcm_contrast(spark, d):
    f = texture.glcm_features(texture.glcm(_levels(spark, d), 2))
    return f.select("frame", *(number(F.col(f"glcm_{a}"), 6).alias(b) for a, b in (("Contrast", "contrast"), ("JointEnergy", "energy"), ("JointEntropy", "entropy"))))


# Gray-level matrices of 2-D frames, with the first cell in the mask as the value 0, and levels in bins of 2.
GRAY = f"""{CINE2}, raw AS (SELECT frame, ax, sag, floor((floor(((CASE WHEN ax = 0 AND sag = 0 THEN 0 ELSE value END) - 80) / 5) + 1) / 2)::INT AS b FROM vox WHERE m = 1 OR (ax = 0 AND sag = 0)),
g AS (SELECT frame, ax, sag, b - min(b) OVER (PARTITION BY frame) + 1 AS level, max(b) OVER (PARTITION BY frame) - min(b) OVER (PARTITION BY frame) + 1 AS ng FROM raw)"""
#: Directions in the plane: one of each pair of opposite ones.
DIRS = "dirs(angle, da, ds) AS (VALUES (0, 0, 1), (1, 1, -1), (2, 1, 0), (3, 1, 1))"
AROUND = "moves(da, ds) AS (SELECT da, ds FROM (SELECT unnest([-1, 0, 1]) AS da), (SELECT unnest([-1, 0, 1]) AS ds) WHERE da <> 0 OR ds <> 0)"


def _sizes_sql(kind: str, matrix: str, each: str = "") -> str:
    """Features of a matrix mat(frame, each, level, size, n), as means over each."""
    part = f"frame{each}"
    terms = (
        "sum(n / size / size) / sum(n)", "sum(n * size * size) / sum(n)", "sum(n * r) / sum(n)", "sum(n * r) / sum(n) / sum(n)", "sum(n * c) / sum(n)", "sum(n * c) / sum(n) / sum(n)", "sum(n) / sum(n * size)",
        "sum(n * level * level) / sum(n) - power(sum(n * level) / sum(n), 2)", "sum(n * size * size) / sum(n) - power(sum(n * size) / sum(n), 2)", "-sum(n / t * log2(n / t))",
        "sum(n / level / level) / sum(n)", "sum(n * level * level) / sum(n)", "sum(n / level / level / size / size) / sum(n)", "sum(n * level * level / size / size) / sum(n)", "sum(n * size * size / level / level) / sum(n)", "sum(n * size * size * level * level) / sum(n)")
    named = [(n, t) for n, t in zip(graylevel.SIZES[kind], terms) if n]
    columns = ", ".join(f'{t} AS "{n}"' for n, t in named)
    means = ", ".join(f'round(avg("{n}"), 6) + 0.0 AS "{n}"' for n, _ in named)
    return f"""{matrix}, d AS (SELECT {part}, level::DOUBLE AS level, size::DOUBLE AS size, n::DOUBLE AS n FROM mat), w AS (SELECT *, (sum(n) OVER (PARTITION BY {part}, level))::DOUBLE AS r, (sum(n) OVER (PARTITION BY {part}, size))::DOUBLE AS c, (sum(n) OVER (PARTITION BY {part}))::DOUBLE AS t FROM d),
per AS (SELECT {part}, {columns} FROM w GROUP BY {part}) SELECT frame, {means} FROM per GROUP BY frame"""


def _gray(spark, d, dims=2):
    cells = X.cine(spark, d, dims).join(X.mask(spark, d, dims), ["scan_id", *["ax", "sag", "cor"][:dims]])
    return graylevel.gray_levels(texture.discretize(texture.phantom_voxel(cells, dims), 5.0, 80.0).withColumn("seg_id", F.lit("roi")), dims, ["scan_id", "seg_id", "frame"], 2)


def _features(table: DataFrame) -> DataFrame:
    return table.select("frame", *(number(F.col(c), 6).alias(c) for c in table.columns[3:]))


KEYS = ["scan_id", "seg_id", "frame"]


@query("radiomics_glrlm", _sizes_sql("glrlm", f"""WITH {GRAY}, {DIRS},
laid AS (SELECT frame, angle, level, CASE WHEN da = 1 THEN ax ELSE sag END AS place, CASE WHEN da = 1 THEN sag - ax * ds ELSE ax END AS line FROM g, dirs),
islands AS (SELECT *, place - row_number() OVER (PARTITION BY frame, angle, line, level ORDER BY place) AS island FROM laid),
runs AS (SELECT frame, angle, level, count(*) AS size FROM islands GROUP BY frame, angle, line, level, island), mat AS (SELECT frame, angle, level, size, count(*) AS n FROM runs GROUP BY ALL)""", ", angle"))
def radiomics_glrlm(spark, d):
    return _features(graylevel.glrlm_features(_gray(spark, d), 2, KEYS))


@query("radiomics_glszm", _sizes_sql("glszm", f"""WITH RECURSIVE {GRAY.strip()}, {AROUND},
reach AS (SELECT frame, ax, sag, ax AS a, sag AS s, level FROM g UNION SELECT r.frame, r.ax, r.sag, g.ax, g.sag, r.level FROM reach r, moves JOIN g ON g.frame = r.frame AND g.ax = r.a + da AND g.sag = r.s + ds AND g.level = r.level),
zones AS (SELECT frame, ax, sag, level, count(*) AS size, min(a * 1000000 + s) AS zone FROM reach GROUP BY ALL), whole AS (SELECT frame, zone, level, any_value(size) AS size FROM zones GROUP BY frame, zone, level),
mat AS (SELECT frame, level, size, count(*) AS n FROM whole GROUP BY ALL)"""))
def radiomics_glszm(spark, d):
    return _features(graylevel.glszm_features(_gray(spark, d), 2, KEYS))


@query("radiomics_gldm", _sizes_sql("gldm", f"""WITH {GRAY}, {AROUND},
alike AS (SELECT a.frame, a.ax, a.sag, a.level, 1 + count(b.level) AS size FROM g a, moves LEFT JOIN g b ON b.frame = a.frame AND b.ax = a.ax + da AND b.sag = a.sag + ds AND b.level = a.level GROUP BY ALL),
mat AS (SELECT frame, level, size, count(*) AS n FROM alike GROUP BY ALL)"""))
def radiomics_gldm(spark, d):
    return _features(graylevel.gldm_features(_gray(spark, d), 2, KEYS))


@query("radiomics_ngtdm", f"""WITH {GRAY}, {AROUND},
near AS (SELECT a.frame, a.ax, a.sag, a.level, avg(b.level) AS mean FROM g a, moves JOIN g b ON b.frame = a.frame AND b.ax = a.ax + da AND b.sag = a.sag + ds GROUP BY ALL),
l AS (SELECT frame, level::DOUBLE AS i, count(*)::DOUBLE AS n, sum(abs(level - mean)) AS s FROM near GROUP BY frame, level), q AS (SELECT *, n / sum(n) OVER (PARTITION BY frame) AS p FROM l),
one AS (SELECT frame, sum(n) AS total, count(*) AS levels, sum(s) AS s, sum(p * s) AS ps FROM q GROUP BY frame),
two AS (SELECT x.frame, sum(x.p * y.p * power(x.i - y.i, 2)) AS a, sum(abs(x.i * x.p - y.i * y.p)) AS b, sum(abs(x.i - y.i) * (x.p * x.s + y.p * y.s) / (x.p + y.p)) AS c, sum((x.p + y.p) * power(x.i - y.i, 2)) AS e FROM q x JOIN q y USING (frame) GROUP BY x.frame)
SELECT frame, round(CASE WHEN ps = 0 THEN 1e6 ELSE 1 / ps END, 6) + 0.0 AS "Coarseness", round(CASE WHEN levels > 1 THEN a / (levels * (levels - 1)) * s / total ELSE 0 END, 6) + 0.0 AS "Contrast",
round(CASE WHEN b > 0 THEN ps / b ELSE 0 END, 6) + 0.0 AS "Busyness", round(c / total, 6) + 0.0 AS "Complexity", round(CASE WHEN s = 0 THEN 0 ELSE e / s END, 6) + 0.0 AS "Strength" FROM one JOIN two USING (frame)""")
def radiomics_ngtdm(spark, d):
    return _features(graylevel.ngtdm_features(_gray(spark, d), 2, KEYS))


GLCM_SQL = f"""WITH {GRAY}, {DIRS}, half AS (SELECT a.frame, angle, a.ng, a.level AS i, b.level AS j FROM g a, dirs JOIN g b ON b.frame = a.frame AND b.ax = a.ax + da AND b.sag = a.sag + ds),
full_ AS (SELECT * FROM half UNION ALL SELECT frame, angle, ng, j, i FROM half), c AS (SELECT frame, angle, any_value(ng)::DOUBLE AS ng, i::DOUBLE AS i, j::DOUBLE AS j, count(*) AS n FROM full_ GROUP BY frame, angle, i, j),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY frame, angle) AS p, abs(i - j) AS k FROM c), m AS (SELECT *, sum(p) OVER (PARTITION BY frame, angle, i) AS px, sum(p) OVER (PARTITION BY frame, angle, j) AS py, sum(p * i) OVER (PARTITION BY frame, angle) AS u FROM p),
away AS (SELECT frame, angle, k, sum(p) AS q FROM p GROUP BY ALL), aw AS (SELECT frame, angle, sum(k * q) AS da, -sum(q * log2(q)) AS de, sum(k * k * q) - power(sum(k * q), 2) AS dv FROM away GROUP BY ALL),
both_ AS (SELECT frame, angle, i + j AS k, sum(p) AS q FROM p GROUP BY ALL), bo AS (SELECT frame, angle, -sum(q * log2(q)) AS se FROM both_ GROUP BY ALL),
one AS (SELECT frame, angle, sum(p * i * j) AS "Autocorrelation", sum(p * i) AS "JointAverage", sum(p * power(i + j - 2 * u, 4)) AS "ClusterProminence", sum(p * power(i + j - 2 * u, 3)) AS "ClusterShade", sum(p * power(i + j - 2 * u, 2)) AS "ClusterTendency",
  sum(p * k * k) AS "Contrast", CASE WHEN sum(p * power(i - u, 2)) = 0 THEN 1 ELSE sum(p * (i - u) * (j - u)) / sum(p * power(i - u, 2)) END AS "Correlation", sum(p * p) AS "JointEnergy", -sum(p * log2(p)) AS "JointEntropy",
  -sum(p * log2(px)) AS hx, -sum(p * log2(py)) AS hy, -sum(p * log2(px * py)) AS hxy1, sum(p / (1 + k * k)) AS "Idm", sum(p / (1 + k * k / ng / ng)) AS "Idmn", sum(p / (1 + k)) AS "Id", sum(p / (1 + k / ng)) AS "Idn", sum(CASE WHEN k > 0 THEN p / k / k ELSE 0 END) AS "InverseVariance",
  max(p) AS "MaximumProbability", sum(p * (i + j)) AS "SumAverage", sum(p * power(i - u, 2)) AS "SumSquares" FROM m GROUP BY ALL),
every AS (SELECT *, da AS "DifferenceAverage", de AS "DifferenceEntropy", dv AS "DifferenceVariance", se AS "SumEntropy", CASE WHEN hx = 0 THEN 0 ELSE ("JointEntropy" - hxy1) / greatest(hx, hy) END AS "Imc1", sqrt(greatest(0, 1 - exp(-2 * (hx + hy - "JointEntropy")))) AS "Imc2" FROM one JOIN aw USING (frame, angle) JOIN bo USING (frame, angle))
SELECT frame, {", ".join(f'round(avg("{n}"), 5) + 0.0 AS "{n}"' for n in graylevel.GLCM if n != "MCC")} FROM every GROUP BY frame"""


@query("radiomics_glcm", GLCM_SQL)
def radiomics_glcm(spark, d):
    """All but MCC, whose eigenvalues SQL doesn't have."""
    features = [f for f in graylevel.GLCM if f != "MCC"]
    table = graylevel.glcm_features(_gray(spark, d), 2, KEYS, features=features)
    return table.select("frame", *(number(F.col(c), 5).alias(c) for c in features))


# Shape of the mask with its first cell, and filtered images of its levels.


def _region(spark, d, dims):
    names = ["ax", "sag", "cor"][:dims]
    m = X.mask(spark, d, dims)
    origin = " AND ".join(f"{c} = 0" for c in names)
    return m.where(f"m = 1 OR ({origin})").select("scan_id", "seg_id", *names)


def _shape_query(spark, d, dims, spacing):
    table = shape.shape_features(_region(spark, d, dims), dims, ["scan_id", "seg_id"], spacing)
    return table.select("seg_id", *(number(F.col(c), 6).alias(c) for c in shape.SHAPE[dims]))


def _ends_sql(dims: int, spacing) -> str:
    """Mesh points pts, in doubled coordinates, and the largest distances between them."""
    names = ["ax", "sag", "cor"][:dims]
    faces = " UNION ALL ".join(f"SELECT {', '.join(f'2 * {c}' + (f' + {way}' if c == along else '') + f' AS {c}' for c in names)} FROM r" for along in names for way in (-1, 1))
    far = " + ".join(f"power((a.{c} - b.{c}) * {s / 2}::DOUBLE, 2)" for c, s in zip(names, spacing))
    planes = "".join(f", sqrt(max({far}) FILTER (a.{c} = b.{c})) AS d_{c}" for c in names)
    return f"faces AS ({faces}), pts AS (SELECT {', '.join(names)} FROM faces GROUP BY ALL HAVING count(*) = 1), far AS (SELECT sqrt(max({far})) AS d{planes} FROM pts a, pts b)"


SHAPE_2D = f"""WITH {CINE2}, r AS (SELECT ax, sag FROM cells WHERE m = 1 OR (ax = 0 AND sag = 0)), corners AS (SELECT ax - da AS ax, sag - ds AS sag, (da + ds) % 2 AS odd FROM r, (SELECT unnest([0, 1]) AS da), (SELECT unnest([0, 1]) AS ds)),
b AS (SELECT count(*) AS n, count(*) = 2 AND sum(odd) IN (0, 2) AS diagonal FROM corners GROUP BY ax, sag),
mesh AS (SELECT sum(CASE WHEN diagonal THEN sqrt(2::DOUBLE) WHEN n = 2 THEN 1 WHEN n IN (1, 3) THEN sqrt(0.5::DOUBLE) ELSE 0 END) AS p, sum(CASE WHEN diagonal THEN 0.25 ELSE [0.125, 0.5, 0.875, 1][n] END)::DOUBLE AS a FROM b),
c AS (SELECT count(*) AS n, var_pop(ax) AS x, var_pop(sag) AS y, covar_pop(ax, sag) AS z FROM r), l AS (SELECT n, (x + y) / 2 + sqrt(power((x - y) / 2, 2) + z * z) AS l0, (x + y) / 2 - sqrt(power((x - y) / 2, 2) + z * z) AS l1 FROM c), {_ends_sql(2, (1, 1))}
SELECT 'roi' AS seg_id, round(a, 6) AS "MeshSurface", round(n::DOUBLE, 6) AS "PixelSurface", round(p, 6) AS "Perimeter", round(p / a, 6) AS "PerimeterSurfaceRatio", round(2 * sqrt(pi() * a) / p, 6) AS "Sphericity", round(d, 6) AS "MaximumDiameter",
round(4 * sqrt(l0), 6) AS "MajorAxisLength", round(4 * sqrt(l1), 6) AS "MinorAxisLength", round(sqrt(l1 / l0), 6) AS "Elongation" FROM mesh, l, far"""


@query("radiomics_shape_2d", SHAPE_2D)
def radiomics_shape_2d(spark, d):
    return _shape_query(spark, d, 2, (1.0, 1.0))


SPACING = (1.5, 0.8, 0.75)
SHAPE_3D = f"""WITH {CINE3}, r AS (SELECT ax, sag, cor FROM cells WHERE m = 1 OR (ax = 0 AND sag = 0 AND cor = 0)),
corners AS (SELECT ax - da AS ax, sag - ds AS sag, cor - dc AS cor, 1 << (4 * da + 2 * ds + dc) AS bit FROM r, (SELECT unnest([0, 1]) AS da), (SELECT unnest([0, 1]) AS ds), (SELECT unnest([0, 1]) AS dc)),
b AS (SELECT ax, sag, cor, sum(bit)::INT AS code FROM corners GROUP BY ax, sag, cor), t(code, size, moment, va, vs, vc) AS (VALUES {", ".join(f"({r[0]}, {', '.join(f'{x!r}::DOUBLE' for x in r[1:])})" for r in shape.mesh_table(3, SPACING))}),
mesh AS (SELECT sum(size) AS p, sum(moment + ax * 1.5 * va + sag * 0.8 * vs + cor * 0.75 * vc)::DOUBLE / 3 AS a FROM b JOIN t USING (code)),
u AS (SELECT ax * 1.5::DOUBLE AS x, sag * 0.8::DOUBLE AS y, cor * 0.75::DOUBLE AS z FROM r), c AS (SELECT count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM u),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt((power(xx - q, 2) + power(yy - q, 2) + power(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS h FROM q),
w AS (SELECT *, acos(least(1, greatest(-1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * h * h * h)))) / 3 AS f FROM p),
l AS (SELECT n, q + 2 * h * cos(f) AS l0, q + 2 * h * cos(f + 4 * pi() / 3) AS l1, q + 2 * h * cos(f + 2 * pi() / 3) AS l2 FROM w), {_ends_sql(3, SPACING)}
SELECT 'roi' AS seg_id, round(a, 6) AS "MeshVolume", round(n * 0.9::DOUBLE, 6) AS "VoxelVolume", round(p, 6) AS "SurfaceArea", round(p / a, 6) AS "SurfaceVolumeRatio", round(power(36 * pi() * a * a, 1 / 3::DOUBLE) / p, 6) AS "Sphericity", round(d, 6) AS "Maximum3DDiameter",
round(d_sag, 6) AS "Maximum2DDiameterSlice", round(d_ax, 6) AS "Maximum2DDiameterColumn", round(d_cor, 6) AS "Maximum2DDiameterRow", round(4 * sqrt(l0), 6) AS "MajorAxisLength", round(4 * sqrt(l1), 6) AS "MinorAxisLength", round(4 * sqrt(l2), 6) AS "LeastAxisLength",
round(sqrt(l1 / l0), 6) AS "Elongation", round(sqrt(l2 / l0), 6) AS "Flatness" FROM mesh, l, far"""


@query("radiomics_shape_3d", SHAPE_3D)
def radiomics_shape_3d(spark, d):
    return _shape_query(spark, d, 3, SPACING)


#: Levels of the mask's cells as an image, and the sizes of its axes.
IMAGE = f"{CINE2}, img AS (SELECT frame, ax, sag, floor(((CASE WHEN ax = 0 AND sag = 0 THEN 0 ELSE value END) - 80) / 5) + 1 AS v FROM vox WHERE m = 1 OR (ax = 0 AND sag = 0)), n AS (SELECT max(ax) + 1 AS na, max(sag) + 1 AS ns FROM cells)"


def _image(spark, d):
    """(cells with values, sizes) of the levels."""
    cells = X.cine(spark, d, 2).join(X.mask(spark, d, 2), ["scan_id", "ax", "sag"])
    levels = texture.discretize(texture.phantom_voxel(cells, 2), 5.0, 80.0).where("m = 1")
    return levels.select("scan_id", "frame", "ax", "sag", F.col("level").cast("double").alias("value")), X.shape(spark, d, 2)


def _images(found: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, image in found.items():
        part = image.select(F.lit(name).alias("image"), "frame", "ax", "sag", number(F.col("value"), 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("radiomics_wavelet", f"""WITH {IMAGE}, w(k, lo, hi) AS (VALUES (0, -0.01565572813546454, 0.0727326195128539), (1, -0.0727326195128539, 0.3378976624578092), (2, 0.38486484686420286, -0.8525720202122554), (3, 0.8525720202122554, 0.38486484686420286), (4, 0.3378976624578092, 0.0727326195128539), (5, -0.0727326195128539, -0.01565572813546454)),
ta AS (SELECT t, CASE WHEN p = na THEN 0 ELSE p END AS s, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (SELECT t, na, (t + 3 - k + na + na % 2) % (na + na % 2) AS p, lo, hi FROM n, w, (SELECT unnest(range(0, na)) AS t FROM n))),
ts AS (SELECT t, CASE WHEN p = ns THEN 0 ELSE p END AS s, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (SELECT t, ns, (t + 3 - k + ns + ns % 2) % (ns + ns % 2) AS p, lo, hi FROM n, w, (SELECT unnest(range(0, ns)) AS t FROM n))),
a AS (SELECT frame, ax, t AS sag, sum(v * lo) AS l, sum(v * hi) AS h FROM img JOIN ts ON sag = s GROUP BY ALL),
b AS (SELECT frame, t AS ax, sag, sum(l * lo) AS ll, sum(l * hi) AS lh, sum(h * lo) AS hl, sum(h * hi) AS hh FROM a JOIN ta ON ax = s GROUP BY ALL),
f AS (SELECT frame, ax, sag, unnest(['wavelet-LL', 'wavelet-LH', 'wavelet-HL', 'wavelet-HH']) AS image, unnest([ll, lh, hl, hh]) AS v FROM img LEFT JOIN b USING (frame, ax, sag))
SELECT image, frame, ax, sag, round(coalesce(v, 0), 6) + 0.0 AS value FROM f""")
def radiomics_wavelet(spark, d):
    cells, size = _image(spark, d)
    return _images(imagefilters.wavelet(cells, 2, ["scan_id", "frame"], size))


@query("radiomics_log", f"""WITH {IMAGE}, e AS (SELECT k, exp(-k * k / 4.5::DOUBLE) / sum(exp(-k * k / 4.5::DOUBLE)) OVER () AS g FROM (SELECT unnest(range(-6, 7)) AS k)),
d0 AS (SELECT k, g, g * (k * k / 2.25::DOUBLE - 1) AS d FROM e), d1 AS (SELECT k, g, d - g * sum(d) OVER () AS d FROM d0), w AS (SELECT k, g, d * 2 / sum(d * k * k) OVER () AS d FROM d1),
ta AS (SELECT t, greatest(0, least(na - 1, t + k)) AS s, sum(g) AS g, sum(d) AS d FROM n, w, (SELECT unnest(range(0, na)) AS t FROM n) GROUP BY ALL), ts AS (SELECT t, greatest(0, least(ns - 1, t + k)) AS s, sum(g) AS g, sum(d) AS d FROM n, w, (SELECT unnest(range(0, ns)) AS t FROM n) GROUP BY ALL),
a AS (SELECT frame, t AS ax, sag, sum(v * g) AS s, sum(v * d) AS d FROM img JOIN ta ON ax = s GROUP BY ALL), b AS (SELECT a.frame, a.ax, ts.t AS sag, sum(a.s * ts.d) + sum(a.d * ts.g) AS v FROM a JOIN ts ON a.sag = ts.s GROUP BY ALL)
SELECT 'log-sigma-1-5-mm-3D' AS image, frame, ax, sag, round(b.v * 2.25::DOUBLE, 6) + 0.0 AS value FROM img JOIN b USING (frame, ax, sag)""")
def radiomics_log(spark, d):
    cells, size = _image(spark, d)
    return _images(imagefilters.images(cells, 2, ["scan_id", "frame"], {"imageType": {"LoG": {"sigma": [1.5]}}}, size, (1.0, 1.0)))


@query("radiomics_gradient", f"""WITH {IMAGE}, spots AS (SELECT i.frame, i.ax, i.sag, least(i.ax + 1, na - 1) AS a1, greatest(i.ax - 1, 0) AS a0, least(i.sag + 1, ns - 1) AS s1, greatest(i.sag - 1, 0) AS s0 FROM img i, n)
SELECT 'gradient' AS image, t.frame, t.ax, t.sag, round(sqrt(power((coalesce(a.v, 0) - coalesce(b.v, 0)) / 2 / 0.5, 2) + power((coalesce(c.v, 0) - coalesce(e.v, 0)) / 2 / 2.0, 2)), 6) + 0.0 AS value FROM spots t
LEFT JOIN img a ON a.frame = t.frame AND a.ax = t.a1 AND a.sag = t.sag LEFT JOIN img b ON b.frame = t.frame AND b.ax = t.a0 AND b.sag = t.sag LEFT JOIN img c ON c.frame = t.frame AND c.ax = t.ax AND c.sag = t.s1 LEFT JOIN img e ON e.frame = t.frame AND e.ax = t.ax AND e.sag = t.s0""")
def radiomics_gradient(spark, d):
    cells, size = _image(spark, d)
    return _images({"gradient": imagefilters.gradient(cells, 2, ["scan_id", "frame"], size, (0.5, 2.0))})


@query("radiomics_pointwise", f"""WITH {IMAGE}, t AS (SELECT *, max(abs(v)) OVER (PARTITION BY frame) AS top FROM img),
f AS (SELECT frame, ax, sag, unnest(['square', 'squareroot', 'logarithm', 'exponential']) AS image, unnest([v * v / top, sign(v) * sqrt(abs(v) * top), sign(v) * ln(abs(v) + 1) * top / ln(top + 1), exp(ln(top) / top * v)]) AS v FROM t)
SELECT image, frame, ax, sag, round(v, 6) + 0.0 AS value FROM f""")
def radiomics_pointwise(spark, d):
    cells, _ = _image(spark, d)
    return _images(imagefilters.images(cells, 2, ["scan_id", "frame"], {"imageType": dict.fromkeys(("Square", "SquareRoot", "Logarithm", "Exponential"))}))


@query("power_spectrum", f"""WITH {CURVE}, l AS (SELECT scan_id, frame, value, count(*) OVER (PARTITION BY scan_id) AS size FROM timed),
t AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * frame / (size - 1)) AS w FROM l), x AS (SELECT scan_id, frame, size, value * w / sqrt(avg(w * w) OVER (PARTITION BY scan_id)) AS x FROM t),
b AS (SELECT unnest(range(16, 48))::INT AS bin),
s AS (SELECT scan_id, bin, any_value(size) AS size, sum(x * cos(2 * pi() * ((bin * frame) % 128) / 128)) AS re, sum(x * sin(2 * pi() * ((bin * frame) % 128) / 128)) AS im FROM x, b GROUP BY scan_id, bin)
SELECT scan_id, bin, round(bin * 2.0::DOUBLE / 127, 9) AS frequency, round(ln(1 + (re * re + im * im) * size * size), 5) + 0.0 AS log_power FROM s""")
def power_spectrum(spark, d):
    lines = X.curves(spark, d).select("scan_id", F.lit(0).alias("line"), F.col("frame").alias("sample"), "value")
    p = spectrum.power_spectrum(lines, 0.25, 0.75, 2.0, 128)
    return p.select("scan_id", "bin", F.round("frequency", 9).alias("frequency"), number(F.log1p("power"), 5).alias("log_power"))


# Studies: scans of unlike shape in one plan ----------------------------------------------------------


def _study(spark, d):
    scans, voxels, mask = X.study_tables(spark, d)
    return study.study_of(scans, voxels), mask


def _scan_sql(name: str) -> str:
    """cells and vox of a scan of the study."""
    width, frames, _, _ = X.SCANS[name]
    return f"""cells AS (SELECT (vec_id // {width})::INT AS ax, (vec_id % {width})::INT AS sag, (label < 5)::INT AS m, embedding FROM embeddings),
vox AS (SELECT ax, sag, m, (i - 1)::INT AS frame, floor((embedding[i]::DOUBLE + 1) * 100) AS value FROM cells, (SELECT unnest(generate_series(1, {frames}))::INT AS i))"""


#: Spacing that the study is resampled to; mm and overlap of its windows.
COMMON, WINDOW_MM, OVERLAP = (1.2171, 0.9337), (6.0, 6.0), (25.0, 25.0)


def _study_curves_sql(name: str) -> str:
    _, _, old, rate = X.SCANS[name]
    axis = lambda c, k, interp, to: _axis_sql(c, c, old[k], COMMON[k], interp).replace(f"to_{c} AS", f"{to}_{c} AS", 1)
    return f"""SELECT * FROM (WITH {_scan_sql(name)}, {axis("ax", 0, "linear", "v")}, {axis("sag", 1, "linear", "v")}, {axis("ax", 0, "nearest", "n")}, {axis("sag", 1, "nearest", "n")},
res AS (SELECT frame, v_ax.t_ax, v_sag.t_sag, sum(value * v_ax.w_ax * v_sag.w_sag) AS value FROM vox JOIN v_ax USING (ax) JOIN v_sag USING (sag) GROUP BY ALL),
roi AS (SELECT t_ax, t_sag FROM cells JOIN n_ax USING (ax) JOIN n_sag USING (sag) WHERE m > 0)
SELECT '{name}' AS scan_id, frame, frame * {rate}::DOUBLE AS time_s, round(avg(value), 6) + 0.0 AS tic FROM res JOIN roi USING (t_ax, t_sag) GROUP BY frame)"""


@query("study_curves", " UNION ALL ".join(map(_study_curves_sql, X.SCANS)))
def study_curves(spark, d):
    """Resampled to one spacing with their masks, then whole-region curves, of all scans at once."""
    s, mask = _study(spark, d)
    done, roi = study.resample(s, COMMON, "linear"), study.resample_masks(study.resample(s, COMMON), mask, COMMON)
    return done.timed(C.roi_curves(done.voxels, roi, 2, frames=done.frames())).select("scan_id", "frame", "time_s", number(F.col("value"), 6).alias("tic"))


def _study_windows_sql(name: str) -> str:
    a, s = (int(mm * (1 - o / 100) / r) for mm, o, r in zip(WINDOW_MM, OVERLAP, X.SCANS[name][2]))
    return f"""SELECT * FROM (WITH {_scan_sql(name)}, box AS (SELECT min(ax) AS a0, max(ax) AS a1, min(sag) AS s0, max(sag) AS s1 FROM cells WHERE m > 0),
starts AS (SELECT a::INT AS ax_start, s::INT AS sag_start FROM (SELECT unnest(range(a0, a1, {a})) AS a FROM box), (SELECT unnest(range(s0, s1, {s})) AS s FROM box)),
kept AS (SELECT ax_start, sag_start FROM starts JOIN cells ON ax >= ax_start AND ax < ax_start + {a} AND sag >= sag_start AND sag < sag_start + {s} GROUP BY ALL HAVING avg((m = 1)::INT) > 0.2),
win AS (SELECT (row_number() OVER (ORDER BY ax_start, sag_start) - 1)::INT AS window_ix, ax_start, sag_start FROM kept)
SELECT '{name}' AS scan_id, window_ix, frame, frame * {X.SCANS[name][3]}::DOUBLE AS time_s, round(avg(value), 6) + 0.0 AS tic FROM win JOIN vox ON ax BETWEEN ax_start AND ax_start + {a} AND sag BETWEEN sag_start AND sag_start + {s} GROUP BY ALL)"""


@query("study_windows", " UNION ALL ".join(map(_study_windows_sql, X.SCANS)))
def study_windows(spark, d):
    """Windows in mm, so in cells of each scan's own spacing."""
    s, mask = _study(spark, d)
    return s.timed(C.window_curves(s.voxels, mask, study.steps(s, WINDOW_MM, OVERLAP))).select("scan_id", "window_ix", "frame", "time_s", number(F.col("value"), 6).alias("tic"))


@query("frame_function", f"WITH {CINE2}, box AS (SELECT min(ax) AS a0, max(ax) AS a1, min(sag) AS s0, max(sag) AS s1 FROM cells WHERE m > 0), v AS (SELECT frame, max(value) FILTER (m = 1) - avg(value) FILTER (m <> 1) AS x, (max(value) FILTER (m = 1))::DOUBLE AS y FROM vox, box WHERE ax BETWEEN a0 AND a1 AND sag BETWEEN s0 AND s1 GROUP BY frame) SELECT frame, unnest(['Contrast', 'Top']) AS curve_name, round(unnest([x, y]), 6) + 0.0 AS value FROM v")
def frame_function(spark, d):
    """A curve type that a user wrote over arrays: its highest value inside against the mean around, of the cells that the image has."""
    cine = X.cine(spark, d, 2)

    def against(frame, mask, unit):
        around = frame[~mask & (frame == frame)]
        top = frame[mask].max() / unit
        return ["Contrast", "Top"], [top - around.mean() / unit if len(around) else None, top]

    kind = C.FrameFunction(against, ("Contrast", "Top"), {"unit": 1.0})
    found = C.roi_texture(cine, X.mask(spark, d, 2), 2, kind.curves, kind.names(), 0.5, cine.select("scan_id", "frame").distinct(), kind.around)
    return found.select("frame", "curve_name", number(F.col("value"), 6).alias("value"))


@query("array_frames", f"WITH {CINE3} SELECT frame, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM vox WHERE frame BETWEEN 10 AND 20 GROUP BY frame")
def array_frames(spark, d):
    """The cine written as a NIfTI array of slabs, and some of its frames read back: a range of bytes of it."""
    cine, (ax, sag, cor) = X.cine(spark, d, 3), X.shape(spark, d, 3)
    path = f"{scratch_folder(spark)}/cine"
    arrays.write_array(cine, path, ("sag", "cor", "ax", "frame"), (sag, cor, ax, 64), "nifti", "|u1", pixdim=(1.0, 1.0, 1.0), frame_step=0.5, slab_bytes=8 * sag * cor * ax)
    # Bytes have no missing value: the mask's table says which cells of the last row the image has.
    cells = X.mask(spark, d, 3).select("ax", "sag", "cor")
    found = arrays.read_array(spark, path).where("frame BETWEEN 10 AND 20").join(cells, ["ax", "sag", "cor"], "left_semi")
    return found.groupBy("frame").agg(number(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


# Parametric maps ---------------------------------------------------------------------------------


def _maps(spark, d):
    mask = X.mask(spark, d, 2)
    quants = quantify.first_order_full(C.window_curves(X.cine(spark, d, 2), mask, STEP_2D))
    return paramap.paramap(quants, mask, windows.window_grid(mask, STEP_2D), STEP_2D, ["Mean_full_TIC"]), mask


MAP = f"""{CINE2}, {BOX2}, {WINTIC2}, q AS (SELECT window_ix, avg(value) AS value FROM wintic GROUP BY window_ix),
map AS (SELECT ax, sag, avg(value) AS value FROM q JOIN win USING (window_ix) JOIN cells ON ax BETWEEN ax_start AND ax_end AND sag BETWEEN sag_start AND sag_end GROUP BY ax, sag)"""


@query("paramap_mean", f"WITH {MAP} SELECT ax, sag, round(value, 3) AS value FROM map")
def paramap_mean(spark, d):
    return _maps(spark, d)[0].select("ax", "sag", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("paramap_trim", f"WITH {MAP} SELECT ax, sag, round(CASE WHEN m > 0 THEN value END, 3) AS value FROM cells LEFT JOIN map USING (ax, sag)")
def paramap_trim(spark, d):
    maps, mask = _maps(spark, d)
    return paramap.trim(maps, mask, 2, ["Mean_full_TIC"]).select("ax", "sag", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("paramap_color_index", f"WITH {MAP}, f AS (SELECT ax, sag, value::FLOAT::DOUBLE AS value FROM map), e AS (SELECT min(value) AS low, max(value) AS high FROM f) SELECT ax, sag, CASE WHEN high > low THEN least(greatest(trunc(255.0::DOUBLE / (high - low) * (value - low)), 0), 255)::INT END AS index FROM f, e")
def paramap_color_index(spark, d):
    return paramap.color_index(_maps(spark, d)[0]).select("ax", "sag", "index")


@query("paramap_range", f"WITH {MAP} SELECT 'Mean_full_TIC' AS param, round(min(value), 3) AS low, round(max(value), 3) AS high FROM map")
def paramap_range(spark, d):
    return tables.value_range(_maps(spark, d)[0]).select("param", F.round(F.col("low").cast("double"), 3).alias("low"), F.round(F.col("high").cast("double"), 3).alias("high"))
