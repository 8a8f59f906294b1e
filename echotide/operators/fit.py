"""Log-normal bolus fits: bounded least squares for many curves at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotide.operators.curves import pack
from echotide.operators.quantify import long, matching, select_times
from echotide.schema import CURVE_KEY

#: Names of the results, in the order of the keys.
NAMES = ["AUC", "PE", "TP", "MTT", "T0", "Mu", "Sigma", "PE_Ix"]
MAX_STEPS, TRIAL_STEPS, RESTART = 400, 12, 1e-4
#: Frames, padding included, that are fitted at a time.
CELLS = 1 << 16


def _parts(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of times t (frames x curves) and parameters p (curves x auc, mu, sigma, t0): where time is after t0, time since then (1 elsewhere), how far its logarithm is from mu, and the model's divisor and exponential."""
    _, mu, sigma, t0 = p.T
    s = t - t0
    ok = s > 0
    s = np.where(ok, s, 1.0)
    z = np.log(s) - mu
    return ok, s, z, s * sigma * np.sqrt(2 * np.pi), np.exp(-(z**2) / (2 * sigma**2))


def _scaled(area: np.ndarray | float, ok: np.ndarray, divisor: np.ndarray, power: np.ndarray) -> np.ndarray:
    y = area / divisor * power
    return np.where(ok & np.isfinite(y), y, 0.0)


def model(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Values at t (curves x frames) of parameters (curves x auc, mu, sigma, t0); 0 where not finite."""
    ok, _, _, divisor, power = _parts(t.T, p)
    return _scaled(p[:, 0], ok, divisor, power).T


def _squares(r: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((r**2).T).sum(1)


def _products(ok: np.ndarray, s: np.ndarray, z: np.ndarray, divisor: np.ndarray, power: np.ndarray, r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over frames of derivatives times the residual (curves x 4) and times each other (curves x 4 x 4)."""
    if len(p) == 1:  # a curve alone would be summed in another order than among others
        return tuple(x[:1] for x in _products(*(np.repeat(x, 2, 1) for x in (ok, s, z, divisor, power, r)), np.repeat(p, 2, 0)))
    auc, _, sigma, _ = p.T
    unit = _scaled(1.0, ok, divisor, power)
    y = unit * auc
    j = [unit, y * z / sigma**2, y * (z**2 / sigma**3 - 1 / sigma), y * (1 / s + z / (sigma**2 * s))]
    g, h = np.empty((len(p), 4)), np.empty((len(p), 4, 4))
    for a in range(4):
        g[:, a] = np.einsum("nb,nb->b", j[a], r)
        for b in range(a, 4):
            h[:, a, b] = h[:, b, a] = np.einsum("nb,nb->b", j[a], j[b])
    return g, h


def _descend(t: np.ndarray, y: np.ndarray, p: np.ndarray, floor: np.ndarray, ceil: np.ndarray, steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and losses after damped least-squares steps from p within the bounds. Padding is 0 in t and y, which adds nothing as t0 isn't negative.

    The model is computed once a step, derivatives only where a step was taken; a curve leaves the arrays when its descent ends. Frames come first,
    so that sums over them run over many curves at a time.
    """
    t, y, p = np.ascontiguousarray(t.T), np.ascontiguousarray(y.T), np.clip(p, floor, ceil)
    out, losses, live = p.copy(), np.empty(len(p)), np.arange(len(p))
    parts = _parts(t, p)
    r = _scaled(p[:, 0], parts[0], *parts[3:]) - y
    loss, damp = _squares(r), np.full(len(p), 1e-3)
    slope, curvature = _products(*parts, r, p)
    for _ in range(steps):
        if not len(live):
            break
        # A parameter at a bound that the descent would push it through stays out of the step.
        held = (p <= floor) & (slope > 0) | (p >= ceil) & (slope < 0)
        h = np.where(held[:, :, None] | held[:, None, :], 0.0, curvature)
        diagonal = np.einsum("bii->bi", h)
        diagonal += damp[:, None] * np.maximum(diagonal, 1e-12) + np.where(held, 1.0, 1e-12)
        new = np.clip(p - np.linalg.solve(h, np.where(held, 0.0, slope)[:, :, None])[:, :, 0], floor, ceil)
        parts = _parts(t, new)
        r = _scaled(new[:, 0], parts[0], *parts[3:]) - y
        newer = _squares(r)
        better = newer < loss
        moved = np.abs(new - p).max(1) > 1e-10 * (1 + np.abs(p).max(1))
        stay = np.where(better, moved & (loss - newer > 1e-10 * (1e-30 + loss)), damp < 1e10)
        p[better] = new[better]
        loss = np.where(better, newer, loss)
        damp = np.where(better, np.maximum(damp / 5, 1e-12), damp * 4)
        k = np.flatnonzero(better & stay)
        if len(k):
            slope[k], curvature[k] = _products(*(np.take(x, k, 1) for x in (*parts, r)), p[k])
        if not stay.all():
            ended = live[~stay]
            out[ended], losses[ended] = p[~stay], loss[~stay]
            live, p, ceil, loss, damp, slope, curvature = (x[stay] for x in (live, p, ceil, loss, damp, slope, curvature))
            t, y = np.compress(stay, t, 1), np.compress(stay, y, 1)
    out[live], losses[live] = p, loss
    return out, losses


def fit(t: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Results (curves x NAMES) for curves of n frames each, padded on the right. NaN where a fit isn't possible.

    Values are shifted to a minimum of 0 and scaled to a maximum of 1. Bounds: auc and mu from 0, sigma 0.01 to 5,
    t0 from 0 to the last time. A peak in the first frame leaves no start value for mu, so such a fit fails.
    Where the one start leaves more than RESTART of a curve's energy, a few steps are tried from further starts that
    put the mode at the peak, from onsets between 0 and the curve's first rise, and the best of these is followed to
    its end; the lesser loss counts.
    """
    inside = np.arange(t.shape[1]) < n[:, None]
    out = np.full((len(t), len(NAMES)), np.nan)
    low = np.where(inside, y, np.inf).min(1, initial=np.inf)
    shifted = np.where(inside, y - np.where(np.isfinite(low), low, 0)[:, None], 0.0)
    high = shifted.max(1, initial=0.0)
    peak = np.where(inside, shifted, -1.0).argmax(1)
    good = np.flatnonzero((n > 1) & np.isfinite(high) & (high > 0) & (peak > 0) & ~np.isnan(np.where(inside, y, 0)).any(1))
    if not len(good):
        return out
    inside, n, peak = inside[good], n[good], peak[good]
    t = np.where(inside, t[good], 0.0)
    y = shifted[good] / high[good][:, None]
    each = np.arange(len(t))
    last, top, apart = t[each, n - 1], t[each, peak], t[:, 1] - t[:, 0]
    floor = np.array([0.0, 0.0, 0.01, 0.0])
    ceil = np.column_stack([np.full(len(t), np.inf), np.full(len(t), np.inf), np.full(len(t), 5.0), last])
    area = y.sum(1) * apart
    p, loss = _descend(t, y, np.column_stack([area, np.log(peak), np.full(len(t), 0.5), 0.15 * top]), floor, ceil)
    energy = (y**2).sum(1)
    rise = t[each, np.maximum((y > 0.01).argmax(1) - 1, 0)]
    again = np.flatnonzero(loss > RESTART * energy)
    best, least = p[again], np.full(len(again), np.inf)
    for onset in (0.0, 0.5, 0.9, 1.0):
        for sigma in (0.25, 0.7):
            t0 = onset * rise[again]
            start = np.column_stack([area[again], np.log(np.maximum(top[again] - t0, 0.1 * apart[again])) + sigma**2, np.full(len(again), sigma), t0])
            new, newer = _descend(t[again], y[again], start, floor, ceil[again], TRIAL_STEPS)
            better = newer < least
            best[better], least[better] = new[better], newer[better]
    if len(again):
        best, least = _descend(t[again], y[again], best, floor, ceil[again])
        better = least < loss[again]
        p[again[better]] = best[better]
    auc, mu, sigma, t0 = p.T
    fitted = np.where(inside, model(t, p), -1.0)
    out[good] = np.column_stack([auc, fitted.max(1), np.exp(mu - sigma**2), np.exp(mu + sigma**2 / 2), np.maximum(t0, 0), mu, sigma, fitted.argmax(1)])
    return out


def fit_curves(curves: DataFrame) -> DataFrame:
    """One row per curve with the results of its fit; T0 is 0 where the fit failed, the others NaN."""
    packed = pack(curves).select(*CURVE_KEY, F.transform("points", lambda q: q["time_s"]).alias("t"), F.transform("points", lambda q: q["value"].cast("double")).alias("y"))
    # Dealt by a stated number: a fit takes far longer than its few bytes suggest, so small partitions must not be merged.
    packed = packed.repartition(int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions")), *CURVE_KEY)
    kinds = dict(packed.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column("t")).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < whole.num_rows:  # as many curves as fill CELLS with the longest of them, at least one
                widest = np.maximum.accumulate(sizes[at:])
                count = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, "right")))
                part, n = whole.slice(at, count), sizes[at : at + count]
                inside = np.arange(max(2, n.max())) < n[:, None]
                t, y = np.zeros(inside.shape), np.zeros(inside.shape)
                t[inside] = pc.list_flatten(part.column("t")).to_numpy(zero_copy_only=False)
                y[inside] = pc.list_flatten(part.column("y")).to_numpy(zero_copy_only=False)
                found = fit(t, y, n)
                found[np.isnan(found[:, NAMES.index("T0")]), NAMES.index("T0")] = 0.0
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in CURVE_KEY), *(pa.array(x) for x in found.T)], names=[*CURVE_KEY, *NAMES])
                at += count

    return packed.mapInArrow(rows, ", ".join([*(f"{c} {kinds[c]}" for c in CURVE_KEY), *(f"{n} double" for n in NAMES)]))


def lognormal_fit_full(curves: DataFrame, curves_to_fit: Sequence[str] = ("TIC",)) -> DataFrame:
    return long(fit_curves(matching(curves, curves_to_fit)), NAMES, F.concat("stat", F.lit("_full_"), "curve_name"))


def lognormal_fit_select(curves: DataFrame, curves_to_fit: Sequence[str] = ("TIC",), start: float = 0.0, end: float | None = None) -> DataFrame:
    """PE_Ix counts from the first selected frame."""
    return long(fit_curves(select_times(matching(curves, curves_to_fit), start, end)), NAMES, F.concat("stat", F.lit("_select_"), "curve_name"))
