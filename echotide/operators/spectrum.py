"""Power spectra of sampled lines, Hann-tapered: fast transforms of batches of lines, summed by scan."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines transformed at a time.
LINES = 64


def power_spectrum(lines: DataFrame, f0: float, f1: float, fs: float, n_fft: int = 8192) -> DataFrame:
    """(scan_id, bin, frequency, power): mean over lines of |transform * size|^2, for bins from f0 to f1.

    lines: scan_id, line, sample (from 0), value. The taper is scaled to a unit root mean square;
    frequencies run from 0 to fs, both ends in, over n_fft bins. Samples beyond n_fft aren't
    transformed. Rows follow the samples, then the scans' bins.
    """
    low, high = round(f0 * n_fft / fs), round(f1 * n_fft / fs)
    if not 0 <= low < high <= n_fft:
        raise ValueError("frequencies must satisfy 0 <= f0 < f1 <= fs")
    line = Window.partitionBy("scan_id", "line")
    size = F.count("*").over(line)
    taper = lines.withColumn("size", size).withColumn("w", F.when(F.col("size") > 1, 0.5 - 0.5 * F.cos(2 * math.pi * F.col("sample") / (F.col("size") - 1))).otherwise(1.0))
    taper = taper.withColumn("x", F.col("value") * F.col("w") / F.sqrt(F.avg(F.col("w") * F.col("w")).over(line))).where(F.col("sample") < n_fft)
    # A line has n_fft samples at most; it is one row, and a batch of lines one transform.
    packed = taper.where("x is not null").groupBy("scan_id", "line").agg(F.first("size").alias("size"), F.collect_list(F.struct(F.col("sample").cast("int").alias("sample"), "x")).alias("points"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, LINES):
                b = whole.slice(at, LINES)
                points, scans, codes = b.column("points"), *np.unique(np.array(b.column("scan_id").to_pylist(), object), return_inverse=True)
                flat, sizes = points.flatten(), b.column("size").to_numpy().astype(float)
                grid = np.zeros((b.num_rows, n_fft))
                line = np.repeat(np.arange(b.num_rows), np.diff(points.offsets.to_numpy()))
                np.add.at(grid, (line, flat.field("sample").to_numpy()), flat.field("x").to_numpy())
                power = np.abs(np.fft.fft(grid)[:, np.arange(low, high) % n_fft]) ** 2 * sizes[:, None] ** 2
                total = np.zeros((len(scans), high - low))
                np.add.at(total, codes, power)
                count = np.bincount(codes, minlength=len(scans))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(scans, high - low), pa.string()), pa.array(np.tile(np.arange(low, high), len(scans)), pa.int32()), pa.array(total.ravel()), pa.array(np.repeat(count, high - low))], names=["scan_id", "bin", "total", "lines"])

    sums = packed.mapInArrow(transform, "scan_id string, bin int, total double, lines long")
    return sums.groupBy("scan_id", "bin").agg((F.sum("total") / F.sum("lines")).alias("power")).withColumn("frequency", F.col("bin") * fs / (n_fft - 1))
