"""Quality scores from random Fourier features.

Statistics of a document (shares of kinds of characters, word and line lengths, repeats) are
standardised and mapped to random cosines, whose products approximate a Gaussian
kernel. Every partition sums its part of the normal equations; Spark adds the cells up, and
a ridge solution follows from one matrix whose size does not grow with the data. Scores of
another fold, in bins, are calibrated by isotonic regression.

Cases: null counts as empty, whose statistics are zeros; without labelled rows of both classes in
both folds every score is 0.5; labels that are null are left out; rows with null or
repeated doc_id are scored like others; an empty table gives an empty result; other
columns are ignored; texts are read whole, whatever their length.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, batch, materialize, table, text_of
from .toxicity import fold

STATISTICS, COSINES, RIDGE, BINS, THRESHOLD = 14, 128, 1e-3, 1024, 0.5
_KINDS = np.full(256, 7, np.int64)  # other ASCII
_KINDS[ord("a") : ord("z") + 1] = 0
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
_KINDS[[9, 32]] = 3
_KINDS[[10, 13]] = 4
_KINDS[[ord(c) for c in ".,;:'\"-"]] = 5
_KINDS[[ord(c) for c in "!?"]] = 6
_KINDS[128:] = 0  # letters beyond ASCII


def statistics(text: str) -> list[float]:
    """STATISTICS numbers, zeros for an empty text."""
    raw = text.encode()
    if not raw:
        return [0.0] * STATISTICS
    n = len(raw)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words, lines = text.split(), text.splitlines()
    distinct = len(set(words)) / max(1, len(words))
    same = 1 - len(set(lines)) / max(1, len(lines))
    mean = sum(map(len, words)) / max(1, len(words))
    return [*kinds.tolist(), np.log1p(n), np.log1p(len(words)), distinct, same, min(mean, 40.0), np.log1p(len(words) / max(1, len(lines)))]


def stats_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of doc_id and statistics: text is read once, for training and scoring."""
    schema = pa.schema([("doc_id", pa.int64()), ("s", pa.list_(pa.float64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches):
            yield batch(schema, b.column("doc_id"), [statistics(t or "") for t in b.column("text").to_pylist()])

    return materialize(arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), rows, "doc_id long, s array<double>"), "statistics")


@functools.lru_cache(maxsize=1)
def _directions() -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of the cosines: fixed, so that they need no place in a model."""
    rng = np.random.default_rng(20_240)
    return rng.standard_normal((STATISTICS, COSINES)) / np.sqrt(STATISTICS), rng.uniform(0, 2 * np.pi, COSINES)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(COSINES + 1))
    at: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    value: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def cosines(self, s: np.ndarray) -> np.ndarray:
        w, phase = _directions()
        z = np.clip((s.reshape(-1, STATISTICS) - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ w + phase) * np.sqrt(2 / COSINES), np.ones(len(z))])

    def raw(self, s: np.ndarray) -> np.ndarray:
        return self.cosines(s) @ self.weights

    def score(self, s: np.ndarray) -> np.ndarray:
        """Rounded, so that a pool of half ones scores 0.5 whatever the order in which partitions were summed."""
        return np.round(np.interp(self.raw(s), self.at, self.value), 9)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums over partitions, cell by cell, of products of features (upper triangle) and with y."""
    d = COSINES + 1
    upper = np.triu_indices(d)
    schema = pa.schema([("cell", pa.int32()), ("value", pa.float64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, seen = np.zeros((d, d)), np.zeros(d), False
        for part in batches:
            x = model.cosines(np.array(part.column("s").to_pylist(), float))
            a += x.T @ x
            b += x.T @ part.column("y").to_numpy(zero_copy_only=False)
            seen = True
        if seen:
            values = np.concatenate([a[upper], b])
            yield batch(schema, np.arange(len(values), dtype=np.int32), values)

    cells = arrow_map(rows.select("s", "y"), sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")["value"].to_numpy()
    a = np.zeros((d, d))
    a[upper] = cells[:-d]
    return a + np.triu(a, 1).T, cells[-d:]


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit to means at ascending x, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for at, m, w in zip(x, mean, weight):
        pools.append([m, w, at, at])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m2 * w2) / (p[1] + w2), p[1] + w2, last
    return np.array([v for p in pools for v in p[2:]]), np.array([p[0] for p in pools for _ in "ab"])


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model | None:
    """A model from the rows that aren't held out; None without both classes in both folds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"), fold().alias("fold")).where("y in (0, 1) and fold <> 1")
    rows = stats.join(known, "doc_id")
    counts = rows.groupBy("fold").agg(F.sum("y").alias("ones"), F.count("*").alias("n"), *(f(F.col("s")[i]).alias(f"{k}{i}") for i in range(STATISTICS) for k, f in (("m", F.avg), ("d", F.stddev_pop)))).collect()
    by = {r["fold"]: r for r in counts}
    if any(f not in by or not 0 < by[f]["ones"] < by[f]["n"] for f in (0, 2)):
        return None
    model = Model(np.array([by[0][f"m{i}"] for i in range(STATISTICS)]), np.array([by[0][f"d{i}"] for i in range(STATISTICS)]) + 1e-6)
    a, b = normal_equations(rows.where("fold = 0"), model)
    model.weights = np.linalg.solve(a + RIDGE * by[0]["n"] * np.eye(len(b)) / COSINES, b)
    schema = pa.schema([("bin", pa.int32()), ("raw", pa.float64()), ("y", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw = model.raw(np.array(part.column("s").to_pylist(), float))
            yield batch(schema, (np.clip((raw + 0.5) / 2, 0, 1) * (BINS - 1)).astype(np.int32), raw, part.column("y"))

    # At most BINS rows.
    bins = arrow_map(rows.where("fold = 2").select("s", "y"), scored, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    model.at, model.value = isotonic(bins["raw"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))
    return model


def train_on(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """As train, from texts: only statistics of the labelled rows are computed and kept."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where((fold() != 1) & F.col(label_col).isin(0, 1)).distinct()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return train(stats_table(own.join(known, "doc_id", "left_semi")), labels, label_col)


def classify(stats: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of statistics."""
    if model is None:
        scored = stats.select("doc_id", F.lit(0.5).alias("score"))
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield batch(schema, b.column("doc_id"), model.score(np.array(b.column("s").to_pylist(), float)))

        scored = arrow_map(stats, rows, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores at least the threshold, all columns kept; all rows without a model."""
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def good(texts):
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts]).reshape(-1, STATISTICS)) >= threshold)

    return docs.where(good(text_of(text_col)))


def op8(spark, sf_dir: str) -> DataFrame:
    stats = stats_table(table(spark, sf_dir, "documents"))
    return classify(stats, train(stats, table(spark, sf_dir, "labels")))
