"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary text and on what sets toxic text
apart. Each window of a document is compressed with either; the byte by which the toxic
dictionary wins, over all windows, give a few statistics, which a logistic
function calibrated on labelled rows turns into a score.

The toxic dictionary is trained on words of toxic texts that a comparison of the two classes
selects, not on these texts as they are: toxic words are so few in them that dictionaries of whole
texts find hardly any (README has the figures of both). The ordinary dictionary stands behind it, so that ordinary
words cost the same with either.

Training sees a bounded sample of labelled rows; the bounds are parameters of `train`: per_class rows of each class
(lowest hash first), and of these at most so many word beginnings (units), words and pieces of text. Dictionaries come
from one fold, the calibration from another, weighted to the shares of the classes. Scoring covers all
windows of all texts.

Cases: null counts as empty; an empty text is one empty window; without labelled rows of
both classes every score is 0.5; labels that are null are left out; rows with null or
repeated doc_id are scored like others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, batch, table, text_of

#: Defaults of the bounds on what training sees.
PER_CLASS, UNITS, WORDS, PIECES = 10_000, 512, 4096, 20_000
DRAWS = 4000
WINDOW_WORDS, PIECE_BYTES, UNIT_LETTERS = 8, 160, (4, 5, 6, 7, 8)
ORDINARY_BYTES, TOXIC_BYTES = 6144, 1024
#: A word beginning sets toxic text apart where it is in this share of toxic rows, so many times more often than in
#: others, and the rows times the logarithm of that are enough to rule out chance.
MIN_SHARE, MIN_ODDS, MIN_EVIDENCE = 0.02, 8.0, 20.0
THRESHOLD = 0.7
FEATURES = 13


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; fold 1 is held out. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(1)).cast("int")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([(features - self.mean) / self.scale, np.ones(len(features))]) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Distance:
    """Compressors with either dictionary."""

    def __init__(self, model: Model):
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=13, chain_log=13, search_log=5, target_length=8, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.pair = []
        for raw in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.pair.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))

    def features(self, text: str) -> list[float]:
        words = text.split()
        windows = [" ".join(words[i : i + WINDOW_WORDS]).encode() for i in range(0, len(words), WINDOW_WORDS)] or [b""]
        plain, toxic = (c.compress for c in self.pair)
        won = np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows), np.float64, len(windows))
        top = np.sort(won)[::-1]
        over = [float((won >= k).sum()) for k in (3, 4, 5, 6)]
        return [top[0], top[:2].mean(), top[:3].mean(), won.mean(), *over, over[1] / len(won), *np.log1p(over)]


def features(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the statistics of each text, and extra integer columns."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.float64())), *((c, pa.int32()) for c in extra)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _Distance(model)
        for b in tokens.slices(batches):
            yield batch(schema, b.column("doc_id"), [distance.features(t or "") for t in b.column("text").to_pylist()], *(b.column(c) for c in extra))

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *extra), rows, "doc_id long, f array<double>" + "".join(f", {c} int" for c in extra))


def _starts(words: Column) -> Column:
    """The distinct beginnings of words, of each length in UNIT_LETTERS."""
    cut = [F.transform(words, (lambda n: lambda w: F.substring(w, 1, n))(n)) for n in UNIT_LETTERS]
    return F.array_distinct(F.flatten(F.array(*cut)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Weighted logistic regression by Newton steps: means, scales, weights."""
    mean = np.average(x, 0, w)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, w)) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge), a.T @ (w * (p - y)) + ridge * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return mean.tolist(), scale.tolist(), beta.tolist()


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, n_units: int = UNITS, n_words: int = WORDS, n_pieces: int = PIECES) -> Model | None:
    """A model from the rows that aren't held out; None without both classes in both folds.

    It learns from at most per_class labelled rows of each class; the dictionaries from at most n_units beginnings of
    words (most evidence first) and n_words words (most frequent first) of the toxic ones, and n_pieces pieces of
    PIECE_BYTES characters (lowest hash first) of the others.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"), fold().alias("fold")).where("y in (0, 1) and fold <> 1")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "fold").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class rows.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").persist()
    try:
        sizes = {(r["y"], r["fold"]): r["n"] for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
        if any((y, f) not in sizes for y in (0, 1) for f in (0, 2)):
            return None
        first = rows.where("fold = 0")
        words = first.select("y", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{4,})"))).alias("words"))
        counts = words.select("y", F.explode(_starts(F.col("words"))).alias("unit")).groupBy("unit").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("plain"))
        n1, n0 = sizes[1, 0], sizes[0, 0]
        odds = (F.col("toxic") / n1) / ((F.col("plain") + 0.5) / n0)
        units = counts.where((F.col("toxic") >= max(3, MIN_SHARE * n1)) & (odds >= MIN_ODDS)).withColumn("evidence", F.col("toxic") * F.log(odds)).where(F.col("evidence") >= MIN_EVIDENCE).orderBy(F.desc("evidence"), "unit").limit(n_units)
        found = words.where("y = 1").select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).withColumn("unit", F.explode(_starts(F.array("word")))).join(F.broadcast(units), "unit").groupBy("word").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "word").limit(n_words).collect()
        pieces = first.where("y = 0").select(F.explode(F.expr(f"transform(sequence(0, length(text) div {PIECE_BYTES}), i -> substring(text, i * {PIECE_BYTES} + 1, {PIECE_BYTES}))")).alias("piece")).orderBy(F.xxhash64("piece"), "piece").limit(n_pieces)
        plain = [p.encode() for (p,) in pieces.collect() if p] or [b" "]
        model = Model(*_dictionaries(plain, [(r["word"].encode(), r["n"]) for r in found]), [], [], [])
        second = features(rows.where("fold = 2"), model, extra=("y",)).select("f", "y").collect()
        y = np.array([r["y"] for r in second], float)
        weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
        model.mean, model.scale, model.weights = _logistic(np.array([r["f"] for r in second]), y, weight / weight.mean())
        return model
    finally:
        rows.unpersist()


def _dictionaries(plain: list[bytes], words: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """Contents of both dictionaries: what is trained on ordinary text, and that behind what is trained on toxic words.

    Ordinary words so cost the same with either.
    """
    # Words stand next to others in every order, as often as they occur.
    total = sum(n for _, n in words) or 1
    pool = [w for w, n in words for _ in range(max(2, n * DRAWS // total))]
    np.random.default_rng(0).shuffle(pool)
    repeats = [b" " + b" ".join(pool[i : i + 4]) + b" " for i in range(0, len(pool), 4)]
    base = _trained(plain, ORDINARY_BYTES, 32, 6)
    return base, (_trained(repeats, TOXIC_BYTES, 32, 8) if repeats else b"") + base


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each text."""
    if model is None:
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"))
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = np.array(b.column("f").to_pylist(), float).reshape(-1, FEATURES)
                yield batch(schema, b.column("doc_id"), model.score(f))

        scored = arrow_map(features(docs, model), rows, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, train(docs, labels))
