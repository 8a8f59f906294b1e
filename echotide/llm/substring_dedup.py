"""Substring dedup by content-defined chunks.

A gear hash of the last 32 bytes cuts texts where its top bits are zero, on average
every 32 bytes; a chunk above 1,024 bytes, as in text that repeats itself, is cut where fewer bits
are. Cuts depend on nothing but these bytes, so an insertion
moves no cut beyond its own chunk. A chunk whose digest occurs in several rows is a repeat;
neighbouring repeats make a span, and spans of MIN_BYTES or more are reported, which
chance repeats of short chunks do not reach. Of each chunk the occurrence in the smallest
(doc_id, row, start) stays: a span is divided where its chunks begin or cease to be the ones that stay.

Chunks are counted with map-side sums before they meet by digest, so a passage in a
third of all rows is one row per task there. Chunks of the HEAVY most frequent digests, which a sketch of bounded size
names and an exact count verifies, are told their group where they are read; those of other digests
meet it in a shuffle, where none holds more than about 1/HEAVY of all chunks.

Digests have 64 bits. Two unlike chunks of one digest are expected among some 10^10 different ones; such a chance repeat is
one chunk, and is only reported where its true neighbours repeat too, so that the span reaches MIN_BYTES.

Cases: null counts as empty; an empty text has no chunks; equal
rows and rows with equal or null doc_id are told apart, and repeat one another; an empty table
gives an empty result; other columns are ignored; texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import arrow_map, batch, frequent, materialize, table, text_of

REACH, ZERO_BITS, MIN_BYTES, MAX_BYTES = 32, 5, 96, 1024
#: Most digests that are broadcast, and counters in the sketch that names them.
HEAVY, TRACKED = 1024, 16384
_GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint32)
_CHUNKS = "row long, doc_id long, start long, length int, digest long"
_CHUNKS_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("digest", pa.int64())])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear(byte k back) << k over REACH bytes; what lies before the data counts as nothing.

    Sums over 1, 2, 4, ... bytes follow from one another.
    """
    h = _GEAR[data]
    width = 1
    while width < REACH:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text."""
    gap = bytes(REACH)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    hashes = gear_hashes(data)
    cuts = np.flatnonzero(hashes >> np.uint32(32 - ZERO_BITS) == 0) + 1
    sizes = np.array(list(map(len, texts)), np.int64)
    first = np.cumsum(sizes + REACH) - sizes - REACH
    low, high = np.searchsorted(cuts, first, "right"), np.searchsorted(cuts, first + sizes, "left")
    ends = [[*(cuts[a:z] - f).tolist(), n] if n else [] for a, z, f, n in zip(low.tolist(), high.tolist(), first.tolist(), sizes.tolist())]
    return [_shortened(x, hashes[f : f + n]) for x, f, n in zip(ends, first.tolist(), sizes.tolist())]


def _shortened(ends: list[int], hashes: np.ndarray) -> list[int]:
    """Chunks above MAX_BYTES cut where fewer top bits are zero, as few fewer as it takes: text that repeats itself has no other cuts."""
    if not ends or max(np.diff(ends, prepend=0)) <= MAX_BYTES:
        return ends
    out, start = [], 0
    for end in ends:
        inner: list[int] = []
        for bits in range(ZERO_BITS - 1, -1, -1) if end - start > MAX_BYTES else ():
            inner = (np.flatnonzero(hashes[start : end - 1] >> np.uint32(32 - bits) == 0 if bits else np.ones(end - start - 1, bool)) + start + 1).tolist()
            if max(np.diff([start, *inner, end])) <= MAX_BYTES:
                break
        out += [*inner, end]
        start = end
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of the chunks of all texts, with places in bytes of UTF-8."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            ends = chunk_ends(texts)
            n = np.array(list(map(len, ends)), np.int64)
            stop = np.array([e for x in ends for e in x], np.int64)
            start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
            firsts = (np.cumsum(n) - n)[n > 0]
            start[firsts] = 0
            digest = np.fromiter((xxhash.xxh3_64_intdigest(t[a:z]) for t, x in zip(texts, ends) for a, z in zip([0, *x], x)), np.uint64, len(stop)).view(np.int64)
            take = pa.array(np.repeat(np.arange(len(texts)), n))
            yield batch(_CHUNKS_ARROW, b.column("row").take(take), b.column("doc_id").take(take), start, (stop - start).astype(np.int32), digest)

    return materialize(arrow_map(source, rows, _CHUNKS), "chunks")


def _shared(chunked: DataFrame) -> DataFrame:
    """Digests that occur in several rows: n, and the occurrence that stays."""
    # A null doc_id ranks last.
    ident = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    groups = chunked.groupBy("digest").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n"), F.min(F.struct(ident.alias("doc_id"), "row", "start")).alias("first"))
    return groups.where("low <> high").select("digest", "n", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start"))


def _repeated(chunked: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """The chunks that occur in several rows, with their digest's n and first occurrence."""
    # At most `heavy` rows each.
    named = F.broadcast(materialize(frequent(chunked, "digest", heavy, tracked), "frequent-chunks"))
    settled = F.broadcast(materialize(_shared(chunked.join(named, "digest", "left_semi")), "frequent-chunks"))
    # Only what places a chunk is dealt by digest; doc_ids of rows are looked up for the spans.
    places = chunked.select("digest", "row", "start", "length")
    rest = places.join(named, "digest", "left_anti").join(_shared(chunked.join(named, "digest", "left_anti")), "digest")
    return places.join(settled, "digest").unionByName(rest)


def repeats(chunked: DataFrame, min_bytes: int = MIN_BYTES, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Spans of text that occur in several rows: doc_id, row, start, end, n_chunks, n_rows, first_doc_id, kept.

    n_rows is the most occurrences that one of its chunks has; kept says whether its chunks are
    the occurrences that stay. Neighbouring spans count together for min_bytes.
    """
    found = _repeated(chunked, heavy, tracked)
    found = found.withColumn("kept", (F.col("first_row") == F.col("row")) & (F.col("first_start") == F.col("start")))
    order = Window.partitionBy("row").orderBy("start")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(-1)) != F.col("start")
    turned = apart | (F.lag("kept").over(order) != F.col("kept"))
    found = found.withColumn("apart", apart.cast("int")).withColumn("turned", turned.cast("int")).withColumn("union", F.sum("apart").over(running)).withColumn("island", F.sum("turned").over(running))
    spans = found.groupBy("row", "union", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("n_chunks"), F.max("n").alias("n_rows"), F.min("first_doc_id").alias("first_doc_id"), F.first("kept").alias("kept"))
    whole = Window.partitionBy("row", "union")
    spans = spans.withColumn("bytes", F.sum(F.col("end") - F.col("start")).over(whole)).where(F.col("bytes") >= min_bytes)
    spans = spans.join(chunked.where("start = 0").select("row", "doc_id"), "row").withColumn("first_doc_id", F.when(F.col("first_doc_id") < (1 << 63) - 1, F.col("first_doc_id")))
    return spans.drop("union", "island", "bytes")


def op10(spark, sf_dir: str) -> DataFrame:
    return repeats(chunks(table(spark, sf_dir, "documents"))).select("doc_id", "start", "end", "n_chunks", "n_rows", "first_doc_id", "kept")
