"""Packing by concatenating and cutting.

All documents form one stream of ids. A first pass encodes them where they are
read and writes, per document, its ids and its place in its partition; the sums
of the partitions, added up in order, give each partition's place in the stream
(one row per partition). A second pass cuts the stream at multiples of the window: a
document that crosses a cut leaves a piece on either side, each a boundary record.
No row of ids is shuffled, and only the last sequence can have padding.

Cases: a null or empty text is its end id alone; rows with a null or repeated
doc_id are packed like others; an empty table gives no pieces; a document longer
than the window fills several sequences; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import arrow_map, batch, materialize, table, text_of

WINDOW = 2048
_DOCS = "doc_id long, part int, start_in_part long, n_tokens long, width int, ids binary"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECES_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID) -> DataFrame:
    """First pass: a table with the ids of each document and its place in its partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b, ids, ends in tokens.encoded(batches, path, end_id):
            starts, n = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32) * np.int32(ids.itemsize)), pa.py_buffer(ids)])
            yield batch(_DOCS_ARROW, b.column("doc_id"), np.full(len(n), part, np.int32), at + starts, n, np.full(len(n), ids.itemsize, np.int32), raw)
            at += int(ends[-1])

    return materialize(arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), rows, _DOCS), "packing")


def pack(encoded: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Second pass: the pieces of all documents; with_ids adds their ids, as in `encoded`."""
    sums = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                out = []
                for doc, start, width, raw in zip(*(b.column(c).slice(at, 1000).to_pylist() for c in ("doc_id", "start", "width", "ids"))):
                    ids = np.frombuffer(raw, f"<u{width}")
                    cut = 0
                    while cut < len(ids):
                        seq, offset = divmod(start + cut, window)
                        piece = ids[cut : cut + window - offset]
                        out.append((doc, cut, len(piece), tokens.crc32_of(piece), len(ids), seq, offset, piece.tobytes() if with_ids else None))
                        cut += len(piece)
                yield batch(_PIECES_ARROW, *zip(*out))

    # One row per partition of the first pass: a bound that the scan sets, not the data's size.
    placed = encoded.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "width", "ids")
    pieces = arrow_map(placed, rows, _PIECES)
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame, window: int = WINDOW, width: int = 2, pad_id: int = 0) -> DataFrame:
    """One row per sequence from pieces with ids: its ids, padded to the window unless their number is a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    pad = F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, F.lit(0)).otherwise(F.lit(window) - F.col("n_tokens"))
    filler = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(width, 'little').hex()}', cast(padding as int))"))
    joined = F.aggregate("parts", F.unhex(F.lit("")), lambda done, p: F.concat(done, p["ids"]))
    return rows.withColumn("padding", pad).select("sequence_id", "n_tokens", "padding", F.concat(joined, filler).alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset"))).alias("boundaries"))


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
