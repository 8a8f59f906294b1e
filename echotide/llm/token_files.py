"""Token-id files: encode, write as range-coded blocks, read back.

Documents are dealt by ranges of (doc_id, row) and sorted, so each partition writes one
shard of consecutive documents, also where many rows share a doc_id. A shard is a series of frames (see range_coder),
each of at most BLOCK_IDS ids, with an index of the documents that it holds parts
of. The frames are rows of a Parquet table: Spark's commit then leaves the files of one
attempt per task, however many executors are lost. Any frame can be decoded by
itself, and a reader's work is spread by frames, not by documents.

Cases: a null or empty text is its end id alone; a document of any length is spread
over frames; rows with a null doc_id come first; rows with the same doc_id follow
one another in any order; an empty table gives an empty file; other columns are ignored.
Ids must be below 65536.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import range_coder, tokens
from .common import arrow_map, batch, materialize, shuffle_partitions, table, text_of

_FRAMES = "shard int, block int, n_ids long, frame binary, docs array<struct<doc_id: long, seq: long, part: long, n: long>>"
_DOC = pa.struct([("doc_id", pa.int64()), ("seq", pa.int64()), ("part", pa.int64()), ("n", pa.int64())])
_FRAMES_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("frame", pa.binary()), ("docs", pa.list_(_DOC))])
_PARTS = "shard int, seq long, doc_id long, part long, start_in_shard long, n long, crc long, ids binary"
_PARTS_ARROW = pa.schema([("shard", pa.int32()), *((c, pa.int64()) for c in ("seq", "doc_id", "part", "start_in_shard", "n", "crc")), ("ids", pa.binary())])


class _Shard:
    """Ids that wait to be written, and the documents that they are of."""

    def __init__(self, number: int, block_ids: int):
        self.number, self.block_ids, self.block, self.before = number, block_ids, 0, 0
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []  # ids of each document that are left
        self.seq, self.part = 0, 0  # of the first document that waits
        self.waiting = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc_ids.append(doc_ids)
        self.sizes.append(np.diff(ends, prepend=0))
        self.waiting += len(ids)

    def cut(self, last: bool) -> pa.RecordBatch | None:
        """The frames of all whole blocks; at the end, of what is left too."""
        size = self.block_ids
        whole = self.waiting if last else self.waiting // size * size
        if not whole:
            return None
        ids, doc_ids, sizes = np.concatenate(self.ids), pa.concat_arrays(self.doc_ids), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        # Pieces lie between neighbouring ends of documents or blocks.
        stops = np.unique(np.concatenate([ends[ends <= whole], np.arange(size, whole, size), [whole]]))
        starts = np.concatenate([[0], stops[:-1]])
        doc = np.searchsorted(ends, starts, "right")
        part = np.arange(len(doc)) - np.searchsorted(doc, doc) + np.where(doc == 0, self.part, 0)
        pieces = pa.StructArray.from_arrays([doc_ids.take(pa.array(doc)), pa.array(self.seq + doc), pa.array(part), pa.array(stops - starts)], fields=list(_DOC))
        n_blocks = -(-whole // size)
        offsets = np.searchsorted(starts, np.append(np.arange(n_blocks) * size, whole)).astype(np.int32)
        blocks = [(self.number, self.block + k, self.before + k * size, ids[k * size : min((k + 1) * size, whole)]) for k in range(n_blocks)]
        out = batch(_FRAMES_ARROW, *zip(*((b[0], b[1], len(b[3]), f) for b, f in zip(blocks, range_coder.frames(blocks)))), pa.ListArray.from_arrays(pa.array(offsets), pieces))
        done = int(np.searchsorted(ends, whole, "right"))  # documents written to their end
        split = done < len(ends) and whole > (ends[done - 1] if done else 0)
        self.part = int(part[-1]) + 1 if split else 0
        left = sizes[done:].copy()
        if split:
            left[0] = ends[done] - whole
        self.ids, self.doc_ids, self.sizes = [ids[whole:]], [doc_ids.slice(done)], [left]
        self.seq, self.block, self.before, self.waiting = self.seq + done, self.block + n_blocks, self.before + whole, self.waiting - whole
        return out


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, shards: int | None = None, block_ids: int = range_coder.BLOCK_IDS, lanes: int = range_coder.LANES) -> DataFrame:
    """The table of frames, written to the scratch folder in ascending doc_id order; lanes blocks are coded at a time."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = named.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(TaskContext.get().partitionId(), block_ids)
        for b, ids, ends in tokens.encoded(batches, path, end_id):
            shard.add(b.column("doc_id"), ids, ends)
            if shard.waiting >= lanes * block_ids and (out := shard.cut(False)) is not None:
                yield out
        if (out := shard.cut(True)) is not None:
            yield out

    return materialize(arrow_map(dealt, rows, _FRAMES), "token-files")


def read_parts(files: DataFrame, with_ids: bool = False, lanes: int = range_coder.LANES) -> DataFrame:
    """The documents in the frames, decoded: place in the shard, number, crc32 and, if asked for, ids (16 bits each).

    A document is in parts only where its frames are decoded apart, lanes frames at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, lanes):
                b = whole.slice(at, lanes)
                out: list[list] = []
                for (shard, _, before, ids), docs in zip(range_coder.read_frames(b.column("frame").to_pylist()), b.column("docs")):
                    d = docs.values.flatten()
                    pos, wide = 0, ids.astype("<u4")
                    for doc, seq, part, n in zip(*(x.to_pylist() for x in d)):
                        piece = wide[pos : pos + n]
                        last = out[-1] if out else None
                        if last and (last[0], last[1], last[4] + last[5]) == (shard, seq, before + pos):
                            last[5] += n
                            last[6] = tokens.crc32_of(piece, last[6])
                        else:
                            out.append([shard, seq, doc, part, before + pos, n, tokens.crc32_of(piece), []])
                        if with_ids:
                            out[-1][7].append(ids[pos : pos + n].astype("<u2").tobytes())
                        pos += n
                *columns, ids = zip(*out)
                yield batch(_PARTS_ARROW, *columns, [b"".join(x) if with_ids else None for x in ids])

    parts = arrow_map(files, rows, _PARTS)
    return parts if with_ids else parts.drop("ids")


def _times(a: int, b: int) -> int:
    """Product of polynomials modulo that of crc32, lowest power first."""
    p = 0
    while a:
        if a & 1 << 31:
            p ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return p


def _crc32_joined(parts: Column) -> Column:
    """crc32 of ids joined, from structs of part, n (ids) and crc; appending n ids multiplies a crc32 by a power of x."""
    power, table = 1 << 23, []  # x^8: what appending a byte multiplies by
    for _ in range(40):
        table += [_times(power, 1 << bit) for bit in range(32)]
        power = _times(power, power)
    shifted = "aggregate(sequence(0, 39), done, (c, k) -> if(shiftright(4 * p.n, k) & 1 = 1, aggregate(sequence(0, 31), 0L, (a, b) -> if(shiftright(c, b) & 1 = 1, a ^ powers[k * 32 + b], a)), c))"
    folded = F.expr(f"aggregate(ordered, 0L, (done, p) -> {shifted.replace('powers', 'array(' + ', '.join(f'{x}L' for x in table) + ')')} ^ p.crc)".replace("ordered", "sort_array(parts)"))
    return F.when(F.size(parts) == 1, parts[0]["crc"]).otherwise(folded)


def document_crcs(files: DataFrame, lanes: int = range_coder.LANES) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    docs = read_parts(files, lanes=lanes).groupBy("shard", "seq").agg(F.first("doc_id").alias("doc_id"), F.min("start_in_shard").alias("at"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("part", "n", "crc")).alias("parts"))
    # One row per shard, whose number the caller sets.
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", _crc32_joined(F.col("parts")).alias("ids_crc32"))


def op2(spark, sf_dir: str) -> DataFrame:
    return document_crcs(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
