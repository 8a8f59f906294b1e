"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries sketch (`approx_top_k_accumulate`, a mergeable frequent-items summary of
bounded size) names digests that may be frequent. Their groups are counted
exactly with map-side sums, and the at most `heavy` winners are broadcast: rows
of those digests are settled where they are read. Rows of all other digests are
shuffled by digest. Of these the largest group is at most the one ranked behind the winners, so it holds less than
1/`heavy` of all rows, give or take the sketch's error of about 1/`tracked` of them.

Cases: null text counts as empty; equal texts with equal (or null) doc_id keep
exactly one row; a null doc_id ranks below any other; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frequent, materialize, table, text_of, unused

#: Most digests that are broadcast, and counters in the sketch.
HEAVY, TRACKED = 1024, 16384


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of (row, doc_id, digest); row tells equal rows apart."""
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"))
    return materialize(keys.withColumn("row", F.monotonically_increasing_id()), "digests")


def _groups(keys: DataFrame) -> DataFrame:
    return keys.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))


def _winners(keys: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """Exact groups of the digests that the sketch names: at most `heavy` rows."""
    named = frequent(keys.select(F.hex("digest").alias("item")), "item", heavy, tracked).select(F.unhex("item").alias("digest"))
    return materialize(_groups(keys.join(F.broadcast(named), "digest", "left_semi")).where("group_size > 1"), "heavy")


def assign(keys: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Each row of `digests` with keep (doc_id, row) and group_size of its group."""
    winners = F.broadcast(_winners(keys, heavy, tracked))
    settled = keys.join(winners, "digest").select("row", "doc_id", "digest", "keep", "group_size")
    rest = keys.join(winners.select("digest"), "digest", "left_anti")
    dealt = rest.join(_groups(rest), "digest").select("row", "doc_id", "digest", "keep", "group_size")
    return settled.unionByName(dealt)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256; of equal texts the largest doc_id stays."""
    found = assign(digests(docs, id_col, text_col), heavy, tracked)
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """docs with one row of each text, all columns kept: the one with the largest doc_id.

    Rows of a frequent text that don't stay are dropped where they are read. What is left meets
    by digest, the only exchange of texts; each task sends on one row of a text at most.
    """
    digest, keep, rank = unused(docs, "digest", "keep", "rank")
    winners = _winners(digests(docs, id_col, text_col), heavy, tracked)
    heavies = F.broadcast(winners.select(F.col("digest").alias(digest), F.col("keep.doc_id").alias(keep)))
    marked = docs.withColumn(digest, F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))).join(heavies, digest, "left")
    left = marked.where(F.col(keep).isNull() | (F.col(id_col).cast("long") == F.col(keep)))
    best = Window.partitionBy(digest).orderBy(F.col(id_col).cast("long").desc_nulls_last())
    return left.withColumn(rank, F.row_number().over(best)).where(F.col(rank) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
