"""Connected components of cells: labelled within tiles, joined over the tiles' borders.

A component's label is the packed coordinate of its first cell. Tiles are independent tasks of bounded size. Only cells at borders of
tiles meet their neighbours, in an equi-join; labels that are neighbours are contracted to stars, round by
round, until nothing changes. So neither an array nor a component needs to fit in a task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotide.schema import axes

#: Cells of a tile along each axis, by dimensions; bits of a coordinate in a label.
TILE, BITS = {2: 512, 3: 64}, 21


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


def neighbours(dims: int, full: bool = True) -> list[tuple[int, ...]]:
    """One of each pair of opposite neighbours: all 8 or 26, or those along axes."""
    out = [()]
    for _ in range(dims):
        out = [(*o, d) for o in out for d in (-1, 0, 1)]
    return [o for o in out if o > (0,) * dims and (full or sum(map(abs, o)) == 1)]


def label_cells(where: Sequence[np.ndarray], level: np.ndarray, steps: Sequence[tuple[int, ...]]) -> np.ndarray:
    """For each cell the number of the first cell of its component, where neighbours of equal level are one."""
    n, low = len(level), [int(w.min()) for w in where]
    grid = np.full([int(w.max()) - a + 3 for w, a in zip(where, low)], -1, np.int64)
    at = tuple(w - a + 1 for w, a in zip(where, low))
    grid[at] = np.arange(n)
    pairs = []
    for step in steps:
        other = grid[tuple(a + d for a, d in zip(at, step))]
        own = np.flatnonzero((other >= 0) & (level[other] == level))
        pairs.append(np.stack((own, other[own])))
    a, b = np.concatenate(pairs, 1)
    label = np.arange(n)
    while len(a):
        # Each root takes the least root next to it, then all point to their roots.
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label != (up := label[label])).any():
            label = up
    return label


def _packed(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, c: F.shiftleft(a, BITS).bitwiseOR(c.cast("long")), columns, F.lit(0).cast("long"))


def contract(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, u, root) of all nodes of edges (keys, u, v): root is the least node that they are joined to.

    Every node tells its larger neighbours of the least one it knows, then its smaller ones; with both, the edges
    of a component become a star within a number of rounds that grows with the logarithm of its size.
    """
    keys = list(keys)

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy(*keys, "u")))
        told = both.withColumn("m", least)
        out = told.where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            out = told.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(told.select(*keys, "u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    edges, before = cut_lineage(edges.where("u <> v").select(*keys, "u", "v").distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(*keys, "u", F.col("v").alias("root"))
        before, edges = state, cut_lineage(star(star(edges, True), False))


def components(cells: DataFrame, dims: int, keys: Sequence[str], full: bool = True, tile: int | None = None) -> DataFrame:
    """cells (keys, spatial columns, level) with zone: a number shared by the cells of a component, its own within the keys.

    Cells are neighbours if they touch, corners included (full), or along axes only. tile changes no result.
    """
    names, keys, tile = axes(dims), list(keys), tile or TILE[dims]
    steps = neighbours(dims, full)
    kept = cells.select(*keys, *(F.col(c).cast("int").alias(c) for c in names), F.col("level").cast("long").alias("level"))
    tiles = [f"__tile_{c}" for c in names]
    kinds = dict(kept.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in names), "level long", "label long"])

    def label(t: pa.Table) -> pa.Table:
        where = [t.column(c).to_numpy().astype(np.int64) for c in names]
        order = np.lexsort(where[::-1])
        where = [w[order] for w in where]
        found = label_cells(where, t.column("level").to_numpy()[order], steps)
        packed = np.zeros(len(order), np.int64)
        for w in where:
            packed = packed << BITS | w
        return t.take(pa.array(order)).drop(tiles).append_column("label", pa.array(packed[found]))

    dealt = kept.withColumns({t: F.expr(f"{c} div {tile}").cast("int") for t, c in zip(tiles, names)})
    labelled = cut_lineage(dealt.groupBy(*keys, *tiles).applyInArrow(label, schema))
    edge = reduce(lambda a, b: a | b, ((F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1) for c in names))
    border = labelled.where(edge)
    moves = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d_{c}") for c, d in zip(names, s))) for s in steps)))
    sent = border.withColumn("o", moves)
    crosses = reduce(lambda a, b: a | b, (F.floor(F.col(c) / tile) != F.floor((F.col(c) + F.col(f"o.d_{c}")) / tile) for c in names))
    sent = sent.where(crosses).select(*keys, *((F.col(c) + F.col(f"o.d_{c}")).alias(c) for c in names), "level", F.col("label").alias("u"))
    edges = sent.join(border.withColumnRenamed("label", "v"), [*keys, *names, "level"]).select(*keys, "u", "v")
    roots = contract(edges, keys).withColumnRenamed("u", "label")
    return labelled.join(roots, [*keys, "label"], "left").select(*keys, *names, "level", F.coalesce("root", "label").alias("zone"))
