"""What the corpus operators share: scratch tables, text columns, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (a local session, as in tests) a temporary folder
    stands in; on a cluster the setting is required.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the scratch folder and read again.

    It cuts the lineage: a lost executor costs the running stage, never the work
    before the table. `clear_scratch` removes the tables.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that `materialize` gave, once nothing reads it any more; other DataFrames are left alone."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if f"/tables-{spark.sparkContext.applicationId}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that `materialize` wrote in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer until no column of df has them, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def frequent(rows: DataFrame, item: str, most: int, tracked: int) -> DataFrame:
    """At most `most` values of a column that occur more than once, among them all that a sketch with so many counters can tell are frequent.

    Sketches of tasks meet in groups first, so that no task merges many of them.
    """
    groups = max(1, round(shuffle_partitions(rows.sparkSession) ** 0.5))
    parts = rows.groupBy((F.spark_partition_id() % groups).alias("g")).agg(F.expr(f"approx_top_k_accumulate({item}, {tracked})").alias("s"))
    top = parts.groupBy(F.lit("all").alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {most})")).alias("t"))
    return top.where("t.count > 1").select(F.col("t.item").alias(item))


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with a schema given as DDL."""
    return df.mapInArrow(rows, T._parse_datatype_string(schema))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch with these columns, in the order of the schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
