"""Tables whose number of vectors is no multiple of a row of cells: the last row of the image is incomplete."""

import duckdb
import pytest
from pyspark.sql import functions as F

from echotide.queries import ORACLES, QUERIES
from echotide.sources import fixtures


def rows(found, columns):
    return sorted((tuple(r[c] for c in columns) for r in found), key=str)


@pytest.fixture(scope="module", params=[463, 487])
def incomplete(spark, sf_dir, tmp_path_factory, request):
    folder = str(tmp_path_factory.mktemp("incomplete"))
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") < request.param).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, con


def agrees(spark, incomplete, name):
    folder, con = incomplete
    df = QUERIES[name](spark, folder)
    theirs = con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert rows(df.collect(), columns) == sorted(theirs.fetchall(), key=str)


def test_size_counts_the_incomplete_row(spark, incomplete):
    assert fixtures.shape(spark, incomplete[0], 2)[0] in (19, 20) and fixtures.shape(spark, incomplete[0], 3) == [10, 10, 5]


@pytest.mark.parametrize("name", [f"resample_{k}_{n}d" for k in ("nearest", "linear", "cubic") for n in (2, 3)] + ["resample_mask", "radiomics_wavelet", "radiomics_log", "radiomics_gradient"])
def test_axes_reach_to_the_incomplete_row(spark, incomplete, name):
    agrees(spark, incomplete, name)


@pytest.mark.parametrize("name", ["fill_holes", "fill_holes_tiles"])
def test_missing_cells_are_walls(spark, incomplete, name):
    agrees(spark, incomplete, name)


def test_holes_beside_missing_cells(spark):
    """A background cell above a missing one is a hole; one with a way to the border isn't."""
    from echotide.operators.preprocess import fill_holes

    have = {(a, s): int((a, s) not in {(2, 1), (1, 3), (0, 3)}) for a in range(4) for s in range(5) if not (a == 3 and s)}
    mask = spark.createDataFrame([("a", "r", a, s, m) for (a, s), m in have.items()], "scan_id string, seg_id string, ax int, sag int, m smallint")
    want = {k: m if k in {(1, 3), (0, 3)} else 1 for k, m in have.items()}
    for one_task in (1 << 24, 0):
        assert {(r.ax, r.sag): r.m for r in fill_holes(mask, 2, one_task=one_task, tile=2).collect()} == want


def test_mean_around_leaves_missing_cells_out(spark, incomplete):
    agrees(spark, incomplete, "frame_function")


def test_array_has_the_cells_of_the_image(spark, incomplete):
    agrees(spark, incomplete, "array_frames")


@pytest.fixture(scope="module", params=["one cell in the last row", "keys shifted past a gap", "no vectors"])
def other_sizes(spark, sf_dir, tmp_path_factory, request):
    folder, ident = str(tmp_path_factory.mktemp("sizes")), F.col("vec_id")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if request.param == "one cell in the last row":
        vectors = vectors.where(ident < 451)
    elif request.param == "keys shifted past a gap":
        vectors = vectors.where(ident < 213)
        vectors = vectors.unionByName(vectors.withColumn("vec_id", ident + 1000))
    else:
        vectors = vectors.where(ident < 0)
    vectors.write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, con


def test_laplacian_of_gaussian_at_other_sizes(spark, other_sizes):
    agrees(spark, other_sizes, "radiomics_log")


def test_wavelet_at_other_sizes(spark, other_sizes):
    agrees(spark, other_sizes, "radiomics_wavelet")


def test_linear_2d_at_other_sizes(spark, other_sizes):
    agrees(spark, other_sizes, "resample_linear_2d")


def test_linear_3d_at_other_sizes(spark, other_sizes):
    agrees(spark, other_sizes, "resample_linear_3d")


def test_mask_at_other_sizes(spark, other_sizes):
    agrees(spark, other_sizes, "resample_mask")


def test_nearest_2d_at_other_sizes(spark, other_sizes):
    agrees(spark, other_sizes, "resample_nearest_2d")


@pytest.fixture(scope="module")
def uneven(spark, sf_dir, tmp_path_factory):
    """Vectors that are null, short, long, or have null elements."""
    folder, ident, e = str(tmp_path_factory.mktemp("uneven")), F.col("vec_id"), F.col("embedding")
    kinds = F.when(ident % 7 == 3, F.lit(None)).when(ident % 11 == 4, F.slice(e, 1, 10)).when(ident % 13 == 5, F.concat(e, e)).when(ident % 5 == 1, F.transform(e, lambda x, i: F.when(i % 3 == 0, x))).otherwise(e)
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(ident < 213).withColumn("embedding", kinds).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, con


def test_linear_2d_of_uneven_vectors(spark, uneven):
    agrees(spark, uneven, "resample_linear_2d")


def test_linear_3d_of_uneven_vectors(spark, uneven):
    agrees(spark, uneven, "resample_linear_3d")


@pytest.mark.parametrize("dims", [2, 3])
def test_nearest_of_uneven_vectors(spark, uneven, dims):
    agrees(spark, uneven, f"resample_nearest_{dims}d")
