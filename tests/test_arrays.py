"""Ranges of array files: what is read, what is written, what is left behind."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan
from pyspark.sql.types import _parse_datatype_string

from echotide.sources import arrays as A
from echotide.sources import images


def scan_rows(cine, name):
    """(scan, frame, ax, sag, cor, value) by definition."""
    if cine.ndim == 3:
        return {(name, t, a, s, None, float(v)) for (t, a, s), v in np.ndenumerate(cine)}
    return {(name, t, a, s, c, float(v)) for (s, c, a, t), v in np.ndenumerate(cine)}


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    cines = {"flat": rng.integers(0, 255, (5, 4, 3)), "deep": rng.integers(0, 255, (4, 3, 2, 6)), "packed": rng.integers(0, 255, (2, 3, 2, 4))}
    for name, cine in cines.items():
        data = images.write_nifti(cine, [1.0, 0.5, 2.0], 0.25)
        (tmp_path / f"{name}.nii{'.gz' if name == 'packed' else ''}").write_bytes(gzip.compress(data) if name == "packed" else data)
    (tmp_path / "note.txt").write_text("no image")
    return tmp_path, {("packed.nii" if n == "packed" else n): c for n, c in cines.items()}


def test_same_rows_as_the_whole_files(spark, folder, monkeypatch):
    path, cines = folder
    got = A.read_nifti(spark, str(path))
    assert {tuple(r) for r in got.collect()} == set().union(*(scan_rows(c, n) for n, c in cines.items()))
    old = images.read_scans(spark, str(path))
    assert sorted(map(str, A.read_nifti(spark, str(path), "scans").drop("scan_path").collect())) == sorted(map(str, old[0].drop("scan_path").collect()))
    assert got.schema == old[1].schema
    turned = A.read_nifti(spark, str(path / "deep.nii"), transpose=True)
    assert {tuple(r) for r in turned.collect()} == scan_rows(cines["deep"].T, "deep")
    assert got.where("frame = 3 AND scan_id = 'deep'").count() == 24 and got.where("frame >= 2 AND frame < 4").groupBy("scan_id").count().count() == 3
    assert A.read_nifti(spark, f"{path}/*.nii").select("scan_id").distinct().count() == 2
    for bad in (b"x" * 400, images.write_nifti(np.zeros((3, 2, 2)), [1.0])[:-1]):
        (path / "bad.nii").write_bytes(bad)
        with pytest.raises(Exception, match="NIfTI|cut off"):
            A.read_nifti(spark, str(path / "bad.nii")).collect()


def test_a_frame_reads_its_range(folder, monkeypatch):
    """Planning reads headers; a frame reads its bytes; filters on other scans and axes read nothing."""
    path, cines = folder
    read, plain = [], A.read_range
    monkeypatch.setattr(A, "read_range", lambda p, o, n: read.append(n) or plain(p, o, n))
    monkeypatch.setattr(A.Bounds.of, "__defaults__", (10,))
    schema = _parse_datatype_string(A.SCHEMAS["voxels"])

    def rows(*filters):
        read.clear()
        r = A.NiftiReader({"path": f"{path}/deep.nii"}, schema)
        assert list(r.pushFilters(list(filters))) == list(filters)
        parts = r.partitions()
        assert read == [352]
        return parts, sum(b.num_rows for p in parts for b in r.read(p)), sum(read) - 352

    assert rows()[1:] == (144, 144) and len(rows()[0]) == 6
    assert rows(EqualTo(("frame",), 3))[1:] == (24, 24)
    assert rows(GreaterThanOrEqual(("frame",), 2), LessThan(("frame",), 4))[1:] == (48, 48)
    assert rows(In(("frame",), (1, 2)))[1:] == (48, 48)
    assert rows(EqualTo(("scan_id",), "other"))[1:] == (0, 0) == rows(EqualTo(("frame",), 9))[1:]
    assert rows(EqualTo(("ax",), 1))[1:] == (144, 144)  # not the slowest axis: Spark filters the rows


def test_pushed_by_spark(spark, folder, capfd):
    path, _ = folder
    df = A.read_nifti(spark, f"{path}/deep.nii").where("frame = 3")
    assert df.rdd.getNumPartitions() == 1 and df.count() == 24


def test_masks(spark, tmp_path):
    m = np.random.default_rng(1).integers(0, 2, (3, 4, 2))
    (tmp_path / "roi.nii").write_bytes(images.write_nifti(m, [1.0, 1.0, 1.0]))
    got = A.read_nifti(spark, str(tmp_path / "roi.nii"), "mask", scan_id="s")
    assert {tuple(r) for r in got.collect()} == {("s", "roi", a, s, c, int(v)) for (s, c, a), v in np.ndenumerate(m)}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, images.read_masks(spark, str(tmp_path / "roi.nii"), "s").collect()), key=str)


def cells(spark, a, names, value="value"):
    return spark.createDataFrame([(*map(int, at), float(a[tuple(at)])) for at in np.argwhere(~np.isnan(a))], f"{', '.join(f'{c} int' for c in names)}, {value} double").repartition(5)


@pytest.mark.parametrize("slab_bytes", [1, 100, 1 << 20])
def test_written_and_read(spark, tmp_path, slab_bytes):
    rng = np.random.default_rng(2)
    a = rng.random((7, 4, 5)).astype(np.float32).astype(float)
    a[2:4] = np.nan
    a[0, 1, 2] = np.nan
    df = cells(spark, a, ("ax", "sag", "cor"))
    A.write_array(df, str(tmp_path / "map"), ("ax", "sag", "cor"), a.shape, slab_bytes=slab_bytes)
    back = A.read_array(spark, str(tmp_path / "map"))
    assert {tuple(r)[:3]: r["value"] for r in back.where("NOT isnan(value)").collect()} == {tuple(map(int, at)): a[tuple(at)] for at in np.argwhere(~np.isnan(a))}
    A.assemble(str(tmp_path / "map"), str(tmp_path / "map.npy"))
    assert np.array_equal(np.load(tmp_path / "map.npy"), a.astype(np.float32), equal_nan=True)
    cine = rng.integers(0, 255, (3, 4, 2, 5))
    A.write_array(cells(spark, cine.astype(float), ("sag", "cor", "ax", "frame")), str(tmp_path / "cine"), ("sag", "cor", "ax", "frame"), cine.shape, "nifti", "|u1", pixdim=(1.0, 2.0, 0.5), frame_step=0.5, slab_bytes=slab_bytes)
    A.assemble(str(tmp_path / "cine"), str(tmp_path / "cine.nii"))
    found, pixdim, rate = images.parse_nifti((tmp_path / "cine.nii").read_bytes())
    assert (found == cine).all() and pixdim == [1.0, 2.0, 0.5] and rate == 2.0
    assert {tuple(r) for r in A.read_nifti(spark, str(tmp_path / "cine.nii")).collect()} == scan_rows(cine, "cine")
    assert sorted(os.listdir(tmp_path / "cine"))[:2] == ["header", "manifest.json"] and not [f for f in os.listdir(tmp_path / "cine") if f.startswith("_")]
    with pytest.raises(ValueError, match="exists"):
        A.write_array(df, str(tmp_path / "map"), ("ax", "sag", "cor"), a.shape)


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    df = cells(spark, np.ones((40, 3)), ("ax", "sag")).withColumn("value", F.when(F.col("ax") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        A.write_array(df, str(tmp_path / "gone"), ("ax", "sag"), (40, 3), slab_bytes=1)
    with pytest.raises(Exception, match="outside"):
        A.write_array(cells(spark, np.ones((40, 3)), ("ax", "sag")), str(tmp_path / "gone"), ("ax", "sag"), (39, 3), slab_bytes=1)
    assert not os.path.exists(tmp_path / "gone")
    with pytest.raises(ValueError, match="no array"):
        A.manifest(str(tmp_path / "gone"))
    A.write_array(cells(spark, np.full((2, 2), np.nan), ("ax", "sag")), str(tmp_path / "none"), ("ax", "sag"), (2, 2))
    assert A.read_array(spark, str(tmp_path / "none")).count() == 0
