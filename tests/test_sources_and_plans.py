"""Readers, sinks, registry, whole runs and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.plans import pipeline as P
from echotide.plans.registry import Registry
from echotide.sources import images, tables
from echotide.streaming import live_curve, live_sessions


def cine(shape):
    rng = np.random.default_rng(7)
    return rng.integers(0, 200, shape).astype(np.uint8)


def test_nifti_round_trip():
    v = cine((4, 3, 5, 6))
    got, pixdim, rate = images.parse_nifti(images.write_nifti(v, [1.0, 2.0, 0.5], 0.25))
    assert np.array_equal(got, v) and pixdim == [1.0, 2.0, 0.5] and rate == 4.0
    assert images.parse_nifti(images.write_nifti(v, [1, 1, 1]))[2] == 1.0
    assert images.parse_nifti(images.write_nifti(v, [1, 1, 1]), transpose=True)[0].shape == (6, 5, 3, 4)
    with pytest.raises(ValueError):
        images.parse_nifti(b"\0" * 400)


def avi(frames, width, height):
    line = (width * 3 + 3) // 4 * 4
    body = b""
    for f in frames:
        rows = b"".join(bytes(f[y].tobytes()).ljust(line, b"\0") for y in range(height - 1, -1, -1))
        body += b"00db" + struct.pack("<I", len(rows)) + rows
    chunk = lambda n, d: n + struct.pack("<I", len(d)) + d
    head = chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13))
    strf = chunk(b"strf", struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, 0, 0, 0, 0, 0))
    movi = chunk(b"LIST", b"movi" + body)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + head + strf) + movi)


def test_avi():
    frames = cine((3, 4, 5, 3))
    got, rate = images.parse_avi(avi(frames, 5, 4))
    b, g, r = (frames[..., i].astype(float) for i in range(3))
    assert np.array_equal(got, np.rint(0.114 * r + 0.587 * g + 0.299 * b).astype(np.uint8)) and rate == 0.04


def dicom(pixels, dx, dy, frame_ms):
    def el(g, e, vr, data):
        data += b"\0" * (len(data) % 2)
        return struct.pack("<HH", g, e) + vr + (b"\0\0" + struct.pack("<I", len(data)) if vr in (b"OB", b"SQ") else struct.pack("<H", len(data))) + data

    region = el(0x18, 0x602C, b"FD", struct.pack("<d", dx)) + el(0x18, 0x602E, b"FD", struct.pack("<d", dy))
    item = struct.pack("<HHI", 0xFFFE, 0xE000, len(region)) + region
    n, rows, columns = pixels.shape
    us = lambda g, e, v: el(g, e, b"US", struct.pack("<H", v))
    return b"\0" * 128 + b"DICM" + el(0x18, 0x1063, b"DS", frame_ms.encode()) + el(0x18, 0x6011, b"SQ", item) + us(0x28, 2, 1) + el(0x28, 8, b"IS", str(n).encode()) + us(0x28, 0x10, rows) + us(0x28, 0x11, columns) + el(0x7FE0, 0x10, b"OB", pixels.tobytes())


def test_dicom_folder(spark, tmp_path):
    small, large = cine((2, 3, 4)), cine((5, 3, 4))
    (tmp_path / "A1").write_bytes(dicom(small, 0.1, 0.2, "40"))
    (tmp_path / "A2").write_bytes(dicom(large, 0.1, 0.2, "40"))
    (tmp_path / "B1").write_bytes(dicom(cine((50, 3, 4)), 0.1, 0.2, "40"))
    scans, voxels = images.read_dicom_folder(spark, str(tmp_path))
    s = scans.first()
    assert s["scan_id"] == "A2" and list(s["shape"]) == [5, 3, 4] and list(s["pixdim"]) == [0.2, 0.1] and s["frame_rate"] == 0.04
    assert {(r["frame"], r["ax"], r["sag"]): r["value"] for r in voxels.collect()} == {tuple(map(int, p)): float(large[tuple(p)]) for p in np.argwhere(np.ones_like(large))}


def config(tmp_path, scale=False):
    v = cine((8, 7, 6, 12))
    m = np.zeros((8, 7, 6), np.uint8)
    m[1:7, 1:6, 1:5] = 1
    (tmp_path / "scan.nii").write_bytes(images.write_nifti(v, [1.0, 1.0, 1.0], 2.0))
    (tmp_path / "mask.nii").write_bytes(images.write_nifti(m, [1.0, 1.0, 1.0]))
    steps = {"scan_preproc_funcs": ["resample"], "scan_preproc_kwargs": {"target_vox_size": [2.0, 1.0, 1.0], "interp": "linear"}, "seg_preproc_funcs": ["resample"], "seg_preproc_kwargs": {"target_vox_size": [2.0, 1.0, 1.0], "interp": "nearest"}} if scale else {}
    return v, m, {"scan_loader": "nifti", "scan_path": str(tmp_path / "scan.nii"), "seg_loader": "nifti", "seg_path": str(tmp_path / "mask.nii"), "analysis_type": "curves", "analysis_funcs": ["tic"], **steps}


def test_run_over_a_region(spark, tmp_path):
    v, m, c = config(tmp_path)
    out = P.main_dict(spark, c | {"analysis_kwargs": {"curves_output_path": str(tmp_path / "curves.csv")}, "curve_quant_funcs": ["first_order_full", "wash_rates", "dte", "cmus_firstorder", "auc_no_fit"], "curve_quant_kwargs": {"tic_name": "TIC", "curves_to_fit": ["tic"]}, "curve_quant_output_path": str(tmp_path / "q.csv")})
    tic = {r["frame"]: r["value"] for r in out["analysis"].curves.collect()}
    assert tic == {f: pytest.approx(v[..., f][m > 0].mean()) for f in range(12)}
    again = tables.load_curves(spark, str(tmp_path / "curves.csv"))
    assert {r["frame"]: pytest.approx(r["value"]) for r in again.collect()} == tic
    saved = spark.read.option("header", True).csv(str(tmp_path / "q.csv")).first().asDict()
    assert float(saved["Mean_full_TIC"]) == pytest.approx(np.mean(list(tic.values()))) and "DTE_TIC" in saved


def test_run_from_saved_curves(spark, tmp_path):
    _, _, c = config(tmp_path)
    P.main_dict(spark, c | {"analysis_kwargs": {"curves_output_path": str(tmp_path / "curves.csv")}})
    out = P.main_dict(spark, {"curves_path": str(tmp_path / "curves.csv"), "curve_quant_funcs": ["first_order_full"], "seg_preproc_funcs": None})
    assert out["quants"].count() == 12


def test_run_over_windows(spark, tmp_path):
    _, m, c = config(tmp_path, scale=True)
    (tmp_path / "c.yml").write_text(__import__("yaml").safe_dump(c | {"analysis_type": "curves_paramap", "analysis_kwargs": {k: v for a in ("ax", "sag", "cor") for k, v in ((f"{a}_vox_len", 4), (f"{a}_vox_ovrlp", 50))}, "curve_quant_funcs": ["first_order_full"], "visualization_type": "paramap", "visualization_params": ["Mean_full_TIC"], "custom_visualization_funcs": ["plot_tics"], "visualization_kwargs": {"paramap_folder_path": str(tmp_path / "maps")}}))
    out = P.main_yaml(spark, str(tmp_path / "c.yml"))
    assert out["analysis"].windows.count() > 0
    maps = tables.load_paramap(spark, str(tmp_path / "maps/paramap"))
    assert maps.where("value is not null").count() > 0
    assert spark.read.parquet(str(tmp_path / "maps/image")).count() == out["analysis"].image.voxels.count()
    assert spark.read.parquet(str(tmp_path / "maps/segmentation")).count() == out["analysis"].mask.count()
    assert spark.read.parquet(str(tmp_path / "maps/pix_dims")).first()["pixdim"] == list(out["analysis"].image.pixdim)
    array = tables.to_array(maps, "Mean_full_TIC", out["analysis"].image.size)
    assert array.shape == (4, 7, 6) and np.isfinite(array).any() and np.isnan(array[0]).all()


def test_run_with_radiomics(spark, tmp_path):
    """The sample run with texture curves over a DICOM folder's shape of configuration, against NumPy."""
    v, m, c = config(tmp_path)
    (tmp_path / "feat.yml").write_text("setting: {binWidth: 1}\nfeatureClass:\n  firstorder:\n  glcm: [Contrast, JointEnergy]\n")
    kwargs = {"curves_output_path": str(tmp_path / "curves.csv"), "binwidth": 25, "min_intensity": 0, "pyradiomics_config_paths": [str(tmp_path / "feat.yml")]}
    out = P.main_dict(spark, c | {"analysis_funcs": ["tic", "pyradiomics"], "analysis_kwargs": kwargs})
    got = {(r["curve_name"], r["frame"]): r["value"] for r in out["analysis"].curves.collect()}
    assert len(got) == 12 * (1 + 18 + 2)
    for f in range(12):
        grid, inside = v[..., f].astype(float).copy(), m == 1
        grid[0, 0, 0], inside[0, 0, 0] = 0, True
        levels = np.floor(grid / 25) + 1
        x = levels[inside]
        _, n = np.unique(x, return_counts=True)
        p = n / n.sum()
        mid = x[(x >= np.percentile(x, 10)) & (x <= np.percentile(x, 90))]
        expected = {"Mean": x.mean(), "Variance": x.var(), "Energy": (x**2).sum(), "Entropy": -(p * np.log2(p)).sum(), "Uniformity": (p**2).sum(), "10Percentile": np.percentile(x, 10), "Median": np.median(x), "MeanAbsoluteDeviation": abs(x - x.mean()).mean(), "RobustMeanAbsoluteDeviation": abs(mid - mid.mean()).mean(), "RootMeanSquared": np.sqrt((x**2).mean())}
        for k, e in expected.items():
            assert got[f"feat_original_firstorder_{k}", f] == pytest.approx(e)
        contrast = []
        for o in [(a, b, d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1) if (a, b, d) > (0, 0, 0)]:
            pairs = [(levels[tuple(q)], levels[tuple(q + o)]) for q in np.argwhere(inside) if all(0 <= z < s for z, s in zip(q + o, m.shape)) and inside[tuple(q + o)]]
            if pairs:
                contrast.append(np.mean([(a - b) ** 2 for a, b in pairs]))
        assert got["feat_original_glcm_Contrast", f] == pytest.approx(np.mean(contrast))
    (tmp_path / "bad.yml").write_text("featureClass: {gltex: }")
    with pytest.raises(ValueError, match="unknown radiomics class: gltex"):
        P.main_dict(spark, c | {"analysis_funcs": ["pyradiomics"], "analysis_kwargs": kwargs | {"pyradiomics_config_paths": [str(tmp_path / "bad.yml")]}})
    with pytest.raises(ValueError, match="needs"):
        P.main_dict(spark, c | {"analysis_funcs": ["pyradiomics"], "analysis_kwargs": {}})


def test_resampled_scans_keep_their_pixel_type(spark, tmp_path):
    _, _, c = config(tmp_path)
    image = P.scan_loading_step(spark, "nifti", c["scan_path"])
    assert image.pixel_type == "uint8"
    out = P.scan_preprocessing_step(["resample"], image, target_vox_size=[0.7, 0.8, 0.9], interp="cubic")
    assert out.voxels.where("value <> rint(value) or value < 0 or value > 255").count() == 0
    z = P.scan_preprocessing_step(["standardize", "resample"], image, target_vox_size=[0.7, 0.8, 0.9], interp="linear")
    assert z.pixel_type == "float64" and z.voxels.where("value <> rint(value)").count() > 0


def test_dicom_decoder(spark, tmp_path):
    (tmp_path / "A1").write_bytes(b"whatever")
    image = P.scan_loading_step(spark, "custom_dicom", str(tmp_path), decoder=lambda data: (np.full((2, 3, 4), len(data), np.uint8), [1.0, 2.0], 0.5))
    assert image.shape == (2, 3, 4) and {r["value"] for r in image.voxels.collect()} == {8.0}


def test_validation(spark, tmp_path):
    _, _, c = config(tmp_path)
    with pytest.raises(ValueError, match="unknown scan loader"):
        P.main_dict(spark, c | {"scan_loader": "x"})
    with pytest.raises(ValueError, match="needs target_vox_size"):
        P.main_dict(spark, c | {"scan_preproc_funcs": ["resample"]})
    with pytest.raises(ValueError, match="reads .nii"):
        P.scan_loading_step(spark, "nifti", "x.avi")
    with pytest.raises(ValueError, match="decoder"):
        P.scan_loading_step(spark, "mp4", "x.mp4")


def test_registry():
    r = Registry("thing")
    r.add("a", depends=["b"])(print)
    r.add("b", depends=["c"])(print)
    r.add("c")(print)
    assert [p.name for p in r.ordered(["a", "c"])] == ["c", "b", "a"]
    r.add("d", depends=["e"])(print)
    r.add("e", depends=["d"])(print)
    with pytest.raises(ValueError, match="circle"):
        r.ordered(["d"])
    with pytest.raises(ValueError, match="unknown"):
        r.ordered(["z"])


def test_live_curves(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("scan_id", F.col("user_id").cast("string"))
    q = live_curve(stream).writeStream.outputMode("append").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {(r["start"], r["scan_id"]): r["n"] for r in spark.table("live").collect()}
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), F.col("user_id").cast("string").alias("u")).count()
    every = {(r["w"]["start"], r["u"]): r["count"] for r in batch.collect()}
    assert live and all(every[k] == n for k, n in live.items())
    s = live_sessions(stream, "2 hours").writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("sessions").count() > 0
