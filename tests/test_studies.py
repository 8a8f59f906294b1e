"""Studies against runs of their scans one by one; curve types of a user's own."""

import numpy as np
import pytest

from echotide.plans import pipeline as P
from echotide.plans import study as S
from echotide.sources import images


@pytest.fixture
def scans(tmp_path):
    """Two scans of unlike shape, spacing and rate, with their masks."""
    rng = np.random.default_rng(3)
    shapes = {"a": ((6, 5, 4, 5), [1.0, 0.5, 2.0], 0.5), "b": ((4, 7, 3, 3), [0.5, 1.0, 1.5], 0.25)}
    for folder in ("scans", "masks"):
        (tmp_path / folder).mkdir()
    for name, (shape, pixdim, step) in shapes.items():
        (tmp_path / f"scans/{name}.nii").write_bytes(images.write_nifti(rng.integers(10, 200, shape), pixdim, step))
        m = np.zeros(shape[:3])
        m[1:-1, 1:-1, :] = 1
        (tmp_path / f"masks/{name}_seg.nii").write_bytes(images.write_nifti(m, pixdim))
    return tmp_path


def run(spark, path, name, extra):
    return P.main_dict(spark, {"scan_loader": "nifti", "scan_path": f"{path}/scans/{name}.nii", "seg_loader": "nifti", "seg_path": f"{path}/masks/{'*' if name == '*' else name + '_seg'}.nii", **extra})


def curves(out):
    return {(r["scan_id"], r["seg_id"], r["window_ix"], r["curve_name"], r["frame"], r["time_s"]): round(r["value"], 9) for r in out["analysis"].curves.collect()}


SIZE = {"target_vox_size": [0.9137, 0.8053, 1.1071], "interp": "linear"}
STEPS = {f"{c}_vox_{k}": v for c in ("ax", "sag", "cor") for k, v in (("len", 2.5), ("ovrlp", 20.0))}


@pytest.mark.parametrize("extra", [
    {"analysis_type": "curves"},
    {"analysis_type": "curves", "scan_preproc_funcs": ["resample", "standardize"], "scan_preproc_kwargs": SIZE, "seg_preproc_funcs": ["resample"], "seg_preproc_kwargs": SIZE | {"interp": "nearest"}},
    {"analysis_type": "curves", "scan_preproc_funcs": ["resample"], "scan_preproc_kwargs": SIZE | {"interp": "cubic"}, "seg_preproc_funcs": ["resample"], "seg_preproc_kwargs": SIZE | {"interp": "nearest"}},
    {"analysis_type": "curves_paramap", "analysis_kwargs": STEPS},
])
def test_a_study_is_as_its_scans(spark, scans, extra):
    both = curves(run(spark, scans, "*", extra))
    one = {}
    for name in "ab":
        one |= curves(run(spark, scans, name, extra))
    assert both == one and {k[0] for k in one} == {"a", "b"} and len(one) > 7


def test_radiomics_of_a_study(spark, scans):
    (scans / "f.yml").write_text("setting: {binWidth: 2}\nfeatureClass:\n  firstorder: [Mean, TotalEnergy]\n  shape: [MeshVolume]\n")
    extra = {"analysis_type": "curves", "analysis_funcs": ["pyradiomics"], "analysis_kwargs": {"binwidth": 5, "min_intensity": 0, "pyradiomics_config_paths": [str(scans / "f.yml")]}}
    both = curves(run(spark, scans, "*", extra))
    assert both == curves(run(spark, scans, "a", extra)) | curves(run(spark, scans, "b", extra)) and len(both) == 3 * 8


def test_results_and_maps_of_a_study(spark, scans):
    extra = {"analysis_type": "curves_paramap", "analysis_kwargs": STEPS, "curve_quant_funcs": ["first_order_full"], "visualization_type": "paramap", "visualization_params": ["Mean_full_TIC"], "visualization_kwargs": {"paramap_folder_path": str(scans / "out")}}
    out = run(spark, scans, "*", extra)
    both = {tuple(r) for r in out["visuals"]["paramap"].collect()}
    one = set().union(*({tuple(r) for r in run(spark, scans, name, extra | {"visualization_kwargs": {}})["visuals"]["paramap"].collect()} for name in "ab"))
    assert both == one and len(both) == 6 * 5 * 4 + 4 * 7 * 3
    assert {tuple(r) for r in spark.read.parquet(str(scans / "out/pix_dims")).select("scan_id").collect()} == {("a",), ("b",)}


def test_what_a_study_refuses(spark, scans):
    (scans / "scans/c.nii").write_bytes(images.write_nifti(np.ones((3, 2, 2)), [1.0, 1.0]))
    with pytest.raises(ValueError, match="all 2-D or all 3-D"):
        P.scan_loading_step(spark, "nifti", f"{scans}/scans/*.nii")
    with pytest.raises(ValueError, match="nothing to read"):
        P.scan_loading_step(spark, "nifti", f"{scans}/scans/none*.nii")
    (scans / "scans/c.nii").unlink()
    study = P.scan_loading_step(spark, "nifti", f"{scans}/scans/*.nii")
    assert isinstance(study, S.Study) and study.frames().count() == 8
    with pytest.raises(Exception, match="below one cell"):
        S.steps(study, (0.1, 0.1, 0.1), (0, 0, 0)).collect()
    with pytest.raises(ValueError, match="one scan"):
        P.seg_loading_step(spark, "load_bolus_mask", study, f"{scans}/masks/a_seg.nii")


def test_a_curve_type_of_ones_own(spark, scans):
    """A function of arrays, with arguments, in regions and windows; gaps where it has nothing to say; errors where it breaks its word."""

    @P.frame_curve_type("edges", ("Rise", "Around"), required=("unit",))
    def edges(frame, mask, unit, **_):
        if np.nanmax(frame) < 0:
            return [], []
        return ["Rise", "Around"], [float(np.abs(np.diff(frame, axis=0)).max()) / unit, float(mask.mean())]

    P.frame_curve_type("liar", ("Truth",))(lambda frame, mask, **_: (["Lie"], [1.0]))
    P.frame_curve_type("rise_too", ("Rise",))(lambda frame, mask, **_: (["Rise"], [1.0]))
    try:
        extra = {"analysis_type": "curves", "analysis_funcs": ["tic", "edges"], "analysis_kwargs": {"unit": 2.0}}
        got = curves(run(spark, scans, "a", extra))
        v = images.parse_nifti((scans / "scans/a.nii").read_bytes())[0][1:-1, 1:-1].astype(float)
        for t in range(5):
            grid = np.transpose(v[..., t], (2, 0, 1))
            assert got["a", "a_seg", None, "Rise", t, t * 2.0] == pytest.approx(np.abs(np.diff(grid, axis=0)).max() / 2) and got["a", "a_seg", None, "Around", t, t * 2.0] == 1
        assert curves(run(spark, scans, "*", extra)) == got | curves(run(spark, scans, "b", extra))
        windows = curves(run(spark, scans, "a", {"analysis_type": "curves_paramap", "analysis_funcs": ["edges"], "analysis_kwargs": STEPS | {"unit": 1.0}}))
        assert {k[3] for k in windows} == {"Rise", "Around"} and {v for k, v in windows.items() if k[3] == "Around"} == {1.0}
        with pytest.raises(ValueError, match="needs unit"):
            run(spark, scans, "a", extra | {"analysis_kwargs": {}})
        with pytest.raises(ValueError, match="duplicate"):
            run(spark, scans, "a", extra | {"analysis_funcs": ["edges", "rise_too"]})
        with pytest.raises(Exception, match="one value each"):
            curves(run(spark, scans, "a", extra | {"analysis_funcs": ["liar"]}))
    finally:
        for name in ("edges", "liar", "rise_too"):
            del P.CURVE_TYPES.plugins[name]


def test_arrays_for_a_viewer(spark, scans):
    from echotide.sources import arrays

    extra = {"analysis_type": "curves_paramap", "analysis_kwargs": STEPS, "curve_quant_funcs": ["first_order_full"], "visualization_type": "paramap", "visualization_params": ["Mean_full_TIC"], "visualization_kwargs": {"paramap_folder_path": str(scans / "out"), "array_format": "npy"}}
    out = run(spark, scans, "a", extra)
    v, m = (images.parse_nifti((scans / p).read_bytes())[0] for p in ("scans/a.nii", "masks/a_seg.nii"))
    for name, want in (("image", v), ("segmentation-a_seg", m)):
        arrays.assemble(str(scans / f"out/{name}.npy"), str(scans / f"{name}.npy"))
        assert np.array_equal(np.load(scans / f"{name}.npy"), want)
    arrays.assemble(str(scans / "out/a_seg-Mean_full_TIC_numerical.npy"), str(scans / "map.npy"))
    grid = np.load(scans / "map.npy")
    known = {(r["sag"], r["cor"], r["ax"]): r["value"] for r in out["visuals"]["paramap"].where("value is not null").collect()}
    assert grid.shape == (6, 5, 4) and {tuple(map(int, at)) for at in np.argwhere(~np.isnan(grid))} == set(known) and all(grid[at] == np.float32(x) for at, x in known.items())


def test_decoders_of_ones_own_and_sql(spark, scans):
    """A decoder serves as a loader and in SQL text; kinds that aren't known are refused when the text is analysed."""

    @P.scan_decoder("tiny", suffixes=(".tiny",))
    def tiny(data):
        return np.frombuffer(data, np.uint8).reshape(-1, 2, 2), [1.0, 2.0], 0.5

    try:
        for name, n in (("x", 3), ("y", 2)):
            (scans / f"{name}.tiny").write_bytes(bytes(range(4 * n)))
        image = P.scan_loading_step(spark, "tiny", f"{scans}/x.tiny")
        assert image.shape == (3, 2, 2) and image.frame_rate == 0.5 and image.voxels.count() == 12
        assert P.scan_loading_step(spark, "tiny", f"{scans}/*.tiny").frames().count() == 5
        P.register_sql(spark)
        got = spark.sql(f"SELECT s.* FROM binaryFile.`{scans}/*.tiny` f, LATERAL load_scan(f.path, f.content, 'tiny') s")
        assert sorted(map(tuple, got.where("scan_id = 'y'").collect())) == [("y", t, a, s, None, float(4 * t + 2 * a + s)) for t in range(2) for a in range(2) for s in range(2)]
        meta = spark.sql(f"SELECT s.scan_id, s.shape, s.frame_rate FROM binaryFile.`{scans}/scans/*.nii` f, LATERAL load_scan(f.path, f.content, 'nifti', 'scans') s")
        assert sorted(map(tuple, meta.collect())) == [("a", [6, 5, 4, 5], 2.0), ("b", [4, 7, 3, 3], 4.0)]
        for bad in ("'none'", "'tiny', 'pixels'"):
            with pytest.raises(Exception, match="load_scan knows"):
                spark.sql(f"SELECT * FROM binaryFile.`{scans}/*.tiny` f, LATERAL load_scan(f.path, f.content, {bad}) s").collect()
        with pytest.raises(ValueError, match="already"):
            P.scan_decoder("tiny")(tiny)
    finally:
        del P.DECODERS["tiny"], P.SCAN_LOADERS.plugins["tiny"]
