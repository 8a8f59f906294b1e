"""Step functions, and whole runs from YAML or a dict. All steps stay lazy until a sink."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from echotide.operators import curves as C
from echotide.operators import fit, paramap, preprocess, quantify, texture, windows
from echotide.plans import study
from echotide.plans.registry import Registry, check_arguments, check_suffix
from echotide.plans.study import Study
from echotide.sources import arrays, images, tables

SCAN_LOADERS, SEG_LOADERS, CURVE_LOADERS = Registry("scan loader"), Registry("mask loader"), Registry("curve loader")
SCAN_STEPS, SEG_STEPS = Registry("scan preprocessing"), Registry("mask preprocessing")
CURVE_TYPES, ANALYSES, QUANTIFIERS, VISUALS = Registry("curve type"), Registry("analysis"), Registry("quantification"), Registry("visualization")


@dataclass(frozen=True)
class Image:
    """A scan: metadata on the driver, voxels as a table. size, pixdim in the order of the file's axes."""

    scan_id: str
    voxels: DataFrame
    shape: tuple[int, ...]
    pixdim: tuple[float, ...]
    frame_rate: float = 1.0
    original_pixdim: tuple[float, ...] | None = None
    pixel_type: str = "uint8"

    @property
    def dims(self) -> int:
        return len(self.shape) - 1

    @property
    def frames(self) -> int:
        return self.shape[0] if self.dims == 2 else self.shape[3]

    @property
    def size(self) -> list[int]:
        """Cells per axis, in the order ax, sag, cor."""
        return list(self.shape[1:]) if self.dims == 2 else [self.shape[2], self.shape[0], self.shape[1]]


@dataclass(frozen=True)
class Analysis:
    """Curves, and the windows that they are of."""

    curves: DataFrame
    windows: DataFrame | None = None
    mask: DataFrame | None = None
    step: tuple[int, ...] | DataFrame = ()
    image: Image | Study | None = None


def _loader(kind: str):
    def load(spark: SparkSession, path: str, **options) -> Image | Study:
        """One scan, or a study where the path matches several. NIfTI is read by ranges, unless a decoder or a listing of files is given."""
        if kind == "dicom":
            scans, voxels = images.read_dicom_folder(spark, path, **options)
        elif kind == "nifti" and not set(options) - {"transpose"}:
            scans, voxels = (arrays.read_nifti(spark, path, table, options.get("transpose", False)) for table in ("scans", "voxels"))
        else:
            scans, voxels = images.read_scans(spark, path, kind, **options)
        return _found(scans, voxels, path)

    return load


def _found(scans: DataFrame, voxels: DataFrame, path: str) -> Image | Study:
    found = scans.limit(2).collect()
    if not found:
        raise ValueError(f"nothing to read at {path}")
    if len(found) > 1:
        return study.study_of(scans, voxels)
    s = found[0]
    return Image(s["scan_id"], voxels, tuple(s["shape"]), tuple(s["pixdim"]), s["frame_rate"], pixel_type=s["pixel_type"])


#: Decoders of a user's own, by kind: bytes of a file to (frames, mm per cell, seconds per frame).
DECODERS: dict[str, Callable] = {}


def scan_decoder(kind: str, suffixes: Sequence[str] = ()):
    """Decorator that registers a decoder as a scan loader, and as a kind that SQL's load_scan knows from the next `register_sql` on."""

    def register(f: Callable) -> Callable:
        if kind in DECODERS or kind in ("nifti", "avi", "dicom"):
            raise ValueError(f"decoder {kind} is registered already")

        def load(spark: SparkSession, path: str, **_) -> Image | Study:
            return _found(*images.read_scans(spark, path, kind, f, files=spark.read.format("binaryFile").load(path)), path)

        SCAN_LOADERS.add(kind, suffixes=suffixes)(load)
        DECODERS[kind] = f
        return f

    return register


def register_sql(spark: SparkSession) -> None:
    """Make load_scan(path, content, kind, what) known to SQL: rows of 'voxels' (by default) or 'scans' of a file's bytes, as in
    SELECT s.* FROM binaryFile.`scans/*.nii` f, LATERAL load_scan(f.path, f.content, 'nifti') s
    """
    decoders, schemas = dict(DECODERS), {what: StructType.fromDDL(arrays.SCHEMAS[what]) for what in ("voxels", "scans")}

    class LoadScan:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, kind: AnalyzeArgument, what: AnalyzeArgument | None = None) -> AnalyzeResult:
            table = what.value if what is not None else "voxels"
            if not kind.isConstantExpression or kind.value not in (*decoders, "nifti", "avi", "dicom") or table not in ("voxels", "scans"):
                raise ValueError(f"load_scan knows the kinds {', '.join(sorted((*decoders, 'nifti', 'avi', 'dicom')))}, and voxels or scans of them")
            return AnalyzeResult(schemas[table])

        def eval(self, path: str, content: bytes, kind: str, what: str = "voxels"):
            if content is None:
                return
            cine, pixdim, rate = images.decoder_of(kind, decoders.get(kind))(bytes(content))
            name = images.stem(path or "")
            if what == "scans":
                yield name, path, cine.ndim - 1, list(map(int, cine.shape)), list(map(float, pixdim)), float(rate), cine.dtype.name
                return
            for pdf in images.frame_rows(name, cine):
                yield from zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in pdf.columns))

    spark.udtf.register("load_scan", udtf(LoadScan))


SCAN_LOADERS.add("nifti", suffixes=(".nii", ".nii.gz"))(_loader("nifti"))
SCAN_LOADERS.add("avi", suffixes=(".avi",))(_loader("avi"))
SCAN_LOADERS.add("mp4", required=("decoder",), suffixes=(".mp4",))(_loader("mp4"))
SCAN_LOADERS.add("custom_dicom")(_loader("dicom"))


#: In a study, what of a mask's name is its scan's: all of it, or what stands before _seg or _mask.
SCAN_OF_MASK = "^(.*?)(?:_(?:seg|mask).*)?$"


@SEG_LOADERS.add("nifti", suffixes=(".nii", ".nii.gz"))
def _nifti_mask(spark: SparkSession, image: Image | Study, path: str, scan_of_mask: str = SCAN_OF_MASK, **_) -> DataFrame:
    """Masks of the scan; in a study, each is the scan's that the first group of scan_of_mask finds in its name."""
    if isinstance(image, Image):
        return arrays.read_nifti(spark, path, "mask", scan_id=image.scan_id)
    return arrays.read_nifti(spark, path, "mask").withColumn("scan_id", F.regexp_extract("seg_id", scan_of_mask, 1))


@SEG_LOADERS.add("load_bolus_mask", suffixes=(".nii", ".nii.gz"))
def _bolus_mask(spark: SparkSession, image: Image, path: str, **_) -> DataFrame:
    """A mask over time: one mask by maximum, cropped to the image, holes filled."""
    one_scan(image, "load_bolus_mask")
    files = spark.read.format("binaryFile").load(path)
    _, cells = images.read_scans(spark, path, "nifti", files=files, transpose=True)
    over_time = cells.select(F.lit(image.scan_id).alias("scan_id"), F.col("scan_id").alias("seg_id"), "ax", "sag", "cor", F.col("value").cast("smallint").alias("m"))
    return preprocess.bolus_mask(over_time, image.size[2], "cor")


@CURVE_LOADERS.add("load_ttc_curves", suffixes=(".csv",))
def _curves_csv(spark: SparkSession, path: str, **_) -> DataFrame:
    return tables.load_curves(spark, path)


def one_scan(image: Image | Study, what: str) -> None:
    if not isinstance(image, Image):
        raise ValueError(f"{what} takes one scan, not a study")


@SCAN_STEPS.add("standardize")
def _standardize(image: Image | Study, arr_to_standardize: str = "both", **_) -> Image:
    if arr_to_standardize not in ("both", "intensities", "pixel_data"):
        raise ValueError("arr_to_standardize must be 'both', 'intensities' or 'pixel_data'")
    wanted = {"both": ("value", "pixel"), "intensities": ("value",), "pixel_data": ("pixel",)}[arr_to_standardize]
    out = replace(image, voxels=preprocess.standardize(image.voxels, [c for c in wanted if c in image.voxels.columns]))
    return replace(out, pixel_type="float64") if isinstance(out, Image) else replace(out, scans=out.scans.withColumn("pixel_type", F.lit("float64")))


def _spacing(values: Sequence[float], dims: int) -> list[float]:
    """Spacings per axis in the order ax, sag, cor, from a file's order."""
    return list(values[:2]) if dims == 2 else [values[2], values[0], values[1]]


@SCAN_STEPS.add("resample", required=("target_vox_size", "interp"))
def _resample(image: Image | Study, target_vox_size: Sequence[float], interp: str = "linear", **_) -> Image | Study:
    if isinstance(image, Study):
        return study.resample(image, target_vox_size, interp)
    old, new = _spacing(image.pixdim, image.dims), _spacing(target_vox_size, image.dims)
    voxels = preprocess.resample(image.voxels.drop("cor") if image.dims == 2 else image.voxels, image.size, old, new, interp)
    voxels = preprocess.to_pixel_type(voxels, image.pixel_type)
    sizes = [preprocess.new_size(n, o, w) for n, o, w in zip(image.size, old, new)]
    shape = (image.shape[0], *sizes) if image.dims == 2 else (sizes[1], sizes[2], sizes[0], image.shape[3])
    return replace(image, voxels=voxels, shape=shape, pixdim=tuple(target_vox_size[: image.dims]), original_pixdim=image.original_pixdim or image.pixdim)


@SEG_STEPS.add("resample", required=("target_vox_size", "interp"))
def _resample_mask(image: Image | Study, mask: DataFrame, target_vox_size: Sequence[float], interp: str = "nearest", **_) -> DataFrame:
    if isinstance(image, Study):
        return study.resample_masks(image, mask, target_vox_size, interp)
    old = image.original_pixdim or image.pixdim
    names = ["ax", "sag", "cor"][: image.dims]
    top = mask.agg(*(F.max(c).alias(c) for c in names)).first()
    return preprocess.resample_mask(mask.select("scan_id", "seg_id", *names, "m"), [top[c] + 1 for c in names], _spacing(old, image.dims), _spacing(target_vox_size, image.dims), interp=interp)


CURVE_TYPES.add("tic")(lambda image, **_: C.tic)
CURVE_TYPES.add("firstorder")(lambda image, **_: texture.radiomics_first_order)


@CURVE_TYPES.add("pyradiomics", required=("pyradiomics_config_paths", "min_intensity", "binwidth"))
def _radiomics(image: Image | Study, pyradiomics_config_paths: Sequence[str], min_intensity: float, binwidth: float, **_) -> C.FrameType:
    """Features of each frame, named by configuration file. Features that aren't known raise ValueError before any work."""
    import yaml

    if isinstance(pyradiomics_config_paths, str):
        raise ValueError("pyradiomics_config_paths must be a list of paths")
    spark = image.voxels.sparkSession
    configs = [(images.stem(p), yaml.safe_load("\n".join(r[0] for r in spark.read.option("wholetext", True).text(p).collect())) or {}) for p in pyradiomics_config_paths]
    make = lambda spacing, size: texture.Radiomics(configs, float(min_intensity), float(binwidth), math.prod(spacing), image.dims, size, spacing)
    out = make(_spacing(image.pixdim, image.dims), image.size) if isinstance(image, Image) else study.per_geometry(image, make)
    out.names()
    return out


def frame_curve_type(name: str, curve_names: Sequence[str], *, required: Sequence[str] = ()):
    """Decorator that registers a function of arrays as a curve type: (frame, mask, **arguments) gives names and values. Arguments are the analysis's own."""

    def register(f):
        CURVE_TYPES.add(name, required=required)(lambda image, **options: C.FrameFunction(f, tuple(curve_names), options))
        return f

    return register


def _both(image: Image | Study, types: Sequence, columns, tables_of) -> DataFrame:
    """Curves of types over values and of those over whole frames; a name that two of them give is an error."""
    over_frames = [t for t in types if isinstance(t, C.FrameType)]
    names = [n for t in over_frames for n in t.names()]
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate curve names: {sorted({n for n in names if names.count(n) > 1})}")
    over_values = [t for t in types if not isinstance(t, C.FrameType)]
    parts = ([columns(over_values)] if over_values else []) + [tables_of(t) for t in over_frames]
    return reduce(DataFrame.unionByName, parts)


@ANALYSES.add("curves")
def _roi(image: Image | Study, mask: DataFrame, types, **_) -> Analysis:
    """A frame without a result repeats the one before it."""
    if isinstance(image, Study):
        frames, rate = image.frames(), 1.0
    else:
        frames, rate = image.voxels.sparkSession.range(image.frames).select(F.lit(image.scan_id).alias("scan_id"), F.col("id").cast("int").alias("frame")), image.frame_rate
    found = _both(image, types, lambda t: C.roi_curves(image.voxels, mask, image.dims, t, rate, frames), lambda t: C.roi_texture(image.voxels, mask, image.dims, t.curves, t.names(), rate, frames, getattr(t, "around", False)))
    filled = C.fill_gaps(found)
    return Analysis(image.timed(filled) if isinstance(image, Study) else filled, mask=mask, image=image)


@ANALYSES.add("curves_paramap", required=("ax_vox_len", "sag_vox_len", "cor_vox_len", "ax_vox_ovrlp", "sag_vox_ovrlp", "cor_vox_ovrlp"))
def _windowed(image: Image | Study, mask: DataFrame, types, axis_res: Sequence[float] | None = None, **k) -> Analysis:
    """Resolutions are pixdim in its own order (ax, sag, cor), unless axis_res names them."""
    names = ["ax", "sag", "cor"][: image.dims]
    lengths, overlaps, many = [k[f"{c}_vox_len"] for c in names], [k[f"{c}_vox_ovrlp"] for c in names], isinstance(image, Study)
    step = study.steps(image, lengths, overlaps, axis_res) if many else tuple(windows.steps(lengths, overlaps, axis_res or image.pixdim))
    rate = 1.0 if many else image.frame_rate
    found = _both(image, types, lambda t: C.window_curves(image.voxels, mask, step, t, rate), lambda t: C.window_texture(image.voxels, mask, step, t.curves, rate))
    return Analysis(image.timed(found) if many else found, windows.window_grid(mask, step), mask, step, image)


@QUANTIFIERS.add("first_order_full")
def _q_full(curves: DataFrame, done: dict, **_) -> DataFrame:
    return quantify.first_order_full(curves)


@QUANTIFIERS.add("first_order_select")
def _q_select(curves: DataFrame, done: dict, start_time: float = 0.0, end_time: float | None = None, **_) -> DataFrame:
    return quantify.first_order_select(curves, start_time, end_time)


@QUANTIFIERS.add("lognormal_fit_full", required=("curves_to_fit",))
def _q_fit(curves: DataFrame, done: dict, curves_to_fit: Sequence[str], **_) -> DataFrame:
    return fit.lognormal_fit_full(curves, curves_to_fit)


@QUANTIFIERS.add("lognormal_fit_select", required=("curves_to_fit",))
def _q_fit_select(curves: DataFrame, done: dict, curves_to_fit: Sequence[str], start_time: float = 0.0, end_time: float | None = None, **_) -> DataFrame:
    return fit.lognormal_fit_select(curves, curves_to_fit, start_time, end_time)


@QUANTIFIERS.add("wash_rates", required=("tic_name", "curves_to_fit"), depends=("lognormal_fit_full",))
def _q_wash(curves: DataFrame, done: dict, tic_name: str, n_frames_to_analyze: int | None = None, **_) -> DataFrame:
    return quantify.wash_rates(curves, quantify.peaks(done["lognormal_fit_full"], tic_name), n_frames_to_analyze)


@QUANTIFIERS.add("dte", required=("tic_name",))
def _q_dte(curves: DataFrame, done: dict, tic_name: str, **_) -> DataFrame:
    return quantify.dte(curves, tic_name)


@QUANTIFIERS.add("cmus_firstorder", required=("tic_name",), depends=("lognormal_fit_full",))
def _q_cmus(curves: DataFrame, done: dict, tic_name: str, **_) -> DataFrame:
    return quantify.cmus_first_order(curves, quantify.peaks(done["lognormal_fit_full"], tic_name), tic_name)


@QUANTIFIERS.add("auc_no_fit", required=("tic_name",))
def _q_auc(curves: DataFrame, done: dict, tic_name: str, **_) -> DataFrame:
    return quantify.auc_no_fit(curves, tic_name)


@VISUALS.add("paramap")
def _v_paramap(analysis: Analysis, quants: DataFrame, params: Sequence[str] | None = None, **_) -> DataFrame:
    maps = paramap.paramap(quants, analysis.mask, analysis.windows, analysis.step, params or None)
    return paramap.trim(maps, analysis.mask, windows.dims_of(analysis.step), params or None)


@VISUALS.add("plot_tics")
def _v_tics(analysis: Analysis, quants: DataFrame, start_time: float = 0.0, end_time: float | None = None, **_) -> DataFrame:
    return C.mean_curve(analysis.curves, start_time, end_time)


def scan_loading_step(spark: SparkSession, scan_type: str, scan_path: str, **options) -> Image | Study:
    loader = SCAN_LOADERS.get(scan_type)
    check_suffix(loader, scan_path)
    check_arguments([loader], options)
    return loader.run(spark, scan_path, **options)


def scan_preprocessing_step(names: Sequence[str] | None, image: Image | Study, **options) -> Image | Study:
    steps = SCAN_STEPS.chosen(names)
    check_arguments(steps, options)
    for s in steps:
        image = s.run(image, **options)
    return image


def seg_loading_step(spark: SparkSession, seg_type: str, image: Image | Study, seg_path: str, **options) -> DataFrame:
    loader = SEG_LOADERS.get(seg_type)
    check_suffix(loader, seg_path)
    check_arguments([loader], options)
    return loader.run(spark, image, seg_path, **options)


def seg_preprocessing_step(names: Sequence[str] | None, image: Image | Study, mask: DataFrame, **options) -> DataFrame:
    steps = SEG_STEPS.chosen(names)
    check_arguments(steps, options)
    for s in steps:
        mask = s.run(image, mask, **options)
    return mask


def analysis_step(analysis_type: str, image: Image | Study, mask: DataFrame, functions: Sequence[str], **options) -> Analysis:
    """Coronal arguments aren't asked for in 2-D."""
    analysis, types = ANALYSES.get(analysis_type), CURVE_TYPES.chosen(functions)
    check_arguments([analysis, *types], options, ("cor_vox_len", "cor_vox_ovrlp") if image.dims == 2 else ())
    return analysis.run(image, mask, [t.run(image, **options) for t in types], **options)


def load_curves_step(spark: SparkSession, path: str, loader: str = "load_ttc_curves", **options) -> Analysis:
    plugin = CURVE_LOADERS.get(loader)
    return Analysis(plugin.run(spark, path, **options))


def curve_quantification_step(analysis: Analysis, names: Sequence[str] | None = None, output_path: str | None = None, **options) -> DataFrame:
    """Long results of the named functions (all, if none are named) and of what they depend on."""
    plugins = QUANTIFIERS.ordered(names or sorted(QUANTIFIERS.plugins))
    check_arguments(plugins, options)
    done: dict[str, DataFrame] = {}
    for p in plugins:
        done[p.name] = p.run(analysis.curves, done, **options)
    out = None
    for d in done.values():
        out = d if out is None else out.unionByName(d)
    if output_path:
        keys = [r[0] for r in out.select("key").distinct().orderBy("key").collect()]
        tables.save_quants(out, output_path, keys, analysis.windows)
    return out


def visualization_step(analysis: Analysis, quants: DataFrame, visual: str = "paramap", params: Sequence[str] | None = None, functions: Sequence[str] | None = None, **options) -> dict[str, DataFrame]:
    """Tables by name. Nothing is written when all is hidden or no folder is named."""
    plugins = [VISUALS.get(visual), *VISUALS.chosen(functions)]
    check_arguments(plugins, options)
    out = {p.name: p.run(analysis, quants, params=params, **options) for p in plugins}
    folder = options.get("paramap_folder_path")
    if folder and not options.get("hide_all_visualizations", False):
        for name, d in out.items():
            (d.write.partitionBy("param") if "param" in d.columns else d.write).parquet(f"{folder}/{name}")
        if isinstance(analysis.image, Study):
            tables.export_images(analysis.image.voxels, analysis.mask, analysis.image.scans, folder)
        elif analysis.image is not None:
            tables.export_image(analysis.image.voxels, analysis.mask, analysis.image.scan_id, analysis.image.pixdim, folder)
            if options.get("array_format") == "npy":
                _export_arrays(analysis, out, folder)
    return out


def _export_arrays(analysis: Analysis, out: Mapping[str, DataFrame], folder: str) -> None:
    """What a viewer loads as arrays: image, segmentation, and each map; in the order of the file's axes, by slabs."""
    image = analysis.image
    columns, space = (("frame", "ax", "sag"), ("ax", "sag")) if image.dims == 2 else (("sag", "cor", "ax", "frame"), ("sag", "cor", "ax"))
    sizes = [image.shape[columns.index(c)] for c in space]
    arrays.write_array(image.voxels, f"{folder}/image.npy", columns, image.shape, dtype="|u1" if image.pixel_type == "uint8" else "<f4")
    for s in [r[0] for r in analysis.mask.select("seg_id").distinct().collect()]:
        arrays.write_array(analysis.mask.where(F.col("seg_id") == s), f"{folder}/segmentation-{s}.npy", space, sizes, dtype="|u1", value="m")
        for name, d in out.items():
            if "param" in d.columns:
                for p in [r[0] for r in d.select("param").distinct().collect()]:
                    arrays.write_array(d.where((F.col("seg_id") == s) & (F.col("param") == p) & F.col("value").isNotNull()), f"{folder}/{s}-{p}_numerical.npy", space, sizes)


def main_dict(spark: SparkSession, config: Mapping) -> dict:
    """A run from a configuration: from a scan and a mask, or from saved curves. Null entries count as empty."""
    c = {k: v for k, v in config.items() if v is not None}
    part = partial(c.get)
    if "curves_path" in c:
        analysis = load_curves_step(spark, c["curves_path"], part("curves_loader", "load_ttc_curves"), **part("curves_loader_kwargs", {}))
    else:
        # All names and arguments are looked at before anything is read.
        check_arguments(SCAN_STEPS.chosen(part("scan_preproc_funcs")), part("scan_preproc_kwargs", {}))
        check_arguments(SEG_STEPS.chosen(part("seg_preproc_funcs")), part("seg_preproc_kwargs", {}))
        check_arguments(QUANTIFIERS.ordered(part("curve_quant_funcs", ())), part("curve_quant_kwargs", {}))
        ANALYSES.get(c["analysis_type"])
        CURVE_TYPES.chosen(part("analysis_funcs"))
        image = scan_loading_step(spark, c["scan_loader"], c["scan_path"], **part("scan_loader_kwargs", {}))
        image = scan_preprocessing_step(part("scan_preproc_funcs"), image, **part("scan_preproc_kwargs", {}))
        mask = seg_loading_step(spark, c["seg_loader"], image, c["seg_path"], **part("seg_loader_kwargs", {}))
        mask = seg_preprocessing_step(part("seg_preproc_funcs"), image, mask, **part("seg_preproc_kwargs", {}))
        analysis = analysis_step(c["analysis_type"], image, mask, part("analysis_funcs", ["tic"]), **part("analysis_kwargs", {}))
        if path := part("analysis_kwargs", {}).get("curves_output_path"):
            names = [r[0] for r in analysis.curves.select("curve_name").distinct().orderBy("curve_name").collect()]
            tables.save_curves(analysis.curves, path, names, analysis.windows)
    out: dict = {"analysis": analysis}
    if part("curve_quant_funcs"):
        out["quants"] = curve_quantification_step(analysis, c["curve_quant_funcs"], part("curve_quant_output_path"), **part("curve_quant_kwargs", {}))
        if analysis.windows is not None and part("visualization_type"):
            out["visuals"] = visualization_step(analysis, out["quants"], c["visualization_type"], part("visualization_params"), part("custom_visualization_funcs"), **part("visualization_kwargs", {}))
    return out


def main_yaml(spark: SparkSession, path: str) -> dict:
    """As main_dict, from a YAML file that Spark can read."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    return main_dict(spark, yaml.safe_load(text))


def main_cli(argv: Sequence[str] | None = None) -> dict:
    """Command line: a YAML file, or entries as name=JSON."""
    import argparse
    import json

    parser = argparse.ArgumentParser(description="Curves, quantification and parametric maps of a scan")
    parser.add_argument("config", nargs="?", help="YAML file")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=JSON", help="an entry of the configuration")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    entries = {k: json.loads(v) for k, _, v in (x.partition("=") for x in args.set)}
    return main_yaml(spark, args.config) if args.config and not entries else main_dict(spark, entries)


if __name__ == "__main__":
    main_cli()
