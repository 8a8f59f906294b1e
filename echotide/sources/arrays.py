"""Arrays in files as tables, read and written by ranges: a Spark data source for NIfTI-1, and one for arrays of slabs.

An array is stored from its slowest axis to its fastest, so a range of the slowest axis is a range of bytes. Readers look at headers
only to plan; each partition reads its own bytes, and filters on the slowest axis drop ranges before anything is read.
Writers get a slab at a time, write it under a name of their own, and name it to the driver; its commit puts the slabs in
place, then the header, then the manifest that makes them an array. An aborted or failed write leaves nothing.

`register` makes both known to a session. Files are reached through pyarrow's file systems, on any of the stores that these know.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from echotide.sources.images import NiftiHeader, nifti_head, nifti_header, stem

#: Bytes of a partition that is read, and of a slab that is written; rows of a batch.
RANGE_BYTES, SLAB_BYTES, BATCH = 32 << 20, 32 << 20, 1 << 16
#: Axes of a scan's and a mask's file from the fastest on, by rank.
SCAN_AXES = {3: ("frame", "ax", "sag"), 4: ("sag", "cor", "ax", "frame")}
MASK_AXES = {2: ("ax", "sag"), 3: ("sag", "cor", "ax")}
MANIFEST = "manifest.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the store that Spark finds it in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_range(path: str, offset: int, size: int) -> bytes:
    """Bytes of a file from an offset on."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        f.seek(offset)
        return f.read(size)


@dataclass
class Extent(InputPartition):
    """Places [first, last) of the slowest axis, at an offset of a file; columns, from the slowest axis on, and their sizes."""

    path: str
    offset: int
    first: int
    last: int
    columns: tuple[str, ...]
    sizes: tuple[int, ...]
    dtype: str
    header: NiftiHeader | None = None
    constants: tuple[tuple[str, str], ...] = ()
    whole: bool = False

    def __post_init__(self):
        super().__init__(0)

    def values(self) -> np.ndarray:
        """Stored numbers in this range."""
        row = math.prod(self.sizes[1:]) * np.dtype(self.dtype).itemsize
        if self.whole:  # compressed, so read from its start
            fs, name = _open(self.path)
            with fs.open_input_stream(name, compression="gzip") as f:
                f.read(self.offset + self.first * row)
                data = f.read((self.last - self.first) * row)
        else:
            data = read_range(self.path, self.offset, (self.last - self.first) * row)
        raw = np.frombuffer(data, np.dtype(self.dtype))
        if len(raw) != (self.last - self.first) * math.prod(self.sizes[1:]):
            raise ValueError(f"{self.path} is cut off")
        return self.header.cast(raw) if self.header else raw


@dataclass
class Bounds:
    """What filters say of columns: a range of places, or values that a constant may have."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    among: dict[str, set] = field(default_factory=dict)

    def take(self, f: Filter) -> None:
        """Narrow by a filter, if it is one on a column. Spark still applies it to the rows."""
        name = ".".join(getattr(f, "attribute", ()))
        value = getattr(f, "value", None)
        if isinstance(f, In):
            self.among[name] = self.among.get(name, set(f.value)) & set(f.value)
            numbers = [v for v in f.value if isinstance(v, int)]
            if numbers and len(numbers) == len(f.value):
                self._range(name, min(numbers), max(numbers) + 1)
        elif isinstance(f, EqualTo) and value is not None:
            self.among[name] = self.among.get(name, {value}) & {value}
            if isinstance(value, int):
                self._range(name, value, value + 1)
        elif isinstance(value, int) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self._range(name, value + isinstance(f, GreaterThan), None)
        elif isinstance(value, int) and isinstance(f, (LessThan, LessThanOrEqual)):
            self._range(name, None, value + isinstance(f, LessThanOrEqual))

    def _range(self, name: str, low: int | None, high: int | None) -> None:
        if low is not None:
            self.low[name] = max(low, self.low.get(name, low))
        if high is not None:
            self.high[name] = min(high, self.high.get(name, high))

    def of(self, extent: Extent, most: int = RANGE_BYTES) -> Iterator[Extent]:
        """The ranges of an extent that may hold wanted rows, each of about so many bytes."""
        for name, value in extent.constants:
            if name in self.among and value not in self.among[name]:
                return
        slow, row = extent.columns[0], max(1, math.prod(extent.sizes[1:]) * np.dtype(extent.dtype).itemsize)
        first, last = max(extent.first, self.low.get(slow, extent.first)), min(extent.last, self.high.get(slow, extent.last))
        step = max(1, most // row) if not extent.whole else max(1, last - first)
        for a in range(first, last, step):
            yield Extent(extent.path, extent.offset if extent.whole else extent.offset + (a - extent.first) * row, a, min(a + step, last), extent.columns, extent.sizes, extent.dtype, extent.header, extent.constants, extent.whole)


class ArrayReader(DataSourceReader):
    """Rows of arrays, a cell each."""

    def __init__(self, extents, schema):
        self.extents, self.schema, self.bounds = extents, schema, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.bounds.take(f)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [p for e in self.extents for p in self.bounds.of(e)]

    def read(self, partition: Extent) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Extent):
            return
        e, values = partition, partition.values()
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        arrow = {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "double": pa.float64(), "float": pa.float32(), "bigint": pa.int64()}
        inner = e.sizes[1:]
        for at in range(0, len(values), BATCH):
            part = values[at : at + BATCH]
            places = dict(zip(e.columns, np.unravel_index(np.arange(at, at + len(part)), (e.last - e.first, *inner))))
            places[e.columns[0]] = places[e.columns[0]] + e.first
            known = dict(e.constants)
            columns = []
            for name, kind in kinds.items():
                if name in known:
                    columns.append(pa.array([known[name]], arrow[kind]).take(pa.array(np.zeros(len(part), np.int32))))
                elif name in places:
                    columns.append(pa.array(places[name].astype(np.int32)).cast(arrow[kind]))
                elif name in ("value", "m"):
                    columns.append(pa.array(part.astype(part.dtype.newbyteorder("="))).cast(arrow[kind], safe=False))
                else:
                    columns.append(pa.nulls(len(part), arrow[kind]))
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))


def _files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files at a path: itself, those below a folder, or those that a pattern with * in the last part matches."""
    fs, name = _open(path)
    base = path[: len(path) - len(name)] if path.endswith(name) else ""
    if "*" in name:
        import fnmatch

        folder = name.rpartition("/")[0]
        found = [i.path for i in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(i.path, name)]
    elif fs.get_file_info(name).type == pafs.FileType.Directory:
        found = [i.path for i in fs.get_file_info(pafs.FileSelector(name, recursive=True)) if i.type == pafs.FileType.File]
    else:
        found = [name]
    if isinstance(fs, pafs.LocalFileSystem):
        base = "file://"
    return [base + f for f in sorted(found) if f.endswith(suffixes)]


def _header(path: str) -> NiftiHeader:
    """A file's header, from its first 352 bytes; of a compressed one no more is unpacked."""
    if not path.endswith(".gz"):
        return nifti_header(read_range(path, 0, 352))
    fs, name = _open(path)
    with fs.open_input_stream(name, compression="gzip") as f:
        return nifti_header(f.read(352))


class NiftiReader(ArrayReader):
    """Voxels, masks or metadata of NIfTI-1 files."""

    def __init__(self, options: dict, schema):
        self.table = options.get("table", "voxels")
        transpose = options.get("transpose", "false").lower() == "true"
        by_rank = MASK_AXES if self.table == "mask" else SCAN_AXES
        extents = []
        for path in _files(options["path"], (".nii", ".nii.gz")):
            h = _header(path)
            if len(h.shape) not in by_rank:
                raise ValueError(f"{path}: {self.table} of rank {len(h.shape)}")
            columns = by_rank[len(h.shape)]
            columns = columns[::-1] if transpose else columns
            name = stem(path)
            constants = (("scan_id", options.get("scan_id", "")), ("seg_id", name.removesuffix(".nii"))) if self.table == "mask" else (("scan_id", name),)
            extents.append(Extent(path, h.offset, 0, h.shape[-1], columns[::-1], h.shape[::-1], h.dtype, h, constants, path.endswith(".gz")))
        super().__init__(extents, schema)

    def partitions(self) -> Sequence[InputPartition]:
        return self.extents if self.table == "scans" else super().partitions()

    def read(self, partition: Extent) -> Iterator:
        if self.table != "scans":
            yield from super().read(partition)
        elif isinstance(partition, Extent):
            h, size = partition.header, dict(zip(partition.columns, partition.sizes))
            order = SCAN_AXES[len(h.shape)]
            yield dict(partition.constants)["scan_id"], partition.path, len(h.shape) - 1, [int(size[c]) for c in order], [float(x) for x in h.pixdim], h.rate, "uint8"


SCHEMAS = {
    "voxels": "scan_id string, frame int, ax int, sag int, cor int, value double",
    "mask": "scan_id string, seg_id string, ax int, sag int, cor int, m smallint",
    "scans": "scan_id string, scan_path string, spatial_dims int, shape array<int>, pixdim array<double>, frame_rate double, pixel_type string",
}


class NiftiSource(DataSource):
    """Format "nifti". Options: path; table: voxels, mask or scans; transpose; scan_id of masks."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "voxels")]

    def reader(self, schema) -> DataSourceReader:
        return NiftiReader(dict(self.options), schema)


@dataclass
class Slabs(WriterCommitMessage):
    """Slabs that a task has written: number and file name."""

    names: list[tuple[int, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Writes rows (slab, cells' places, value), sorted by slab, as one file a slab."""

    def __init__(self, options: dict):
        self.path, self.columns, self.sizes = options["path"], options["columns"].split(","), [int(s) for s in options["sizes"].split(",")]
        self.length, self.dtype, self.fill = int(options["slab"]), options["dtype"], float(options.get("fill", "nan"))
        self.value, self.head, self.kind = options.get("value", "value"), options.get("head", ""), options.get("kind", "npy")
        self.work = f"{self.path.rstrip('/')}/_work-{uuid.uuid4().hex}"

    def _shape(self, slab: int) -> list[int]:
        return [min(self.length, self.sizes[0] - slab * self.length), *self.sizes[1:]]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Slabs:
        fs, work = _open(self.work)
        fs.create_dir(work, recursive=True)
        done, slab, grid = [], None, None

        def put() -> None:
            name = f"slab-{slab:08d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{work}/{name}") as f:
                f.write(grid.tobytes())
            done.append((slab, name))

        for b in iterator:
            numbers = b.column("slab").to_numpy()
            places = [b.column(c).to_numpy() for c in self.columns]
            for c, p, n in zip(self.columns, places, self.sizes):
                if len(p) and (p.min() < 0 or p.max() >= n):
                    raise ValueError(f"{c} is outside of an axis of {n}")
            values = b.column(self.value).to_numpy(zero_copy_only=False)
            for k in dict.fromkeys(numbers.tolist()):
                if k != slab:
                    if slab is not None:
                        put()
                    slab, grid = k, np.full(self._shape(k), self.fill if np.dtype(self.dtype).kind == "f" else 0, self.dtype)
                mine = numbers == k
                at = [p[mine] for p in places]
                grid[(at[0] - k * self.length, *at[1:])] = values[mine]
        if slab is not None:
            put()
        return Slabs(done)

    def commit(self, messages: list[Slabs | None]) -> None:
        fs, path = _open(self.path)
        names = dict(n for m in messages if m for n in m.names)
        # Slabs without a cell have no file; they are all fill.
        files = []
        for slab in sorted(names):
            to = f"slab-{slab:08d}"
            fs.move(f"{_open(self.work)[1]}/{names[slab]}", f"{path}/{to}")
            files.append({"slab": slab, "file": to})
        with fs.open_output_stream(f"{path}/header") as f:
            f.write(bytes.fromhex(self.head))
        self._clear()
        with fs.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps({"columns": self.columns, "sizes": self.sizes, "slab": self.length, "dtype": self.dtype, "fill": self.fill, "kind": self.kind, "slabs": files}).encode())

    def abort(self, messages: list[Slabs | None]) -> None:
        self._clear()
        fs, path = _open(self.path)
        if fs.get_file_info(path).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(path)):
            fs.delete_dir(path)

    def _clear(self) -> None:
        fs, work = _open(self.work)
        if fs.get_file_info(work).type == pafs.FileType.Directory:
            fs.delete_dir(work)


def manifest(path: str) -> dict:
    """The manifest of an array; ValueError where there is none, as after a write that didn't end."""
    fs, name = _open(path)
    if fs.get_file_info(f"{name}/{MANIFEST}").type != pafs.FileType.File:
        raise ValueError(f"no array at {path}")
    with fs.open_input_file(f"{name}/{MANIFEST}") as f:
        return json.loads(f.read())


class ArraySource(DataSource):
    """Format "array": slabs under a folder. Rows are cells that slabs hold; slabs without a cell have none."""

    @classmethod
    def name(cls) -> str:
        return "array"

    def schema(self) -> str:
        m = manifest(self.options["path"])
        return ", ".join([*(f"{c} int" for c in m["columns"]), f"value {'float' if m['dtype'] == '<f4' else 'double'}"])

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"].rstrip("/")
        m = manifest(path)
        n, length = m["sizes"][0], m["slab"]
        extents = [Extent(f"{path}/{s['file']}", 0, s["slab"] * length, min(n, (s["slab"] + 1) * length), tuple(m["columns"]), tuple(m["sizes"]), m["dtype"]) for s in m["slabs"]]
        return ArrayReader(extents, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make formats nifti and array known, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NiftiSource)
    spark.dataSource.register(ArraySource)


def read_nifti(spark: SparkSession, path: str, table: str = "voxels", transpose: bool = False, scan_id: str = "") -> DataFrame:
    """voxels, scans or mask of the NIfTI-1 files at a path, by ranges."""
    register(spark)
    return spark.read.format("nifti").options(table=table, transpose=str(transpose).lower(), scan_id=scan_id).load(qualified(spark, path))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """Cells of an array of slabs: a column per axis, and value."""
    register(spark)
    return spark.read.format("array").load(qualified(spark, path))


def _npy_head(sizes: Sequence[int], dtype: str) -> bytes:
    text = f"{{'descr': '{dtype}', 'fortran_order': False, 'shape': ({', '.join(map(str, sizes))}{',' if len(sizes) == 1 else ''}), }}"
    text += " " * (-(len(text) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(text).to_bytes(2, "little") + text.encode()


def write_array(cells: DataFrame, path: str, columns: Sequence[str], sizes: Sequence[int], kind: str = "npy", dtype: str = "<f4", value: str = "value", fill: float = math.nan, pixdim: Sequence[float] = (), frame_step: float = 0.0, slab_bytes: int = SLAB_BYTES) -> None:
    """cells as an array of slabs: header, then slabs in turn, are an .npy file (kind npy, columns from the slowest axis) or a NIfTI-1 file (kind nifti, columns from the fastest).

    Each slab meets in one task, a slab at a time. Cells that a slab lacks are `fill` (0 in whole numbers). An array that is there already is an error.
    """
    spark = cells.sparkSession
    register(spark)
    to = qualified(spark, path)
    fs, name = _open(to)
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    if kind not in ("npy", "nifti"):
        raise ValueError("kind must be 'npy' or 'nifti'")
    head = _npy_head(sizes, dtype) if kind == "npy" else nifti_head(sizes, pixdim, frame_step, dtype.lstrip("<|"))
    order, size = (list(columns), list(sizes)) if kind == "npy" else (list(columns)[::-1], list(sizes)[::-1])
    row = math.prod(size[1:]) * np.dtype(dtype).itemsize
    length = max(1, min(size[0], slab_bytes // max(1, row)))
    slabs = -(-size[0] // length)
    rows = cells.select(F.expr(f"`{order[0]}` div {length}").cast("int").alias("slab"), *(F.col(c).cast("int").alias(c) for c in order), F.col(value).cast("double").alias("value"))
    tasks = max(1, min(slabs, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows.repartition(tasks, "slab").sortWithinPartitions("slab").write.format("array").mode("append").options(
        columns=",".join(order), sizes=",".join(map(str, size)), slab=str(length), dtype=dtype, fill=str(fill), head=head.hex(), kind=kind).save(to)


def assemble(path: str, target: str) -> None:
    """One .npy or .nii file from an array of slabs, copied slab by slab."""
    m = manifest(path)
    fs, name = _open(path)
    out, to = _open(target)
    have, row = {s["slab"]: s["file"] for s in m["slabs"]}, math.prod(m["sizes"][1:])
    with out.open_output_stream(to) as f:
        with fs.open_input_file(f"{name}/header") as h:
            f.write(h.read())
        for slab in range(-(-m["sizes"][0] // m["slab"])):
            if slab in have:
                with fs.open_input_file(f"{name}/{have[slab]}") as s:
                    f.write(s.read())
            else:
                n = min(m["slab"], m["sizes"][0] - slab * m["slab"])
                f.write(np.full(n * row, m["fill"] if np.dtype(m["dtype"]).kind == "f" else 0, m["dtype"]).tobytes())
