"""Image files as voxel and mask tables: NIfTI-1, uncompressed AVI, uncompressed DICOM.

Spark lists and reads the files (binaryFile, so any store it knows), one task per file at a time; the header
parsers are small NumPy helpers. Layouts: 2-D over time is (time, ax, sag), 3-D over time is (sag, cor, ax, time).
"""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: NIfTI-1 data types by code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
_VOXELS = "scan_id string, frame int, ax int, sag int, cor int, value double"
_SCANS = "scan_id string, scan_path string, spatial_dims int, shape array<int>, pixdim array<double>, frame_rate double, pixel_type string"


def stem(path: str) -> str:
    """A file's name without its last suffix."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass(frozen=True)
class NiftiHeader:
    """What a NIfTI-1 header says: the file's axes from the fastest on, how its numbers are stored and scaled, mm per cell, seconds per frame (1 where it has none)."""

    shape: tuple[int, ...]
    dtype: str
    offset: int
    slope: float
    inter: float
    pixdim: tuple[float, ...]
    rate: float

    def cast(self, raw: np.ndarray) -> np.ndarray:
        """Stored numbers as unsigned bytes."""
        if self.slope not in (0.0, 1.0) or (self.slope and self.inter):
            raw = raw * self.slope + self.inter
        return raw.astype(np.uint8)


def nifti_header(data: bytes) -> NiftiHeader:
    """The header that the first 352 bytes are."""
    order = next((o for o in "<>" if len(data) >= 352 and struct.unpack(f"{o}i", data[:4])[0] == 348), None)
    if order is None:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(f"{order}8h", data[40:56])
    kind = struct.unpack(f"{order}h", data[70:72])[0]
    if kind not in NIFTI_TYPES:
        raise ValueError(f"NIfTI data type {kind} isn't supported")
    zoom = struct.unpack(f"{order}8f", data[76:108])
    offset, slope, inter = struct.unpack(f"{order}3f", data[108:120])
    rate = 1 / zoom[4] if dim[0] >= 4 and zoom[4] > 0 else 1.0
    return NiftiHeader(tuple(dim[1 : dim[0] + 1]), order + NIFTI_TYPES[kind], int(offset), slope, inter, tuple(float(z) for z in zoom[1 : min(dim[0], 3) + 1]), float(rate))


def parse_nifti(data: bytes, transpose: bool = False) -> tuple[np.ndarray, list[float], float]:
    """Voxels as unsigned bytes, mm per cell, seconds per frame (1 where the header has none)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    h = nifti_header(data)
    voxels = h.cast(np.frombuffer(data, np.dtype(h.dtype), int(np.prod(h.shape)), h.offset).reshape(h.shape, order="F"))
    return (voxels.T if transpose else voxels), list(h.pixdim), h.rate


def nifti_head(shape: Sequence[int], pixdim: Sequence[float], frame_step: float = 0.0, dtype: str = "u1") -> bytes:
    """The header of a NIfTI-1 file, 352 bytes."""
    head, code = bytearray(352), next(k for k, t in NIFTI_TYPES.items() if t == dtype)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<2h", head, 70, code, 8 * np.dtype(dtype).itemsize)
    struct.pack_into("<8f", head, 76, 1.0, *pixdim, *([frame_step] if len(shape) == 4 else []), *[0.0] * (7 - len(pixdim) - (len(shape) == 4)))
    struct.pack_into("<f", head, 108, 352.0)
    head[344:348] = b"n+1\0"
    return bytes(head)


def write_nifti(voxels: np.ndarray, pixdim: list[float], frame_step: float = 0.0) -> bytes:
    """A NIfTI-1 file of unsigned bytes."""
    return nifti_head(voxels.shape, pixdim, frame_step) + np.asfortranarray(voxels.astype(np.uint8)).tobytes(order="F")


def parse_avi(data: bytes, luma: tuple[float, float, float] = (0.114, 0.587, 0.299)) -> tuple[np.ndarray, float]:
    """Gray frames (time, ax, sag) of an uncompressed 24-bit or 8-bit AVI, and seconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    step, width, height, bits, frames = 0.0, 0, 0, 0, []

    def walk(at: int, end: int) -> None:
        nonlocal step, width, height, bits
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if body + size > len(data):
                raise ValueError("AVI file is cut off")
            if name in (b"LIST", b"RIFF"):
                walk(body + 4, body + size)
            elif name == b"avih":
                step = struct.unpack_from("<I", data, body)[0] / 1e6
            elif name == b"strf" and not width:
                _, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, body)
                if packed or bits not in (8, 24):
                    raise ValueError("only uncompressed AVI is read here; give a decoder for others")
            elif name[2:4] in (b"db", b"dc") and size:
                line = (width * bits // 8 + 3) // 4 * 4
                image = np.frombuffer(data, np.uint8, line * abs(height), body).reshape(abs(height), line)[:, : width * bits // 8]
                frames.append(image[::-1] if height > 0 else image)
            at = body + size + size % 2

    walk(12, len(data))
    if not frames:
        raise ValueError("AVI file without frames")
    cine = np.stack(frames)
    if bits == 24:
        bgr = cine.reshape(len(cine), abs(height), width, 3).astype(float)
        cine = np.rint(bgr[..., 2] * luma[0] + bgr[..., 1] * luma[1] + bgr[..., 0] * luma[2]).astype(np.uint8)
    return cine, step or 1.0


#: Explicit value representations with a four-byte length.
_LONG_VR = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN")


def parse_dicom(data: bytes, luma: tuple[float, float, float] = (0.114, 0.587, 0.299)) -> tuple[np.ndarray, list[float], float]:
    """Gray frames (time, ax, sag), mm per cell [ax, sag], seconds per frame, of an uncompressed explicit little-endian file."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    found: dict[tuple[int, int], bytes] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            tag = struct.unpack_from("<HH", data, at)
            if tag[0] == 0xFFFE:  # items of a sequence
                size = struct.unpack_from("<I", data, at + 4)[0]
                at += 8
                if tag == (0xFFFE, 0xE000) and size != 0xFFFFFFFF:
                    walk(at, at + size)
                    at += size
                continue
            vr = data[at + 4 : at + 6]
            size, at = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if vr in _LONG_VR else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
            if vr == b"SQ" or size == 0xFFFFFFFF:
                if tag == (0x7FE0, 0x0010):
                    raise ValueError("compressed pixel data isn't read here")
                if size != 0xFFFFFFFF:
                    walk(at, at + size)
                    at += size
                continue
            found.setdefault(tag, data[at : at + size])
            at += size

    walk(132, len(data))
    us = lambda g, e, default=None: struct.unpack("<H", found[g, e][:2])[0] if (g, e) in found else default
    text = lambda g, e, default: found[g, e].decode("ascii").strip("\0 ") if (g, e) in found else default
    rows, columns, samples = us(0x28, 0x10), us(0x28, 0x11), us(0x28, 0x02, 1)
    n = int(text(0x28, 0x08, "1"))
    pixels = np.frombuffer(found[0x7FE0, 0x0010], np.uint8, n * rows * columns * samples).reshape(n, rows, columns, samples)
    cine = pixels[..., 0] if samples == 1 else np.rint(pixels.astype(float) @ np.array(luma)).astype(np.uint8)
    spacing = [abs(struct.unpack("<d", found[0x18, e])[0]) if (0x18, e) in found else 1.0 for e in (0x602E, 0x602C)]
    return cine, spacing, float(text(0x18, 0x1063, "1000")) / 1000


def frame_rows(scan: str, cine: np.ndarray) -> Iterator[pd.DataFrame]:
    """Voxel rows, frame by frame."""
    volume = cine.ndim == 4
    n = cine.shape[3] if volume else cine.shape[0]
    for frame in range(n):
        grid = cine[..., frame] if volume else cine[frame]
        at = np.indices(grid.shape).reshape(grid.ndim, -1)
        ax, sag, cor = (at[2], at[0], at[1]) if volume else (at[0], at[1], None)
        yield pd.DataFrame({"scan_id": scan, "frame": frame, "ax": ax, "sag": sag, "cor": cor if volume else pd.array([None] * at.shape[1], "Int32"), "value": grid.ravel().astype(float)})


def _read(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").rlike("(" + "|".join(map(re.escape, suffixes)) + ")$"))


def decoder_of(kind: str, decoder: Callable | None = None, **options) -> Callable[[bytes], tuple[np.ndarray, list[float], float]]:
    """What turns a file's bytes into (frames, mm per cell, seconds per frame)."""
    if decoder:
        return decoder
    if kind == "nifti":
        return lambda data: parse_nifti(data, options.get("transpose", False))
    if kind == "avi":
        def avi(data):
            cine, rate = parse_avi(data)
            return cine, [options.get("pix_height_mm", 1.0), options.get("pix_width_mm", 1.0)], rate
        return avi
    if kind == "dicom":
        return parse_dicom
    raise ValueError(f"reading {kind} needs a decoder: a function from bytes to (frames, mm per cell, seconds per frame)")


SUFFIXES = {"nifti": (".nii", ".nii.gz"), "avi": (".avi",), "mp4": (".mp4",), "dicom": ("",)}


def read_scans(spark: SparkSession, path: str, kind: str = "nifti", decoder: Callable | None = None, files: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(scans, voxels) of the files below a path. files: a listing to use instead (path, content)."""
    source = (_read(spark, path, SUFFIXES[kind]) if files is None else files).select("path", "content")
    decode = decoder_of(kind, decoder, **options)

    def scans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                cine, pixdim, rate = decode(data)
                yield pd.DataFrame({"scan_id": [stem(p)], "scan_path": [p], "spatial_dims": [cine.ndim - 1], "shape": [list(cine.shape)], "pixdim": [pixdim], "frame_rate": [rate], "pixel_type": [cine.dtype.name]})

    def voxels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                yield from frame_rows(stem(p), decode(data)[0])

    return source.mapInPandas(scans, _SCANS), source.mapInPandas(voxels, _VOXELS)


def largest_file(files: DataFrame, prefix: str = "A") -> DataFrame:
    """Of files whose name starts with a prefix, the largest; the first path of equals."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.where(name.startswith(prefix)).orderBy(F.desc("length"), "path").limit(1)


def read_dicom_folder(spark: SparkSession, folder: str, prefix: str = "A", decoder: Callable | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(scans, voxels) of the largest file of a folder whose name starts with a prefix. Contents of others aren't read.

    decoder reads what parse_dicom doesn't: compressed pixels and implicit value representations.
    """
    listing = spark.read.format("binaryFile").load(folder)
    chosen = largest_file(listing.select("path", "length"), prefix).first()
    if chosen is None:
        raise ValueError(f"no file in {folder} starts with {prefix}")
    return read_scans(spark, chosen["path"], "dicom", decoder, **options)


def read_masks(spark: SparkSession, path: str, scan_id: str, files: DataFrame | None = None) -> DataFrame:
    """Dense masks (scan_id, seg_id, ax, sag, cor, m) of NIfTI files: 2-D (ax, sag) or 3-D (sag, cor, ax)."""
    source = (_read(spark, path, SUFFIXES["nifti"]) if files is None else files).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                grid = parse_nifti(data)[0]
                at = np.indices(grid.shape).reshape(grid.ndim, -1)
                seg = stem(p).removesuffix(".nii")
                ax, sag, cor = (at[0], at[1], pd.array([None] * at.shape[1], "Int32")) if grid.ndim == 2 else (at[2], at[0], at[1])
                yield pd.DataFrame({"scan_id": scan_id, "seg_id": seg, "ax": ax, "sag": sag, "cor": cor, "m": grid.ravel().astype("int16")})

    return source.mapInPandas(rows, "scan_id string, seg_id string, ax int, sag int, cor int, m smallint")
