"""Table layouts of the engine. Long form inside; wide form only at sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCAN = "scan_id string, scan_path string, spatial_dims int, shape array<int>, pixdim array<double>, frame_rate double, original_pixdim array<double>"
VOXEL = "scan_id string, frame int, ax int, sag int, cor int, value double"
MASK = "scan_id string, seg_id string, ax int, sag int, cor int, m smallint"
CURVE = "scan_id string, seg_id string, window_ix int, curve_name string, frame int, time_s double, value double"
QUANT = "scan_id string, seg_id string, window_ix int, key string, value double"
PARAMAP = "scan_id string, seg_id string, param string, ax int, sag int, cor int, value float"

#: A curve's identity, and a region's.
CURVE_KEY = ["scan_id", "seg_id", "window_ix", "curve_name"]
ROI = ["scan_id", "seg_id"]


def axes(dims: int) -> list[str]:
    """Spatial columns, axial first: the order that numbers windows."""
    if dims not in (2, 3):
        raise ValueError("image data must be 2-D or 3-D over time")
    return ["ax", "sag", "cor"][:dims]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or ValueError where it lacks columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
