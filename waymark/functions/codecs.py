"""Binary columns of map stores: poses (12 float32), descriptors and calibrations, decoded in Arrow batches at ingest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _floats(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(bytes(b), dtype="<f4").astype("f8").tolist())


@F.pandas_udf(T.BinaryType())
def encode_floats(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def decode_pose(blob: Column, strict: bool = True) -> Column:
    """12 numbers, row-major 3x4; null for other lengths and, if strict, for all zeros."""
    ok = F.octet_length(blob) == 48 if strict else F.octet_length(blob) >= 48
    values = _floats(F.when(ok, F.substring(blob, 1, 48)))
    return F.when(F.exists(values, lambda x: x != 0), values) if strict else values


def decode_descriptor(blob: Column, size: int) -> Column:
    """The first ``size`` float32 numbers; null for shorter blobs."""
    return F.when(F.octet_length(blob) >= 4 * size, F.slice(_floats(blob), 1, size))


#: Fixed layout of a calibration blob, little-endian, 164 bytes: three version numbers, type, width and height, four matrix sizes, the
#: size of the local transform, the 3x3 camera matrix in doubles, and the local transform in floats.
CALIBRATION = np.dtype([("version", "<i4", 3), ("type", "<i4"), ("size", "<i4", 2), ("sizes", "<i4", 4), ("local_size", "<i4"), ("k", "<f8", 9), ("local", "<f4", 12)])
INTRINSICS = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("fx", "fy", "cx", "cy")), *(T.StructField(c, T.IntegerType()) for c in ("width", "height"))])
#: Where fx, fy, cx and cy stand in the camera matrix.
PLACES = (0, 4, 2, 5)


@F.pandas_udf(INTRINSICS)
def _intrinsics(blobs: pd.Series) -> pd.DataFrame:
    empty = bytes(CALIBRATION.itemsize)
    known = blobs.notna().to_numpy()
    rows = np.frombuffer(b"".join(bytes(b) if ok else empty for b, ok in zip(blobs, known)), dtype=CALIBRATION)
    out = pd.DataFrame({c: rows["k"][:, at] for c, at in zip(("fx", "fy", "cx", "cy"), PLACES)})
    return out.assign(width=rows["size"][:, 0], height=rows["size"][:, 1])


def decode_calibration(blob: Column) -> Column:
    """fx, fy, cx, cy, width, height of a calibration blob; null for one of another length or with a value that isn't
    positive."""
    whole = F.octet_length(blob) == CALIBRATION.itemsize
    k = _intrinsics(F.when(whole, blob))
    good = F.least(*[k[c].cast("double") for c in INTRINSICS.names]) > 0
    return F.when(whole & good, k)


@F.pandas_udf(T.BinaryType())
def encode_calibration(fx: pd.Series, fy: pd.Series, cx: pd.Series, cy: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """The blob of a pinhole camera without distortion, whose local transform is none."""
    rows = np.zeros(len(fx), dtype=CALIBRATION)
    rows["size"] = np.c_[width, height]
    rows["sizes"], rows["local_size"] = (9, 0, 0, 0), 12
    for c, at in zip((fx, fy, cx, cy), PLACES):
        rows["k"][:, at] = c
    rows["k"][:, 8] = 1
    rows["local"][:, [0, 5, 10]] = 1
    return pd.Series([r.tobytes() for r in rows])
