"""Vector column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Dot product of two array<float|double> columns, summed in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_normalize(v) -> Column:
    """Unit-length vector (array<double>); a zero vector stays zero."""
    v = _c(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def _valid_bits(a: pa.Array) -> pa.Buffer:
    return pa.array(a.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_vector(blob: pa.Array) -> pa.Array:
    """float32 little-endian bytes -> array<float>.  The bytes of a batch
    are one buffer, so they are taken over whole with their offsets divided."""
    if not len(blob):
        return pa.array([], pa.list_(pa.float32()))
    bits, at = _valid_bits(blob), blob.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(at.buffers()[1], np.int32)[at.offset:at.offset + len(at) + 1]
    if (np.diff(ends) % 4).any():
        raise ValueError("a vector blob is no whole number of float32 values")
    data = np.frombuffer(at.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].tobytes()
    return pa.Array.from_buffers(pa.list_(pa.float32()), len(at),
                                 [bits, pa.py_buffer(((ends - ends[0]) // 4).astype(np.int32))],
                                 children=[pa.array(np.frombuffer(data, "<f4"))])


@F.arrow_udf(T.BinaryType())
def encode_vector(vec: pa.Array) -> pa.Array:
    """B11 inverse: array<float> -> float32 little-endian bytes."""
    if not len(vec):
        return pa.array([], pa.binary())
    ends = vec.offsets.to_numpy()
    data = vec.values.to_numpy(zero_copy_only=False).astype("<f4")[ends[0]:ends[-1]].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(vec), [_valid_bits(vec), pa.py_buffer(
        ((ends - ends[0]) * 4).astype(np.int32)), pa.py_buffer(data)])
