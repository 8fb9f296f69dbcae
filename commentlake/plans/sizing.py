"""Size checks in front of every broadcast.

A side is broadcast only when an upper bound on its bytes is proven: its rows are
either known by construction (``bound=``: e.g. queries x 3 x limit ranked rows, or
the number of rules), or measured with one ``count()`` on a side that is small
by nature (tag dimension, query list); a row counts as wide as its columns' types
usually are, or ``width`` bytes.  Beyond the bound the plain join is
returned and Catalyst/AQE choose a shuffle join (AQE still converts it to a
broadcast at runtime when the shuffled side turns out small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_BYTES = 256 << 20


def usual_bytes(kind: T.DataType) -> int:
    """About what a value of a type takes in a broadcast table."""
    if isinstance(kind, T.StructType):
        return 16 + sum(usual_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 16 + 8 * usual_bytes(kind.elementType)
    if isinstance(kind, T.MapType):
        return 32 + 8 * (usual_bytes(kind.keyType) + usual_bytes(kind.valueType))
    return 64 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def checked_broadcast(df: DataFrame, bound: int | None = None, width: int | None = None) -> DataFrame:
    n = bound if bound is not None else df.count()
    return F.broadcast(df) if n * (width or usual_bytes(df.schema)) <= BROADCAST_MAX_BYTES else df
