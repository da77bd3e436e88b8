"""The six column types and how they map between Spark, NumPy and bit views."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T


@dataclass(frozen=True)
class DType:
    code: int
    name: str
    numpy: np.dtype
    spark: T.DataType
    #: The integer type of the same width; deltas, frames of reference and equality work on these bits.
    bits: str

    @property
    def width(self) -> int:
        return self.numpy.itemsize

    @property
    def is_float(self) -> bool:
        return self.numpy.kind == "f"


DTYPES: dict[str, DType] = {
    d.name: d
    for d in (
        DType(0, "char", np.dtype("i1"), T.ByteType(), "char"),
        DType(1, "short", np.dtype("<i2"), T.ShortType(), "short"),
        DType(2, "int", np.dtype("<i4"), T.IntegerType(), "int"),
        DType(3, "time", np.dtype("<i8"), T.LongType(), "time"),
        DType(4, "float", np.dtype("<f4"), T.FloatType(), "int"),
        DType(5, "double", np.dtype("<f8"), T.DoubleType(), "time"),
    )
}
BY_CODE = {d.code: d for d in DTYPES.values()}


def of_spark(kind: T.DataType) -> DType:
    """The column type of a Spark type; raises for what has none (strings, decimals, nested types)."""
    for d in DTYPES.values():
        if isinstance(kind, type(d.spark)):
            return d
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return DTYPES["time"]
    raise TypeError(f"no column type for {kind.simpleString()}")


def bit_view(x: np.ndarray) -> np.ndarray:
    """x with the same bits as integers."""
    return x.view(f"<i{x.dtype.itemsize}") if x.dtype.kind == "f" else x
