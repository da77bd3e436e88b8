"""Codecs as SQL functions: arrays to compressed values and back, bit fields of floats, segments as rows.

They run on Arrow batches. `register(spark)` makes them known to SQL as encode_blob, decode_blob, float_bits, bits_float
and decode_segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.search import independent
from ..plans.tree import Plan, compress, decompress
from .dtypes import DTYPES


def _encoder(dtype: str, plan: str | None):
    d = DTYPES[dtype]
    fixed = Plan.parse(plan).fixed(d) if plan else None

    def encode(column: pa.Array) -> pa.Array:
        def one(v: pa.ListScalar):
            if not v.is_valid:
                return None
            if v.values.null_count:
                raise ValueError("an array holds nulls; a series has none")
            x = v.values.to_numpy(zero_copy_only=False).astype(d.numpy, copy=False)
            return compress(fixed, x, d) if fixed else independent(x, d)[0]

        return pa.array([one(v) for v in column], pa.binary())

    return F.arrow_udf(encode, T.BinaryType())


def encode_blob(values: Column, dtype: str = "double", plan: str | None = None) -> Column:
    """Arrays of numbers as compressed binaries; plan: a fixed plan, else the best within the rules."""
    return _encoder(dtype, plan)(values)


def _decoder(dtype: str):
    d = DTYPES[dtype]
    kind = pa.list_(pa.from_numpy_dtype(d.numpy))

    def decode(column: pa.Array) -> pa.Array:
        parts = [None if b is None else decompress(b).astype(d.numpy, copy=False) for b in column.to_pylist()]
        ends = np.cumsum([0, *(0 if p is None else len(p) for p in parts)])
        values = np.concatenate([np.zeros(0, d.numpy), *(p for p in parts if p is not None)])
        empty = pa.array([p is None for p in parts], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind.value_type), mask=empty)

    return F.arrow_udf(decode, T.ArrayType(d.spark))


def decode_blob(data: Column, dtype: str = "double") -> Column:
    return _decoder(dtype)(data)


def _view(x: Column, numpy: str, kind: pa.DataType, spark: T.DataType) -> Column:
    def view(column: pa.Array) -> pa.Array:
        return pa.array(column.fill_null(0).to_numpy(zero_copy_only=False).view(numpy), kind, mask=np.array(column.is_null()))

    return F.arrow_udf(view, spark)(x)


def float_bits(x: Column) -> Column:
    """The 32 bits of a float as an integer; sign, exponent and mantissa follow by bit_fields."""
    return _view(x.cast("float"), "i4", pa.int32(), T.IntegerType())


def bits_float(bits: Column) -> Column:
    return _view(bits.cast("int"), "f4", pa.float32(), T.FloatType())


def double_bits(x: Column) -> Column:
    return _view(x.cast("double"), "i8", pa.int64(), T.LongType())


def bits_double(bits: Column) -> Column:
    return _view(bits.cast("long"), "f8", pa.float64(), T.DoubleType())


def bit_fields(bits: Column) -> Column:
    """sign, exponent, mantissa of a float's bits."""
    b = bits.cast("long")
    return F.struct(F.shiftright(b, 31).bitwiseAND(F.lit(1)).alias("sign"), F.shiftright(b, 23).bitwiseAND(F.lit(255)).alias("exponent"), b.bitwiseAND(F.lit(0x7FFFFF)).alias("mantissa"))


class DecodeSegment:
    """A segment's values as rows (at, value, whole): value as a double; whole, for integers, exactly. Row by
    row, since SQL allows no Arrow table function in a lateral join; decode_blob and explode stay in Arrow."""

    def eval(self, payload):
        if payload is not None:
            for i, v in enumerate(decompress(bytes(payload)).tolist()):
                yield i, float(v), None if isinstance(v, float) else v


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.udf.register("encode_blob", _encoder("double", None))
    spark.udf.register("decode_blob", _decoder("double"))
    spark.udtf.register("decode_segment", F.udtf(DecodeSegment, returnType="at int, value double, whole long"))
