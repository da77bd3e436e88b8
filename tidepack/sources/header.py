"""Header files: one line `name,type,decimals` per column."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..functions.dtypes import DTYPES, DType, of_spark


def parse_header(text: str) -> T.StructType:
    """The schema; a name that was used before gets _2, _3 and so on. decimals are kept as field metadata."""
    fields, used = [], set()
    for line in filter(None, map(str.strip, text.splitlines())):
        name, kind, *rest = [p.strip() for p in line.split(",")]
        if kind not in DTYPES:
            raise ValueError(f"unknown type {kind} of column {name}")
        unique, k = name, 1
        while unique in used:
            k += 1
            unique = f"{name}_{k}"
        used.add(unique)
        fields.append(T.StructField(unique, DTYPES[kind].spark, False, {"decimals": int(rest[0]) if rest and rest[0] else 0, "type": kind}))
    return T.StructType(fields)


def render_header(schema: T.StructType) -> str:
    lines = (f"{f.name},{f.metadata.get('type') or of_spark(f.dataType).name},{f.metadata.get('decimals', 0)}" for f in schema)
    return "\n".join(lines) + "\n"


def read_header(spark: SparkSession, path: str) -> T.StructType:
    """From any file system that Spark reads; a header is a few lines."""
    return parse_header("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_header(spark: SparkSession, schema: T.StructType, path: str) -> None:
    spark.createDataFrame([(render_header(schema).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def dtypes_of(schema: T.StructType) -> dict[str, DType]:
    return {f.name: of_spark(f.dataType) for f in schema}
