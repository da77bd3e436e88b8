"""Compressing a table of columns into segments, one per (column, part), and back.

Rows need a dense row index. Each part is gathered once (one shuffle by part) and all its columns are encoded in
that task. In the independent mode every part is planned alone. In the adaptive mode a column's plan is carried
from part to part: raw parts are dealt by column and lane, sorted by part, and streamed through. A lane is so many
consecutive parts; a new one begins without a history, so a long column is many streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dtypes import DTYPES, DType, of_spark
from ..plans.search import Adaptive, independent
from ..plans.tree import Plan, compress, decompress
from ..shipping import ship

SEGMENTS = "column string, part int, dtype string, n_rows long, raw_bytes long, enc_bytes long, plan string, ratio double, payload binary"
_RAW = "column string, part int, dtype string, raw binary"


def column_types(df: DataFrame, index: str) -> dict[str, DType]:
    return {f.name: of_spark(f.dataType) for f in df.schema if f.name != index}


def _plain(df: DataFrame, index: str, batch: int) -> DataFrame:
    """part, row_idx and the columns, times as microseconds. Nulls are not part of the data model."""
    columns = []
    for f in df.schema:
        if f.name == index:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        columns.append(c.alias(f.name))
    i = F.col(f"`{index}`").cast("long")
    return df.select(F.floor(i / batch).cast("int").alias("part"), i.alias("row_idx"), *columns)


def _values(t: pa.Table, name: str, d: DType) -> np.ndarray:
    column = t.column(name)
    if column.null_count:
        raise ValueError(f"column {name} holds nulls; a series has none")
    return np.ascontiguousarray(column.to_numpy().astype(d.numpy, copy=False))


def _segment(column: str, part: int, d: DType, x: np.ndarray, data: bytes, plan: Plan) -> tuple:
    return column, part, d.name, len(x), x.nbytes, len(data), str(plan), plan.ratio, data


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def compress_table(df: DataFrame, index: str, batch: int = 1_000_000, mode: str = "independent", plan: Plan | None = None, lane: int = 256) -> DataFrame:
    """Segments of all columns but the index. mode: independent or adaptive, by lanes of so many parts. plan: a fixed one
    for all instead."""
    ship(df.sparkSession)
    types = column_types(df, index)
    plain = _plain(df, index, batch)

    def sorted_part(t: pa.Table) -> pa.Table:
        return t.sort_by("row_idx") if t.num_rows else t

    if mode == "adaptive" and plan is None:

        def raw(t: pa.Table) -> pa.Table:
            t = sorted_part(t)
            return _batch([(n, t.column("part")[0].as_py(), d.name, _values(t, n, d).tobytes()) for n, d in types.items()], _RAW)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stretch, state = None, None
            for b in batches:
                for name, part, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    d = DTYPES[kind]
                    if (name, part // lane) != stretch:
                        stretch, state = (name, part // lane), Adaptive(d)
                    x = np.frombuffer(data, d.numpy)
                    payload, used = state.part(x)
                    yield from _batch([_segment(name, part, d, x, payload, used)], SEGMENTS).to_batches()

        parts = plain.groupBy("part").applyInArrow(raw, _RAW)
        dealt = parts.repartition("column", F.floor(F.col("part") / lane)).sortWithinPartitions("column", "part")
        return dealt.mapInArrow(stream, SEGMENTS)

    def encode(t: pa.Table) -> pa.Table:
        t, rows = sorted_part(t), []
        part = t.column("part")[0].as_py()
        for n, d in types.items():
            x = _values(t, n, d)
            if plan is None:
                data, used = independent(x, d)
            else:
                used = plan.fixed(d)
                data = compress(used, x, d)
            rows.append(_segment(n, part, d, x, data, used))
        return _batch(rows, SEGMENTS)

    return plain.groupBy("part").applyInArrow(encode, SEGMENTS)


def decompress_table(segments: DataFrame, types: dict[str, DType], index: str = "row_idx", batch: int = 1_000_000) -> DataFrame:
    """The table again: one shuffle of payloads by part; a part's columns are decoded together, so nothing is joined."""
    ship(segments.sparkSession)
    kinds = {"char": "byte", "short": "short", "int": "int", "time": "long", "float": "float", "double": "double"}
    schema = ", ".join([f"`{index}` long", *(f"`{n}` {kinds[d.name]}" for n, d in types.items())])

    def decode(t: pa.Table) -> pa.Table:
        data = dict(zip(t.column("column").to_pylist(), t.column("payload").to_pylist(), strict=True))
        start = t.column("part")[0].as_py() * batch
        out = {n: decompress(data[n]) for n in types}
        n = len(next(iter(out.values())))
        return pa.table([pa.array(np.arange(start, start + n)), *(pa.array(v) for v in out.values())], names=[index, *out])

    wanted = segments.filter(F.col("column").isin(list(types))).select("column", "part", "payload")
    return wanted.groupBy("part").applyInArrow(decode, schema)


def write_segments(segments: DataFrame, path: str) -> None:
    """One folder per column, so reading a column reads its files only."""
    segments.write.mode("overwrite").partitionBy("column").parquet(path)


def read_segments(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*(f.split()[0] for f in SEGMENTS.split(", ")))
