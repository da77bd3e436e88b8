"""CSV and fixed-width binary files with a dense row index."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.dtypes import of_spark
from ..shipping import ship
from .header import parse_header


def with_row_index(df: DataFrame, order: list[str], index: str = "row_idx") -> DataFrame:
    """A dense index in the given order, without a window over all rows: rows are range-partitioned by the order,
    counted by partition, and numbered within it. The counts are one row per partition. The sorted rows stay persisted, for
    the caller to read once or often: df.sparkSession.catalog.clearCache() lets go of them."""
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions(*order).persist()
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = ranged.withColumn("_i", place).join(F.broadcast(starts), "_p")
    return out.select((F.col("_start") + F.col("_i")).alias(index), *df.columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, index: str = "row_idx") -> DataFrame:
    """Comma-separated lines without a title line, numbered in file order: by file, then by place in the file. Nothing is
    shuffled but one row per block of a file, as scans cut them: lines are counted by block, and ids of a scan grow by one
    from line to line of a block. Both scans must cut files alike, else an error is raised."""
    lines = spark.read.csv(path, schema=schema, mode="FAILFAST")
    lines = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_at") - F.col("_least")
    number = F.when(place.between(0, F.col("_n") - 1), F.col("_start") + place).otherwise(F.raise_error(F.lit("files were cut in another way while they were numbered")))
    return lines.join(blocks, ["_file", "_block"], "left").select(number.alias(index), *schema.names)


def write_csv(df: DataFrame, path: str, schema: T.StructType, index: str = "row_idx") -> None:
    """Lines in index order, floating point values with the columns' decimals."""
    columns = []
    for f in schema:
        digits = f.metadata.get("decimals", 0)
        c = F.col(f"`{f.name}`")
        columns.append(c.cast(T.DecimalType(38, digits)).alias(f.name) if of_spark(f.dataType).is_float else c)
    df.repartitionByRange(index).sortWithinPartitions(index).select(*columns).write.mode("overwrite").csv(path)


def record_type(schema: T.StructType, padding: int = 0) -> np.dtype:
    kinds = [(f.name, of_spark(f.dataType).numpy) for f in schema]
    return np.dtype(kinds + ([("padding", f"V{padding}")] if padding else []))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, n: int, start: int):
        self.path, self.first, self.n, self.start = path, first, n, start


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str], record: np.dtype, split: int):
        self.schema, self.paths, self.record, self.split = schema, paths, record, split

    def partitions(self):
        out, start = [], 0
        for path in self.paths:
            n, rest = divmod(os.path.getsize(path), self.record.itemsize)
            if rest:
                raise ValueError(f"{path} ends within a record of {self.record.itemsize} bytes")
            per = max(1, self.split // self.record.itemsize)
            out += [_Range(path, k, min(per, n - k), start + k) for k in range(0, n, per)]
            start += n
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        step = 1 << 16
        for at in range(0, part.n, step):
            n = min(step, part.n - at)
            rows = np.fromfile(part.path, self.record, n, offset=(part.first + at) * self.record.itemsize)
            names = [f.name for f in self.schema][1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part.start + at), *(pa.array(np.ascontiguousarray(rows[c])) for c in names)], names=[self.schema[0].name, *names])


class _Message(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceArrowWriter):
    """Files of a run have its name behind their partition's, and `.part` until the run is committed; then those of
    earlier runs go if it overwrites."""

    def __init__(self, path: str, names: list[str], record: np.dtype, overwrite: bool):
        self.path, self.names, self.record, self.overwrite, self.run = path, names, record, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{task.partitionId():06d}-{self.run}-{task.taskAttemptId()}.bin"
        with open(os.path.join(self.path, f"{name}.part"), "wb") as f:
            for batch in batches:
                block = np.zeros(batch.num_rows, self.record)
                for n in self.names:
                    column = batch.column(batch.schema.get_field_index(n))
                    if column.null_count:
                        raise ValueError(f"column {n} holds nulls; a series has none")
                    block[n] = column.to_numpy(zero_copy_only=False)
                f.write(block.tobytes())
        return _Message(name)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        old = glob.glob(os.path.join(self.path, "*.bin"))
        for m in messages:
            os.replace(os.path.join(self.path, f"{m.name}.part"), os.path.join(self.path, m.name))
        for path in [*(old if self.overwrite else ()), *glob.glob(os.path.join(self.path, f"*-{self.run}-*.part"))]:
            os.remove(path)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        for path in glob.glob(os.path.join(self.path, f"*-{self.run}-*.part")):
            os.remove(path)


class FixedWidth(DataSource):
    """Format `fixedwidth` with the options path (on a file system that all executors mount), header (text of a header
    file), padding (bytes behind each record) and split (bytes of a partition). Reading adds row_idx, which follows
    from a record's offset, so files are split without counting. Files are read in the order of their names."""

    @classmethod
    def name(cls) -> str:
        return "fixedwidth"

    def _columns(self) -> T.StructType:
        return parse_header(self.options["header"])

    def _record(self) -> np.dtype:
        return record_type(self._columns(), int(self.options.get("padding", 0)))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("row_idx", T.LongType(), False), *self._columns().fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path = self.options["path"].removeprefix("file://")
        paths = sorted(glob.glob(os.path.join(path, "*.bin"))) if os.path.isdir(path) else [path]
        return _Reader(self.schema(), paths, self._record(), int(self.options.get("split", 64 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].removeprefix("file://"), [f.name for f in self._columns()], self._record(), overwrite)


def read_binary(spark: SparkSession, path: str, header: str, padding: int = 0, split: int = 64 << 20) -> DataFrame:
    ship(spark)
    spark.dataSource.register(FixedWidth)
    return spark.read.format("fixedwidth").options(header=header, padding=padding, split=split).load(path)


def write_binary(df: DataFrame, path: str, header: str, padding: int = 0, index: str = "row_idx") -> None:
    """One file per partition of a range-partitioned table, so names keep the order of the index. Replaces what is there."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(FixedWidth)
    ordered = df.repartitionByRange(index).sortWithinPartitions(index)
    ordered.write.format("fixedwidth").options(header=header, padding=padding).mode("overwrite").save(path)
