"""What the operators share: reading tables, cutting lineage, shipping the package, byte words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as send

#: Documents that a Python stage handles at once, and about how many bytes of text: the memory bound of a worker.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Rows in one Arrow batch between the JVM and a worker.
ARROW_ROWS = 1000
#: Folders that materialize wrote.
_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidepack-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: lineage is cut, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepack-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    out = spark.read.parquet(path)
    out._tidepack_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, and nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._tidepack_path)


def clean(spark: SparkSession) -> None:
    """Deletes all that materialize wrote in this session: for callers, once they have written an operator's result."""
    for path in list(_written):
        _delete(spark, path)


def forget(spark: SparkSession) -> None:
    """Lets the JVM find out which finished shuffles nothing refers to any more, so that their files are deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the executors' Python workers, and their batches of rows small."""
    send(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of bounded rows and bytes; one long text may make a piece of its own."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i in range(batch.num_rows):
            n = len(sizes[i].as_buffer()) if sizes[i].is_valid else 0
            if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


def trim() -> None:
    """Gives the memory that a worker has freed back to the system: workers stay, for tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that extra columns with other meanings can't clash."""
    return df.select(*[df[n] for n in names])




def sample_rows(df: DataFrame, draw: Column, n: int, total: int) -> DataFrame:
    """The n rows with the smallest draws (longs of a hash), of about `total` rows. Rows whose draw is not among the
    smallest four times as many are left out first, so what tasks send on does not grow with their number."""
    if total > 4 * n:
        df = df.filter(F.pmod(draw, F.lit(1 << 40)) < int((1 << 40) * 4 * n / total))
    return df.orderBy(F.pmod(draw, F.lit(1 << 40)), draw).limit(n)
