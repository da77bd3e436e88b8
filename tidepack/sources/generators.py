"""Seeded test series over spark.range. Random draws depend on the seed and the row alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _unit(seed: int, *more: int) -> Column:
    """In (0, 1], from the row's number."""
    return (F.pmod(F.xxhash64(F.lit(seed), *map(F.lit, more), "row_idx"), F.lit(1 << 53)) + 1) / float(1 << 53)


def rows(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n).withColumnRenamed("id", "row_idx")


def random_floats(seed: int = 1) -> Column:
    return _unit(seed).cast("float")


def random_doubles(seed: int = 1) -> Column:
    return _unit(seed)


def random_ints(low: int = 100, high: int = 1000, seed: int = 1) -> Column:
    """In [low, high)."""
    return (F.pmod(F.xxhash64(F.lit(seed), "row_idx"), F.lit(high - low)) + low).cast("int")


def consecutive(start: int = 0, step: int = 1) -> Column:
    return F.lit(start) + F.col("row_idx") * step


def random_stencil(seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "row_idx"), F.lit(2)).cast("int")


def floats_of_precision(digits: int, seed: int = 1) -> Column:
    """Each with up to so many digits behind the point."""
    scale = F.pow(F.lit(10.0), F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "row_idx"), F.lit(digits + 1)))
    return (F.floor(_unit(seed) * scale) / scale).cast("float")


def _turns(k: Column, low: float, high: float, step: float) -> Column:
    """low plus k steps on a way that turns a step beyond either bound, where values then are the bounds."""
    up = int((high - low) // step) + 1  # steps until it is above
    way = 2 * up + 1
    at = k % way
    return F.greatest(F.lit(low), F.least(F.lit(high), F.when(at <= up, low + at * step).otherwise(low + (2 * up - at) * step)))


def staircase(length: int = 1000, step: float = 10, low: float = 0, high: float = 1_000_000) -> Column:
    """A stair of `length` rows a step, that climbs and falls between the bounds; each begins with a spike to high."""
    k = F.floor((F.col("row_idx") + length - 1) / length)
    return F.when(F.col("row_idx") % length == 0, F.lit(high)).otherwise(_turns(k, low, high, step))


def zigzag(length: int, low: float = -10_000, high: float = 10_000, seed: int = 1) -> Column:
    """For `length` rows, high less and low plus a small draw by turns; then for as many a valley."""
    i = F.col("row_idx")
    draw, at, step = F.pmod(F.xxhash64(F.lit(seed), "row_idx"), F.lit(6)), i % length, (high - low) // (length / 2)
    return F.when(F.floor(i / length) % 2 == 0, F.when(i % 2 == 0, high - draw).otherwise(low + draw)).otherwise(F.when(at < length / 2, high - at * step).otherwise(high - (length - at) * step))


def time_steps(df: DataFrame, start: int = 0, flatness: float = 0.5, batch: int = 1_000_000, seed: int = 1, name: str = "x") -> DataFrame:
    """Times that stay with probability `flatness` or go on by 1 or 2. Sums are by batch of rows; what the batches
    before it add up to is a window over one row a batch."""
    grow = F.when(_unit(seed) > flatness, 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "row_idx"), F.lit(2))).otherwise(F.lit(0))
    df = df.withColumn("_b", F.floor(F.col("row_idx") / batch)).withColumn("_g", grow)
    sums = df.groupBy("_b").agg(F.sum("_g").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_g").over(Window.partitionBy("_b").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_in", inside).join(sums, "_b").withColumn(name, F.lit(start) + F.col("_before") + F.col("_in")).drop("_b", "_g", "_in", "_before")


def outliers(df: DataFrame, probability: float, step: float = 1, low: float = 0, high: float = 1_000_000, batch: int = 1_000_000, seed: int = 1, name: str = "x") -> DataFrame:
    """A ramp, that turns at the bounds and goes on only on rows that are no outliers; outliers are near high. Ramps
    begin anew in each batch."""
    out = _unit(seed) < probability
    w = Window.partitionBy(F.floor(F.col("row_idx") / batch)).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_out", out).withColumn("_k", F.coalesce(F.sum((~F.col("_out")).cast("int")).over(w), F.lit(0)))
    near = high + F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "row_idx"), F.lit(20)) - 10
    return df.withColumn(name, F.when(F.col("_out"), near).otherwise(_turns(F.col("_k"), low, high, step))).drop("_out", "_k")


#: The header of generate()'s table.
HEADER = "TIME,time,0\nPATTERN_A_INT,int,0\nPATTERN_B_INT,int,0\nFLOAT_PREC_4,float,4\nPATTERN_A_FLOAT,float,6\nPATTERN_B_FLOAT,float,6\n"


def generate(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """row_idx and six columns of the kinds above."""
    df = time_steps(rows(spark, n), 1_400_000_000, 0.05, seed=seed, name="TIME")
    return df.select(
        "row_idx",
        F.col("TIME").cast("long").alias("TIME"),
        staircase(10, 10, 0, 1_000_000).cast("int").alias("PATTERN_A_INT"),
        zigzag(100_000, 0, 1_000_000, seed).cast("int").alias("PATTERN_B_INT"),
        floats_of_precision(4, seed).alias("FLOAT_PREC_4"),
        staircase(10, 0.01, 0.0, 1e3).cast("float").alias("PATTERN_A_FLOAT"),
        zigzag(1_000_000, 0, 10_000_000, seed).cast("float").alias("PATTERN_B_FLOAT"),
    )
