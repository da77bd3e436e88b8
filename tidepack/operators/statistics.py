"""Statistics, histograms and size predictions: aggregates by part, with partial aggregation before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blobs
from ..functions.dtypes import of_spark
from ..functions.transforms import bit_length, wrap, wrapping_difference
from .relational import lookahead, ordered, whole


def data_statistics(df: DataFrame, width: int, window: int = 2) -> DataFrame:
    """part, size, low, high, min_bits, mean, sorted, runs, and for floating point values digits, the most decimals that
    one needs. One sort by part serves all windows."""
    digits = [F.max(precision(F.col("x"))).alias("digits")] if of_spark(df.schema["x"].dataType).is_float else []
    rows = lookahead(df, window).withColumns({"falls": (F.col("x") > F.lead("x").over(ordered())).cast("int"), "at": F.row_number().over(ordered()), "n": F.count("*").over(whole())})
    runs = F.avg(F.when(F.col("at") <= F.col("n") - window, F.col("same")))
    out = rows.groupBy("part").agg(
        F.count("*").alias("size"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.avg("x").alias("mean"),
        (F.coalesce(F.max("falls"), F.lit(0)) == 0).alias("sorted"),
        F.coalesce(runs, F.lit(1.0)).alias("runs"),
        *digits,
    )
    return out.withColumn("min_bits", bit_length(F.col("low"), F.col("high"), width))


def dense_histogram(df: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: equal widths, the highest value alone on top; empty buckets are 0. The bounds are one row."""
    bounds = df.agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    rows = df.join(F.broadcast(bounds))
    bucket = F.when(F.col("high") == F.col("low"), 0).otherwise(F.floor((F.col("x") - F.col("low")) * ((buckets - 1) / (F.col("high") - F.col("low"))))).cast("int")
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sparse_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("x").agg(F.count("*").alias("n"))


def integer_histogram(df: DataFrame) -> DataFrame:
    """x, n for every integer from the smallest to the largest."""
    bounds = df.agg(F.min("x").cast("long").alias("a"), F.max("x").cast("long").alias("b")).filter("a is not null")
    low, high = next(((r.a, r.b) for r in bounds.collect()), (0, -1))
    every = df.sparkSession.range(low, high + 1).select(F.col("id").alias("x"))
    return every.join(sparse_histogram(df).select(F.col("x").cast("long").alias("x"), "n"), "x", "left").select("x", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bucket_of(x: Column, low, high, buckets: int) -> Column:
    return F.floor((x - low) * (F.lit(float(buckets)) / (high - low))).cast("int")


def most_frequent(df: DataFrame, k: int) -> DataFrame:
    return sparse_histogram(df).orderBy(F.col("n").desc(), "x").limit(k)


def precision(x: Column, most: int = 10) -> Column:
    """Decimal digits that a double needs: the first p at which it is a whole number of 10 ** -p."""
    out = F.lit(most)
    for p in range(most - 1, -1, -1):
        out = F.when(F.rint(x * float(10**p)) / float(10**p) == x, F.lit(p)).otherwise(out)
    return out


def _words(n: Column, values: Column) -> Column:
    """Bytes of n codes among so many values."""
    bits = F.length(F.bin(F.greatest(values - 1, F.lit(0)).cast("long")))
    return 4 * F.ceil(n / F.floor(F.lit(32) / bits))


def predicted_sizes(df: DataFrame, width: int, kind: str = "int") -> DataFrame:
    """part, encoding, meta, size: bytes of metadata and output of each encoding, without encoding."""
    w = F.lit(width)
    counts = df.groupBy("part", "x").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("n").desc(), "x"))
    values = counts.withColumn("rank", rank).groupBy("part").agg(
        F.sum("n").alias("n"), F.count("*").alias("u"), F.max("n").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.sum(F.when(F.col("rank") <= 4, F.col("n"))).alias("t"),
    )
    runs = df.withColumn("new", F.coalesce((F.col("x") != F.lag("x").over(ordered())).cast("int"), F.lit(1))).groupBy("part").agg(F.sum("new").alias("r"))
    s = values.join(runs, "part")
    n, u, t, k = F.col("n"), F.col("u"), F.col("t"), F.least(F.col("u"), F.lit(4))
    mask = F.ceil(n / 8) + 1
    bits = bit_length(F.col("low"), F.col("high"), width)
    sizes = {
        "none": (F.lit(8), n * w),
        "delta": (w, (n - 1) * w),
        "scale": (w, n * w),
        "rle": (F.lit(4), F.col("r") * (w + 4)),
        "const": (mask + w, w * (n - F.col("c"))),
        "dict": (mask, 16 + F.ceil(k * w / 4) * 4 + _words(t, k) + w * (n - t)),
        "unique": (16 + u * w, _words(n, u)),
        "patch": (mask, n * w),
        "afl": (F.lit(4), F.ceil(bits * n / (8 * width)) * w),
    }
    if kind in ("float", "double"):
        del sizes["afl"]
        sizes["floatToInt"] = (F.lit(4), n * 4)
    rows = F.array(*(F.struct(F.lit(e).alias("encoding"), m.cast("long").alias("meta"), b.cast("long").alias("size")) for e, (m, b) in sizes.items()))
    return s.select("part", F.explode(rows).alias("r")).select("part", "r.*")


def predicted_float_sizes(df: DataFrame) -> DataFrame:
    """part, encoding, meta, size of the encodings that look at the bits of floating point values: afl and gfc."""
    kind = of_spark(df.schema["x"].dataType)
    w, wide, chunk = kind.width, 32, 2048
    bits = blobs.double_bits(F.col("x")) if kind.name == "double" else blobs.float_bits(F.col("x"))
    rows = df.select("part", "row_idx", bits.cast("long").alias("b")).withColumn("place", F.row_number().over(ordered()) - 1)
    at, first = F.col("place") % chunk, Window.partitionBy("part", F.floor(F.col("place") / chunk))
    rows = rows.withColumn("source", F.max(F.when(at == wide - 1, F.col("b"))).over(first))
    diff = wrapping_difference(F.col("b"), F.when(at < wide, F.lit(0)).otherwise(F.col("source")).cast("long"))
    diff = diff if w == 8 else wrap(diff, 32)
    lowest = -(1 << (8 * w - 1))
    size = F.when(diff == lowest, F.lit(8 * w)).when(diff == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(F.when(diff == lowest, F.lit(0)).otherwise(diff)))))
    used = F.ceil(size / 8)
    used = F.when(used == 2, 3).otherwise(used) if w == 8 else used  # three bits tell no two bytes apart from three
    field = blobs.bit_fields(F.col("b"))
    out = rows.withColumns({"used": used, "f": field}).groupBy("part").agg(
        F.count("*").alias("n"), F.sum("used").alias("used"), F.min("b").alias("low"), F.max("b").alias("high"),
        F.min("f.sign").alias("s0"), F.max("f.sign").alias("s1"), F.max("f.exponent").alias("e"), F.max("f.mantissa").alias("m"),
    )
    n, length = F.col("n"), lambda c: F.length(F.bin(F.col(c)))
    gfc = (F.lit(12), 4 * F.ceil(n / chunk) + F.ceil(n / 2) + F.col("used"))
    if w == 4:
        mask = F.when(F.col("s0") == F.col("s1"), 0).otherwise(F.ceil(n / 8) + 1)
        afl = (mask + 9, 4 * F.ceil(n * length("e") / 32) + 4 * F.ceil(n * length("m") / 32))
    else:
        afl = (F.lit(4), F.ceil(bit_length(F.col("low"), F.col("high"), 8) * n / 64) * 8)
    both = [F.struct(F.lit(e).alias("encoding"), m.cast("long").alias("meta"), s.cast("long").alias("size")) for e, (m, s) in (("afl", afl), ("gfc", gfc))]
    return out.select("part", F.explode(F.array(*both)).alias("r")).select("part", "r.*")


def best_single(sizes: DataFrame) -> DataFrame:
    """part, encoding, total: the smallest of predicted_sizes, with 8 bytes for the node and 16 for its leaf; ties
    by name."""
    total = F.col("meta") + F.col("size") + F.when(F.col("encoding") == "none", 8).otherwise(24)
    best = sizes.groupBy("part").agg(F.min(F.struct(total.alias("total"), F.col("encoding"))).alias("b"))
    return best.select("part", "b.encoding", "b.total")


