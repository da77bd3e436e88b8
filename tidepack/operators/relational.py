"""The encodings and array primitives as DataFrame operations.

Frames have the columns part, row_idx (dense within the series) and x. Everything that depends on neighbours is
a window partitioned by part, so parts are spread over the cluster and no window spans the series.

Series hold no nulls: encodings refuse them. Integers wrap at their width, as in C. Deltas and frames of reference of
floating point values are those of their bits, which decoding is told by `kind` (float or double).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import blobs
from ..functions.dtypes import of_spark
from ..functions.transforms import wrap, wrapping_difference, wrapping_sum

#: Aggregates that reduce() knows.
REDUCTIONS = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor}

def whole() -> WindowSpec:
    return Window.partitionBy("part")


def ordered() -> WindowSpec:
    return whole().orderBy("row_idx")


def up_to_here() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def series(df: DataFrame, index: str, x: Column, batch: int = 1000) -> DataFrame:
    """part, row_idx, x from a table with a dense index."""
    i = F.col(index).cast("long")
    return df.select(F.floor(i / batch).cast("int").alias("part"), i.alias("row_idx"), x.alias("x"))


def whole_series(df: DataFrame) -> DataFrame:
    """df, where a null in x is an error."""
    x = F.when(F.col("x").isNull(), F.raise_error(F.lit("x holds nulls; a series has none")).cast(df.schema["x"].dataType)).otherwise(F.col("x"))
    return df.withColumn("x", x)


def _integers(df: DataFrame) -> DataFrame:
    """Without nulls, and floating point values as their bits."""
    kind = of_spark(df.schema["x"].dataType)
    df = whole_series(df)
    if not kind.is_float:
        return df
    return df.withColumn("x", blobs.double_bits(F.col("x")) if kind.name == "double" else blobs.float_bits(F.col("x")))


def _values(df: DataFrame, kind: str | None) -> DataFrame:
    if kind not in ("float", "double"):
        return df
    return df.withColumn("x", blobs.bits_double(F.col("x")) if kind == "double" else blobs.bits_float(F.col("x")))


# --- scans -----------------------------------------------------------------------------------------------------


def prefix_sum(df: DataFrame, inclusive: bool = True) -> DataFrame:
    return df.withColumn("s", F.coalesce(F.sum("x").over(up_to_here() if inclusive else before()), F.lit(0)))


def adjacent_difference(df: DataFrame) -> DataFrame:
    return df.withColumn("d", F.col("x") - F.lag("x").over(ordered()))


def lookahead(df: DataFrame, window: int = 2) -> DataFrame:
    """same: how many values from each on, up to window, equal it without a gap."""
    same, out = F.lit(True), F.lit(1)
    for k in range(1, window):
        same = same & F.coalesce(F.lead("x", k).over(ordered()) == F.col("x"), F.lit(False))
        out = out + same.cast("int")
    return df.withColumn("same", out)


# --- encodings -------------------------------------------------------------------------------------------------


def delta_encode(df: DataFrame) -> DataFrame:
    """x becomes its difference to the value before; the first of a part stays."""
    df = _integers(df)
    kind = of_spark(df.schema["x"].dataType)
    x, last = F.col("x").cast("long"), F.coalesce(F.lag("x").over(ordered()), F.lit(0)).cast("long")
    return df.withColumn("x", wrapping_difference(x, last) if kind.width == 8 else wrap(x - last, 8 * kind.width).cast(kind.spark))


def delta_decode(df: DataFrame, kind: str | None = None) -> DataFrame:
    d = of_spark(df.schema["x"].dataType)
    total = wrapping_sum(F.col("x").cast("long"), lambda c: F.sum(c).over(up_to_here()))
    return _values(df.withColumn("x", total if d.width == 8 else wrap(total, 8 * d.width).cast(d.spark)), kind)


def scale_encode(df: DataFrame) -> DataFrame:
    """x less the part's smallest value, which is kept as low; where the type can't hold the range, low is 0."""
    df = _integers(df)
    kind = of_spark(df.schema["x"].dataType)
    least, most = F.min("x").over(whole()).cast("long"), F.max("x").over(whole()).cast("long")
    room = F.lit((1 << (8 * kind.width - 1)) - 1).cast("long")
    low = F.when((least < 0) & (most >= 0) & (F.when(most >= 0, room - most + least) < 0), F.lit(0)).otherwise(least)
    return df.withColumn("low", low.cast(kind.spark)).withColumn("x", (F.col("x") - F.col("low")).cast(kind.spark))


def scale_decode(df: DataFrame, kind: str | None = None) -> DataFrame:
    return _values(df.withColumn("x", F.col("x") + F.col("low")).drop("low"), kind)


def rle_encode(df: DataFrame) -> DataFrame:
    """part, run (from 0), start (row_idx), length, x."""
    first = F.coalesce((F.col("x") != F.lag("x").over(ordered())).cast("int"), F.lit(0))
    runs = whole_series(df).withColumn("first", first).withColumn("run", F.sum("first").over(up_to_here()))
    return runs.groupBy("part", "run").agg(F.min("row_idx").alias("start"), F.count("*").alias("length"), F.min("x").alias("x"))


def rle_decode(runs: DataFrame) -> DataFrame:
    return runs.select("part", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("row_idx"), "x")


def top_values(df: DataFrame, k: int) -> DataFrame:
    """part, x, n: the k most frequent values of a part, ties to the smaller."""
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("n").desc(), "x"))
    return df.groupBy("part", "x").agg(F.count("*").alias("n")).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def dict_encode(df: DataFrame, k: int = 4) -> DataFrame:
    """code of x among the part's top values (in their order), or other = x."""
    code = F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1
    top = top_values(df, k).select(F.col("part").alias("p"), F.col("x").alias("v"), code.alias("code"))
    joined = whole_series(df).join(top, (F.col("part") == F.col("p")) & (F.col("x") == F.col("v")), "left")
    return joined.select("part", "row_idx", "code", F.when(F.col("code").isNull(), F.col("x")).alias("other"))


def dict_decode(codes: DataFrame, top: DataFrame) -> DataFrame:
    code = F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1
    values = top.select(F.col("part").alias("p"), code.alias("c"), F.col("x").alias("v"))
    joined = codes.join(values, (F.col("part") == F.col("p")) & (F.col("code") == F.col("c")), "left")
    return joined.select("part", "row_idx", F.coalesce("v", "other").alias("x"))


def unique_encode(df: DataFrame) -> DataFrame:
    """code: the place of x among the part's distinct values. One window, no join."""
    return whole_series(df).withColumn("code", F.dense_rank().over(Window.partitionBy("part").orderBy("x")) - 1).drop("x")


def unique_values(df: DataFrame) -> DataFrame:
    """The dictionary: part, code, x."""
    values = df.select("part", "x").distinct()
    return values.withColumn("code", F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1)


def unique_decode(codes: DataFrame, values: DataFrame) -> DataFrame:
    return codes.join(values, ["part", "code"]).select("part", "row_idx", "x")


def const_encode(df: DataFrame) -> DataFrame:
    """constant: the part's most frequent value; other: x where it differs, else null."""
    top = top_values(df, 1).select(F.col("part").alias("p"), F.col("x").alias("constant"))
    joined = whole_series(df).join(top, F.col("part") == F.col("p"))
    return joined.select("part", "row_idx", "constant", F.when(F.col("x") != F.col("constant"), F.col("x")).alias("other"))


def const_decode(df: DataFrame) -> DataFrame:
    return df.select("part", "row_idx", F.coalesce("other", "constant").alias("x"))


def patch_encode(df: DataFrame, kind: str = "lower", share: float = 0.1) -> DataFrame:
    """stencil: 1 below the top share of the range (lower) or in its middle (between)."""
    low, high = F.min("x").over(whole()), F.max("x").over(whole())
    dist = (high - low) * F.lit(share)
    holds = F.col("x") < high - dist if kind == "lower" else (F.col("x") >= low + dist) & (F.col("x") <= high - dist)
    return whole_series(df).withColumn("stencil", holds.cast("int"))


def float_to_int(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("x", F.rint(F.col("x") * float(10**digits)).cast("long"))


def int_to_float(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("x", F.col("x") / float(10**digits))


# --- split, merge, stencils ------------------------------------------------------------------------------------


def split(df: DataFrame) -> DataFrame:
    """A stable partition by stencil: place, the position within its side."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("part", "stencil").orderBy("row_idx")) - 1)


def split2(df: DataFrame) -> DataFrame:
    """The same partition by one stable sort: place, the position with all zeros first and the ones behind them."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("stencil", "row_idx")) - 1)


def merge(stencils: DataFrame, sides: DataFrame) -> DataFrame:
    """The inverse: stencils (part, row_idx, stencil) filled from sides (part, stencil, place, x) in order."""
    return split(stencils.select("part", "row_idx", "stencil")).join(sides, ["part", "stencil", "place"]).select("part", "row_idx", "x")


def copy_if(df: DataFrame, holds: bool = True) -> DataFrame:
    return df.filter(F.col("stencil") == int(holds))


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn("stencil", 1 - F.col("stencil"))


def pack_stencil(df: DataFrame) -> DataFrame:
    """part, byte_idx, bits: eight stencil values in a byte, the first lowest."""
    at = F.col("row_idx") % 8
    bits = F.sum(F.expr("shiftleft(stencil, cast(row_idx % 8 as int))")).cast("int")
    return df.groupBy("part", F.floor(F.col("row_idx") / 8).alias("byte_idx")).agg(bits.alias("bits"), F.max(at).alias("last"))


def unpack_stencil(packed: DataFrame) -> DataFrame:
    """last: the highest place in use in each byte."""
    rows = packed.withColumn("i", F.explode(F.expr("sequence(0, cast(last as int))")))
    return rows.select("part", (F.col("byte_idx") * 8 + F.col("i")).alias("row_idx"), F.expr("shiftright(bits, i) & 1").alias("stencil"))


# --- order, sets -----------------------------------------------------------------------------------------------


def sort_values(df: DataFrame, ascending: bool = True) -> DataFrame:
    """place: of x in its part's order, ties by row_idx."""
    x = F.col("x").asc() if ascending else F.col("x").desc()
    return df.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(x, "row_idx")) - 1)


def search(df: DataFrame, probes: DataFrame, upper: bool = False) -> DataFrame:
    """probes (part, v) with place: of the first value of the part's sorted values that is not below v (upper: that is
    above v). Values and probes are sorted together, in one window."""
    values = df.select("part", F.col("x").alias("v"), F.lit(0 if upper else 1).alias("_last"), F.lit(1).alias("_value"))
    both = values.union(probes.select("part", "v", F.lit(1 if upper else 0).alias("_last"), F.lit(0).alias("_value")))
    upto = Window.partitionBy("part").orderBy("v", "_last").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("place", F.sum("_value").over(upto)).filter("_value = 0").select("part", "v", "place")


def reduce(df: DataFrame, *names: str) -> DataFrame:
    """part and the values brought together by associative operations (REDUCTIONS), first within tasks."""
    return df.groupBy("part").agg(*(REDUCTIONS[n]("x").alias(n) for n in names))


def sample_prefix(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each part."""
    return df.withColumn("at", F.row_number().over(ordered())).filter(F.col("at") <= n).drop("at")


def concatenate(*frames: DataFrame) -> DataFrame:
    """Series one after another, with row_idx counted on. Lengths are aggregates of one row a frame."""
    out, start = None, F.lit(0).cast("long")
    for i, df in enumerate(frames):
        moved = df.withColumn("row_idx", F.col("row_idx") + start)
        out = moved if out is None else out.unionByName(moved)
        if i + 1 < len(frames):
            last = df.agg(F.max("row_idx")).first()[0]
            start = F.lit(0 if last is None else last + 1).cast("long") + start
    return out


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two series agree row by row, nulls and NaN included."""
    both = a.select("row_idx", F.col("x").alias("xa"), F.lit(1).alias("ina")).join(b.select("row_idx", F.col("x").alias("xb"), F.lit(1).alias("inb")), "row_idx", "full")
    return both.filter(F.col("ina").isNull() | F.col("inb").isNull() | ~F.col("xa").eqNullSafe(F.col("xb"))).isEmpty()
