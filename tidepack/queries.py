"""One query per operator over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import transforms as X
from .functions.dtypes import DTYPES, of_spark
from .operators import relational as R
from .operators import statistics as S
from .operators.codecs import CODECS
from .operators.segments import column_types, compress_table, decompress_table, read_segments, write_segments
from .plans.search import best_static, independent, static_plans
from .plans.tree import Plan, predicted_size
from .sources import generators as G
from .sources.files import read_binary, read_csv, write_binary, write_csv
from .sources.header import parse_header, read_header, write_header

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BATCH = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def users(spark: SparkSession, sf_dir: str, x: str = "user_id") -> DataFrame:
    return R.series(events(spark, sf_dir), "event_id", F.col(x), BATCH)


#: The same frame in SQL, as the CTE e.
E = "with e as (select cast(floor(event_id / 1000) as int) as part, event_id as row_idx, {} as x from events) "
U, V, N = E.format("user_id"), E.format("value"), E.format("event_type")
W = "(partition by part order by row_idx)"
BELOW = "x < max(x) over (partition by part) - (max(x) over (partition by part) - min(x) over (partition by part)) * cast(0.1 as double)"
TOP4 = "t as (select *, row_number() over (partition by part order by x) - 1 as code from (select part, x, row_number() over (partition by part order by count(*) desc, x) as r from e group by part, x) where r <= 4)"


# --- encodings -------------------------------------------------------------------------------------------------


@query(U + f"select part, row_idx, x - coalesce(lag(x) over {W}, 0) as x from e")
def delta_encode(spark, sf_dir):
    return R.delta_encode(users(spark, sf_dir))


@query(U + "select part, row_idx, x from e")
def delta_decode(spark, sf_dir):
    return R.delta_decode(R.delta_encode(users(spark, sf_dir)))


@query(V + "select part, row_idx, x from e")
def delta_roundtrip(spark, sf_dir):
    """Of the bits of doubles."""
    return R.delta_decode(R.delta_encode(users(spark, sf_dir, "value")), "double")


def wide(spark, sf_dir) -> DataFrame:
    """Values whose differences need more than 64 bits."""
    x = F.when(F.col("user_id") % 2 == 0, F.lit(9 * 10**18)).otherwise(F.lit(-9 * 10**18)) + F.col("event_id")
    return R.series(events(spark, sf_dir), "event_id", x, BATCH)


WIDE = E.format("case when user_id % 2 = 0 then 9000000000000000000 else -9000000000000000000 end + event_id")


@query(WIDE + f", d as (select part, row_idx, x::hugeint - coalesce(lag(x) over {W}, 0)::hugeint as h from e) select part, row_idx, cast(case when h > 9223372036854775807 then h - 18446744073709551616 when h < -9223372036854775808 then h + 18446744073709551616 else h end as bigint) as x from d")
def delta_wraps(spark, sf_dir):
    return R.delta_encode(wide(spark, sf_dir))


@query(WIDE + "select part, row_idx, x from e")
def delta_wraps_decode(spark, sf_dir):
    return R.delta_decode(R.delta_encode(wide(spark, sf_dir)))


@query(WIDE + ", b as (select *, min(x) over (partition by part) as lo, max(x) over (partition by part) as hi from e), c as (select *, case when lo < 0 and 9223372036854775807::hugeint - hi < -(lo::hugeint) then 0 else lo end as low from b) select part, row_idx, x - low as x, low from c")
def scale_wide(spark, sf_dir):
    return R.scale_encode(wide(spark, sf_dir))


@query(V + "select part, row_idx, x from e")
def scale_roundtrip(spark, sf_dir):
    """Of the bits of doubles."""
    return R.scale_decode(R.scale_encode(users(spark, sf_dir, "value")), "double")


@query(U + "select part, row_idx, x - min(x) over (partition by part) as x, min(x) over (partition by part) as low from e")
def scale_encode(spark, sf_dir):
    return R.scale_encode(users(spark, sf_dir))


@query(U + "select part, row_idx, x from e")
def scale_decode(spark, sf_dir):
    return R.scale_decode(R.scale_encode(users(spark, sf_dir)))


RUNS = f"f as (select *, coalesce(cast(x <> lag(x) over {W} as int), 0) as b from e), g as (select *, sum(b) over {W} as run from f)"


@query(N + f", {RUNS} select part, run, min(row_idx) as start, count(*) as length, min(x) as x from g group by part, run")
def rle_encode(spark, sf_dir):
    return R.rle_encode(users(spark, sf_dir, "event_type"))


@query(N + "select part, row_idx, x from e")
def rle_decode(spark, sf_dir):
    return R.rle_decode(R.rle_encode(users(spark, sf_dir, "event_type")))


@query(U + f", {TOP4} select e.part, row_idx, code, case when code is null then e.x end as other from e left join t on e.part = t.part and e.x = t.x")
def dict_encode(spark, sf_dir):
    return R.dict_encode(users(spark, sf_dir))


@query(U + "select part, row_idx, x from e")
def dict_decode(spark, sf_dir):
    df = users(spark, sf_dir)
    return R.dict_decode(R.dict_encode(df), R.top_values(df, 4))


@query(U + "select part, row_idx, dense_rank() over (partition by part order by x) - 1 as code from e")
def unique_encode(spark, sf_dir):
    return R.unique_encode(users(spark, sf_dir))


@query(U + "select part, row_idx, x from e")
def unique_decode(spark, sf_dir):
    df = users(spark, sf_dir)
    return R.unique_decode(R.unique_encode(df), R.unique_values(df))


@query(U + "select part, x, row_number() over (partition by part order by x) - 1 as code from (select distinct part, x from e)")
def find_unique(spark, sf_dir):
    return R.unique_values(users(spark, sf_dir))


@query(N + ", t as (select part, x as constant, row_number() over (partition by part order by count(*) desc, x) as r from e group by part, x) select e.part, row_idx, constant, case when x <> constant then x end as other from e join t on e.part = t.part and r = 1")
def const_encode(spark, sf_dir):
    return R.const_encode(users(spark, sf_dir, "event_type"))


@query(N + "select part, row_idx, x from e")
def const_decode(spark, sf_dir):
    return R.const_decode(R.const_encode(users(spark, sf_dir, "event_type")))


@query(V + f"select *, cast({BELOW} as int) as stencil from e")
def patch_lower(spark, sf_dir):
    return R.patch_encode(users(spark, sf_dir, "value"))


@query(V + ", b as (select *, min(x) over (partition by part) as lo, max(x) over (partition by part) as hi from e) select part, row_idx, x, cast(x >= lo + (hi - lo) * cast(0.1 as double) and x <= hi - (hi - lo) * cast(0.1 as double) as int) as stencil from b")
def patch_between(spark, sf_dir):
    return R.patch_encode(users(spark, sf_dir, "value"), "between")


@query(V + "select part, row_idx, x from e")
def patch_decode(spark, sf_dir):
    coded = R.patch_encode(users(spark, sf_dir, "value"))
    return R.merge(coded, R.split(coded).drop("row_idx"))


@query(V + "select part, row_idx, cast(round_even(x * 100, 0) as bigint) as x from e")
def float_to_int(spark, sf_dir):
    return R.float_to_int(users(spark, sf_dir, "value"), 2)


@query(V + "select part, row_idx, x from e")
def int_to_float(spark, sf_dir):
    return R.int_to_float(R.float_to_int(users(spark, sf_dir, "value"), 2), 2)


# --- stencils, split and merge ---------------------------------------------------------------------------------


def stencils(spark, sf_dir):
    return users(spark, sf_dir).withColumn("stencil", X.stencil(F.col("x"), "lower", SIDE))


#: Both sides of it occur in tables of every size.
SIDE = 8
ST = U + f", s as (select *, cast(x < {SIDE} as int) as stencil from e) "


@query(U + "select part, row_idx, x, cast(x = 50 as int) as equal, cast(x <> 50 as int) as not_equal, cast(x < 50 as int) as lower, cast(x > 50 as int) as greater, cast(x between 20 and 80 as int) as between_, cast(x < 20 or x > 80 as int) as not_between from e")
def predicates(spark, sf_dir):
    x = F.col("x")
    args = {"equal": (50,), "not_equal": (50,), "lower": (50,), "greater": (50,), "between": (20, 80), "not_between": (20, 80)}
    return users(spark, sf_dir).select("*", *(X.stencil(x, k, *a).alias("between_" if k == "between" else k) for k, a in args.items()))


@query(ST + "select part, row_idx // 8 as byte_idx, cast(sum(stencil << cast(row_idx % 8 as int)) as int) as bits, max(row_idx % 8) as last from s group by part, row_idx // 8")
def stencil_pack(spark, sf_dir):
    return R.pack_stencil(stencils(spark, sf_dir))


@query(ST + "select part, row_idx, stencil from s")
def stencil_unpack(spark, sf_dir):
    return R.unpack_stencil(R.pack_stencil(stencils(spark, sf_dir)))


@query(ST + "select *, row_number() over (partition by part, stencil order by row_idx) - 1 as place from s")
def split(spark, sf_dir):
    return R.split(stencils(spark, sf_dir))


@query(ST + "select *, row_number() over (partition by part order by stencil, row_idx) - 1 as place from s")
def split2(spark, sf_dir):
    return R.split2(stencils(spark, sf_dir))


@query(U + "select part, row_idx, x from e")
def merge(spark, sf_dir):
    df = stencils(spark, sf_dir)
    return R.merge(df, R.split(df).drop("row_idx"))


@query(ST + "select * from s where stencil = 1")
def copy_if(spark, sf_dir):
    return R.copy_if(stencils(spark, sf_dir))


@query(ST + "select part, row_idx, x, 1 - stencil as stencil from s where stencil = 0")
def copy_if_not_negated(spark, sf_dir):
    return R.negate(R.copy_if(stencils(spark, sf_dir), False))


# --- scans, order, sets ----------------------------------------------------------------------------------------


@query(U + f"select *, cast(sum(x) over {W} as bigint) as s from e")
def prefix_sum_incl(spark, sf_dir):
    return R.prefix_sum(users(spark, sf_dir))


@query(U + "select *, cast(coalesce(sum(x) over (partition by part order by row_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as s from e")
def prefix_sum_excl(spark, sf_dir):
    return R.prefix_sum(users(spark, sf_dir), False)


@query(U + f"select *, x - lag(x) over {W} as d from e")
def adjacent_difference(spark, sf_dir):
    return R.adjacent_difference(users(spark, sf_dir))


@query(N + f"select *, 1 + coalesce(cast(lead(x) over {W} = x as int), 0) + coalesce(cast(lead(x) over {W} = x and lead(x, 2) over {W} = x as int), 0) as same from e")
def lookahead_equal(spark, sf_dir):
    return R.lookahead(users(spark, sf_dir, "event_type"), 3)


@query(U + "select *, row_number() over (partition by part order by x desc, row_idx) - 1 as place from e")
def sort_descending(spark, sf_dir):
    return R.sort_values(users(spark, sf_dir), False)


@query(U + "select *, row_number() over (partition by part order by x, row_idx) - 1 as place from e")
def stable_sort(spark, sf_dir):
    return R.sort_values(users(spark, sf_dir))


PROBES = U + ", p as (select distinct part, x - x % 10 as v from e) "


def _probes(spark, sf_dir, upper: bool) -> DataFrame:
    df = users(spark, sf_dir)
    return R.search(df, df.select("part", (F.col("x") - F.col("x") % 10).alias("v")).distinct(), upper)


@query(PROBES + "select p.part, v, count(*) filter (x < v) as place from p join e on p.part = e.part group by p.part, v")
def lower_bound(spark, sf_dir):
    return _probes(spark, sf_dir, False)


@query(PROBES + "select p.part, v, count(*) filter (x <= v) as place from p join e on p.part = e.part group by p.part, v")
def upper_bound(spark, sf_dir):
    return _probes(spark, sf_dir, True)


@query(U + "select part, cast(sum(x) as bigint) as sum, min(x) as min, max(x) as max, bit_and(x) as bit_and, bit_or(x) as bit_or, bit_xor(x) as bit_xor from e group by part")
def reduce(spark, sf_dir):
    return R.reduce(users(spark, sf_dir), "sum", "min", "max", "bit_and", "bit_or", "bit_xor")


@query("select event_id, cast(trunc((event_id - 500) / 7) as bigint) as quotient from events")
def whole_division(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.divide_whole(F.col("event_id") - 500, 7).alias("quotient"))


@query(U + "select part, row_idx, x from (select *, row_number() over (partition by part order by row_idx) as r from e) where r <= 100")
def prefix_sample(spark, sf_dir):
    return R.sample_prefix(users(spark, sf_dir), 100)


@query(U + "select part, row_idx, x from e union all select part, row_idx + (select max(row_idx) + 1 from e), x from e")
def concatenate(spark, sf_dir):
    df = users(spark, sf_dir)
    return R.concatenate(df, df)


@query("select true as equal, false as equal_to_delta")
def compare(spark, sf_dir):
    df = users(spark, sf_dir)
    return spark.createDataFrame([(R.equal(df, R.delta_decode(R.delta_encode(df))), R.equal(df, R.delta_encode(df)))], "equal boolean, equal_to_delta boolean")


# --- scalar transforms -----------------------------------------------------------------------------------------


@query(
    V + "select row_idx, cast(trunc(x) as int) as as_int, row_idx % 7 as modulus, x + 1.5::double as added, x - 1.5::double as subtracted, x * 3 as multiplied, x / 4 as divided, abs(x - 100) as absolute, 0 as zero, 1 as one, 5 as filled, cast(row_idx % 3 = 0 as int) as negated, round_even(x * 10, 0) / 10 as set_precision from e"
)
def transforms(spark, sf_dir):
    x, i = F.col("x"), F.col("row_idx")
    return users(spark, sf_dir, "value").select(
        "row_idx", X.cast_int(x).alias("as_int"), X.modulus(i, 7).alias("modulus"), X.add(x, 1.5).alias("added"), X.subtract(x, 1.5).alias("subtracted"), X.multiply(x, 3).alias("multiplied"),
        X.divide(x, 4).alias("divided"), X.absolute(x - 100).alias("absolute"), X.zero(x).alias("zero"), X.one(x).alias("one"), X.fill(x, 5).alias("filled"),
        X.logical_not(i % 3).alias("negated"), X.set_precision(x, 1).alias("set_precision"),
    )


@query("select event_id, ((event_id * 1000003 + 2147483648) & 4294967295) - 2147483648 as wrapped, case when user_id < 0 then 32 else length(bin(user_id)) end as bits, (event_id >> 3) & 31 as field, (event_id & ~248) | ((user_id << 3) & 248) as put from events")
def bit_operations(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select("event_id", X.wrap(i * 1_000_003, 32).alias("wrapped"), X.bit_length_of(u).alias("bits"), X.get_bits(i, 3, 5).alias("field"), X.set_bits(i, u, 3, 5).alias("put"))


@query("select event_id, epoch_us(ts) as micros from events")
def time_as_micros(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


# --- statistics ------------------------------------------------------------------------------------------------


@query(
    U + f", l as (select *, lead(x) over {W} as nx, row_number() over {W} as rn, count(*) over (partition by part) as n from e) "
    "select part, count(*) as size, min(x) as low, max(x) as high, avg(x) as mean, count(*) filter (x > nx) = 0 as sorted, "
    "coalesce(avg(case when rn <= n - 2 then 1 + cast(x = nx as int) end), 1.0) as runs, case when min(x) < 0 then 64 else length(bin(max(x))) end as min_bits from l group by part"
)
def data_statistics(spark, sf_dir):
    return S.data_statistics(users(spark, sf_dir), 8)


@query("with b as (select min(value) as lo, max(value) as hi from events), c as (select cast(floor((value - lo) * (9 / (hi - lo))) as int) as bucket, count(*) as n from events, b group by 1) select cast(i as int) as bucket, coalesce(n, 0) as n from (select unnest(generate_series(0, 9)) as i) left join c on i = bucket")
def histogram_dense(spark, sf_dir):
    return S.dense_histogram(users(spark, sf_dir, "value"), 10)


@query("select user_id as x, count(*) as n from events group by user_id")
def dictionary_counter(spark, sf_dir):
    return S.sparse_histogram(users(spark, sf_dir))


@query("select i as x, count(user_id) as n from (select unnest(generate_series((select min(user_id) from events), (select max(user_id) from events))) as i) left join events on i = user_id group by i")
def histogram_integers(spark, sf_dir):
    return S.integer_histogram(users(spark, sf_dir))


@query("select user_id as x, count(*) as n from events group by user_id order by n desc, x limit 4")
def top_k(spark, sf_dir):
    return S.most_frequent(users(spark, sf_dir), 4)


@query("select event_id, cast(floor((value - 0) * (cast(10 as double) / 500.0::double)) as int) as bucket from events")
def get_bucket(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.bucket_of(F.col("value"), 0, F.lit(500.0), 10).alias("bucket"))


DIGITS = "case " + " ".join(f"when round_even(x * 1e{p}, 0) / 1e{p} = x then {p}" for p in range(10)) + " else 10 end"
#: Doubles of few and of many digits.
MANY = "case when user_id % 3 = 0 then value / 7 when user_id % 3 = 1 then value / 32 else value end"


def many_digits(spark, sf_dir) -> DataFrame:
    value, u = F.col("value"), F.col("user_id")
    return R.series(events(spark, sf_dir), "event_id", F.when(u % 3 == 0, value / 7).when(u % 3 == 1, value / 32).otherwise(value), BATCH)


@query(E.format(MANY) + f"select row_idx, {DIGITS} as digits from e")
def decimal_precision(spark, sf_dir):
    return many_digits(spark, sf_dir).select("row_idx", S.precision(F.col("x")).alias("digits"))


@query(
    E.format(MANY) + f", l as (select *, lead(x) over {W} as nx, row_number() over {W} as rn, count(*) over (partition by part) as n from e) "
    f"select part, count(*) as size, min(x) as low, max(x) as high, avg(x) as mean, count(*) filter (x > nx) = 0 as sorted, max({DIGITS}) as digits, "
    "coalesce(avg(case when rn <= n - 2 then 1 + cast(x = nx as int) end), 1.0) as runs, case when min(x) < 0 then 64 else length(bin(cast(trunc(max(x)) as bigint))) end as min_bits from l group by part"
)
def data_statistics_double(spark, sf_dir):
    return S.data_statistics(many_digits(spark, sf_dir), 8)


SIZES = (
    U + f""", v as (select part, sum(c) as n, count(*) as u, max(c) as c, min(x) as lo, max(x) as hi, least(count(*), 4) as k, sum(c) filter (r <= 4) as t
    from (select part, x, count(*) as c, row_number() over (partition by part order by count(*) desc, x) as r from e group by part, x) group by part),
  rr as (select part, sum(b) as r from (select part, coalesce(cast(x <> lag(x) over {W} as int), 1) as b from e) group by part),
  s as (select v.*, rr.r, case when lo < 0 then 64 else length(bin(hi)) end as bits, 32 // length(bin(k - 1)) as kc, 32 // length(bin(u - 1)) as uc, ceil(n / 8) + 1 as mask from v join rr using (part)),
  z as (
    select part, 'none' as encoding, 8 as meta, n * 8 as size from s
    union all select part, 'delta', 8, (n - 1) * 8 from s
    union all select part, 'scale', 8, n * 8 from s
    union all select part, 'rle', 4, r * 12 from s
    union all select part, 'const', mask + 8, 8 * (n - c) from s
    union all select part, 'dict', mask, 16 + k * 8 + 4 * ceil(t / kc) + 8 * (n - t) from s
    union all select part, 'unique', 16 + u * 8, 4 * ceil(n / uc) from s
    union all select part, 'patch', mask, n * 8 from s
    union all select part, 'afl', 4, ceil(bits * n / 64) * 8 from s)
"""
)


@query(SIZES + "select part, encoding, cast(meta as bigint) as meta, cast(size as bigint) as size from z")
def predicted_sizes(spark, sf_dir):
    return S.predicted_sizes(users(spark, sf_dir), 8)


@query(SIZES + "select part, arg_min(encoding, (total, encoding)) as encoding, cast(min(total) as bigint) as total from (select *, meta + size + case when encoding = 'none' then 8 else 24 end as total from z) group by part")
def best_single_encoding(spark, sf_dir):
    return S.best_single(S.predicted_sizes(users(spark, sf_dir), 8))


# --- physical codecs and plans ---------------------------------------------------------------------------------


def typed(spark, sf_dir) -> DataFrame:
    """All six column types. User ids beyond 16 bits wrap in s, as in C; the SQL's cast refuses them."""
    c = F.col
    return events(spark, sf_dir).select(
        "event_id", c("user_id").cast("int").alias("i"), (c("user_id") % 100).cast("byte").alias("c"), X.wrap(c("user_id"), 16).cast("short").alias("s"), c("event_id").alias("t"), c("value").cast("float").alias("f"), c("value").alias("d")
    )


TYPED = "select event_id, cast(user_id as int) as i, cast(user_id % 100 as tinyint) as c, cast(user_id as smallint) as s, event_id as t, cast(value as float) as f, value as d from events"


def _round_trip(df: DataFrame, index: str, **how) -> DataFrame:
    return decompress_table(compress_table(df, index, BATCH, **how), column_types(df, index), index, BATCH)


def _codec_query(plan: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _round_trip(typed(spark, sf_dir), "event_id", plan=Plan.parse(plan))


for _name in CODECS:
    QUERIES[f"codec_{_name.lower()}"] = _codec_query(_name)
    ORACLES[f"codec_{_name.lower()}"] = TYPED
#: The hand-built trees to be tested.
for _i, _plan in enumerate(("dict(scale(delta), delta)", "patch(dict(delta, scale), delta)", "scale(delta(patch(afl, none)))", "scale(delta(unique))", "patch(const, floatToInt(rle(const, scale(afl))))", "delta(floatToInt(afl))", "scale(delta(gfc))", "delta(patch(delta(afl), delta(afl)))", "delta(rle(afl, afl))", "dict(scale(delta(gfc)), delta(floatToInt(afl)))", "patch(delta(scale(afl)), delta(scale(afl)))", "patchBetween(afl, delta(afl))")):
    QUERIES[f"tree_{_i + 1}"] = _codec_query(_plan)
    ORACLES[f"tree_{_i + 1}"] = TYPED


@query(TYPED)
def compress_independent(spark, sf_dir):
    return _round_trip(typed(spark, sf_dir), "event_id")


@query(TYPED)
def compress_adaptive(spark, sf_dir):
    return _round_trip(typed(spark, sf_dir), "event_id", mode="adaptive")


@query("select event_id, epoch_us(ts) as ts, user_id, value from events")
def compress_times(spark, sf_dir):
    return _round_trip(events(spark, sf_dir).select("event_id", "ts", "user_id", "value"), "event_id")


@query()
def segments_adaptive(spark, sf_dir):
    """column, part, sizes, ratio and plan of each segment."""
    return compress_table(typed(spark, sf_dir), "event_id", BATCH, "adaptive").drop("payload")


def _planned(df: DataFrame, plan: Callable, kind: str) -> DataFrame:
    d = DTYPES[kind]

    def run(t: pa.Table) -> pa.Table:
        x = t.sort_by("row_idx").column("x").to_numpy().astype(d.numpy)
        found, size = plan(x, d)
        return pa.table([t.column("part")[:1], pa.array([str(found)]), pa.array([size], pa.int64()), pa.array([x.nbytes], pa.int64())], names=["part", "plan", "size", "raw"])

    from .shipping import ship

    ship(df.sparkSession)
    return df.groupBy("part").applyInArrow(run, "part int, plan string, size long, raw long")


#: The bytes of every static plan, in SQL: st holds what the encodings in front make of a part (s: which of them, w: bytes
#: of a value), ch what the last encoding before afl hands to its children. An afl leaf takes 28 bytes and its words.
HALVES = "(select 0 as h union all select 1)"
HALF = "case when h = 1 then (v - (v & 4294967295)) // 4294967296 when (v & 4294967295) >= 2147483648 then (v & 4294967295) - 4294967296 else v & 4294967295 end"
STATIC = (
    U
    + f"""
, d as (select part, row_idx, x - lag(x) over {W} as v from e qualify v is not null),
  whole as (
    select 0 as s, part, row_idx as pos, x as v from e union all select 2, part, row_idx, v from d
    union all select 3, part, row_idx, x - min(x) over (partition by part) from e),
  st as (
    select s, 8 as w, part, pos, v from whole
    union all select case s when 0 then 1 when 2 then 4 else 5 end, 4, part, 2 * pos + h, {HALF} from whole, {HALVES}),
  g as (select s, w, part, count(*) as n, max(v) - cast(0.1 as double) * (max(v) - min(v)) as high from st group by s, w, part),
  f as (select s, w, part, v, count(*) as c, row_number() over (partition by s, part order by count(*) desc, v) as r from st group by s, w, part, v),
  top as (select *, row_number() over (partition by s, part order by v) - 1 as code from f where r <= 4),
  k as (select s, part, count(*) as k, sum(c) as t, length(bin(count(*) - 1)) as bits, 32 // length(bin(count(*) - 1)) as per from top group by s, part),
  runs as (select s, w, part, v, count(*) as c from (select *, sum(new) over (partition by s, part order by pos) as run from (select *, case when v = lag(v) over (partition by s, part order by pos) then 0 else 1 end as new from st)) group by s, w, part, v, run),
  coded as (select s, part, code, row_number() over (partition by s, part order by pos) - 1 as i from st join top using (s, part, v)),
  packed as (select s, part, sum(code * cast(power(2, bits * (i % per)) as bigint)) as v from coded join k using (s, part) group by s, part, i // per),
  ch as (
    select s, part, 3 as o, 0 as child, w, v from st
    union all select s, part, 1, 0, st.w, st.v from st join f using (s, part) where f.r = 1 and f.v <> st.v
    union all select s, part, 2, 0, 4, c from runs union all select s, part, 2, 1, w, v from runs
    union all select s, part, 4, cast(v >= high as int), w, v from st join g using (s, w, part)
    union all select s, part, 0, 1, w, v from st anti join top using (s, part, v)
    union all select s, part, 0, 0, 4, unnest([k, 0, t, 0]) from k
    union all select s, part, 0, 0, 4, {HALF} from top, {HALVES} where w = 8 or h = 0
    union all select s, part, 0, 0, 4, case when v >= 2147483648 then v - 4294967296 else v end from packed),
  leaves as (select s, part, o, ceil((case when min(v) < 0 then 8 * w else length(bin(max(v)::bigint)) end) * count(*) / (8 * w)) * w as size from ch group by s, part, o, child, w),
  pre as (select * from (values (0, 0, '', ''), (1, 12, 'floatToInt(', ')'), (2, 16, 'delta(', ')'), (3, 16, 'scale(', ')'), (4, 28, 'delta(floatToInt(', '))'), (5, 28, 'scale(floatToInt(', '))')) as v(s, before, head, tail)),
  suf as (select * from (values (0, 'dict', 2), (1, 'const', 1), (2, 'rle', 2), (3, '', 1), (4, 'patch', 2)) as v(o, name, children)),
  plans as (
    select part, 1 + 5 * s + o as nr, head || case o when 3 then 'afl(none)' else name || '(' || repeat('afl(none), ', children - 1) || 'afl(none))' end || tail as plan,
      before + case o when 3 then 0 when 2 then 12 else 9 + ceil(n / 8) + case o when 1 then w else 0 end end + 28 * children + coalesce((select sum(size) from leaves where leaves.s = g.s and leaves.part = g.part and leaves.o = suf.o), 0) as size
    from g join pre using (s), suf
    union all select part, 0, 'none', 16 + 8 * count(*) from e group by part)
"""
)


@query(STATIC + "select part, arg_min(plan, (size, nr)) as plan, cast(min(size) as bigint) as size, cast(8 * any_value(n) as bigint) as raw from plans join (select part, count(*) as n from e group by part) using (part) group by part")
def best_static_plan(spark, sf_dir):
    return _planned(users(spark, sf_dir), best_static, "time")


def _all_static(x, d):
    return [(str(p.fixed(d)), predicted_size(p.fixed(d), x, d)) for p in (Plan("none"), *static_plans())]


@query(STATIC + "select part, plan, cast(size as bigint) as size from plans")
def static_plan_sizes(spark, sf_dir):
    """The bytes that each static plan is predicted to take."""
    listed = _planned(users(spark, sf_dir), lambda x, d: (json.dumps(_all_static(x, d)), 0), "time")
    each = F.explode(F.from_json("plan", "array<array<string>>")).alias("p")
    return listed.select("part", each).select("part", F.col("p")[0].alias("plan"), F.col("p")[1].cast("long").alias("size"))


def _searched(x, d):
    data, plan = independent(x, d)
    return plan, len(data)


@query()
def plan_search(spark, sf_dir):
    return _planned(users(spark, sf_dir), _searched, "time")


#: Leaves below an encoding, each with a node of 16 bytes.
LEAVES = {"delta": 1, "scale": 1, "rle": 2, "const": 1, "dict": 2, "unique": 1, "patch": 2, "afl": 1}
OUTPUTS = "case encoding " + " ".join(f"when '{k}' then {n}" for k, n in LEAVES.items()) + " end"


@query(SIZES + f"select part, encoding, cast(meta + size + 8 + 16 * {OUTPUTS} as bigint) as bytes from z where encoding <> 'none'")
def encoded_sizes(spark, sf_dir):
    """What each encoding really writes, beside its prediction."""
    df, out = users(spark, sf_dir).select("row_idx", "x"), None
    for name in LEAVES:
        got = compress_table(df, "row_idx", BATCH, plan=Plan.parse(name)).select("part", F.lit(name).alias("encoding"), F.col("enc_bytes").alias("bytes"))
        out = got if out is None else out.union(got)
    return out


@query("select distinct cast(floor(event_id / 1000) as int) as part, k as kind, c as encoding, true as as_predicted from events, (values ('afl'), ('gfc')) as v(c), (values ('float'), ('double')) as w(k)")
def float_sizes(spark, sf_dir):
    """Predicted sizes of encodings of floating point values beside what they write."""
    out = None
    for kind in ("float", "double"):
        df = users(spark, sf_dir, "value").withColumn("x", F.col("x").cast(kind))
        for name, leaves in (("afl", 1), ("gfc", 2)):
            wrote = compress_table(df.select("row_idx", "x"), "row_idx", BATCH, plan=Plan.parse(name)).select("part", "enc_bytes")
            both = S.predicted_float_sizes(df).filter(F.col("encoding") == name).join(wrote, "part")
            got = both.select("part", F.lit(kind).alias("kind"), "encoding", (F.col("meta") + F.col("size") + 8 + 16 * leaves == F.col("enc_bytes")).alias("as_predicted"))
            out = got if out is None else out.union(got)
    return out


@query(SIZES + ", b as (select part, n, min(meta + size + case when encoding = 'none' then 8 else 24 end) as best from z join s using (part) group by part, n) select part, cast(8 * n as bigint) as raw, true as not_above_single from b")
def plan_search_bounds(spark, sf_dir):
    """The search finds no more bytes than the best encoding alone takes."""
    found = _planned(users(spark, sf_dir), _searched, "time")
    single = S.best_single(S.predicted_sizes(users(spark, sf_dir), 8).filter(F.col("encoding").isin("none", "delta", "scale", "afl", "unique", "const"))).select("part", F.col("total").alias("single"))
    return found.join(single, "part").select("part", "raw", (F.col("size") <= F.col("single")).alias("not_above_single"))


@query(U + "select part, cast(8 * count(*) as bigint) as raw, true as not_above_raw from e group by part")
def static_plan_bounds(spark, sf_dir):
    found = _planned(users(spark, sf_dir), best_static, "time")
    return found.select("part", "raw", (F.col("size") <= F.col("raw") + 8).alias("not_above_raw"))


@query("select c as column, cast(floor(event_id / 1000) as int) as part, count(*) as n_rows, cast(count(*) * w as bigint) as raw_bytes, true as smaller from events, (values ('i', 4), ('c', 1), ('s', 2), ('t', 8), ('f', 4), ('d', 8)) as v(c, w) group by c, w, cast(floor(event_id / 1000) as int)")
def segment_facts(spark, sf_dir):
    """Segments of the adaptive mode; none is larger than its values and a node."""
    segments = compress_table(typed(spark, sf_dir), "event_id", BATCH, "adaptive")
    return segments.select("column", "part", "n_rows", "raw_bytes", (F.col("enc_bytes") <= F.col("raw_bytes") + 8).alias("smaller"))


# --- files -----------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A folder for a query's files: in the shared one, or a local one where there is none and no cluster."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared}/tidepack-files-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tidepack-files-")


#: A header file of the columns that file queries write.
FILE_HEADER = "user,int,0\ntime,time,0\nvalue,double,2\n"
FILED = "select event_id as row_idx, cast(user_id as int) as user, event_id as time, value from events"


def filed(spark, sf_dir) -> DataFrame:
    c = F.col
    return events(spark, sf_dir).select(c("event_id").alias("row_idx"), c("user_id").cast("int").alias("user"), c("event_id").alias("time"), "value")


@query(FILED)
def binary_file(spark, sf_dir):
    """Written twice; the second replaces the first."""
    at = f"{_folder(spark)}/binary"
    write_binary(filed(spark, sf_dir).limit(3), at, FILE_HEADER, 4)
    write_binary(filed(spark, sf_dir), at, FILE_HEADER, 4)
    return read_binary(spark, at, FILE_HEADER, 4)


@query("select event_id as row_idx, cast(user_id as int) as user, event_id as time, cast(cast(value as decimal(38, 2)) as double) as value from events")
def csv_file(spark, sf_dir):
    at, schema = f"{_folder(spark)}/csv", parse_header(FILE_HEADER)
    write_csv(filed(spark, sf_dir), at, schema)
    return read_csv(spark, at, schema)


@query(FILED)
def segment_files(spark, sf_dir):
    at, df = f"{_folder(spark)}/segments", filed(spark, sf_dir)
    write_segments(compress_table(df, "row_idx", BATCH), at)
    return decompress_table(read_segments(spark, at), column_types(df, "row_idx"), batch=BATCH)


@query("select * from (values ('user', 'int', 0), ('time', 'time', 0), ('value', 'double', 2)) as v(name, type, decimals)")
def header_file(spark, sf_dir):
    at = f"{_folder(spark)}/header"
    write_header(spark, parse_header(FILE_HEADER), at)
    schema = read_header(spark, at)
    rows = [(f.name, of_spark(f.dataType).name, f.metadata.get("decimals", 0)) for f in schema]
    return spark.createDataFrame(rows, "name string, type string, decimals int")


# --- generators ------------------------------------------------------------------------------------------------


@query("select i as row_idx, 5 + i * 3 as x from (select unnest(generate_series(0, 9999)) as i)")
def generate_consecutive(spark, sf_dir):
    return G.rows(spark, 10_000).withColumn("x", G.consecutive(5, 3))


@query("select i as row_idx, case when i % 1000 = 0 then 100 else greatest(0, least(100, case when k % 23 <= 11 then 10 * (k % 23) else 10 * (22 - k % 23) end)) end as x from (select i, cast(floor((i + 999) / 1000) as bigint) as k from (select unnest(generate_series(0, 49999)) as i))")
def generate_staircase(spark, sf_dir):
    return G.rows(spark, 50_000).withColumn("x", G.staircase(1000, 10, 0, 100))


def _drawn(name: str, *seeds: int) -> str:
    """The 64-bit xxHash of row_idx (8 bytes), begun from those of the seeds (4 bytes each) and 42, as columns in SQL: `name`, and
    `name`_s with a sign. Unsigned 128-bit arithmetic modulo 2 ** 64."""
    seed = 42
    for s in seeds:
        seed = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed)
    # fixed values: the primes of xxHash64
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    whole = f"{1 << 64}::uhugeint"
    turned = lambda x, r: f"(({x} * {1 << r}::uhugeint) % {whole} + {x} // {1 << (64 - r)}::uhugeint)"
    mixed = lambda x, r: f"xor({x}, {x} // {1 << r}::uhugeint)"
    steps = (
        f"(row_idx::uhugeint * {p2}) % {whole}",
        f"xor(({turned(f'{name}0', 31)} * {p1}) % {whole}, ({seed}::uhugeint + {p5} + 8::uhugeint) % {whole})",
        f"({turned(f'{name}1', 27)} * {p1} + {p4}) % {whole}",
        f"({mixed(f'{name}2', 33)} * {p2}) % {whole}",
        f"({mixed(f'{name}3', 29)} * {p3}) % {whole}",
    )
    columns = [f"{x} as {name}{i}" for i, x in enumerate(steps)]
    return ", ".join([*columns, f"{mixed(f'{name}4', 32)} as {name}", f"case when {name} >= {1 << 63}::uhugeint then -({whole} - {name})::hugeint else {name}::hugeint end as {name}_s"])


def _pmod(x: str, n: int) -> str:
    return f"cast(({x}_s % {n} + {n}) % {n} as bigint)"


def _in_unit(x: str) -> str:
    return f"(cast({x} % {1 << 53}::uhugeint as double) + 1) / {float(1 << 53)!r}::double"


def _turning(k: str, high: str, up: int, step: str) -> str:
    return f"greatest(0, least({high}, case when {k} % {2 * up + 1} <= {up} then ({k} % {2 * up + 1}) * {step} else ({2 * up} - {k} % {2 * up + 1}) * {step} end))"


#: Draws of rows: a, by the seed alone; b to d with one more number.
DRAWS = f"with n as (select unnest(generate_series(0, 19999)) as row_idx), h as (select row_idx, {_drawn('a', 1)}, {_drawn('b', 1, 1)}, {_drawn('c', 1, 2)}, {_drawn('d', 1, 3)} from n) "


@query(
    DRAWS
    + f"""select row_idx, cast(1400000000 + sum(case when {_in_unit('a')} > 0.05::double then 1 + {_pmod('c', 2)} else 0 end) over (order by row_idx) as bigint) as "TIME",
  cast(case when row_idx % 10 = 0 then 1000000 else {_turning('((row_idx + 9) // 10)', '1000000', 100_001, '10')} end as int) as "PATTERN_A_INT",
  cast(case when row_idx % 2 = 0 then 1000000 - {_pmod('a', 6)} else {_pmod('a', 6)} end as int) as "PATTERN_B_INT",
  cast(floor({_in_unit('a')} * power(10::double, {_pmod('b', 5)})) / power(10::double, {_pmod('b', 5)}) as float) as "FLOAT_PREC_4",
  cast(case when row_idx % 10 = 0 then 1000 else ((row_idx + 9) // 10) * 0.01::double end as float) as "PATTERN_A_FLOAT",
  cast(case when row_idx % 2 = 0 then 10000000 - {_pmod('a', 6)} else {_pmod('a', 6)} end as float) as "PATTERN_B_FLOAT" from h"""
)
def generate_table(spark, sf_dir):
    return G.generate(spark, 20_000)


@query(
    DRAWS
    + f""", o as (select *, cast({_in_unit('a')} < 0.1::double as int) as away from h),
  k as (select *, coalesce(sum(1 - away) over (partition by row_idx // 5000 order by row_idx rows between unbounded preceding and 1 preceding), 0)::bigint as k from o)
select row_idx, cast({_in_unit('a')} as float) as floats, {_in_unit('a')} as doubles, cast({_pmod('a', 900)} + 100 as int) as ints, cast({_pmod('a', 2)} as int) as stencil,
  cast(floor({_in_unit('a')} * power(10::double, {_pmod('b', 4)})) / power(10::double, {_pmod('b', 4)}) as float) as precise,
  cast(case when (row_idx // 100) % 2 = 0 then case when row_idx % 2 = 0 then 50 - {_pmod('a', 6)} else -50 + {_pmod('a', 6)} end
    else 50 - 2 * least(row_idx % 100, 100 - row_idx % 100) end as double) as zigzag,
  cast(10 + sum(case when {_in_unit('a')} > 0.5::double then 1 + {_pmod('c', 2)} else 0 end) over (order by row_idx) as bigint) as times,
  cast(case when away = 1 then 100 + {_pmod('d', 20)} - 10 else {_turning('k', '100', 101, '1')} end as double) as outliers from k"""
)
def generate_series(spark, sf_dir):
    """Every kind of random series, with batches that begin anew."""
    df = G.outliers(G.time_steps(G.rows(spark, 20_000), 10, 0.5, batch=3000, name="times"), 0.1, 1, 0, 100, batch=5000, name="outliers")
    more = {"floats": G.random_floats(), "doubles": G.random_doubles(), "ints": G.random_ints(), "stencil": G.random_stencil(), "precise": G.floats_of_precision(3), "zigzag": G.zigzag(100, -50, 50).cast("double")}
    return df.select("row_idx", "times", F.col("outliers").cast("double").alias("outliers"), *(c.alias(n) for n, c in more.items()))


@query("select 20000 as n, true as dense, true as times_step, true as ints_inside, true as floats_inside, true as digits_few, true as stencil_even, true as zigzag_inside, true as outliers_few, true as reruns_agree")
def generator_facts(spark, sf_dir):
    """What holds of each kind of random series, by aggregates over all rows."""
    n, c = 20_000, F.col
    df = G.outliers(G.time_steps(G.rows(spark, n), 10, 0.5, batch=3000, name="t"), 0.1, 1, 0, 100_000, batch=5000, name="o")
    more = [G.random_ints(10, 100).alias("i"), G.random_floats().alias("f"), G.floats_of_precision(3).alias("p"), G.random_stencil().alias("s"), G.zigzag(100, -50, 50).alias("z")]
    df = df.select("row_idx", "t", "o", *more, F.floor(c("row_idx") / BATCH).alias("part"))
    steps = df.withColumn("step", c("t") - F.lag("t").over(R.ordered())).withColumn("again", G.random_ints(10, 100))
    every = lambda x: F.min(F.coalesce(x, F.lit(True)))
    return steps.agg(
        F.count("*").cast("int").alias("n"),
        ((F.min("row_idx") == 0) & (F.max("row_idx") == n - 1) & (F.count_distinct("row_idx") == n)).alias("dense"),
        every(c("step").between(0, 2)).alias("times_step"),
        (every(c("i").between(10, 99)) & (F.count_distinct("i") == 90)).alias("ints_inside"),
        every((c("f") > 0) & (c("f") <= 1)).alias("floats_inside"),
        every(F.abs(F.round(c("p").cast("double"), 3) - c("p")) < 1e-6).alias("digits_few"),
        (every(c("s").isin(0, 1)) & F.avg("s").between(0.45, 0.55)).alias("stencil_even"),
        every(c("z").between(-50, 50)).alias("zigzag_inside"),
        F.avg((c("o") >= 99_990).cast("int")).between(0.08, 0.12).alias("outliers_few"),
        every(c("again") == c("i")).alias("reruns_agree"),
    )


