"""Scalar transforms and predicates as column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(x: Column, bits: int) -> Column:
    """A BIGINT brought into a signed integer of `bits` (below 64) bits, as C arithmetic would."""
    half = 1 << (bits - 1)
    return (x.cast("long") + half).bitwiseAND(F.lit((1 << bits) - 1)) - half


_LOW = 0xFFFFFFFF


def _joined(high: Column, low: Column) -> Column:
    """high * 2 ** 32 + low as a BIGINT; what is above 64 bits is lost, as in C."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def wrapping_sum(x: Column, total) -> Column:
    """total(x), a sum of BIGINTs over fewer than 2 ** 31 rows, that wraps at 64 bits; total: F.sum with its window."""
    return _joined(total(F.shiftright(x, 32)), total(x.bitwiseAND(F.lit(_LOW))))


def wrapping_difference(a: Column, b: Column) -> Column:
    """a - b of BIGINTs, wrapped at 64 bits."""
    return _joined(F.shiftright(a, 32) - F.shiftright(b, 32), a.bitwiseAND(F.lit(_LOW)) - b.bitwiseAND(F.lit(_LOW)))


def cast_int(x: Column) -> Column:
    """Truncates towards zero and wraps to 32 bits."""
    return wrap(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"), 32).cast("int")


def modulus(x: Column, by) -> Column:
    return x % by


def add(x: Column, by) -> Column:
    return x + by


def subtract(x: Column, by) -> Column:
    return x - by


def multiply(x: Column, by) -> Column:
    return x * by


def divide(x: Column, by) -> Column:
    return x / by


def divide_whole(x: Column, by) -> Column:
    """Division of integers, towards zero."""
    return F.call_function("div", x, F.lit(by))


def absolute(x: Column) -> Column:
    return F.abs(x)


def zero(x: Column) -> Column:
    return F.lit(0)


def one(x: Column) -> Column:
    return F.lit(1)


def fill(x: Column, value) -> Column:
    return F.lit(value)


def logical_not(x: Column) -> Column:
    return (x == 0).cast("int")


def set_precision(x: Column, digits: int) -> Column:
    return F.rint(x * float(10**digits)) / float(10**digits)


def float_to_int(x: Column, digits: int) -> Column:
    return F.rint(x * float(10**digits)).cast("long")


def int_to_float(x: Column, digits: int) -> Column:
    return x / float(10**digits)


def bit_length(low: Column, high: Column, width: int) -> Column:
    """Bits that integers between low and high need; all 8 * width if any is negative."""
    return F.when(low < 0, F.lit(8 * width)).otherwise(F.length(F.bin(high.cast("long")))).cast("int")


def bit_length_of(x: Column) -> Column:
    """Bits of one 32-bit value, at least one; 32 if negative."""
    return bit_length(x, x, 4)


def get_bits(x: Column, start: int, n: int) -> Column:
    return F.shiftrightunsigned(x.cast("long"), start).bitwiseAND(F.lit((1 << n) - 1))


def set_bits(x: Column, value: Column, start: int, n: int) -> Column:
    mask = ((1 << n) - 1) << start
    return x.cast("long").bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(value.cast("long"), start).bitwiseAND(F.lit(mask)))


def get_bit(x: Column, i: int) -> Column:
    return get_bits(x, i, 1)


def set_bit(x: Column, i: int, value: Column) -> Column:
    return set_bits(x, value, i, 1)


#: Predicates, named by where they hold.
PREDICATES = {
    "equal": lambda x, v: x == v,
    "not_equal": lambda x, v: x != v,
    "lower": lambda x, v: x < v,
    "greater": lambda x, v: x > v,
    "between": lambda x, low, high: (x >= low) & (x <= high),
    "not_between": lambda x, low, high: (x < low) | (x > high),
}


def stencil(x: Column, predicate: str, *args) -> Column:
    """1 where the predicate holds, else 0."""
    return PREDICATES[predicate](x, *args).cast("int")
