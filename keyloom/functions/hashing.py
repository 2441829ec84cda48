"""Hash functions of integer keys, and reductions to buckets, as column expressions.

ANSI arithmetic refuses overflow, so products are split in halves of sixteen bits;
every intermediate value stays below 2**53. Functions of 32 bits take and give
non-negative whole numbers; those of 64 bits and ``xxhash64`` give the 64 bits as a
long, so half of their values are negative, which ``mod`` folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK32 = 0xFFFFFFFF


def _times32(x: Column, c: int) -> Column:
    """x * c modulo 2**32, for x and c below 2**32."""
    low, high = x.bitwiseAND(65535) * c, F.shiftright(x, 16) * c
    return (low + high.bitwiseAND(65535) * 65536).bitwiseAND(_MASK32)


def _fold(x: Column) -> Column:
    """A 63-bit key as 32 bits: both halves combined."""
    return x.bitwiseAND(_MASK32).bitwiseXOR(F.shiftrightunsigned(x, 32))


def murmur32(key: Column) -> Column:
    """The 32-bit Murmur3 finalizer."""
    x = key.cast("long").bitwiseAND(_MASK32)
    # Fixed values of the published finalizer: shifts 16, 13, 16; multipliers.
    x = _times32(x.bitwiseXOR(F.shiftright(x, 16)), 0x85EBCA6B)
    x = _times32(x.bitwiseXOR(F.shiftright(x, 13)), 0xC2B2AE35)
    return x.bitwiseXOR(F.shiftright(x, 16))


def _times64(x: Column, c: int) -> Column:
    """The lower 64 bits of x * c, for any long x and c below 2**64."""
    low, high = x.bitwiseAND(_MASK32), F.shiftrightunsigned(x, 32)
    c_low, c_high = c & _MASK32, c >> 32
    # The product of the lower halves has 64 bits: its lower and upper half apart.
    first, second = low.bitwiseAND(65535) * c_low, F.shiftright(low, 16) * c_low
    middle = F.shiftright(first, 16) + second
    lower = F.shiftleft(middle.bitwiseAND(65535), 16).bitwiseOR(first.bitwiseAND(65535))
    upper = F.shiftright(middle, 16) + _times32(high, c_low) + _times32(low, c_high)
    return F.shiftleft(upper.bitwiseAND(_MASK32), 32).bitwiseOR(lower)


def fmix64(key: Column) -> Column:
    """The 64-bit Murmur3 finalizer."""
    x = key.cast("long")
    # Fixed values of the published finalizer: shifts 33; multipliers.
    x = _times64(x.bitwiseXOR(F.shiftrightunsigned(x, 33)), 0xFF51AFD7ED558CCD)
    x = _times64(x.bitwiseXOR(F.shiftrightunsigned(x, 33)), 0xC4CEB9FE1A85EC53)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def mult_prime64(key: Column) -> Column:
    """Multiplicative hashing by the largest prime below 2**64."""
    return _times64(key.cast("long"), 2**64 - 59)


def fibonacci64(key: Column) -> Column:
    """Multiplicative hashing by 2**64 over the golden ratio."""
    return _times64(key.cast("long"), 0x9E3779B97F4A7C15)


def byte_swapped(key: Column) -> Column:
    """The eight bytes of a long in the opposite order, as radix trees compare them."""
    x = key.cast("long")
    out = F.lit(0).cast("long")
    for i in range(8):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 8 * i).bitwiseAND(255), 56 - 8 * i))
    return out


def radix_prefix(key: Column, low: int, high: int, bits: int = 12) -> Column:
    """The upper ``bits`` bits of a key between ``low`` and ``high``, as the upper nodes of a radix tree branch; others are clamped."""
    shift = max(0, (high - low).bit_length() - bits)
    return F.shiftrightunsigned(bounded(key.cast("long"), low, high) - low, shift)


def murmur64(key: Column) -> Column:
    """Two lanes of ``murmur32`` over the halves of a key, 62 bits."""
    x = key.cast("long")
    low = murmur32(x.bitwiseXOR(F.lit(0x9E3779B9)))
    high = murmur32(_fold(x))
    return F.shiftleft(high.bitwiseAND(0x3FFFFFFF), 32).bitwiseOR(low)


def mult_prime32(key: Column) -> Column:
    """Multiplicative hashing by a large prime."""
    return _times32(_fold(key.cast("long")), 4294967291)


def fibonacci32(key: Column) -> Column:
    """Multiplicative hashing by 2**32 over the golden ratio."""
    return _times32(_fold(key.cast("long")), 0x9E3779B1)


#: Named hash functions; users may add callables from a column to a column.
HASHES: dict[str, Callable[[Column], Column]] = {
    "murmur32": murmur32,
    "murmur64": murmur64,
    "mult_prime32": mult_prime32,
    "fibonacci32": fibonacci32,
    "fmix64": fmix64,
    "mult_prime64": mult_prime64,
    "fibonacci64": fibonacci64,
    "xxhash64": lambda k: F.xxhash64(k.cast("long")),
    "identity": lambda k: k.cast("long"),
}


def mod(h: Column, n: int | Column) -> Column:
    """Bucket by remainder, never negative."""
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n)).cast("long")


def fast_range(h: Column, n: int | Column) -> Column:
    """Bucket of a 32-bit hash by multiply and shift; n below 2**31."""
    return F.shiftright(h * n, 32)


def mask(h: Column, bits: int, skip: int = 0) -> Column:
    """Bucket by ``bits`` bits above the lowest ``skip``."""
    return F.shiftright(h.bitwiseAND(((1 << bits) - 1) << skip), skip)


def next_pow2(n: int) -> int:
    """The least power of two that is at least ``n``."""
    return 1 << max(0, (n - 1).bit_length())


REDUCTIONS: dict[str, Callable] = {"mod": mod, "fast_range": fast_range, "mask": lambda h, n: mask(h, next_pow2(n).bit_length() - 1)}


def linear(x: Column, slope: float | Column, intercept: float | Column) -> Column:
    """A linear model's value."""
    return slope * x + intercept


def bounded(x: Column, low: int | float, high: int | float) -> Column:
    """``x``, or the bound that it lies beyond."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _xor_shift_sql(x: str, n: int) -> str:
    return f"xor({x}, {x} >> {n})"


def _times64_sql(x: str, c: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _signed_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775808 THEN CAST(CAST({x} AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST({x} AS BIGINT) END"


def steps64_sql(source: str, steps: list[str], columns: str = "key") -> str:
    """Common table expressions s0, s1 ... that put a non-negative ``key`` of ``source`` through steps in terms of ``x``, an unsigned long; the last has ``h``, signed."""
    out = [f"s0 AS (SELECT {columns}, CAST(key AS UBIGINT) AS x FROM {source})"]
    out += [f"s{i + 1} AS (SELECT {columns}, {step} AS x FROM s{i})" for i, step in enumerate(steps)]
    return ", ".join([*out, f"hashed AS (SELECT {columns}, {_signed_sql('x')} AS h FROM s{len(steps)})"])


def fmix64_steps() -> list[str]:
    return [_xor_shift_sql("x", 33), _times64_sql("x", 0xFF51AFD7ED558CCD), _xor_shift_sql("x", 33), _times64_sql("x", 0xC4CEB9FE1A85EC53), _xor_shift_sql("x", 33)]


def mult64_steps(c: int) -> list[str]:
    return [_times64_sql("x", c)]


def xxhash64_steps(seed: int = 42) -> list[str]:
    """The published 64-bit hash of eight bytes."""
    # Fixed values of the published hash: primes, rotations, shifts.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    turn = lambda x, n: f"CAST(((CAST({x} AS UHUGEINT) << {n}) | (CAST({x} AS UHUGEINT) >> {64 - n})) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    plus = lambda x, n: f"CAST((CAST({x} AS UHUGEINT) + {n}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    start = (seed + p5 + 8) % 2**64
    return [_times64_sql("x", p2), turn("x", 31), _times64_sql("x", p1), f"xor(x, {start}::UBIGINT)", turn("x", 27), _times64_sql("x", p1), plus("x", p4), _xor_shift_sql("x", 33), _times64_sql("x", p2), _xor_shift_sql("x", 29), _times64_sql("x", p3), _xor_shift_sql("x", 32)]


def murmur32_sql(x: str) -> str:
    """``murmur32`` in SQL with ``xor``, ``&`` and ``>>``."""
    times = lambda v, c: f"((({v}) & 65535) * {c} + (((({v}) >> 16) * {c}) & 65535) * 65536) & 4294967295"
    a = f"xor(({x}) & 4294967295, (({x}) & 4294967295) >> 16)"
    b = f"({times(a, 0x85EBCA6B)})"
    c = f"({times(f'xor({b}, {b} >> 13)', 0xC2B2AE35)})"
    return f"xor({c}, {c} >> 16)"
