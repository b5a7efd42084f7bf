"""Unsigned 64-bit arithmetic on BIGINT bit patterns, safe in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
#: Fixed values of the two finalisers and of the seeds.
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
GOLDEN = 0x9E3779B97F4A7C15
SLOT_BLOCK, SLOT_FRAME = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
CELL_Y = 0x2545F4914F6CDD1D


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK32))


def _high(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _times32(a: Column, b: int) -> Column:
    """Low 32 bits of a 32-bit column times a 32-bit constant."""
    upper = (F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF))
    return _low(a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b) + F.shiftleft(upper, 16))


def times(a: Column, constant: int) -> Column:
    """a * constant modulo 2**64."""
    constant &= (1 << 64) - 1
    ch, cl = constant >> 32, constant & MASK32

    def product(v):
        low, high = _low(v), _high(v)
        part = F.shiftright(low, 16) * F.lit(cl)
        total = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(cl) + F.shiftleft(part.bitwiseAND(F.lit(0xFFFF)), 16)
        carry = F.shiftright(total, 32) + F.shiftright(part, 16)
        return _joined(_low(carry + _times32(high, cl) + _times32(low, ch)), _low(total))

    return let(a.cast("long"), product)


def plus(a: Column, b: Column) -> Column:
    """a + b modulo 2**64."""

    def added(s):
        low = _low(s["a"]) + _low(s["b"])
        return _joined(_low(_high(s["a"]) + _high(s["b"]) + F.shiftright(low, 32)), _low(low))

    return let(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), added)


def modulo(a: Column, n: int | Column) -> Column:
    """The unsigned remainder."""
    n = F.lit(n) if isinstance(n, int) else n
    return let(a, lambda v: ((F.shiftrightunsigned(v, 1) % n) * 2 + v.bitwiseAND(F.lit(1))) % n)


def _xor_shift(a: Column, n: int) -> Column:
    return let(a, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))


def mix(a: Column) -> Column:
    """Finaliser without the golden-ratio step."""
    a = times(_xor_shift(a, 30), MIX_A)
    a = times(_xor_shift(a, 27), MIX_B)
    return _xor_shift(a, 31)


def splitmix(a: Column) -> Column:
    """Finaliser after adding the golden ratio."""
    return mix(plus(a.cast("long"), F.lit(signed(GOLDEN))))


def unit(a: Column) -> Column:
    """The top 24 bits of the mixed value as a float in [0, 1)."""
    return F.shiftrightunsigned(mix(a), 40).cast("float") / F.lit(16777216.0).cast("float")


def dot(*terms: tuple[Column, int]) -> Column:
    """Sum of column * constant, modulo 2**64."""
    total = None
    for column, constant in terms:
        term = times(column, constant)
        total = term if total is None else plus(total, term)
    return total


def cell_seed(block: Column, x: Column, y: Column, bucket: Column, cell_x: int, cell_y: int) -> Column:
    """Seed of a cell of samples within a block and latch bucket."""
    return dot((block, GOLDEN), (bucket, MIX_A), (F.floor(x / cell_x), MIX_B), (F.floor(y / cell_y), CELL_Y))
