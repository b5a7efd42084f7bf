"""Scalar rules shared by the operators, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def every(n: int, ordinal: Column | str) -> Column:
    """True at each n-th ordinal; never for n = 0."""
    return F.lit(False) if n == 0 else (col(ordinal) % F.lit(n)) == 0


def clamp(c: Column, low: int | float | Column, high: int | float | Column) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, c))


def byte(c: Column) -> Column:
    return clamp(c, 0, 255).cast("int")


def short(c: Column) -> Column:
    return clamp(c, -32768, 32767).cast("int")


def wrap(c: Column, n: int | Column) -> Column:
    return F.pmod(c, F.lit(n) if isinstance(n, int) else n)


def div_round(v: Column, d: int | Column) -> Column:
    """Integer division, half away from zero; a divisor of at most 1 changes nothing."""
    d = F.lit(d) if isinstance(d, int) else d
    half = F.floor(d / 2)
    away = F.floor((F.abs(v) + half) / d) * F.signum(v.cast("double")).cast("long")
    return F.when(d <= 1, v).otherwise(away).cast("int")


def half_away(v: Column) -> Column:
    """Rounding of a double, half away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) + F.lit(0.5))).cast("long")


def luma_fast(r, g, b) -> Column:
    return F.shiftright(77 * col(r) + 150 * col(g) + 29 * col(b), 8)


def ycbcr(r, g, b) -> tuple[Column, Column, Column]:
    r, g, b = col(r), col(g), col(b)
    return (
        byte(F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)),
        byte(F.shiftright(-43 * r - 85 * g + 128 * b + 128, 8) + 128),
        byte(F.shiftright(128 * r - 107 * g - 21 * b + 128, 8) + 128),
    )


def rgb(luma, cb, cr) -> tuple[Column, Column, Column]:
    y, cb, cr = col(luma), col(cb) - 128, col(cr) - 128
    return (
        byte(y + F.shiftright(359 * cr + 128, 8)),
        byte(y - F.shiftright(88 * cb + 183 * cr + 128, 8)),
        byte(y + F.shiftright(454 * cb + 128, 8)),
    )


def ycocg(r, g, b) -> tuple[Column, Column, Column]:
    """Reversible luma, orange and green differences."""
    r, g, b = col(r), col(g), col(b)
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return t + F.shiftright(cg, 1), co, cg


def ycocg_back(y, co, cg) -> tuple[Column, Column, Column]:
    y, co, cg = col(y), col(co), col(cg)
    t = y - F.shiftright(cg, 1)
    b = t - F.shiftright(co, 1)
    return b + co, cg + t, b


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * clamp(t, 0.0, 1.0)


def gate(score: Column, threshold: float, softness: float) -> Column:
    """A hard threshold, or a smooth step as wide as ``softness``."""
    if softness == 0:
        return F.when(score >= threshold, 1.0).otherwise(0.0)
    t = clamp((score - F.lit(float(threshold))) / F.lit(float(softness)), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def index_jitter(i: Column, axis: int, amount: int) -> Column:
    """A fixed wobble in -amount..amount by index and axis."""
    if amount == 0:
        return F.lit(0)
    return ((i.cast("long") * 1103515245 + axis * 2654435761 + 12345) % (2 * amount + 1) - amount).cast("int")


def scaled_vector(v: Column, s: float) -> Column:
    return short(half_away(v * F.lit(float(s))))


def quantized_vector(v: Column, q: int) -> Column:
    return v if q <= 1 else short(half_away(v / F.lit(float(q))) * q)


def rotated(array: Column, by: int) -> Column:
    """An array rotated right by ``by`` (left if negative), modulo its length."""
    n = F.size(array)
    k = F.pmod(F.lit(by), n)
    return F.when(n <= 1, array).otherwise(F.concat(F.slice(array, n - k + 1, k), F.slice(array, F.lit(1), n - k)))


def jpeg_scale(quality: int) -> int:
    return 5000 // quality if quality < 50 else 200 - 2 * quality


def jpeg_table(base: list[int], quality: int) -> list[int]:
    s = jpeg_scale(quality)
    return [min(255, max(1, (t * s + 50) // 100)) for t in base]


def wavelet_step(quality: int, levels: int, level: int, detail: bool, channel: int) -> int:
    """Quantizer of a band: finer for the approximation, coarser for chroma and for fine detail."""
    if quality >= 100:
        return 1
    base = 1 + (101 - quality) ** 2 // 180
    chroma = 2 if channel else 1
    return base * (levels - level + 1) * chroma if detail else max(1, base // 3) * chroma
