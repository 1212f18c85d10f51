"""Clamping, quantising and rounding as column expressions (rounding is half to even)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def affine_quantise(v: Column, lo: float, hi: float, levels: int = 255) -> Column:
    """[lo, hi] to 0..levels; values outside are clamped."""
    return F.rint(clamp((v - lo) / (hi - lo), 0.0, 1.0) * levels).cast("int")


def affine_dequantise(q: Column, lo: float, hi: float, levels: int = 255) -> Column:
    return q / levels * (hi - lo) + lo


def snap(v: Column, lo: float, hi: float, levels: int = 255) -> Column:
    """The value that storing and reading v gives."""
    return affine_dequantise(affine_quantise(v, lo, hi, levels), lo, hi, levels)


def signed_byte(v: Column, scale: float = 255.0, most: int = 127) -> Column:
    return clamp(F.rint(v * scale), -float(most), float(most)).cast("int")


def align(v: Column, to: int) -> Column:
    return (F.ceil(v / to) * to).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")
