"""Colour conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions.numeric import clamp

#: Rec. 709 luma (fixed values).
LUMA = (0.2126, 0.7152, 0.0722)


def srgb_to_linear(s: Column) -> Column:
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    c = clamp(v, 0.0, 1.0)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 without offsets."""
    y = r * 0.299 + g * 0.587 + b * 0.114
    return y, (b - y) / 1.772, (r - y) / 1.402


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    r, b = y + cr * 1.402, y + cb * 1.772
    return r, (y - r * 0.299 - b * 0.114) / 0.587, b
