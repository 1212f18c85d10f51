"""Rate-distortion constants by quality, rates and objectives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions.numeric import clamp

#: Bytes of a primitive by kind (const, linear, line, curve, triangle; others OTHER) and of fixed parts (fixed values).
KIND_BYTES = {0: 7, 1: 18, 2: 17, 3: 21, 4: 19}
OTHER = 20


def quality(q: Column) -> Column:
    return clamp(q, 0, 100)


def tile_lambda(q: Column) -> Column:
    c = quality(q)
    return F.pow((F.lit(101.0) - c) / 100, F.lit(2.0)) * F.when(c >= 90, 2e-4).otherwise(1e-3)


def dct_step(q: Column) -> Column:
    c = clamp(q, 10, 99)
    return clamp(F.pow((F.lit(101.0) - c) / 100, F.lit(2.0)) * 0.2, 0.003, 0.20)


def frequency_weight(i: Column, j: Column, n: int, alpha: float) -> Column:
    return F.lit(1.0) if n == 1 else (i + j) * (alpha / (2.0 * (n - 1))) + 1.0


def select_lambda_scale(q: Column) -> Column:
    """How much auto-selection weighs bytes: less and less above quality 75."""
    return F.when(q > 75, F.pow((F.lit(100.0) - q) / 25, F.lit(2.0))).otherwise(1.0)


def scale_byte(s: Column) -> Column:
    """Tile scale in [0.25, 4] to a byte, evenly in log2."""
    return F.rint((F.log2(clamp(s, 0.25, 4.0)) + 2) / 4 * 255).cast("int")


def byte_scale(b: Column) -> Column:
    return F.pow(F.lit(2.0), b / 255 * 4 - 2)


def primitive_bits(kind: Column) -> Column:
    size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_BYTES.items() for x in kv]), kind), F.lit(OTHER))
    return size * 8


def objective(row: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum that skips null metrics."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(row[name] * w, F.lit(0.0))
    return out
