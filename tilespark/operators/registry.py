"""Named encoder variants, and the choice among them by image."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.operators import codec, experiments, kernels

#: name to (tiles (n, 64), quality) -> (restored tiles, bits of each tile)
Variant = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
_VARIANTS: dict[str, tuple[Variant, bool]] = {}


def register_variant(name: str, scalable: bool = False):
    """Decorator. A scalable variant can be rendered at any size."""

    def put(f: Variant) -> Variant:
        if name in _VARIANTS:
            raise ValueError(f"variant {name} is registered twice")
        _VARIANTS[name] = (f, scalable)
        return f

    return put


def variants(scalable_only: bool = False) -> list[str]:
    return [n for n, (_, s) in _VARIANTS.items() if s or not scalable_only]


@dataclass(frozen=True)
class Config:
    """Settings of an encoding; from_dict refuses names and values that it doesn't know."""

    quality: int = 75
    scalable_only: bool = False
    window: float = 5.0
    gain: float = 2.0
    bits_weight: float = 0.02

    @classmethod
    def from_dict(cls, d: dict) -> Config:
        known = {f.name: f.type for f in fields(cls)}
        if unknown := set(d) - set(known):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        for k, v in d.items():
            if known[k] == "bool" and not isinstance(v, bool) or known[k] != "bool" and (isinstance(v, bool) or not isinstance(v, (int, float))):
                raise ValueError(f"{k}: {v!r}")
        return cls(**{**d, "quality": min(100, max(0, int(d.get("quality", cls.quality))))})


@register_variant("dct")
def _dct(tiles, quality):
    q = kernels.dct_quantise(tiles, codec.step_of(quality))
    return kernels.dct_restore(q, codec.step_of(quality)), 4 * (q != 0).sum(axis=1) + 32


@register_variant("bicubic", scalable=True)
def _bicubic(tiles, quality):
    c = np.rint(np.clip(kernels.bicubic_fit(tiles) + 0.5, 0, 1) * 255) / 255 - 0.5
    return kernels.bicubic_eval(c, codec.SIDE), np.full(len(tiles), 16 * 8)


@register_variant("two-tone", scalable=True)
def _two_tone(tiles, quality):
    model, _, c0, c1 = kernels.two_bucket_fit(tiles)
    m = kernels.half_planes(codec.SIDE)[model]
    return np.where(m > 0, c1[:, None], c0[:, None]), np.full(len(tiles), 18 * 8)


@register_variant("gradient")
def _gradient(tiles, quality):
    gx, gy = kernels.forward(tiles)
    code = lambda g: np.clip(np.rint(np.where(np.abs(g) < 0.01, 0, g) * 127), -127, 127)
    qx, qy = code(gx), code(gy)
    return kernels.poisson(qx / 127, qy / 127, tiles.mean(axis=1)), 5 * ((qx != 0).sum(axis=1) + (qy != 0).sum(axis=1)) + 32


def of_cell(v: np.ndarray, cell: dict) -> tuple[np.ndarray, np.ndarray]:
    """A sweep's cell (variant and quality) on a matrix of tiles."""
    if cell["variant"] not in _VARIANTS:
        raise KeyError(f"no variant {cell['variant']}")
    quality = cell["quality"]
    if quality is None or not 0 <= quality <= 100:
        raise ValueError(f"quality {quality}")
    return _VARIANTS[cell["variant"]][0](v, int(quality))


def shared(v: np.ndarray, prims, quality: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The four variants that layer something on one fit: the stacks alone, each tile's cheaper of stack and bicubic patch, and that with a residual layer at the quality's step and at half of it.
    v: grey tiles in 0..1 (n x 64); prims: their stacks."""
    from tilespark.operators import fits

    stack, bits = fits.drawn(prims, codec.SIDE)[:, :, 0], fits.wire_bits(prims)
    lam = ((101 - quality) / 100) ** 2 * (2e-4 if quality >= 90 else 1e-3)
    patch, patch_bits = _bicubic(v - 0.5, quality)
    patch = patch + 0.5
    cheaper = ((v - patch) ** 2).mean(axis=1) + lam * patch_bits < ((v - stack) ** 2).mean(axis=1) + lam * bits
    mixed, mixed_bits = np.where(cheaper[:, None], patch, stack), np.where(cheaper, patch_bits, bits)
    out = {"stacks": (stack, bits), "hybrid": (mixed, mixed_bits)}
    for name, step in (("hybrid-dct", codec.step_of(quality)), ("hybrid-dct-tight", codec.step_of(quality) / 2)):
        q = kernels.dct_quantise(v - mixed, step)
        out[name] = (np.clip(mixed + kernels.dct_restore(q, step), 0, 1), mixed_bits + 4 * (q != 0).sum(axis=1) + 32)
    return out


def compete_shared(tiles: DataFrame, cache: str, quality: int = 75) -> tuple[DataFrame, int]:
    """image, variant, mse, bits, won for the four variants of one fit: the fit is made once for each distinct tile (or found in the cache) and every tile is read once for all variants; also the number of fits that were made.
    The least mse + lam * bits of an image wins, the first on ties."""
    import pyarrow as pa
    from pyspark.sql import Window

    from tilespark.operators import fits

    names = ("stacks", "hybrid", "hybrid-dct", "hybrid-dct-tight")
    grey = F.transform("v", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x + 0.5)))
    d = tiles.select("image", grey.alias("g")).withColumn("v", F.flatten(F.transform("g", lambda x: F.array(x, x, x))))
    d, made = fits.fitted(d, fits.settings(quality), cache)
    lam = ((101 - quality) / 100) ** 2 * (2e-4 if quality >= 90 else 1e-3)

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v = part.column("g").flatten().to_numpy(zero_copy_only=False).reshape(-1, codec.SIDE * codec.SIDE)
                got = shared(v, part.column("prims"), quality)
                cols = [x for n in names for x in (((v - got[n][0]) ** 2).mean(axis=1), np.asarray(got[n][1], float))]
                yield pa.RecordBatch.from_arrays([part.column("image"), *map(pa.array, cols)], names=["image", *[f"{p}{i}" for i in range(len(names)) for p in "mb"]])

    kind = tiles.schema["image"].dataType.simpleString()
    sums = d.filter("prims IS NOT NULL").select("image", "g", "prims").mapInArrow(run, f"image {kind}, " + ", ".join(f"{p}{i} double" for i in range(len(names)) for p in "mb"))
    sums = sums.groupBy("image").agg(*[F.avg(f"{p}{i}").alias(f"{p}{i}") for i in range(len(names)) for p in "mb"])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("variant"), F.col(f"m{i}").alias("mse"), F.col(f"b{i}").alias("bits")) for i, n in enumerate(names)]))
    c = sums.select("image", rows.alias("r")).select("image", "r.*")
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.round(F.col("mse") + F.lit(lam) * F.col("bits"), 12), "ord"))
    return c.select("image", "variant", "mse", "bits", (place == 1).alias("won")), made


def compete(tiles: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """image, variant, psnr, bits, override: the tournament of all variants, image by image. Every tile is fitted once for each
    variant in one pass; only sums travel."""
    names = variants(config.scalable_only)

    def kernel(v):
        out = []
        for n in names:
            back, bits = _VARIANTS[n][0](v, config.quality)
            out += [((v - back) ** 2).mean(axis=1), bits.astype(float)]
        return out

    cols = {f"{part}_{i}": "double" for i in range(len(names)) for part in ("mse", "bits")}
    d = kernels.over_tiles(tiles, "v", cols, kernel, ["image"])
    sums = d.groupBy("image").agg(*[F.avg(c).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("variant"), F.col(f"mse_{i}").alias("mse"), F.col(f"bits_{i}").alias("bits")) for i, n in enumerate(names)]))
    c = sums.select("image", rows.alias("r")).select("image", "r.*").withColumn("psnr", F.log10(F.greatest("mse", F.lit(1e-10))) * -10)
    won = experiments.tournament(c, ["image"], F.col("psnr") - F.col("bits") * config.bits_weight, "psnr", "ord", config.window, config.gain)
    return won.select("image", "variant", F.round("psnr", 6).alias("psnr"), F.round("bits", 6).alias("bits"), "override")
