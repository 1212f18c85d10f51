"""The library in a few calls: encode and decode (tiles or image files), bench, experiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.operators import codec, experiments, sweeps


def encode(tiles: DataFrame, quality: int = 75) -> DataFrame:
    """(image, tile, v array<double>) to containers, a row for each part of an image."""
    return codec.encode(tiles, quality)


def decode(parts: DataFrame) -> DataFrame:
    """Containers back to tiles, with each tile's error against its samples."""
    return codec.decode(parts)


def encode_files(spark: SparkSession, path: str, quality: int = 75) -> DataFrame:
    """Image files below a folder to containers: image, height, width, ch, part and blob."""
    from tilespark.sources import images

    return codec.encode_images(images.tiles(spark, path, codec.SIDE), quality)


def decode_files(parts: DataFrame, folder: str) -> DataFrame:
    """Containers of encode_files to PNG files in a folder that the tasks reach; name and bytes of each.

    A file is named by its image's last name and a digest of its whole path, so images of two folders don't meet."""
    from tilespark.sources import images

    stem = F.regexp_extract("image", r"([^/]*?)(\.\w+)?$", 1)
    d = codec.restore_images(parts).filter("png IS NOT NULL")
    return images.save(d.select(F.concat(stem, F.lit("-"), F.substring(F.sha2("image", 256), 1, 12), F.lit(".png")).alias("name"), "png"), folder)


def encode_pictures(spark: SparkSession, path: str, out: str, quality: int = 75, basis: str = "auto") -> DataFrame:
    """Image files below a folder to container files below out, by the encoder that suits each part (or by the one named): image, y, x, basis, mse, bits and error of each part. Parts are encoded once, into a table."""
    from tilespark import session
    from tilespark.operators import encoder
    from tilespark.sources import images, tile_files

    d = session.written(encoder.encode(images.tiles(spark, path, encoder.TILE), quality, basis), "pictures")
    tile_files.save(d.filter("blocks IS NOT NULL"), out)
    return d.drop("name", "blocks", "meta")


def decode_pictures(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Container files of encode_pictures to PNG files; name and bytes of each. Images that can't be restored are left out."""
    from tilespark.operators import encoder
    from tilespark.sources import images, tile_files

    stem = F.regexp_extract("image", r"([^/]*?)(\.\w+)?$", 1)
    d = encoder.restored(tile_files.load(spark, path, complete="true")).filter("png IS NOT NULL")
    return images.save(d.select(F.concat(stem, F.lit("-"), F.substring(F.sha2("image", 256), 1, 12), F.lit(".png")).alias("name"), "png"), folder)


def picture_experiment(spark: SparkSession, path: str, profiles: list[dict], weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Profiles (name, quality and basis: few) on the image files below a folder: facts by profile and image (bits a pixel, mse, psnr, and the error of an image that failed), leaderboard, front and bootstrap."""
    from tilespark import session
    from tilespark.functions import rd
    from tilespark.operators import encoder
    from tilespark.operators.relational import skyline
    from tilespark.sources import images

    weights = weights or {"bits_per_pixel": 1.0, "psnr": -0.1}
    tiles = session.written(images.tiles(spark, path, encoder.TILE), "tiles")
    size = tiles.groupBy("image").agg(F.first("height").alias("height"), F.first("width").alias("width"))
    part = F.least(F.lit(encoder.SIDE), F.col("height") - F.col("y")) * F.least(F.lit(encoder.SIDE), F.col("width") - F.col("x"))
    facts = None
    for p in profiles:
        d = encoder.encode(tiles, int(p["quality"]), p.get("basis", "auto")).join(size, "image")
        d = d.groupBy("image").agg(F.sum("bits").alias("bits"), F.sum(F.col("mse") * part).alias("m"), F.sum(part).alias("pixels"), F.max("error").alias("error"))
        mse = F.when(F.col("error").isNull(), F.col("m") / F.col("pixels"))
        d = d.select(F.lit(p["name"]).alias("profile"), "image", F.when(F.col("error").isNull(), F.col("bits") / F.col("pixels")).alias("bits_per_pixel"), mse.alias("mse"), (-10 * F.log10(F.greatest(mse, F.lit(1e-10)))).alias("psnr"), "error")
        facts = d if facts is None else facts.unionByName(d)
    facts = session.written(facts.withColumn("objective", rd.objective({m: F.col(m) for m in weights}, weights)), "facts")
    board = experiments.leaderboard(facts, "profile", [*weights, "objective"], "objective")
    lower, higher = [f"avg_{m}" for m, w in weights.items() if w > 0], [f"avg_{m}" for m, w in weights.items() if w <= 0]
    pairs = experiments.paired(facts, "profile", "image", "objective", board.filter("place = 1"))
    return {"facts": facts, "leaderboard": board, "pareto": skyline(board, lower, higher), "bootstrap": experiments.bootstrap(pairs, "profile")}


def bench(tiles: DataFrame, qualities: list[int]) -> DataFrame:
    """One row for each quality and image: bytes, bits a sample, mean squared error and PSNR."""
    out = None
    for q in qualities:
        d = decode(encode(tiles, q)).groupBy("image").agg(F.count(F.lit(1)).alias("tiles"), F.avg("mse").alias("mse"), F.max("bytes").alias("bytes"))
        d = d.select(F.lit(f"q{q}").alias("profile"), "image", "bytes", (F.col("bytes") * 8 / (F.col("tiles") * 64)).alias("bits_per_sample"), "mse", (-10 * F.log10(F.greatest("mse", F.lit(1e-10)))).alias("psnr"))
        out = d if out is None else out.unionByName(d)
    return out


def experiment(spark: SparkSession, axes: dict, template: str, evaluate: Callable[[DataFrame], DataFrame], weights: dict[str, float]) -> dict[str, DataFrame]:
    """A sweep: the grid of profiles, what evaluate makes of it (profile, image and metrics; an error column is kept), the
    leaderboard by weighted objective, the Pareto front of its means and the paired bootstrap against the winner."""
    from tilespark.functions import rd
    from tilespark.operators.relational import skyline

    grid = sweeps.grid(spark, axes, template)
    facts = evaluate(grid)
    facts = facts.withColumn("objective", rd.objective({m: F.col(m) for m in weights}, weights))
    board = experiments.leaderboard(facts, "profile", [*weights, "objective"], "objective")
    lower, higher = [f"avg_{m}" for m, w in weights.items() if w > 0], [f"avg_{m}" for m, w in weights.items() if w <= 0]
    pairs = experiments.paired(facts, "profile", "image", "objective", board.filter("place = 1"))
    return {"grid": grid, "facts": facts, "leaderboard": board, "pareto": skyline(board, lower, higher), "bootstrap": experiments.bootstrap(pairs, "profile")}


def suite(spark: SparkSession, profiles: DataFrame, evaluate: Callable[[DataFrame], DataFrame], weights: dict[str, float], numeric: list[str], voted: list[str], hybrid: str = "hybrid_top3") -> dict[str, DataFrame]:
    """An experiment that ends with its hybrid evaluated too: profiles (profile, numeric and voted settings) are evaluated, the best three suggest a configuration (weighted means and votes), which is evaluated
    like the others unless a profile of that name has been, and the board, the front and the bootstrap are made of all results. Facts are written once, so nothing is evaluated twice."""
    from tilespark import session
    from tilespark.functions import rd
    from tilespark.operators.relational import skyline

    scored = lambda d: d.withColumn("objective", rd.objective({m: F.col(m) for m in weights}, weights))
    metrics = [*weights, "objective"]
    base = session.written(scored(evaluate(profiles)), "facts")
    board = experiments.leaderboard(base, "profile", metrics, "objective")
    suggestion = experiments.hybrid_suggestion(board.join(profiles, "profile"), "profile", "avg_objective", numeric, voted).withColumn("profile", F.lit(hybrid)).select("profile", *numeric, *voted)
    suggestion = session.written(suggestion.join(profiles.select("profile"), "profile", "left_anti"), "hybrid")
    again = session.written(scored(evaluate(suggestion)).select(*base.columns), "facts-hybrid")
    facts = base.unionByName(again)
    final = experiments.leaderboard(facts, "profile", metrics, "objective")
    lower, higher = [f"avg_{m}" for m, w in weights.items() if w > 0], [f"avg_{m}" for m, w in weights.items() if w <= 0]
    pairs = experiments.paired(facts, "profile", "image", "objective", final.filter("place = 1"))
    return {"facts": facts, "base": board, "hybrid": suggestion, "leaderboard": final, "pareto": skyline(final, lower, higher), "bootstrap": experiments.bootstrap(pairs, "profile")}
