"""Sweeps and dataset packs as JSON files: schema-checked, with a row for what is wrong.

A sweep is an object with axes (name to a list of values), and may have name_template, base_encode_config, env and objective_weights. Its profiles are the product of its axes in their order, made by
column expressions inside the file's row, so thousands of sweeps are read in parallel and none goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What profiles weigh metrics with unless they say so (fixed values).
WEIGHTS = {"lpips": 1.0, "one_minus_ssim": 0.5, "edge_mse": 0.5, "bpp": 0.25, "encode_seconds": 0.02, "decode_seconds": 0.02}
_STRINGS = "map<string,string>"


def _empty() -> Column:
    return F.create_map().cast(_STRINGS)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, _empty())


def profiles(files: DataFrame, text: str = "value") -> DataFrame:
    """The columns of files, and i, name, config, env, a weight a metric and error: a row for each profile; a file that is no sweep gives one row with its error and nulls.
    Values keep the text that they have in the file."""
    raw = F.from_json(text, "struct<axes:string,name_template:string,base_encode_config:map<string,string>,env:map<string,string>,objective_weights:map<string,double>>")
    d = files.withColumn("__s", raw)
    axes = F.map_entries(F.from_json("__s.axes", _STRINGS))
    d = d.withColumn("__a", F.transform(axes, lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], "array<string>").alias("values"))))
    broken = F.filter("__a", lambda e: e["values"].isNull() | (F.size(e["values"]) == 0) | ~e["key"].rlike(r"^\S+$"))
    is_object = F.coalesce(F.trim(text).startswith("{"), F.lit(False)) & F.col("__s").isNotNull() & (F.json_object_keys(text).isNotNull())
    error = (
        F.when(~is_object, "a sweep is a JSON object")
        .when(F.col("__a").isNull() | (F.size("__a") == 0), "a sweep has axes")
        .when(F.size(broken) > 0, F.concat(F.lit("axis "), broken[0]["key"], F.lit(" is no list of values")))
    )
    d = d.withColumn("error", error)
    add = lambda made, e: F.flatten(F.transform(made, lambda m: F.transform(e["values"], lambda v: F.map_concat(m, F.create_map(e["key"], v)))))
    product = F.aggregate("__a", F.array(_empty()), add)
    d = d.withColumn("__p", F.when(F.col("error").isNull(), product).otherwise(F.array(F.lit(None).cast(_STRINGS))))
    d = d.select("*", F.posexplode("__p").alias("__i", "__t"))
    ok = F.col("error").isNull()
    tags = F.map_entries(F.map_concat(F.create_map(F.lit("i"), F.col("__i").cast("string")), F.map_filter("__t", lambda k, _: k != "i")))
    template = F.coalesce("__s.name_template", F.lit("sweep_{i}"))
    name = F.aggregate(tags, template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("null"))))
    base = F.map_filter(_or_empty(F.col("__s.base_encode_config")), lambda k, _: ~F.map_contains_key("__t", k))
    weights = _or_empty(F.col("__s.objective_weights").cast(_STRINGS))
    return d.select(
        *files.columns, F.when(ok, F.col("__i")).alias("i"), F.when(ok, name).alias("name"), F.when(ok, F.map_concat(base, F.col("__t"))).alias("config"), F.when(ok, _or_empty(F.col("__s.env"))).alias("env"),
        *[F.when(ok, F.coalesce(F.try_element_at(weights, F.lit(k)).cast("double"), F.lit(v))).alias(k) for k, v in WEIGHTS.items()], "error",
    )


def sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of the JSON files below a folder (or of one), with the file's path."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return profiles(d).drop("value")


def packs(spark: SparkSession, path: str) -> DataFrame:
    """pack and folder of a file {"packs": {pack: folder}}; a file without them raises when it is used."""
    d = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "struct<packs:map<string,string>>")["packs"]
    m = F.when(m.isNull(), F.raise_error(F.lit("a file of packs has an object named packs"))).otherwise(m)
    return d.select(F.explode(m).alias("pack", "folder"))


def resolved(asked: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """asked (with dataset and pack) with folder and error: the pack's folder below the dataset's, the dataset itself where no pack is asked for. Packs are few: the table is broadcast."""
    d = asked.join(F.broadcast(known.select("pack", F.col("folder").alias("__f"))), "pack", "left")
    top = F.concat(F.lit(root.rstrip("/") + "/"), F.col("dataset"))
    folder = F.when(F.col("pack").isNull(), top).when(F.col("__f").isNotNull(), F.concat(top, F.lit("/"), F.col("__f")))
    return d.withColumn("folder", folder).withColumn("error", F.when(folder.isNull(), F.concat(F.lit("no such pack: "), F.col("pack")))).drop("__f")
