"""Results of experiments as files: CSV and JSON by Spark's writers, JSON reports read back, a small HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table below folder/name, as CSV where all columns are plain and as JSON otherwise; existing ones are replaced."""
    for name, df in tables.items():
        plain = all("<" not in t for _, t in df.dtypes)
        w = df.write.mode("overwrite")
        w.option("header", "true").csv(f"{folder}/{name}") if plain else w.json(f"{folder}/{name}")


def profiles(spark: SparkSession, path: str, defaults: dict[str, float]) -> DataFrame:
    """name, config map and one weight column for each default, from JSON lines {name, config, weights}; what is missing gets its default."""
    weights = ", ".join(f"{k}: DOUBLE" for k in defaults)
    d = spark.read.schema(f"name STRING, config MAP<STRING, STRING>, weights STRUCT<{weights}>").json(path)
    return d.select("name", F.coalesce("config", F.create_map().cast("map<string,string>")).alias("config"), *[F.coalesce(F.col(f"weights.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()])


def report(spark: SparkSession, path: str) -> DataFrame:
    """The leaderboard rows of JSON reports {leaderboard: [...]}, several files at once."""
    d = spark.read.option("multiLine", "true").json(path)
    return d.select(F.explode("leaderboard").alias("r")).select("r.*")


def canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def page(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """An HTML page of the first rows of small tables, escaped; null is n/a."""
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out)
