"""Experiment analytics: leaderboards, Pareto fronts, paired comparisons, hybrids, tournaments and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(facts: DataFrame, profile: str, metrics: Sequence[str], objective: str) -> DataFrame:
    """Count and null-skipping means by profile, with the place by mean objective (nulls last, then by name)."""
    d = facts.groupBy(profile).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 10).alias(f"avg_{m}") for m in metrics])
    w = Window.orderBy(F.asc_nulls_last(f"avg_{objective}"), profile)  # a row for each profile
    return d.withColumn("place", F.row_number().over(w))


def regression(base: DataFrame, candidate: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Deltas of the profiles that both have."""
    a, b = base.alias("a"), candidate.alias("b")
    return a.join(b, key).select(key, *[F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 10).alias(f"delta_{m}") for m in metrics])


def paired(facts: DataFrame, profile: str, item: str, metric: str, top: DataFrame) -> DataFrame:
    """Deltas of every other profile to the top one (a one-row table), item by item."""
    best = facts.join(F.broadcast(top.select(profile)), profile, "left_semi").select(item, F.col(metric).alias("__best"))
    others = facts.join(F.broadcast(top.select(profile)), profile, "left_anti")
    return others.join(best, item).select(profile, item, F.round(F.col(metric) - F.col("__best"), 10).alias("delta"))


def bootstrap(deltas: DataFrame, profile: str, resamples: int = 1000, seed: int = 12345) -> DataFrame:
    """Mean, 2.5 and 97.5 percentiles and the share of resampled means at or below 0, by profile. Each profile has
    a generator of its own, so neither order nor partitioning matters."""
    import numpy as np
    import pandas as pd
    import zlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, d = pdf[profile].iloc[0], np.sort(pdf["delta"].to_numpy(float))
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        means = d[rng.integers(0, len(d), (resamples, len(d)))].mean(axis=1)
        lo, hi = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({profile: [name], "n": [len(d)], "mean_delta": [d.mean()], "low": [lo], "high": [hi], "p_not_worse": [(means <= 0).mean()]})

    return deltas.groupBy(profile).applyInPandas(run, f"{profile} string, n long, mean_delta double, low double, high double, p_not_worse double")


def hybrid_weights(board: DataFrame, profile: str, objective: str, n: int = 3) -> DataFrame:
    """Inverse-objective weights of the best n, normalised."""
    top = board.orderBy(F.asc_nulls_last(objective), profile).limit(n)
    inverse = F.try_divide(F.lit(1.0), F.col(objective))
    return top.select(profile, F.round(inverse / F.sum(inverse).over(Window.partitionBy()), 10).alias("weight"))


def hybrid_suggestion(board: DataFrame, profile: str, objective: str, numeric: Sequence[str], voted: Sequence[str]) -> DataFrame:
    """A configuration from the best three: weighted means of numbers, weighted votes of choices (ties: least)."""
    w = hybrid_weights(board, profile, objective)
    d = board.join(F.broadcast(w), profile)
    means = d.agg(*[F.round(F.sum(F.col(c) * F.col("weight")), 10).alias(c) for c in numeric])
    for c in voted:
        vote = d.groupBy(c).agg(F.round(F.sum("weight"), 10).alias("__v")).agg(F.min(F.struct((-F.col("__v")).alias("v"), c))[c].alias(c))
        means = means.crossJoin(vote)
    return means


def tournament(cands: DataFrame, item: Sequence[str], score: Column, psnr: str, order: str, window: float, gain: float) -> DataFrame:
    """The best score of each item (first in order on ties), unless within ``window`` of it another has ``gain`` dB more."""
    c = cands.withColumn("__s", score).withColumn("__p", F.when(F.isnan(psnr) | F.col(psnr).isNull(), -1e9).otherwise(F.col(psnr)))
    by = Window.partitionBy(*item)
    c = c.withColumn("__best", F.max(F.struct("__s", (-F.col(order)).alias("o"), F.col("__p").alias("p"))).over(by))
    band = F.col("__s") >= F.col("__best.__s") - window
    c = c.withColumn("__sharp", F.max(F.when(band, F.struct(F.col("__p").alias("p"), (-F.col(order)).alias("o")))).over(by))
    swap = F.col("__sharp.p") >= F.col("__best.p") + gain
    won = F.when(swap, F.col("__sharp.o") == -F.col(order)).otherwise(F.col("__best.o") == -F.col(order))
    return c.filter(won).withColumn("override", swap).drop("__s", "__p", "__best", "__sharp")


def gate(board: DataFrame, profile: str, baseline: str, checks: dict[str, tuple[str, float]]) -> DataFrame:
    """For each profile, whether its deltas to the baseline's row pass: metric to ("max" or "min", bound)."""
    b = board.filter(F.col(profile) == baseline).select(*[F.col(m).alias(f"__{m}") for m in checks]).limit(1)
    d = board.filter(F.col(profile) != baseline).crossJoin(F.broadcast(b))  # one row
    out, ok = [], F.lit(True)
    for m, (kind, bound) in checks.items():
        delta = F.round(F.col(m) - F.col(f"__{m}"), 10)
        passed = delta <= bound if kind == "max" else delta >= bound
        out += [delta.alias(f"delta_{m}")]
        ok = ok & F.coalesce(passed, F.lit(False))
    return d.select(profile, *out, ok.alias("accepted"))
