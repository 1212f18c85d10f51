"""Experiment analytics on orders and customers: profile is priority and status, image the customer's nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import rd
from tilespark.operators import experiments as E
from tilespark.operators import relational as R
from tilespark.plans.catalogue import register
from tilespark.session import table

_FACTS = """f AS (SELECT o_orderpriority || '/' || o_orderstatus AS profile, c_nationkey AS image, count(*) AS n,
  round(avg(o_totalprice) / 100000 + 1.23e-7, 4) AS bpp, round(30 + avg(c_acctbal) / 1000 + 1.23e-7, 4) AS psnr, round(max(o_totalprice) / 1000, 5) AS decode_ms,
  CAST(sum(floor(o_totalprice)) AS BIGINT) AS bytes, CAST(sum(floor(c_acctbal) + 1000) AS BIGINT) AS png_bytes
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
o AS (SELECT *, round(bpp * 2 + coalesce(CASE WHEN n % 7 <> 0 THEN decode_ms END * 0.001, 0) - psnr * 0.05, 10) AS objective FROM f)"""
_BOARD = """b AS (SELECT profile, count(*) AS n, round(avg(bpp), 10) AS avg_bpp, round(avg(psnr), 10) AS avg_psnr, round(avg(decode_ms), 10) AS avg_decode_ms,
  round(avg(objective), 10) AS avg_objective FROM o GROUP BY 1)"""
#: Keeps means off the middle between two rounded values; from there on, 10 digits hold means of up to 127 values exactly.
NUDGE = 1.23e-7
WEIGHTS = {"bpp": 2.0, "slow": 0.001, "psnr": -0.05}


def facts(spark, sf, where=None):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    o = o.filter(where) if where else o
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    d = d.groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("profile"), F.col("c_nationkey").alias("image")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice") / 100000 + NUDGE, 4).alias("bpp"), F.round(F.avg("c_acctbal") / 1000 + 30 + NUDGE, 4).alias("psnr"),
        F.round(F.max("o_totalprice") / 1000, 5).alias("decode_ms"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes"),
        F.sum(F.floor("c_acctbal") + 1000).cast("long").alias("png_bytes"),
    )
    row = {"bpp": F.col("bpp"), "psnr": F.col("psnr"), "slow": F.when(F.col("n") % 7 != 0, F.col("decode_ms"))}
    return d.withColumn("objective", F.round(rd.objective(row, WEIGHTS), 10))


def board(spark, sf, where=None):
    return E.leaderboard(facts(spark, sf, where), "profile", ["bpp", "psnr", "decode_ms", "objective"], "objective")


@register("objective_score", f"WITH {_FACTS} SELECT * FROM o")
def objective_score(spark, sf):
    return facts(spark, sf)


@register("leaderboard", f"WITH {_FACTS}, {_BOARD} SELECT *, CAST(row_number() OVER (ORDER BY avg_objective NULLS LAST, profile) AS INTEGER) AS place FROM b")
def leaderboard(spark, sf):
    return board(spark, sf)


@register(
    "pareto_front",
    f"""WITH {_FACTS} SELECT profile, image, bpp, psnr, decode_ms FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.bpp <= a.bpp AND b.decode_ms <= a.decode_ms
      AND b.psnr >= a.psnr AND (b.bpp < a.bpp OR b.decode_ms < a.decode_ms OR b.psnr > a.psnr)) ORDER BY bpp, psnr DESC""",
)
def pareto_front(spark, sf):
    d = facts(spark, sf).select("profile", "image", "bpp", "psnr", "decode_ms")
    return R.skyline(d, ["bpp", "decode_ms"], ["psnr"]).orderBy("bpp", F.desc("psnr"))


def _by_year(test):
    return f"""SELECT o_orderpriority || '/' || o_orderstatus AS profile, avg(o_totalprice) / 100000 AS bpp, avg(c_acctbal) / 1000 + 30 AS psnr
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE {test} GROUP BY 1"""


@register(
    "regression_delta",
    f"""SELECT a.profile, round(b.bpp - a.bpp, 10) AS delta_bpp, round(b.psnr - a.psnr, 10) AS delta_psnr FROM ({_by_year("year(o_orderdate) < 1995")}) a
      JOIN ({_by_year("year(o_orderdate) >= 1995")}) b USING (profile)""",
)
def regression_delta(spark, sf):
    def half(test):
        d = table(spark, sf, "orders").filter(test).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        return d.groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("profile")).agg(
            (F.avg("o_totalprice") / 100000).alias("bpp"), (F.avg("c_acctbal") / 1000 + 30).alias("psnr"))

    return E.regression(half("year(o_orderdate) < 1995"), half("year(o_orderdate) >= 1995"), "profile", ["bpp", "psnr"])


@register(
    "bootstrap_pairs",
    f"""WITH {_FACTS}, {_BOARD}, t AS (SELECT profile FROM b ORDER BY avg_objective NULLS LAST, profile LIMIT 1)
      SELECT x.profile, x.image, round(x.objective - y.objective, 10) AS delta FROM o x JOIN o y USING (image) WHERE y.profile IN (FROM t) AND x.profile NOT IN (FROM t)""",
)
def bootstrap_pairs(spark, sf):
    top = board(spark, sf).filter("place = 1")
    return E.paired(facts(spark, sf), "profile", "image", "objective", top)


@register("bootstrap_significance")
def bootstrap_significance(spark, sf):
    return E.bootstrap(bootstrap_pairs(spark, sf), "profile")


@register(
    "hybrid_weights",
    f"""WITH {_FACTS}, {_BOARD}, t AS (SELECT * FROM b ORDER BY avg_decode_ms NULLS LAST, profile LIMIT 3)
      SELECT profile, round(1.0 / avg_decode_ms / sum(1.0 / avg_decode_ms) OVER (), 10) AS weight FROM t""",
)
def hybrid_weights(spark, sf):
    return E.hybrid_weights(board(spark, sf), "profile", "avg_decode_ms")


@register(
    "hybrid_suggestion",
    f"""WITH {_FACTS}, {_BOARD}, t AS (SELECT * FROM b ORDER BY avg_decode_ms NULLS LAST, profile LIMIT 3),
      w AS (SELECT *, split_part(profile, '/', 2) AS status, round(1.0 / avg_decode_ms / sum(1.0 / avg_decode_ms) OVER (), 10) AS weight FROM t)
      SELECT round(sum(avg_bpp * weight), 10) AS avg_bpp, round(sum(avg_psnr * weight), 10) AS avg_psnr,
        (SELECT status FROM (SELECT status, round(sum(weight), 10) v FROM w GROUP BY 1) ORDER BY v DESC, status LIMIT 1) AS status FROM w""",
)
def hybrid_suggestion(spark, sf):
    b = board(spark, sf).withColumn("status", F.element_at(F.split("profile", "/"), 2))
    return E.hybrid_suggestion(b, "profile", "avg_decode_ms", ["avg_bpp", "avg_psnr"], ["status"])


@register(
    "interaction_matrix",
    f"""WITH {_FACTS}, {_BOARD} SELECT b.profile, round(b.avg_objective - z.avg_objective, 10) AS delta_objective, round(b.avg_bpp - z.avg_bpp, 10) AS delta_bpp
      FROM b, (SELECT * FROM b WHERE profile = '1-URGENT/F') z WHERE b.profile <> z.profile""",
)
def interaction_matrix(spark, sf):
    b = board(spark, sf)
    base = b.filter("profile = '1-URGENT/F'").select(F.col("avg_objective").alias("o"), F.col("avg_bpp").alias("p"))
    d = b.filter("profile <> '1-URGENT/F'").crossJoin(F.broadcast(base))  # one row
    return d.select("profile", F.round(F.col("avg_objective") - F.col("o"), 10).alias("delta_objective"), F.round(F.col("avg_bpp") - F.col("p"), 10).alias("delta_bpp"))


@register(
    "campaign_winners",
    f"WITH {_FACTS}, {_BOARD} SELECT profile, avg_objective FROM b WHERE profile <> '1-URGENT/F' ORDER BY avg_objective NULLS LAST, profile LIMIT 5",
)
def campaign_winners(spark, sf):
    b = board(spark, sf).filter("profile <> '1-URGENT/F'")
    return b.orderBy(F.asc_nulls_last("avg_objective"), "profile").limit(5).select("profile", "avg_objective")


@register(
    "acceptance_gate",
    f"""WITH {_FACTS}, {_BOARD} SELECT b.profile, round(b.avg_bpp - z.avg_bpp, 10) AS delta_avg_bpp, round(b.avg_psnr - z.avg_psnr, 10) AS delta_avg_psnr,
      coalesce(round(b.avg_bpp - z.avg_bpp, 10) <= 0.0 AND round(b.avg_psnr - z.avg_psnr, 10) >= -0.1, false) AS accepted
      FROM b, (SELECT * FROM b WHERE profile = '1-URGENT/F') z WHERE b.profile <> z.profile""",
)
def acceptance_gate(spark, sf):
    return E.gate(board(spark, sf), "profile", "1-URGENT/F", {"avg_bpp": ("max", 0.0), "avg_psnr": ("min", -0.1)})


@register(
    "variant_histogram",
    f"""WITH {_FACTS}, w AS (SELECT image, profile, row_number() OVER (PARTITION BY image ORDER BY objective, profile) AS r FROM o)
      SELECT profile AS variant, count(*) AS wins FROM w WHERE r = 1 GROUP BY 1 ORDER BY wins DESC, variant""",
)
def variant_histogram(spark, sf):
    w = R.argmin_first(facts(spark, sf).select("image", "objective", "profile"), ["image"], "objective", ["profile"])
    return w.groupBy(F.col("profile").alias("variant")).agg(F.count(F.lit(1)).alias("wins")).orderBy(F.desc("wins"), "variant")


@register(
    "bench_totals",
    f"""WITH {_FACTS} SELECT CAST(sum(bytes) AS BIGINT) AS total_bytes, round(avg(psnr), 10) AS mean_psnr, round(sum(bytes)::DOUBLE / nullif(sum(png_bytes), 0), 10) AS ratio,
      count(*) FILTER (psnr > 34) AS wins, round(avg(psnr - 30), 10) AS mean_delta FROM f""",
)
def bench_totals(spark, sf):
    return facts(spark, sf).agg(
        F.sum("bytes").alias("total_bytes"), F.round(F.avg("psnr"), 10).alias("mean_psnr"), F.round(F.try_divide(F.sum("bytes").cast("double"), F.sum("png_bytes").cast("double")), 10).alias("ratio"),
        F.count_if(F.col("psnr") > 34).alias("wins"), F.round(F.avg(F.col("psnr") - 30), 10).alias("mean_delta"))


@register(
    "size_ratios",
    f"""WITH {_FACTS} SELECT profile, image, CASE WHEN png_bytes > 0 THEN round(bytes::DOUBLE / png_bytes, 10) END AS vs_source, round(8.0 * bytes / (1024 * 768), 10) AS bits_per_pixel FROM f""",
)
def size_ratios(spark, sf):
    return facts(spark, sf).select("profile", "image", F.round(F.when(F.col("png_bytes") > 0, F.col("bytes").cast("double") / F.col("png_bytes")), 10).alias("vs_source"),
                                   F.round(F.col("bytes") * 8.0 / (1024 * 768), 10).alias("bits_per_pixel"))


@register(
    "auto_select_winner",
    f"""WITH {_FACTS}, c AS (SELECT image, profile, row_number() OVER (PARTITION BY image ORDER BY profile) AS ord, psnr, bpp,
        psnr - bpp * 10 * power((100.0 - 90) / 25, 2) AS score FROM f),
      m AS (SELECT *, first_value(score) OVER s AS best, first_value(psnr) OVER s AS best_psnr, first_value(ord) OVER s AS best_ord FROM c
        WINDOW s AS (PARTITION BY image ORDER BY score DESC, ord)),
      n AS (SELECT *, first_value(psnr) OVER p AS sharp_psnr, first_value(ord) OVER p AS sharp_ord FROM m WHERE score >= best - 5.0
        WINDOW p AS (PARTITION BY image ORDER BY psnr DESC, ord))
      SELECT image, profile, psnr, bpp, sharp_psnr >= best_psnr + 2.0 AS override FROM n
      WHERE ord = CASE WHEN sharp_psnr >= best_psnr + 2.0 THEN sharp_ord ELSE best_ord END""",
)
def auto_select_winner(spark, sf):
    from pyspark.sql import Window

    c = facts(spark, sf).withColumn("ord", F.row_number().over(Window.partitionBy("image").orderBy("profile")))
    score = F.col("psnr") - F.col("bpp") * 10 * rd.select_lambda_scale(F.lit(90))
    return E.tournament(c, ["image"], score, "psnr", "ord", 5.0, 2.0).select("image", "profile", "psnr", "bpp", "override")


@register(
    "best_quality_in_budget",
    f"""WITH {_FACTS}, q AS (SELECT CAST(range AS INTEGER) AS quality FROM range(1, 101))
      SELECT profile, image, max(quality) AS quality FROM f, q WHERE floor(bytes * quality / 100) <= png_bytes * 20 GROUP BY 1, 2""",
)
def best_quality_in_budget(spark, sf):
    d = facts(spark, sf).withColumn("quality", F.explode(F.sequence(F.lit(1), F.lit(100))))
    return d.filter(F.floor(F.col("bytes") * F.col("quality") / 100) <= F.col("png_bytes") * 20).groupBy("profile", "image").agg(F.max("quality").alias("quality"))
