"""Queries on order-aware relational operators, sweeps and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import numeric, rd
from tilespark.operators import relational as R
from tilespark.plans.catalogue import register
from tilespark.session import table

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
_TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*_LINE.split(", "))


@register(
    "argmin_per_segment",
    f"""SELECT l_orderkey, score, l_linenumber, l_partkey FROM (
      SELECT l_orderkey, l_extendedprice AS score, l_linenumber, l_partkey,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, {", ".join(_TIES)}) AS r FROM lineitem) WHERE r = 1""",
)
def argmin_per_segment(spark, sf):
    d = _lines(spark, sf).withColumnRenamed("l_extendedprice", "score")
    return R.argmin_first(d, ["l_orderkey"], "score", _TIES).select("l_orderkey", "score", "l_linenumber", "l_partkey")


def _topk_sql(segment, k, direction):
    return f"""SELECT {segment} AS segment, l_orderkey, l_extendedprice AS score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY {segment} ORDER BY l_extendedprice {direction}, l_orderkey, {", ".join(_TIES)}) AS INTEGER) AS rank
      FROM lineitem) WHERE rank <= {k}"""


@register("segmented_topk_small", _topk_sql("l_orderkey", 2, "ASC"))
def segmented_topk_small(spark, sf):
    order = [F.asc("l_extendedprice"), F.asc("l_orderkey"), *map(F.asc, _TIES)]
    t = R.segmented_topk(_lines(spark, sf), ["l_orderkey"], 2, order)
    return t.select(F.col("l_orderkey").alias("segment"), "l_orderkey", F.col("l_extendedprice").alias("score"), "rank")


@register("segmented_topk_large", _topk_sql("l_suppkey", 5, "DESC"))
def segmented_topk_large(spark, sf):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), *map(F.asc, _TIES)]
    t = R.segmented_topk(_lines(spark, sf), ["l_suppkey"], 5, order)
    return t.select(F.col("l_suppkey").alias("segment"), "l_orderkey", F.col("l_extendedprice").alias("score"), "rank")


@register(
    "compact_flags",
    """SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS slot FROM events WHERE event_type = 'purchase'""",
)
def compact_flags(spark, sf):
    return R.compact(table(spark, sf, "events"), F.col("event_type") == "purchase", "event_id")


@register(
    "exclusive_scan_global",
    """SELECT doc_id, octet_length(encode(text)) AS length,
      CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
      FROM documents""",
)
def exclusive_scan_global(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    return R.exclusive_scan(d, "length", ["doc_id"])


@register(
    "exclusive_scan_wide",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      CAST(coalesce(sum(CAST(l_partkey AS BIGINT)) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem""",
)
def exclusive_scan_wide(spark, sf):
    """With further columns."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return R.exclusive_scan(d.withColumn("value", F.col("l_partkey").cast("long")), "value", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).drop("value")


@register(
    "exclusive_scan_segmented",
    """SELECT doc_id // 64 AS chunk, doc_id, octet_length(encode(text)) AS length,
      CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
      FROM documents""",
)
def exclusive_scan_segmented(spark, sf):
    d = table(spark, sf, "documents").select(F.expr("doc_id div 64").alias("chunk"), "doc_id", F.octet_length("text").cast("long").alias("length"))
    return R.segmented_scan(d, "length", ["chunk"], ["doc_id"])


@register(
    "kind_stream_offsets",
    """SELECT event_type, event_id, CAST(length(props) AS BIGINT) AS length,
      CAST(coalesce(sum(length(props)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
      FROM events""",
)
def kind_stream_offsets(spark, sf):
    d = table(spark, sf, "events").select("event_type", "event_id", F.length("props").cast("long").alias("length"))
    return R.exclusive_scan(d, "length", ["event_id"], segment=["event_type"])


_CHUNKS = """c AS (SELECT l_orderkey // 64 AS chunk, min(l_orderkey) AS start, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)"""


@register(
    "contiguity_violations",
    f"""WITH {_CHUNKS} SELECT chunk, start, n, expected FROM (SELECT *, lag(start + n) OVER (ORDER BY chunk) AS expected FROM c) WHERE expected IS NOT NULL AND expected <> start""",
)
def contiguity_violations(spark, sf):
    d = table(spark, sf, "lineitem")
    c = d.groupBy(F.expr("l_orderkey div 64").alias("chunk")).agg(F.min("l_orderkey").alias("start"), F.countDistinct("l_orderkey").alias("n"))
    return R.violations(c, ["chunk"], "start", "n")


@register(
    "dedup_first_coarse_key",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (
      PARTITION BY l_suppkey, CAST(floor(l_extendedprice / 4096 + 0.5) AS BIGINT), CAST(floor(l_discount * 32 + 0.5) AS BIGINT)
      ORDER BY l_orderkey, {", ".join(_TIES)}, l_extendedprice) AS r FROM lineitem) WHERE r = 1""",
)
def dedup_first_coarse_key(spark, sf):
    key = [F.col("l_suppkey"), F.floor(F.col("l_extendedprice") / 4096 + 0.5), F.floor(F.col("l_discount") * 32 + 0.5)]
    d = R.dedup_first(_lines(spark, sf), key, ["l_orderkey", *_TIES, "l_extendedprice"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@register(
    "key_intersection",
    """SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier) ORDER BY 1""",
)
def key_intersection(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return c.intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).orderBy("k")


@register(
    "candidate_union_distinct",
    """SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM (
      SELECT p_partkey, p_brand, p_size FROM part WHERE p_size < 10 UNION SELECT p_partkey, p_brand, p_size FROM part WHERE p_retailprice > 1000) GROUP BY 1, 2""",
)
def candidate_union_distinct(spark, sf):
    p = table(spark, sf, "part")
    cols = ["p_partkey", "p_brand", "p_size"]
    u = p.filter("p_size < 10").select(*cols).union(p.filter("p_retailprice > 1000").select(*cols)).distinct()
    return u.groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "unexecuted_profiles",
    """SELECT DISTINCT p_brand AS brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""",
)
def unexecuted_profiles(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(done, "p_partkey", "left_anti").select(F.col("p_brand").alias("brand")).distinct()


@register(
    "distinct_counts",
    """SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1""",
)
def distinct_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


@register(
    "sensor_summary",
    """SELECT user_id AS run_id, round(avg(value), 10) AS avg_power, max(value) AS max_power, count(*) AS samples FROM events GROUP BY 1""",
)
def sensor_summary(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.round(F.avg("value"), 10).alias("avg_power"), F.max("value").alias("max_power"), F.count(F.lit(1)).alias("samples"))


@register(
    "sweep_grid",
    """SELECT CAST(row_number() OVER (ORDER BY q, c, p) - 1 AS INTEGER) AS ord, 'q' || q || '_c' || c || '_' || p AS name, q AS quality, c AS chunk_tiles, p AS preset
      FROM (VALUES (50), (75), (90)) a(q), (VALUES (32), (64), (128)) b(c), (SELECT r_name AS p FROM region) d""",
)
def sweep_grid(spark, sf):
    from tilespark.operators import sweeps

    axes = {"quality": [50, 75, 90], "chunk_tiles": [32, 64, 128], "preset": table(spark, sf, "region").select(F.col("r_name").alias("preset"))}
    return sweeps.grid(spark, axes, "q{quality}_c{chunk_tiles}_{preset}")


@register(
    "technique_pairs",
    """SELECT a.n_name || '+' || b.n_name AS pair, a.n_nationkey AS first, b.n_nationkey AS second FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
      ORDER BY a.n_nationkey, b.n_nationkey LIMIT 40""",
)
def technique_pairs(spark, sf):
    from tilespark.operators import sweeps

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    return sweeps.pairs(n, 40)


@register(
    "config_overlay",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 90 ELSE 75 END AS quality, 64 AS chunk_tiles,
      CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS strict FROM lineitem""",
)
def config_overlay(spark, sf):
    base = F.create_map(F.lit("quality"), F.lit(75), F.lit("chunk_tiles"), F.lit(64), F.lit("strict"), F.lit(0))
    over = F.when(F.col("l_quantity") > 25, F.create_map(F.lit("quality"), F.lit(90))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    more = F.when(F.col("l_discount") > 0.05, F.create_map(F.lit("strict"), F.lit(1))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    take = lambda k: F.coalesce(more[k], over[k], base[k]).alias(k)  # noqa: E731  the right-most map wins
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", take("quality"), take("chunk_tiles"), take("strict"))


@register(
    "profile_name_parts",
    """SELECT c_custkey, 't_' || c_mktsegment || '_' || c_nationkey AS name, c_mktsegment AS label, CAST(c_nationkey AS VARCHAR) AS level,
      regexp_replace(c_name || '/' || c_mktsegment, '[^A-Za-z0-9._-]', '_', 'g') AS safe, base64(encode(c_name)) AS b64, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS scale
      FROM customer""",
)
def profile_name_parts(spark, sf):
    name = F.concat(F.lit("t_"), F.col("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"))
    c = table(spark, sf, "customer").withColumn("name", name)
    parts = F.split("name", "_")
    label = F.when(F.col("name").startswith("t_"), F.array_join(F.slice(parts, 2, F.size(parts) - 2), "_"))
    return c.select(
        "c_custkey", "name", label.alias("label"), F.element_at(parts, -1).alias("level"),
        numeric.safe_name(F.concat_ws("/", "c_name", "c_mktsegment")).alias("safe"), F.base64(F.encode("c_name", "UTF-8")).alias("b64"),
        F.format_string("%03d", "c_nationkey").alias("scale"),
    )


@register(
    "comma_lists",
    """SELECT doc_id, CAST(len(v) AS INTEGER) AS n, round(list_sum(v), 6) AS total FROM (
      SELECT doc_id, list_transform(list_filter(string_split(CAST(n_chars AS VARCHAR) || ', ,' || CAST(doc_id AS VARCHAR) || ',0.5', ','), lambda x: trim(x) <> ''), lambda x: CAST(trim(x) AS DOUBLE)) AS v FROM documents)""",
)
def comma_lists(spark, sf):
    text = F.concat(F.col("n_chars").cast("string"), F.lit(", ,"), F.col("doc_id").cast("string"), F.lit(",0.5"))
    v = F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))
    d = table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return d.select("doc_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register(
    "number_format",
    """SELECT o_orderkey, coalesce(printf('%.3f', nullif(o_totalprice, 0)), 'n/a') AS price, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE printf('%.2f', o_totalprice / 7) END AS part FROM orders""",
)
def number_format(spark, sf):
    o = table(spark, sf, "orders")
    price = F.coalesce(F.format_string("%.3f", F.nullif("o_totalprice", F.lit(0.0))), F.lit("n/a"))
    part = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.format_string("%.2f", F.col("o_totalprice") / 7))
    return o.select("o_orderkey", price.alias("price"), part.alias("part"))


@register(
    "quality_curves",
    """SELECT l_orderkey, l_linenumber, l_partkey, q, power((101.0 - least(100, greatest(0, q))) / 100, 2) * CASE WHEN least(100, greatest(0, q)) >= 90 THEN 2e-4 ELSE 1e-3 END AS lambda,
      least(0.20, greatest(0.003, power((101.0 - least(99, greatest(10, q))) / 100, 2) * 0.2)) AS step,
      CASE WHEN q > 75 THEN power((100.0 - q) / 25, 2) ELSE 1.0 END AS select_scale, CAST(ceil(q / 64.0) * 64 AS BIGINT) AS aligned
      FROM (SELECT *, CAST(l_quantity * 2 AS INTEGER) + CAST(l_linenumber AS INTEGER) - 5 AS q FROM lineitem)""",
)
def quality_curves(spark, sf):
    """What every line's quality, within 0 to 100 and beyond, makes of lambda, step and weights."""
    c = F.col("q")
    q = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_quantity") * 2).cast("int") + F.col("l_linenumber").cast("int") - 5).alias("q"))
    return q.select("l_orderkey", "l_linenumber", "l_partkey", "q", rd.tile_lambda(c).alias("lambda"), rd.dct_step(c).alias("step"), rd.select_lambda_scale(c).alias("select_scale"), numeric.align(c, 64).alias("aligned"))


@register(
    "quantise_roundtrip",
    """SELECT vec_id, p, qb, CAST(qb AS DOUBLE) / 255 * 2.0 - 1.0 AS snapped, CAST(round_even(least(1.0, greatest(0.0, (v + 1) / 2)) * 65535, 0) AS INTEGER) AS qw,
      CAST(least(127.0, greatest(-127.0, round_even(v * 255, 0))) AS INTEGER) AS qs
      FROM (SELECT vec_id, p, v, CAST(round_even(least(1.0, greatest(0.0, (v + 1) / 2)) * 255, 0) AS INTEGER) AS qb FROM (
        SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))""",
)
def quantise_roundtrip(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "f")).withColumn("v", F.col("f").cast("double"))
    v = F.col("v")
    return e.select("vec_id", "p", numeric.affine_quantise(v, -1, 1).alias("qb"), numeric.snap(v, -1, 1).alias("snapped"),
                    numeric.affine_quantise(v, -1, 1, 65535).alias("qw"), numeric.signed_byte(v).alias("qs"))


@register(
    "primitive_rates",
    """SELECT l_orderkey, CAST(sum(CASE l_linenumber % 6 WHEN 0 THEN 7 WHEN 1 THEN 18 WHEN 2 THEN 17 WHEN 3 THEN 21 WHEN 4 THEN 19 ELSE 20 END * 8) + 8 + 24 AS BIGINT) AS bits FROM lineitem GROUP BY 1""",
)
def primitive_rates(spark, sf):
    bits = rd.primitive_bits(F.col("l_linenumber") % 6)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum(bits) + 8 + 24).cast("long").alias("bits"))
