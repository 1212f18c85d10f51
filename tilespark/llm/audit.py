"""Filter interaction audit: what each filter removes, alone and after others, in every order of the filters.

Every document is judged by five filters once, however the filters are ordered; its failures are the bits of one number. Four of
them look at the text alone (A: few words, B: few different words, C: many capitals, D: symbols). E, a copy of an earlier document, is
existential: a left-semi join of the documents with the first document of each text, on hash, exact text and smaller doc_id. Its ids are united
with the failures of the other filters, and documents are counted by part, bits and labels; 32 bit combinations by two labels a part are
all that the 120 orders need.

Texts are read once for the bits and once more for copies, where only documents whose hash another document has go on, so texts without a copy are
never shuffled. That filter is broadcast while it has at most ``BROADCAST`` hashes, and joined by a shuffle beyond. Of the copies of a text only its
first one is on the joins' right side (combined before the shuffle), so a large group of copies costs a row for each of its documents.

Null texts are empty texts, and empty texts are copies of one another; a null lang is the empty part. A document with a null id is no copy and no original;
of rows that repeat an id, each counts, and equal texts under one id are no copies of each other. A document is good (toxic) if any of its rows in ``labels`` says
so; labels of unknown documents and null labels have no effect. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm import store
from tilespark.llm.words import count_chars, words

#: Filters in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hashes of copied texts that are sent to every executor (8 bytes each); more are joined by a shuffle.
BROADCAST = 500_000
_KEY = ["__id", "__part", "__h", "__g"]


def _bit(failed: Column, letter: str) -> Column:
    return F.when(failed, 1 << FILTERS.index(letter)).otherwise(0)


def _texts(docs: DataFrame) -> DataFrame:
    """__id, __part, __h and __g (128 bits of the text's hash) and __text."""
    d = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__part"), F.coalesce("text", F.lit("")).alias("__text"))
    return d.select("__id", "__part", F.xxhash64("__text").alias("__h"), F.xxhash64(F.lit(1), "__text").alias("__g"), "__text")


def judged(docs: DataFrame) -> DataFrame:
    """A table of _KEY and __bits of the filters A to D for every document."""
    t = F.col("__text")
    d = _texts(docs).withColumn("__w", words(t))
    n, different = F.size("__w"), F.size(F.array_distinct("__w"))
    bits = (
        _bit(n < LEAST_WORDS, "A")
        + _bit(different.cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT, "B")
        + _bit(count_chars(t, CAPITALS) * 100 > F.length(t).cast("long") * CAPITALS_PERCENT, "C")
        + _bit(t.rlike("[" + SYMBOLS + "]"), "D")
    )
    return store.table(d.select(*_KEY, bits.alias("__bits")), "audit")


def copies(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """_KEY of the documents whose text a document with a smaller id has; ``keys`` holds the _KEY of all."""
    shared = store.table(keys.groupBy("__h").count().filter("count > 1").select("__h"), "audit-shared")
    few = shared.count() <= BROADCAST
    suspects = store.table(_texts(docs).join(F.broadcast(shared) if few else shared, "__h", "left_semi"), "audit-suspects")
    first = suspects.groupBy(F.col("__h").alias("__fh"), F.col("__text").alias("__ft")).agg(F.min("__id").alias("__first"))
    same = (F.col("__h") == F.col("__fh")) & (F.col("__text") == F.col("__ft")) & (F.col("__first") < F.col("__id"))
    return suspects.join(first, same, "left_semi").select(*_KEY)


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, good, toxic and n: documents by the filters that they fail."""
    own = judged(docs)
    others = copies(docs, own).select(*_KEY, F.lit(1 << FILTERS.index("E")).alias("__bits"), F.lit(0).alias("__n"))
    united = own.withColumn("__n", F.lit(1)).unionByName(others)
    d = united.groupBy(*_KEY).agg(F.bit_or("__bits").alias("bits"), F.sum("__n").alias("__n"))
    said = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    d = d.join(said, "__id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.groupBy(F.col("__part").alias("part"), "bits", zero("good"), zero("toxic")).agg(F.sum("__n").alias("n"))


def _grid(spark) -> DataFrame:
    """Every order, step and bit combination: 120 x 5 x 32 rows, whatever the input."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            rows.append(("".join(FILTERS[j] for j in order), i + 1, 1 << f, before))
            before |= 1 << f
    g = spark.createDataFrame(rows, "filter_order string, step int, own int, before int")
    return g.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))


def report(combos: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    orders = 1
    for i in range(2, len(FILTERS) + 1):
        orders *= i
    d = combos.join(F.broadcast(_grid(combos.sparkSession)), "bits")
    fails, earlier = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    count = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    # among the filters that a document fails, each is the first in an equal share of the orders
    turns = F.when(fails, F.col("n") * F.expr(f"{orders} div bit_count(bits)")).otherwise(0)
    return d.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~earlier, "kept"), count(removed, "removed"), count(fails & earlier, "redundant"), count(F.col("bits") == F.col("own"), "unique_fails"),
        count(removed & (F.col("good") == 1), "good_lost"), count(removed & (F.col("toxic") == 1), "toxic_lost"), F.sum(turns).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return report(combinations(read("documents"), read("labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
m AS (SELECT t, min(doc_id) AS earliest FROM d GROUP BY t),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, doc_id > earliest AS e FROM d JOIN m USING (t)),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
b AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS bits
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, good, toxic, count(*) AS n FROM b GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(x, v)),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.v, q.v, r.v, s.v, u.v] AS vs FROM f p, f q, f r, f s, f u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
g AS (SELECT filter_order, i::INT AS step, vs[i] AS own, coalesce(list_sum(vs[1 : i - 1]), 0)::INT AS before FROM o, range(1, 6) k(i)),
r AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (bits & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & own > 0 AND bits & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bits & own > 0 AND bits & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (bits & own > 0 AND bits & before = 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (bits & own > 0 AND bits & before = 0 AND toxic), 0)::BIGINT AS toxic_lost FROM c, g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
