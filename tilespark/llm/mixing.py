"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source, documents are ordered by key; the key range is
cut into fixed ranges (16 ** digits, as many digits as the rows need for about ROWS a cell), so a hot source is spread over many
groups and no sampling of ranges is needed.  Word counts are summed per cell (combined before the shuffle), a prefix over a source's cells gives each cell's start, and a window inside the cell gives each document's.  A source's budget cuts
this line exactly; what exceeds the source's size goes round a second time.

Null sources form one source, last in order; null texts have size 0 and are never taken; null ids are keyed
as an empty id.  Repeated rows are separate documents. Ties of key, id and size are broken by a hash of the text, so only rows
with equal texts are alike, and their order has no effect on the result.  An empty table gives an empty result.  Further columns, whatever
their names, are ignored by ``mix`` and kept by ``mix_documents``, which carries the row as one struct. Targets need one row for each source in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.words import n_words, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SALT = "mix"
#: Rows of a cell, about, if one source had all.
ROWS = 256


def _key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(__src, source_size) to (.., target): weights cycle over the sources in code point order; the total is
    ``share`` of all sizes; none is above ``most`` times its size.  Water filling: with sources by cap/weight, the
    level is the largest of (total - caps before) / (weights from here on), which equals resharing the excess
    by weight until none is above.  One row a source, so the windows over all rows are small."""
    everything = Window.orderBy("__src")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("__w", F.element_at(cycle, (F.row_number().over(everything) - 1) % len(weights) + 1))
    s = s.withColumn("__cap", F.col("source_size").cast("double") * most)
    line = Window.orderBy(F.col("__cap") / F.col("__w"), "__src")
    before = F.coalesce(F.sum("__cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(line.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole).cast("double") * share
    s = s.withColumn("__level", (total - before) / rest)
    level = F.max("__level").over(whole)
    return s.withColumn("target", F.least("__cap", level * F.col("__w"))).select("__src", "source_size", "target")


def digits(rows: int) -> int:
    """Hex digits of the key that name a cell."""
    n = 1
    while 16**n * ROWS < rows and n < 15:
        n += 1
    return n


def _placed(docs: DataFrame, carried: Column) -> DataFrame:
    """__row (what is carried), doc_id, __src, __size, __tie and __key."""
    # "~" follows "s": the null source comes last
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~"))
    return docs.select(
        carried.alias("__row"), "doc_id", source.alias("__src"), n_words(F.col("text")).alias("__size"), F.xxhash64("text").alias("__tie"), _key(F.col("doc_id")).alias("__key"),
    )


def _celled(placed: DataFrame, n: int) -> DataFrame:
    return placed.withColumn("__cell", F.substring("__key", 1, n))


def _cells(thin: DataFrame, weights, share: float, most: int) -> DataFrame:
    cells = thin.groupBy("__src", "__cell").agg(F.sum("__size").alias("__words"))
    along = Window.partitionBy("__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__start", F.coalesce(F.sum("__words").over(along), F.lit(0)))
    cells = cells.withColumn("source_size", F.sum("__words").over(Window.partitionBy("__src")))
    sources = cells.groupBy("__src").agg(F.max("source_size").alias("source_size"))
    goal = targets(sources, weights, share, most).select("__src", "target")
    cells = cells.join(goal, "__src")
    return cells.select("__src", "__cell", "__start", F.col("source_size").alias("__sum"), F.col("target").alias("__target"))


def _taken(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds __first and __second: words taken in the first and the second epoch."""
    at = Window.partitionBy("__src", "__cell").orderBy("__key", "doc_id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    d = placed.join(cells, ["__src", "__cell"])
    d = d.withColumn("__before", F.col("__start") + F.coalesce(F.sum("__size").over(at), F.lit(0)))
    budget, zero = F.floor("__target"), F.lit(0).cast("long")
    cut = lambda left: F.least(F.col("__size"), F.greatest(zero, left - F.col("__before")))
    return d.withColumn("__first", cut(budget)).withColumn("__second", cut(budget - F.col("__sum")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; no text leaves the scan."""
    from tilespark.llm import store

    thin = store.table(_placed(docs, F.lit(0)), "mix")  # texts are read once
    thin = _celled(thin, digits(thin.count()))
    d = _taken(thin, _cells(thin, weights, share, most))
    return d.select("doc_id", F.col("__size").alias("size"), F.col("__sum").alias("source_size"), F.col("__target").alias("target"), (F.col("__first") + F.col("__second")).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch that takes a document; the one document
    where the budget ends is cut after its share of words (joined by single spaces; n_chars follows)."""
    placed = _celled(_placed(docs, F.struct("*")), digits(docs.count()))
    thin = placed.select("__src", "__cell", "__size")
    d = _taken(placed, _cells(thin, weights, share, most))
    d = d.withColumn("__part", F.explode(F.filter(F.array("__first", "__second"), lambda x: x > 0)))
    whole = F.col("__part") == F.col("__size")
    some = F.array_join(F.slice(words(F.col("__row.text")), 1, F.col("__part").cast("int")), " ")
    out = d.withColumn("__text", F.when(whole, F.col("__row.text")).otherwise(some))
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(whole, F.col("__row.n_chars")).otherwise(F.length("__text").cast(kind))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '~') AS src, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w
  FROM d GROUP BY src),
c AS (SELECT *, source_size::DOUBLE * 2 AS cap FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5
     - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
     / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT src, source_size, least(cap, (SELECT max(level) FROM l) * w) AS target FROM l),
p AS (
  SELECT doc_id, src, size,
     coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target,
  CAST(least(size, greatest(0, floor(target)::BIGINT - before)) + least(size, greatest(0, floor(target)::BIGINT - source_size - before)) AS BIGINT) AS taken
FROM p JOIN t USING (src)
"""
