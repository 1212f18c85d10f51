"""Quality rules with risk-controlled thresholds, in column expressions alone.

Base rules are fixed.  On top, a document's risk is the largest of its scores, each over its scale in SCALES. Every stratum gets the
lowest cutoff of GRID that the labelled holdout supports: among n labelled good documents, k have a risk above the
cutoff, and the exact binomial test of "the false rejection rate is ALPHA or more" has the p-value P(Binomial(n, ALPHA) <= k).
A cutoff is admitted if that is at most DELTA / strata (Bonferroni over the strata) and every milder cutoff of the grid
is admitted too (a fixed sequence, so the grid needs no further correction; as the scores are one risk, they need none either).
With probability 1 - DELTA, no stratum loses more than ALPHA of its good documents to the admitted cutoffs. Where labels are
too few, no cutoff is admitted and the risk rejects nothing: with one stratum that is below 149 good documents.

Strata come from the data: a language with at least LEAST_GOOD labelled good documents is one of its own (the MOST_STRATA with the most of them,
should there be more), all others are one together. So tables of strata have MOST_STRATA + 1 rows at most and are broadcast: texts are not
dealt out by language, where one may have most of them.

All labelled documents count, and all statistics cover all rows.  Features are written once as a table and
reread, so texts are read once.

Null texts have no words; null languages are with the small ones; labels of unknown documents have no effect; a document with
several labels is good only if all its labels say so; repeated rows are judged alike.  An empty table gives no rows.
Further columns may have any names: ``keep_good`` carries the row as one struct. Windows are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm import store
from tilespark.llm.words import SPACE, count_chars, words

WINDOW = 8
LEAST_WORDS = 20
REPEATS_PERCENT = 30
SYMBOLS = "#*$%&|<>"
ALPHA = 0.02
DELTA = 0.05
#: With twenty strata, fewer good documents admit no cutoff: 0.98 ** 297 is just under DELTA / 20.
LEAST_GOOD = 297
MOST_STRATA = 500
#: Score (higher is worse) to the value that is a risk of 1.
SCALES = {"symbol_share": 0.2, "dup_line_share": 0.5, "repeat_share": 0.25, "upper_share": 0.1, "shout_share": 0.05, "word_length": 12.0}
#: Cutoffs of the risk, from the mildest to the strictest.
GRID = (8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8)


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (as __names)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__text", text).withColumn("__w", words(F.col("text")))
    d = d.withColumn("__n_words", F.size("__w").cast("long"))
    d = d.withColumn("__word_chars", F.length(F.translate("__text", SPACE, "")).cast("long"))
    d = d.withColumn("__n_symbols", count_chars(F.col("__text"), SYMBOLS))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    d = d.withColumn("__lines", lines)
    d = d.withColumn("__n_lines", F.size("__lines").cast("long"))
    d = d.withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    many = F.size("__h") >= WINDOW
    at = lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(WINDOW)])
    grams = F.when(many, F.transform(F.sequence(F.lit(0), F.size("__h") - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__g", grams)
    # only texts with a repeated window pay for the sort that finds where
    again = F.size(F.array_distinct("__g")) < F.size("__g")
    pairs = F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    d = d.withColumn("__s", F.when(again, F.array_sort(pairs)))
    near = lambda e, i: F.get("__s", i)["g"].eqNullSafe(e["g"])
    twice = F.filter("__s", lambda e, i: near(e, i - 1) | near(e, i + 1))
    d = d.withColumn("__p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    gain = F.transform("__p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gain, F.lit(0), lambda a, x: a + x)
    d = d.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("__n_words") < LEAST_WORDS) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * REPEATS_PERCENT)
    return d.withColumn("__base_failed", failed).drop("__h", "__g", "__s", "__p", "__w", "__lines")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def score_columns(d: DataFrame) -> DataFrame:
    n, chars, t = F.col("__n_words"), F.col("__word_chars"), F.col("__text")
    d = d.withColumn("__symbol_share", _share(F.col("__n_symbols"), chars))
    d = d.withColumn("__dup_line_share", _share(F.col("__n_dup_lines"), F.col("__n_lines")))
    d = d.withColumn("__repeat_share", _share(F.col("__n_repeat_words"), n))
    d = d.withColumn("__upper_share", _share(count_chars(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars))
    d = d.withColumn("__shout_share", _share(count_chars(t, "!?"), chars))
    d = d.withColumn("__word_length", _share(chars, n))
    return d.withColumn("__risk", F.greatest(*[F.col(f"__{x}") / F.lit(scale) for x, scale in SCALES.items()]))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly in logarithms; 1 where k is above the mean (no need to sum)."""
    import math

    ratio = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)

    def step(acc: Column, j: Column) -> Column:
        term = acc["t"] + F.log((n - j + 1) / j) + F.lit(ratio)
        top, low = F.greatest(acc["s"], term), F.least(acc["s"], term)
        return F.struct(term.alias("t"), (top + F.log1p(F.exp(low - top))).alias("s"))

    start = F.struct(first.alias("t"), first.alias("s"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, start, step, lambda a: a["s"])))


def thresholds(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a stratum: __stratum ("l" and the language, "~" for all small ones), n_good and the admitted __cut (null: none)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("__quality")).filter("__quality = 1")
    f = features.filter(~F.col("__base_failed")).join(good, "doc_id", "left_semi")
    counts = [F.count(F.when(F.col("__risk") > c, 1)).alias(f"__k{i}") for i, c in enumerate(GRID)]
    by_lang = f.groupBy("__lang").agg(F.count(F.lit(1)).alias("n_good"), *counts)
    own = by_lang.filter(F.col("__lang").isNotNull() & (F.col("n_good") >= LEAST_GOOD)).orderBy(F.desc("n_good"), "__lang").limit(MOST_STRATA)
    by_lang = by_lang.join(F.broadcast(own.select("__lang", F.lit(True).alias("__own"))), "__lang", "left")
    stratum = F.when(F.col("__own"), F.concat(F.lit("l"), F.col("__lang"))).otherwise(F.lit("~")).alias("__stratum")
    by_lang = by_lang.select(stratum, "n_good", *[f"__k{i}" for i in range(len(GRID))])
    t = by_lang.groupBy("__stratum").agg(*[F.sum(c).alias(c) for c in by_lang.columns[1:]])
    t = t.withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()))  # a row for each stratum
    admitted = [binomial_cdf(F.col(f"__k{i}"), F.col("n_good"), ALPHA) <= F.lit(DELTA) / F.col("__m") for i in range(len(GRID))]
    cut: Column = F.lit(None).cast("double")
    for i in reversed(range(len(GRID))):  # stops at the first that is not admitted
        cut = F.when(admitted[i], F.coalesce(cut, F.lit(GRID[i])))
    return t.select("__stratum", "n_good", cut.alias("__cut"))


def judged(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features with __kept."""
    cut = thresholds(features, labels).drop("n_good")
    own = cut.filter("__stratum <> '~'").select(F.substring("__stratum", 2, 1 << 30).alias("__lang"), F.col("__stratum").alias("__of"))
    d = features.join(F.broadcast(own), "__lang", "left").withColumn("__stratum", F.coalesce("__of", F.lit("~"))).drop("__of")
    d = d.join(F.broadcast(cut), "__stratum", "left")
    return d.withColumn("__kept", ~F.col("__base_failed") & ~F.coalesce(F.col("__risk") > F.col("__cut"), F.lit(False)))


_THIN = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed", "__risk"]


def _features(docs: DataFrame, carried: Column) -> DataFrame:
    """A table of __row (what is carried), doc_id, __lang and _THIN."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(carried.alias("__row"), "doc_id", "text", lang.alias("__lang"))
    return store.table(score_columns(base_columns(d)).select("__row", "doc_id", "__lang", *_THIN), "quality")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document."""
    j = judged(_features(docs, F.lit(0)), labels.select("doc_id", "quality"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return j.select("doc_id", *[F.col(f"__{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    return judged(_features(docs, F.struct("*")), labels.select("doc_id", "quality")).filter("__kept").select("__row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return assess(read("documents"), read("labels"))


def _sql() -> str:
    grid = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(GRID))
    risk = ", ".join(f"{x} / {scale!r}::DOUBLE" for x, scale in SCALES.items())
    p = ALPHA
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k.range) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) x, range(8) k WHERE c > 1 GROUP BY 1),
b AS (SELECT l.doc_id, lang, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(text, '[^!?]', '', 'g')) AS shouts FROM l LEFT JOIN r USING (doc_id)),
s AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATS_PERCENT} * n_words AS base_failed,
    coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_share,
    coalesce(upper_::DOUBLE / nullif(word_chars, 0), 0) AS upper_share, coalesce(shouts::DOUBLE / nullif(word_chars, 0), 0) AS shout_share, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS word_length FROM b),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
v AS MATERIALIZED (SELECT *, greatest({risk}) AS risk FROM s),
o AS (SELECT lang FROM v WHERE NOT base_failed AND doc_id IN (FROM good) AND lang IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST_GOOD} ORDER BY count(*) DESC, lang LIMIT {MOST_STRATA}),
w AS MATERIALIZED (SELECT v.*, CASE WHEN o.lang IS NULL THEN '~' ELSE 'l' || o.lang END AS stratum FROM v LEFT JOIN o USING (lang)),
k AS (SELECT stratum, i, cutoff, count(*) AS n, count(*) FILTER (risk > cutoff) AS k FROM w, (VALUES {grid}) c(i, cutoff) WHERE NOT base_failed AND doc_id IN (FROM good) GROUP BY ALL),
t AS (SELECT *, CASE WHEN k > n * {p!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}::DOUBLE) + (n - j) * ln(1 - {p!r}::DOUBLE)))) END
    <= {DELTA!r}::DOUBLE / (SELECT count(DISTINCT stratum) FROM k) AS ok FROM k),
a AS (SELECT *, min(ok) OVER (PARTITION BY stratum ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS admitted FROM t),
cut AS (SELECT stratum, min(cutoff) AS cutoff FROM a WHERE admitted GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(risk > cutoff, false) AS kept FROM w LEFT JOIN cut USING (stratum)
"""


SQL = _sql()
