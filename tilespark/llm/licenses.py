"""License scans by diagonal voting.

Texts are lower-cased (A-Z) and cut into words. All rolling word k-grams are joined with the templates' k-grams in Spark; a
match at word p of a document and word t of a template votes for the diagonal p - t. Votes are summed by diagonal,
diagonals within BAND of one another and near in the text are merged, and a merged span is verified: the share of the template's
words that its matching k-grams cover must reach COVERAGE, within a span of at most SLACK times the template's length. So a word that is replaced, left out or put in
costs one word of the template, not the k-grams around it.

The phrases of BASE are templates of one k-gram, as long as themselves; each of their votes is a place. Words are numbered in
the templates' vocabulary and a k-gram is its numbers, so equal k-grams are equal words and no hash can collide.
Only k-grams made of that vocabulary leave the scan, since no other can join: a semi-join pushed below it.
What is broadcast is the table of templates, fixed in this module.

Null texts are empty; each row is scanned by itself, also where ids are null or repeated; an empty table gives no rows;
other columns are ignored. Labels are "" where there are none; the score is the best verified coverage, 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm import batches
from tilespark.llm.runs import Words

GRAM = 3
BAND = 2
COVERAGE = 0.9
SLACK = 1.25
#: Bits of a word's number in a k-gram.
BITS = 12

#: Phrase and label (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label and notice, as published by the licences' stewards (fixed values).
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc-sa", "licensed under cc by-nc-sa 4.0"),
    ("cc-by-nd", "licensed under cc by-nd 4.0"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("boost", "distributed under the boost software license version 1.0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
)

#: Bytes to lower case; those between words to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def scan_words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _templates(base=BASE, notices=NOTICES) -> tuple[dict[bytes, int], list[tuple]]:
    """The vocabulary, and rows (tpl, label, base, k, gram, tpos, grams, words)."""
    all_ = [(p, label, True) for p, label in base] + [(t, label, False) for label, t in notices]
    number: dict[bytes, int] = {}
    rows = []
    for tpl, (text, label, is_base) in enumerate(all_):
        ids = [number.setdefault(w, len(number) + 1) for w in scan_words(text)]
        k = len(ids) if is_base else GRAM
        grams = [sum(x << BITS * j for j, x in enumerate(ids[i : i + k])) for i in range(len(ids) - k + 1)]
        rows += [(tpl, label, is_base, k, g, i, len(grams), len(ids)) for i, g in enumerate(grams)]
    if len(number) >= 1 << BITS:
        raise ValueError("too many words in the templates")
    return number, rows


def _grams(docs: DataFrame, vocabulary: dict[bytes, int], ks: list[int]) -> DataFrame:
    """(row, doc_id, n_words, k, pos, gram): one row for each document (k 0) and for each k-gram of the vocabulary."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("row", pa.int64()), ("doc_id", batches.hold(kind)), ("n_words", pa.int64()), ("k", pa.int32()), ("pos", pa.int64()), ("gram", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, get = TaskContext.get().partitionId() << 36, vocabulary.get
        for b in batches.pieces(it, "text"):
            words, docs_ = Words([t.encode() for t in batches.texts(b)], _FOLD), b.num_rows
            size = words.sizes
            ids = np.fromiter((get(w, 0) for w in words.distinct), np.int64, len(words.distinct))[words.index]
            of = np.repeat(np.arange(docs_), size)
            begin = np.cumsum(size) - size
            doc_ids = b.column("doc_id")
            yield batches.batch(schema, [row + np.arange(docs_), doc_ids, size, np.zeros(docs_, np.int32), pa.nulls(docs_, pa.int64()), pa.nulls(docs_, pa.int64())])
            for k in ks:
                n = len(ids) - k + 1
                if n <= 0:
                    continue
                known = of[:n] == of[k - 1 :]
                gram = np.zeros(n, np.int64)
                for j in range(k):
                    known &= ids[j : j + n] > 0
                    gram |= ids[j : j + n] << BITS * j
                at = np.flatnonzero(known)
                if len(at):
                    yield batches.batch(schema, [row + of[at], doc_ids.take(pa.array(of[at])), size[of[at]], np.full(len(at), k, np.int32), at - begin[of[at]], gram[at]])
            row += docs_

    return batches.mapped(docs.select("doc_id", "text"), run, f"row long, doc_id {kind}, n_words long, k int, pos long, gram long")


def spans(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """One row for each merged diagonal span (and one without a template for each document): row, doc_id, n_words, tpl, label,
    base, votes, first_pos, last_pos (a word's index, inclusive), coverage, verified."""
    vocabulary, rows = _templates(base, notices)
    spark = docs.sparkSession
    ks = sorted({r[3] for r in rows})
    t = spark.createDataFrame(rows, "tpl int, label string, base boolean, k int, gram long, tpos long, grams int, words int")
    hits = _grams(docs, vocabulary, ks).join(F.broadcast(t), ["k", "gram"], "left").filter("k = 0 OR tpl IS NOT NULL")
    hits = hits.repartition("row")  # all that follows is by row: no other shuffle
    votes = hits.groupBy("row", "doc_id", "tpl", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("k").alias("k"),
        F.first("grams").alias("grams"), F.first("words").alias("words"), F.count("tpl").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("tpos"),
    )
    along = Window.partitionBy("row", "doc_id", "tpl").orderBy("diag")
    apart = F.col("base") | (F.col("diag") - F.lag("diag").over(along) > BAND) | (F.col("lo") - F.lag("hi").over(along) > F.col("words"))
    votes = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    votes = votes.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    s = votes.groupBy("row", "doc_id", "tpl", "part").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("words").alias("words"),
        F.sum("votes").alias("votes"), F.min("lo").alias("first_pos"), (F.max("hi") + F.first("k") - 1).alias("last_pos"),
        F.first("k").alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("tpos"),  # a template's places at most
    )
    gain = F.transform("tpos", lambda x, i: F.least(F.col("k").cast("long"), F.coalesce(F.get("tpos", i + 1) - x, F.col("k").cast("long"))))
    s = s.withColumn("coverage", F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x) / F.col("words"))
    fits = (F.col("coverage") >= COVERAGE) & (F.col("last_pos") - F.col("first_pos") + 1 <= F.col("words") * SLACK)
    return s.withColumn("verified", F.coalesce(fits, F.lit(False))).drop("part", "words", "k", "tpos")


def scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    b = F.col("base") & F.col("tpl").isNotNull()
    out = spans(docs, base, notices).groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.coalesce(F.sum(F.when(b, F.col("votes"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(b, F.col("first_pos"))).alias("first_word"), F.max(F.when(b, F.col("first_pos"))).alias("last_word"),
        found(b).alias("base_labels"), found(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("verified"), F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    all_ = [(p, label, True) for p, label in BASE] + [(t, label, False) for label, t in NOTICES]
    rows = []
    for tpl, (text, label, base) in enumerate(all_):
        ws = [w.decode() for w in scan_words(text)]
        k = len(ws) if base else GRAM
        rows += [f"({tpl}, '{label}', {base}, {k}, {i}, '{' '.join(ws[i : i + k])}', {len(ws) - k + 1}, {len(ws)})" for i in range(len(ws) - k + 1)]
    ks = ", ".join(f"({k})" for k in sorted({len(p.split()) for p, _ in BASE} | {GRAM}))
    return rf"""
WITH t(tpl, label, base, k, tpos, gram, grams, words) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(ws[i : i + k - 1], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (VALUES {ks}) ks(k))),
v AS (SELECT doc_id, tpl, pos - tpos AS diag, any_value(label) AS label, any_value(base) AS base, any_value(g.k) AS k, any_value(grams) AS grams, any_value(words) AS words, count(*) AS votes, min(pos) AS lo, max(pos) AS hi, list(tpos) AS tp
    FROM g JOIN t ON g.k = t.k AND g.gram = t.gram GROUP BY doc_id, tpl, pos - tpos),
n AS (SELECT *, CASE WHEN coalesce(base OR diag - lag(diag) OVER w > {BAND} OR lo - lag(hi) OVER w > words, true) THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, tpl ORDER BY diag)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diag ROWS UNBOUNDED PRECEDING) AS part FROM n),
s AS (SELECT doc_id, tpl, part, any_value(label) AS label, any_value(base) AS base, sum(votes) AS votes, min(lo) AS first_pos, max(hi) + any_value(k) - 1 AS last_pos, len(list_distinct(flatten(list_transform(flatten(list(tp)), lambda x: range(x, x + k)))))::DOUBLE / any_value(words) AS coverage,
    any_value(words) AS words FROM p GROUP BY doc_id, tpl, part, k),
f AS (SELECT *, coverage >= {COVERAGE}::DOUBLE AND last_pos - first_pos + 1 <= words * {SLACK}::DOUBLE AS verified FROM s),
r AS (SELECT doc_id, CAST(sum(votes) FILTER (base) AS BIGINT) AS n_base, min(first_pos) FILTER (base) AS first_word, max(first_pos) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(coverage) FILTER (verified) AS score FROM f GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""


SQL = _sql()
