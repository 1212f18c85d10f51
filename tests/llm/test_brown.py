"""Class-based bigrams against plain recounting."""

import math
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import rows
from tilespark.llm import batches, brown, store

C = brown.CLASSES


def matrix(line, cls):
    out = np.zeros((C, C), np.int64)
    np.add.at(out, (cls[line[:-1]], cls[line[1:]]), 1)
    return out


def test_best_classes_equals_recounting():
    rng = np.random.default_rng(7)
    m = 60
    line = rng.zipf(1.3, 4000) % m
    line[rng.random(4000) < 0.1] = m  # ends
    cls = np.append(rng.integers(0, 6, m), C - 1)
    big = matrix(line, cls)
    out, into, self_ = np.zeros((m + 1, C), np.int64), np.zeros((m + 1, C), np.int64), np.zeros(m + 1, np.int64)
    np.add.at(out, (line[:-1], cls[line[1:]]), 1)
    np.add.at(into, (line[1:], cls[line[:-1]]), 1)
    np.add.at(self_, line[1:][line[1:] == line[:-1]], 1)
    got = brown.best_classes(big, out[:m], into[:m], self_[:m], cls[:m])
    moved = 0
    for w in range(m):
        trace = []
        for c in range(C - 1):
            other = cls.copy()
            other[w] = c
            trace.append(brown.likelihood(matrix(line, other)))
        assert trace[got[w]] == pytest.approx(max(trace), abs=1e-6)
        moved += got[w] != cls[w]
    assert moved > 20


@pytest.fixture(scope="module")
def fitted(spark, docs):
    folder = store.fresh(spark, "brown-test")
    n = brown.BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = brown._count(docs.select("doc_id", "text"), folder, n, brown.FREQUENT)
    model, replies = brown.fit(counts, folder, n)
    told = {r["bundle"]: r for r in rows(counts.filter("kind = 3"))}
    asked = counts.filter("kind IN (0, 3)").select("kind", "bundle", "buckets", "blob")
    if replies is not None:
        asked = asked.unionByName(replies.filter("kind = 4").select("kind", "bundle", "buckets", "blob"))
    cls, count = {}, {}
    table = asked.toArrow()
    for name in told:
        part = table.filter(np.array(table.column("bundle").to_pylist()) == name).to_batches()
        t = brown.load(folder, name)
        w = brown._arrived(part, model.cls[model.symbols(t.words)])
        for x, c, n_ in zip(t.words, w.cls.tolist(), w.count.tolist(), strict=True):
            assert cls.setdefault(x, c) == c and count.setdefault(x, n_) == n_
    assert batches.column(table.to_batches(), "bundle")
    return model, cls, count


def test_probabilities_sum_to_one(fitted):
    model, cls, count = fitted
    step, room = model.step(), model.room()
    assert np.allclose((10**step).sum(axis=1), 1)
    inside = Counter()
    for w, c in cls.items():
        if count[w]:
            inside[c] += count[w] + 1
    inside[C - 1] += model.end_count + 1
    for c in range(C):  # one is left for words that are unseen
        assert inside[c] + 1 == pytest.approx(10 ** room[c] if c < C - 1 or model.end_count else 2, rel=1e-9)


def test_scores_equal_recounting(spark, docs, fitted):
    model, cls, count = fitted
    step, room = model.step(), model.room()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = []
    for r in rows(docs.select("doc_id", "text")):
        score, before = 0.0, C - 1
        for w in [*(r["text"] or "").translate(lower).encode().split(), None]:
            c, k = (C - 1, model.end_count) if w is None else (cls[w], count[w])
            score += step[before, c] + math.log10(k + 1) - room[c]
            before = c
        want.append((r["doc_id"] is None, r["doc_id"] or 0, round(score, 6)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in rows(brown.score(docs))]
    assert sorted(got) == sorted(want)


def test_exchange_over_all_words_helps(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, all_ = (brown.score(d, full).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first() for full in (0, brown.FULL))
    assert all_.s > few.s > few.b


def test_no_training_documents(spark):
    ids = [i for i in range(200) if brown.held_out(i)]
    got = rows(brown.score(spark.createDataFrame([(i, "a b", 1) for i in ids], "doc_id long, text string, score int")))
    assert len(got) == len(ids) and all(r["held_out"] and r["n_known"] == r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
