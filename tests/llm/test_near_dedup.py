"""Near duplicates against brute-force edit distance."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import rows
from tilespark.llm import near_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def distance(a, b):
    """Levenshtein's, by the plain recurrence."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def linked(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    if a == b:
        return True
    return min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= most and len(set(a) & set(b)) > 0 and distance(a, b) <= most


def trimmed(w, seen_before=16):
    seen, out = defaultdict(int), []
    for i, x in enumerate(w):
        g = tuple(w[i : i + 5])
        if len(g) < 5 or seen[g] < seen_before:
            out.append(x)
        seen[g] += 1
    return out


def both(a, b):
    return linked(a, b) and linked(trimmed(a), trimmed(b))


def grouped(words, link):
    root = list(range(len(words)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(words)):
        for j in range(i):
            if find(i) != find(j) and link(words[i], words[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(words))]


def hashed(words):
    return np.array([hash(w) & 0x7FFFFFFFFFFFFFFF for w in words], np.uint64)


def test_near_duplicates(docs):
    plain = rows(docs.select("doc_id", "text"))
    of = grouped([WORD.findall(r["text"] or "") for r in plain], both)
    groups = defaultdict(list)
    for g, r in zip(of, plain, strict=True):
        groups[g].append(r["doc_id"])
    want = []
    for ids in groups.values():
        c = min((x for x in ids if x is not None), default=None)
        want += [(x, c) for x in ids]
    got = rows(near_dedup.classes(docs))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_alignment_is_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a = [str(rng.randint(0, rng.choice((5, 400)))) for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 16)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [str(rng.randint(0, 400)) for _ in range(rng.randint(0, 2))]
            b = b or ["x"]
        d = distance(a, b)
        x, y = near_dedup.Text(hashed(a)), near_dedup.Text(hashed(b))
        for most in (0, 3, 9, 80):
            assert near_dedup.banded_distance(x.h, y.h, most) == min(d, most + 1)
            if min(len(a), len(b)) >= near_dedup.SHINGLE:
                low, high = near_dedup._bounds(x, y, most)
                assert low <= d <= high
        if len(b) >= 5:
            assert near_dedup.near(x, y) == linked(a, b)


def test_moved_blocks_do_not_link():
    """Sets of shingles would link them: the alignment alone decides."""
    w = [f"w{i}" for i in range(400)]
    parts = [w[i : i + 50] for i in range(0, 400, 50)]
    moved = sum((parts[i] for i in (5, 2, 7, 0, 4, 6, 1, 3)), [])
    shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, moved)]
    assert len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) > 0.8
    assert not near_dedup.near(near_dedup.Text(hashed(w)), near_dedup.Text(hashed(moved)))


def test_repeated_filler_makes_nothing_similar():
    own = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    filler = ["is", "so."] * 200
    x, y = (near_dedup.Text(hashed(w + filler)) for w in own)
    assert linked(own[0] + filler, own[1] + filler) and not both(own[0] + filler, own[1] + filler)
    assert not near_dedup.near(x, y) and near_dedup.near(x, near_dedup.Text(hashed([*own[0], "more", *filler])))
    assert (near_dedup.trimmed(x.h) == hashed(trimmed(own[0] + filler))).all()


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(3):  # six edits between two copies: sets of shingles are less than 0.7 similar
            w[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate([*texts, " ".join(f"y{i}" for i in range(120))])), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.classes(d))}
    assert {got[i] for i in range(150)} == {0} and got[150] == 150


def test_a_family_of_forms_equals_brute_force(spark):
    """Texts of one template that are too unlike for any hub, with near copies of some among them."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(132)]
    forms = []
    for i in range(500):
        own = [f"f{i}x{j}" for j in range(50)]  # of 182 words: two forms are similar to 0.725
        forms.append([*base[:80], *own, *base[80:]])
        if i % 4 == 0:  # 33 words of its own: similar to 0.819
            forms.append([*base[:80], *own[:17], *(f"g{i}x{j}" for j in range(33)), *base[80:]])
    rng.shuffle(forms)
    # words stand at the same places in all forms, so the distance is the number of places that differ
    want = grouped(forms, lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= 36)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(forms)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.classes(d))}
    assert len(set(want)) == 500 and got == dict(enumerate(want))


def test_recall_of_near_copies(spark):
    """Of all pairs of the documents that link, nine in ten at least are in one class (all that are found link, by brute force)."""
    plain = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))]
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.op3_near_duplicates(spark, "/root/testdata/sf0.01"))}
    texts = sorted(((len(w), i, near_dedup.Text(hashed(w))) for i, w in plain if len(w) >= 5), key=lambda x: x[:2])
    every, links = 0, defaultdict(set)
    for k, (n, i, x) in enumerate(texts):
        for m, j, y in texts[k + 1 :]:
            if m - n > 0.2 * m:
                break
            if near_dedup.near(x, y):
                links[i].add(j)
                every += 1
    found = sum(got[i] == got[j] for i, js in links.items() for j in js)
    assert every > 50 and found / every >= 0.9
    joined = set(got[j] for js in links.values() for j in js)
    members = defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    empty = {i for i, w in plain if len(w) < 5}
    assert all(len(m) == 1 or c in joined or set(m) <= empty for c, m in members.items())


@pytest.mark.parametrize("length", [60, 100, 300])
@pytest.mark.parametrize("percent", [2, 5, 10, 15, 18, 20])
def test_sketches_meet_where_texts_link(length, percent):
    """Words replaced anywhere, up to the bound: nine in ten pairs at least become candidates."""
    rng = np.random.default_rng(5)
    met, edits = 0, length * percent // 100
    for _ in range(200):
        a = rng.integers(0, 2**63, length).astype(np.uint64)
        b = a.copy()
        b[rng.choice(length, edits, replace=False)] = rng.integers(0, 2**63, edits).astype(np.uint64)
        assert near_dedup.near(near_dedup.Text(a), near_dedup.Text(b))
        met += bool(np.isin(near_dedup.sketch(a), near_dedup.sketch(b)).any())
    assert met >= 0.9 * 200


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_buckets_are_counted_as_they_come(size):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    runs = rng.choice([1, 1, 1, 2, 5, 63, 64, 65, 300], 60)
    value = np.repeat(np.sort(rng.choice(10**6, 60, replace=False)) - 500_000, runs)
    row = rng.permutation(len(value))
    parts = [pa.record_batch([pa.array(value[i : i + size]), pa.array(row[i : i + size])], names=["value", "row"]) for i in range(0, len(value), size)]
    got = [x for b in near_dedup._counted(iter(parts)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    n = dict(zip(*np.unique(value, return_counts=True), strict=True))
    assert got == [(v, r, min(64, n[v])) for v, r in zip(value.tolist(), row.tolist(), strict=True) if n[v] > 1]


def test_sketches_of_short_texts_and_of_other_orders():
    w = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert [len(near_dedup.sketch(w[:n])) for n in (0, 4, 5, 6, 8, 9, 300)] == [0, 0, 1, 1, 6, 84, 84]
    moved = np.concatenate([w[200:], w[:200]])
    assert 0 < np.isin(near_dedup.sketch(w), near_dedup.sketch(moved)).mean() < 0.7  # pairs across the cut have turned round


@pytest.mark.parametrize("percent", [10, 15, 20])
def test_pairs_of_every_edit_rate_end_in_one_class(spark, percent):
    rng = random.Random(percent)
    texts = []
    for i in range(60):
        w = [f"w{i}x{j}" for j in range(200)]
        v = list(w)
        for j in rng.sample(range(200), 2 * percent):
            v[j] = f"v{i}x{j}"
        texts += [" ".join(w), " ".join(v)]
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(60)) >= 54
    assert len({got[2 * i] for i in range(60)}) == 60


def test_no_rows_and_missing_ids(spark, nothing):
    assert near_dedup.classes(nothing).count() == near_dedup.keep_one(nothing).count() == 0
    d = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id int, text string")
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in rows(near_dedup.classes(d))) == [("3", "3"), ("None", "None"), ("None", "None")]
