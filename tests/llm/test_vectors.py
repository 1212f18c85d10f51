"""Nearest neighbours, product codes and the filter audit against brute force."""

from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows
from tilespark.llm import audit, lloyd, rotated

KIND = "vec_id long, embedding array<float>, label int, id long, v string, cell int, rank int"


def table(spark, vectors, labels=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None if labels is None else labels[k], 7, "x", 1, 2) for k, (i, v) in enumerate(vectors)], KIND).repartition(3)


# nearest neighbours


def product(a, b):
    """From the first dimension to the last; sum() would compensate for rounding."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def brute(vectors, k):
    """(query, rank, id) and scores of the vectors that take part, singles as float32 hold them."""
    best = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        best[i] = min(best.get(i, v), v)
    n = max(map(len, best.values()), default=0)
    m = {i: np.array(v + [0.0] * (n - len(v))) for i, v in best.items()}
    out = []
    for q, a in m.items():
        if q % 20 == 0:
            near = sorted((-product(a.tolist(), b.tolist()), i) for i, b in m.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def found(d, k=20):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(rotated.nearest(d, F.col("id") % 20 == 0, k)))


@pytest.mark.parametrize("spread", [0.02, 0.5, 5.0])
def test_neighbours_equal_brute_force(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    middles = rng.normal(size=(12, 24))
    vectors = [(i, middles[i % 12] + spread * rng.normal(size=24)) for i in range(1500)]
    assert found(table(spark, vectors)) == brute(vectors, 20)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8)) for i in range(90)]
    vectors += [(100, None), (120, [0.0] * 8), (140, [1.0, None] + [0.0] * 6), (160, [float("nan")] * 8), (180, [float("inf")] * 8), (None, [1.0] * 8), (200, []), (220, [2.0, 1.0]), (240, [-0.0] * 8), (260, [1e18, -1e18] + [0.0] * 6)]
    vectors += [(300 + i, vectors[20][1]) for i in range(60)]  # ties: equal vectors, some of them queries
    vectors += [(40, vectors[40][1]), (40, vectors[40][1] + 1), (7, vectors[3][1])]  # repeated rows, and ids with two vectors
    assert found(table(spark, vectors)) == brute(vectors, 20)
    few = [(0, [1.0, 2.0]), (1, [3.0, 0.5]), (20, [0.1, 0.2])]
    assert found(table(spark, few)) == brute(few, 20) and len(found(table(spark, few))) == 4
    for none in ([], [(0, [1.0])], [(0, None), (20, [0.0])]):
        assert found(table(spark, none)) == []


def test_a_third_of_all_rows_may_be_one_vector(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(size=16)
    vectors = [(i, one if i % 3 else rng.normal(size=16)) for i in range(1200)]
    assert found(table(spark, vectors)) == brute(vectors, 20)


def test_estimates_are_within_their_bounds_and_recall_holds():
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(2000, 48)), rng.normal(size=(100, 48))
    turn = rotated.rotation(48)
    assert np.allclose(turn.T @ turn, np.eye(48), atol=1e-5)
    block = rotated.encode(v, turn)
    assert block["bits"].dtype == np.uint8 and block["bits"].shape == (2000, len(turn) // 8)
    for errors, share in ((1.0, 0.6), (2.0, 0.93), (5.0, 1.0)):
        guess, bound = rotated.estimate(block, q, q.astype(np.float32) @ turn.T, len(turn), errors)
        off = np.abs(guess - q @ v.T)
        assert (off <= bound).mean() >= share
        assert abs((guess - q @ v.T).mean()) < 0.02  # no bias
    guess, bound = rotated.estimate(block, q, q.astype(np.float32) @ turn.T, len(turn))
    true = q @ v.T
    top = np.sort(true, axis=1)[:, -20:]
    assert ((guess + bound >= top[:, :1]) | (true < top[:, :1])).all() and (guess + bound >= top[:, :1]).mean() < 0.5


# product codes


def coded(vectors, parts=16, entries=64, rounds=2):
    kept = [(i, v) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v in kept), default=1) // parts))
    x = np.array([np.floor(np.array([*np.asarray(v, np.float32), *[0.0] * (parts * width - len(v))], float) * 256) for _, v in kept]).clip(-(1 << 25), 1 << 25).astype(np.int64).reshape(len(kept), parts, width)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(y)) for y in kept[k][1]]))
    books = x[order[:entries]].copy()

    def assign():
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        of, _ = assign()
        for p in range(parts):
            for e in range(len(books)):
                if (of[:, p] == e).any():
                    books[e, p] = x[of[:, p] == e, p].sum(axis=0) // (of[:, p] == e).sum()
    of, error = assign()
    return [(kept[k][0], bytes(of[k].astype(np.uint8).tolist()).hex(), int(error[k].sum())) for k in range(len(kept))], np.ascontiguousarray(books.transpose(1, 0, 2))


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=40) * (0.2 if i % 5 else 0.001)) for i in range(500)]
    vectors += [(900 + i, vectors[3][1]) for i in range(250)] + [(3, vectors[3][1]), (3, vectors[4][1])]  # a third is one vector; repeated ids
    vectors += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 40), (2003, []), (2004, [0.5] * 37), (None, [0.25] * 40), (2005, [3e30] * 40)]
    labels = [None if k % 7 == 0 else k % 4 for k in range(len(vectors))]
    d, books = lloyd.compress(table(spark, vectors, labels), most=200)
    got = rows(lloyd.by_label(d))
    want, entries = coded(vectors)
    key = lambda x: (x[0] is None, *[y or 0 for y in x[:1]], *x[1:])
    assert sorted(((r["vec_id"], r["code"].hex(), r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert all(np.array_equal(a, b) for a, b in zip(books, entries, strict=True))
    sums = defaultdict(int)
    for r in got:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_few_rows_and_none(spark):
    few = [(5, [0.1, 0.2]), (2, [0.3, -0.4]), (9, [0.3, -0.4])]
    d, books = lloyd.compress(table(spark, few))
    want, entries = coded(few)
    assert sorted((r["vec_id"], r["code"].hex(), r["error"]) for r in rows(d)) == sorted(want) and all(np.array_equal(a, b) for a, b in zip(books, entries, strict=True))
    for none in ([], [(1, None)]):
        assert lloyd.by_label(lloyd.compress(table(spark, none))[0]).count() == 0


@pytest.mark.parametrize("width", [1, 3, 8])
def test_cover_trees(width):
    rng = np.random.default_rng(width)
    points, count = np.unique((rng.normal(size=(3000, width)) * np.array([40.0, 3.0])[rng.integers(0, 2, 3000)][:, None]).astype(np.int64), axis=0, return_counts=True)
    t = lloyd.Tree.grow(points, count)
    assert sorted(t.order.tolist()) == list(range(len(points))) and (t.total[0] == [*(points * count[:, None]).sum(axis=0), count.sum()]).all()
    for i in range(len(t.centre)):
        mine = points[t.order[t.lo[i] : t.hi[i]]]
        far = np.sqrt(((mine - points[t.centre[i]]) ** 2).sum(axis=1).max())
        assert far == pytest.approx(t.radius[i])
        if t.children[i]:
            kids = np.arange(t.child[i], t.child[i] + t.children[i])
            assert t.lo[kids[0]] == t.lo[i] and t.hi[kids[-1]] == t.hi[i] and (t.lo[kids[1:]] == t.hi[kids[:-1]]).all() and t.centre[i] in t.centre[kids]
            scale = 2.0 ** (np.ceil(np.log2(t.radius[i])) - 1)  # the largest power of two below the radius
            assert (t.radius[kids] <= scale).all()
            c = points[t.centre[kids]]
            apart = ((c[:, None] - c[None]) ** 2).sum(axis=2)[~np.eye(len(c), dtype=bool)]
            assert not len(apart) or apart.min() > scale * scale
    entries = points[rng.choice(len(points), min(40, len(points)), replace=False)]
    entries = np.concatenate([entries, entries[:3]])  # ties go to the first
    want = lloyd.squared(points, entries).argmin(axis=1)
    assert np.array_equal(t.codes(entries), want)
    nodes, given, seen = t.assign(entries)
    assert sum((t.hi - t.lo)[nodes]) == len(points)
    near = t.assign(np.array([points[0], points[0] + 10**6]))
    assert near[2] < 5 and len(near[0]) < 5  # far entries: whole subtrees at once


# filter audit

WORD = "\x20\x09\x0a\x0b\x0c\x0d"


def audited(docs, labels):
    """Every order and step, by applying the filters to lists of documents."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        t = t or ""
        w = [x for x in "".join(" " if c in WORD else c for c in t).split(" ") if x]
        return "".join(f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and t in first and first[t] < i), strict=True) if bad)

    parts = defaultdict(list)
    for i, t, lang in docs:
        parts[lang or ""].append((i, fails(i, t)))
    out = []
    for part, here in parts.items():
        shapley = defaultdict(int)
        mine = []
        for order in map("".join, permutations("ABCDE")):
            left = here
            for k, f in enumerate(order):
                gone, stay = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                mine.append([part, order, k + 1, len(stay), len(gone), sum(f in d[1] for d in here) - len(gone), sum(d[1] == f for d in here), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)])
                left = stay
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_audit_equals_applying_the_filters(spark, texts, monkeypatch, broadcast):
    monkeypatch.setattr(audit, "BROADCAST", broadcast)
    more = [*texts, "ABC DEF " * 60, "w " * 200, " ".join(f"word{i}" for i in range(150)), " ".join(f"word{i}" for i in range(150)), " ".join(f"w{i}" for i in range(99)) + " #", *["copy of one text"] * 40]
    docs = [(None if k % 13 == 5 else k % 60, t, [None, "", "en", "de"][k % 4]) for k, t in enumerate(more)]
    docs += [(3, more[3], "en"), (3, more[3], "en"), (3, "another text", "en")]  # repeated rows and ids
    labels = [(k, k % 3 == 0, k % 5 == 0) for k in range(50)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    labels = [(i, None if q is None else int(q), None if x is None else int(x)) for i, q, x in labels]
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, lang string, bits int, part int, n int").repartition(4)
    got = rows(audit.report(audit.combinations(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == audited(docs, labels)


def test_audit_of_nothing(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.report(audit.combinations(nothing, none)).count() == 0
    d = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = rows(audit.report(audit.combinations(d, none)))
    assert len(got) == 600 and {r["part"] for r in got} == {""}


@pytest.mark.parametrize("name", ["op11_rotated_codes", "op12_filter_audit", "op13_cover_codes"])
def test_queries_equal_their_sql(spark, name):
    import oracle

    from tilespark.llm import catalogue

    sf = "/root/testdata/sf0.001"
    assert not oracle.difference(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], oracle.connection(sf))
