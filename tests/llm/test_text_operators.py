"""Operators against brute force, with nulls, empty, blank and very long texts, repeated rows, clashing columns, no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tilespark.llm import brown, chat, licenses, media, mixing, packing, phrases, quality, tokens
from tests.llm.conftest import rows

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(t):
    return WORD.findall(t or "")


def same(got, want):
    key = lambda r: repr(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.fixture(scope="module")
def plain(docs):
    return rows(docs.select("doc_id", "text", "source"))


# tokens


def test_token_counts(docs, plain):
    tok = tokens.tokenizer(None)
    want = []
    for r in plain:
        n = len(tok.encode(r["text"] or "", add_special_tokens=False))
        want.append({"doc_id": r["doc_id"], "n_bytes": len((r["text"] or "").encode()), "n_tokens": n, "over_limit": n > 2048})
    same(rows(tokens.count_tokens(docs)), want)


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 5), (400, 40), (32_768, 512)])
def test_spliced_ids_are_the_library_s(texts, chunk, overlap):
    tok = tokens.tokenizer(None)
    for t in texts:
        if t and len(t) < 70_000 or chunk > 1000:
            assert tokens.spliced_ids(tok, (t or "")[:4000] if chunk < 1000 else t or "", chunk, overlap) == tok.encode((t or "")[:4000] if chunk < 1000 else t or "", add_special_tokens=False).ids


def test_random_texts_by_runs():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    many = ["".join(rng.choice("abcDé 12'.,\n\t! <|>Σßǘ日\xa0 ‍́") for _ in range(rng.randint(0, 200))) for _ in range(400)] + ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>"]
    tok = tokens.tokenizer(None)
    assert tokens.Counter(memo=50)(many) == [len(tok.encode(t, add_special_tokens=False)) for t in many]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in packing.Encoder(memo=50)(many)] == [lib.encode(t, add_special_tokens=False).ids + [1] for t in many]


# media


def test_media(docs, plain):
    want = []
    for r in plain:
        raw = (r["text"] or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append({"doc_id": r["doc_id"], "n_bytes": len(raw), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:])})
    got = rows(media.media(docs))
    same([{k: r[k] for k in want[0]} for r in got], want)
    by = defaultdict(set)
    for r in got:
        assert r["digest"] == r["payload_sha256"]
        by[r["digest"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())


def test_shards_are_tar_files(spark, docs, tmp_path):
    import io
    import tarfile

    r = media.write_shards(docs, f"file://{tmp_path}/m").collect()
    for x in r:
        with tarfile.open(tmp_path / "m" / x.shard) as t:
            entry = t.extractfile(x.digest + ".png").read()
        assert len(entry) == x.length and hashlib.sha256(media.decode(entry)).hexdigest() == x.digest
        assert io.BytesIO((tmp_path / "m" / x.shard).read_bytes()[x.offset : x.offset + x.length]).read() == entry


# packing


def test_packing(docs, plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(packing.pack(docs, with_ids=True))
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in plain)
    seqs = defaultdict(list)
    for p in got:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    # pieces of each document make it up, whole; documents that share an id are told apart by their lengths
    parts = defaultdict(lambda: defaultdict(list))
    for p in got:
        parts[p["doc_id"], p["doc_tokens"]][p["start"]].append(tuple(p["ids"]))
    for (doc_id, ids), n in want.items():
        p = parts[doc_id, len(ids)]
        assert all(len(v) >= n for v in p.values())
    assert sum(p["length"] for p in got) == sum(len(ids) * n for (_, ids), n in want.items())
    used = sum(p["length"] for p in got)
    assert used / (2048 * len(seqs)) > 0.5  # three small partitions


@pytest.mark.parametrize("longest", [300, 1500, 2048, 9000])
def test_packer(longest):
    """Nothing is lost, little is padding, and documents that fit are cut only where classes can't place them."""
    rng = np.random.default_rng(3)
    lengths = [int(rng.integers(1, longest + 1)) for _ in range(3000)] + [1, 2048, 2047, 2049]
    p, done = packing.Packer(), []
    for i, n in enumerate(lengths):
        done += p.add(n, i)
    done += p.rest()
    pieces = defaultdict(list)
    for s in done:
        assert 0 < sum(n for _, _, n in s) <= 2048
        for i, start, n in s:
            pieces[i].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces[i]):
            assert start == at and k > 0
            at += k
        assert at == n
    assert sum(lengths) / (2048 * len(done)) > 0.985
    fit = [i for i, n in enumerate(lengths) if n <= 2048]
    assert sum(len(pieces[i]) > 1 for i in fit) < {300: 0.05, 1500: 0.3, 2048: 0.3, 9000: 0.1}[longest] * len(fit)
    again = packing.Packer()
    assert [s for i, n in enumerate(lengths) for s in again.add(n, i)] + again.rest() == done


def test_packer_ends_early():
    for lengths in ([], [5], [2048], [5000], [1500, 1500], [700, 700, 700, 1300]):
        p = packing.Packer()
        done = [s for i, n in enumerate(lengths) for s in p.add(n, i)] + p.rest()
        assert sum(n for s in done for _, _, n in s) == sum(lengths) and len(done) == -(-sum(lengths) // 2048)


# language model


def test_brown(docs, plain):
    toks = [[w for w in split((r["text"] or "").translate(LOWER))] + [None] for r in plain]
    held = [zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 == 2 for r in plain]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((len(t), h, sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for t, h in zip(toks, held, strict=True))
    got = rows(brown.score(docs))
    assert sorted((r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_model_is_a_distribution_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.001"
    got = brown.op5_brown_scores(spark, sf).filter("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert got.s > got.b


def test_exchange_finds_blocks():
    rng = np.random.default_rng(0)
    # words alternate between two sets
    n = np.zeros((21, 21), np.int64)
    n[:10, 10:20] = rng.integers(5, 20, (10, 10))
    n[10:20, :10] = rng.integers(5, 20, (10, 10))
    cls = brown.exchange(n, classes=4)
    assert not set(cls[:10]) & set(cls[10:20])
    assert (brown.exchange(n, classes=4) == cls).all()


def test_exchange_never_worsens():
    n = np.random.default_rng(2).integers(0, 9, (31, 31))

    def likelihood(cls):
        big = np.eye(6)[cls].T @ n @ np.eye(6)[cls]
        x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
        return x(big) - x(big.sum(axis=0)) - x(big.sum(axis=1))

    trace = [likelihood(brown.exchange(n, 6, r)) for r in range(6)]
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] > trace[0]


# quality rules


def base_rules(text):
    w = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    return n | {"base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def test_quality_base(docs, labels, plain):
    got = rows(quality.assess(docs, labels))
    same([{k: v for k, v in r.items() if k != "kept"} for r in got], [{"doc_id": r["doc_id"]} | base_rules(r["text"]) for r in plain])
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns


@pytest.mark.parametrize(("n", "k"), [(100, 0), (1000, 2), (5000, 20), (5000, 25), (200_000, 900), (10, 0), (0, 0)])
def test_exact_binomial(spark, n, k):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.005)).first()[0]
    if k > n * 0.005:
        assert got == 1
    else:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.005) + (n - i) * math.log1p(-0.005) for i in range(k + 1)]
        assert got == pytest.approx(sum(map(math.exp, logs)), rel=1e-6)


def test_thresholds_hold_their_risk(spark):
    """Good documents have little risk, bad ones much: cutoffs are admitted by stratum, and they reject at most ALPHA of the good."""
    made = []
    for i in range(9000):
        lang = "en" if i % 3 else "fr" if i % 2 else None if i % 4 else f"x{i % 60}"
        good = i % 10 != 0
        made.append((i, lang, (1.4 if lang == "fr" else 0.5) * (i % 100 < 97) + 0.45 if good else 2.4, good, False))
    f = spark.createDataFrame(made, "doc_id long, __lang string, __risk double, good boolean, __base_failed boolean")
    labels = f.selectExpr("doc_id", "CAST(good AS int) quality")
    t = {r["__stratum"]: r["__cut"] for r in rows(quality.thresholds(f, labels))}
    assert set(t) == {"len", "lfr", "~"} and t["lfr"] == 2.0 and t["len"] == 1.0 == t["~"]
    j = quality.judged(f, labels)
    for lang in ("en", "fr", None):
        part = j.filter(f.__getattr__("__lang").eqNullSafe(lang)) if lang else j.filter("__lang IS NULL OR __lang LIKE 'x%'")
        assert part.filter("good AND NOT __kept").count() <= quality.ALPHA * part.filter("good").count()
        assert part.filter("NOT good AND __kept").count() == 0
    few = quality.judged(f.filter("doc_id < 100"), labels)
    assert few.filter("NOT __kept").count() == 0


def test_names_never_clash(spark, labels):
    """Columns with the names that the operators use inside come through."""
    odd = ["__text", "__size", "__src", "__key", "__row", "__risk", "__lang", "__kept", "__n_words", "__cell", "__first", "__target", "a.b"]
    made = [(i, f"words of {i} " * (i + 1) + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", *[f"{c}{i}" for c in odd]) for i in range(12)]
    d = spark.createDataFrame(made, ["doc_id", "text", "lang", "source", *odd])
    got = rows(quality.keep_good(d, labels))
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in odd) and all(r["text"].startswith(f"words of {r['doc_id']} ") for r in got)
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns and all(r[c] == f"{c}{r['doc_id']}" for r in rows(mixed) for c in odd)


def test_equal_keys_and_sizes_are_told_apart(spark):
    made = [(None, "s", f"w{i} w{i}") for i in range(10)]
    one, two = (rows(mixing.mix_documents(spark.createDataFrame(x, "doc_id long, source string, text string").coalesce(1), share=0.75)) for x in (made, made[::-1]))
    same(one, two)


# mixing


def test_mixing(docs, plain):
    size = lambda r: len(split(r["text"]))
    total = Counter()
    for r in plain:
        total[r["source"]] += size(r)
    order = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    got = rows(mixing.mix(docs))
    again = rows(mixing.mix(docs.repartition(5)))
    same(got, again)
    assert len(got) == len(plain)
    taken = Counter()
    by_size = {v: k for k, v in total.items()}
    assert len(by_size) == len(total)
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in total)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in rows(mixed):
        words[r["source"]] += len(split(r["text"]))
    assert words == +taken


# chat


def test_chat_folds_events(spark):
    e = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "a"), (1, 3, 2, "delta", None, "b"), (1, 4, 2, "regenerate", "assistant", ""), (1, 5, 2, "delta", "assistant", "c</s>\\"),
        (1, 6, 1, "edit", "user", "[INST]\\n"), (1, 7, 3, "message", "user", "gone"), (1, 8, 3, "retract", None, None), (1, 9, 4, "message", "tool\n\\x", None), (None, 1, 1, "message", "assistant", "<s>"),
    ]
    d = spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.render(chat.fold(d))))}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "[INST]\\n"), ("assistant", "c</s>\\"), ("tool\n\\x", "")]
    assert got[1]["loss_text"] == "c</s>\\" and got[None]["loss_text"] == "<s>"
    assert got[1]["formatted"].count("</s>") == 3


def test_chat_query(spark, tmp_path):
    turns = [(5, 0, "user", None), (5, 1, "assistant", "é\\<s>[/INST] x"), (5, 1, "assistant", "tie"), (6, 0, None, "alone"), (None, 3, "assistant", "\n")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in rows(chat.op8_chat_format(spark, str(tmp_path)))}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[5]["n_turns"] == 3 and got[5]["loss_sha256"] == sha("tie" + "é\\<s>[/INST] x") or got[5]["loss_sha256"] == sha("é\\<s>[/INST] x" + "tie")
    probe = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == sha(f"user\n{probe}\nassistant\n{probe}\n") and got[-7]["loss_chars"] == 21 and got[-7]["loss_sha256"] == sha(probe)
    assert got[6]["loss_chars"] == 0 and got[None]["loss_sha256"] == sha("\n")


# phrases


def test_repeated_phrases(docs, plain):
    last = 2**63 - 1
    first = {}
    ws = [split(r["text"]) for r in plain]
    ids = [last if r["doc_id"] is None else r["doc_id"] for r in plain]
    for w, i in zip(ws, ids, strict=True):
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            first[g] = min(first.get(g, last), i)
    want, texts = [], []
    for w, i, r in zip(ws, ids, plain, strict=True):
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append({"doc_id": r["doc_id"], "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(" ".join(kept).encode()).hexdigest()})
        texts.append((r["doc_id"], kept))
    assert sum(r["n_removed"] for r in want) > 1000
    same(rows(phrases.digests(docs)), want)
    cut = phrases.dedup(docs)
    assert cut.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], split(r["text"])) for r in rows(cut)), key=key) == sorted(texts, key=key)


# licenses


def test_license_base(docs, plain):
    want = []
    for r in plain:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r["text"] or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        want.append({"doc_id": r["doc_id"], "n_words": len(w), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(labels))})
    got = rows(licenses.scan(docs))
    same([{k: r[k] for k in want[0]} for r in got], want)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 for r in got)


def test_a_changed_word_costs_one_word(spark):
    """In notices of ten words or more, one word replaced, put in or left out in the middle."""
    long = [(label, t.split()) for label, t in licenses.NOTICES if len(t.split()) >= 10]
    assert len(long) > 12
    changed = [(label, " ".join(w[: len(w) // 2] + put + w[len(w) // 2 + cut :])) for label, w in long for put, cut in ((["changed"], 1), (["more"], 0), ([], 1))]
    halves = [" ".join(w[: len(w) // 2]) for _, w in long]
    got = {r["doc_id"]: r for r in rows(licenses.scan(spark.createDataFrame(list(enumerate([t for _, t in changed] + halves)), "doc_id long, text string")))}
    for i, (label, t) in enumerate(changed):
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= 0.9, t
    for i in range(len(halves)):
        assert got[len(changed) + i]["labels"] in ("", "apache", "gpl")  # phrases of the base alone


def test_license_notices(spark):
    full = dict((t, label) for label, t in licenses.NOTICES)
    cases = [(t.upper(), label) for t, label in full.items()]
    cases += [("Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the 'Software'), to deal in the Software without restriction", "mit")]
    cases += [("permission is granted to any person to deal with the files", None), ("this work is licensed", None)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in rows(licenses.scan(d))}
    for i, (_, label) in enumerate(cases):
        assert label in got[i] if label else got[i] == [""]


# no rows


def test_empty_tables(spark, nothing, labels, tmp_path):
    for f in (tokens.count_tokens, media.media, packing.pack, brown.score, mixing.mix, mixing.mix_documents, phrases.digests, phrases.dedup, licenses.scan):
        assert f(nothing).count() == 0, f
    assert quality.assess(nothing, labels).count() == quality.keep_good(nothing, labels.limit(0)).count() == 0
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in rows(chat.op8_chat_format(spark, str(tmp_path)))] == [-7]


# automata


def shard(texts, splits=1, n=1):
    """Windows that go, by document, from parcels of one document each, all in this process."""
    windows = [phrases.Windows([t.encode()]) for t in texts]
    anchor, often, twice = phrases._merged(*(np.concatenate(c) for c in zip(*(w.elected() for w in windows), strict=True)))
    anchor, parts = anchor[twice], np.full(int(twice.sum()), splits)
    sent, places = defaultdict(list), []
    for i, w in enumerate(windows):
        p = phrases.Parcel()
        p.add(0, w, np.array([i]), anchor, parts, n)
        where, rows_ = p.close()
        places.append(where)
        for bucket, blob, text in rows_:
            sent[bucket].append((i, *phrases.bundles.unpack(blob, "u4", "u4", "i8", "i8"), phrases.bundles.unpack(text, "u1")[0].tobytes()))
    goes = set()
    for got in sent.values():
        number, size, least, most = (np.concatenate(c) for c in list(zip(*got, strict=True))[1:5])
        of = np.repeat([g[0] for g in got], [len(g[1]) for g in got])
        for passage, offset, _ in zip(*phrases.recurring([g[5] for g in got], size.astype(np.int64), least, most), strict=True):
            where = places[of[passage]]
            goes |= {(int(of[passage]), int(s + offset)) for s in where[2][where[0] == number[passage]].tolist()}
    return goes


def wanted(texts):
    first = {}
    at = [(i, j, tuple(t.split()[j : j + 13])) for i, t in enumerate(texts) for j in range(len(t.split()) - 12)]
    for i, _, g in at:
        first[g] = min(first.get(g, i), i)
    return {(i, j) for i, j, g in at if first[g] < i}


def test_automata_locate_every_recurring_window(monkeypatch):
    import random

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n))
    common = [say(30), say(60)]
    texts = [" ".join([say(rng.randint(0, 40)), rng.choice(common), say(rng.randint(0, 20))]) for _ in range(30)]
    want = wanted(texts)
    assert len(want) > 300
    assert shard(texts) == want == shard(texts, n=7) == shard(texts, splits=5, n=11)
    automaton = phrases.located
    monkeypatch.setattr(phrases, "located", lambda line, many: automaton(line, many[1:]))
    assert shard(texts) < want  # windows of the phrase that the automaton lacks are not found
    monkeypatch.setattr(phrases, "located", lambda line, many: automaton(line, []))
    assert not shard(texts)


def test_automata_go_by_words_where_hashes_collide(monkeypatch):
    """Sixteen values for all phrases: places looked up by hash would be wrong nearly everywhere."""
    import random

    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n))
    common = [say(30), say(25)]
    texts = [" ".join([say(rng.randint(0, 30)), rng.choice(common), say(rng.randint(0, 20))]) for _ in range(20)]
    want, good, asked = wanted(texts), phrases.bundles.rolling, []
    automaton = phrases.located
    monkeypatch.setattr(phrases.bundles, "rolling", lambda h, k, seed: good(h, k, seed) & np.uint64(15) if k == phrases.PHRASE else good(h, k, seed))
    monkeypatch.setattr(phrases, "located", lambda line, many: asked.append((line, many, found := automaton(line, many))) or found)
    assert shard(texts) == want and asked
    for line, many, found in asked:
        whole = {p: k for k, x in enumerate(many) for p in range(len(line)) if line.startswith(x, p)}
        assert {p: int(k) for p, k in enumerate(found.tolist()) if k >= 0} == whole


def test_a_shard_closes_on_rows(spark, tmp_path, monkeypatch):
    """One short text many times needs one entry of media: a task must not hold all of its rows."""
    d = spark.createDataFrame([(i, "same" if i % 50 else f"other {i}") for i in range(2000)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(media, "ROWS", 300)
    made = rows(media.write_shards(d, f"file://{tmp_path}/shards"))
    assert len(made) == 2000
    of = defaultdict(set)
    for r in made:
        of[r["shard"]].add(r["doc_id"])
    assert max(map(len, of.values())) <= 2000 and sum(map(len, of.values())) == 2000


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(10,0)", "string"])
def test_ids_of_other_types(spark, kind):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", None, "mit license", "a b c"])], "doc_id int, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    for f in (tokens.count_tokens, media.media, packing.pack, brown.score, licenses.scan):
        assert {str(r["doc_id"]) for r in rows(f(d))} == {"0", "1", "2", "3"}
    from tilespark.llm import near_dedup

    for f in (near_dedup.classes, near_dedup.keep_one, phrases.digests, phrases.dedup):
        if kind == "string":
            with pytest.raises(TypeError):
                f(d)
        else:
            assert {int(r["doc_id"]) for r in rows(f(d))} >= {0, 1, 2}
