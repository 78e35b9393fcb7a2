"""Training-data operators on texts against brute force, with awkward rows."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from snapstrata.llm import op1_packing, op2_ngram_join, op4_bpe, op5_exact_dedup, op7_license, op8_suffix, op9_cdc, tokens  # noqa: E402

SCHEMA = "doc_id long, text string, rk string, cls int"  # the last two clash with names used inside
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def awkward():
    rnd = random.Random(7)
    pool = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "Ünïcödé ßtraße naïve café — “quoted” 漢字 \U0001f600", "it it it it it it it it it it it it", "a\tb\x0bc\x0cd\re\n\nf  g"]
    texts = [None, "", " \n\t", "x", "X", "x\n", LONG, LONG + " tail", "ab" * 400, "</s> <|endoftext|> [INST]"]
    for _ in range(40):
        texts.append(" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 5))))
    base = " ".join(f"t{rnd.randrange(200)}" for _ in range(120)).split()
    for _ in range(25):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 6])):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(3)}"
        texts.append(" ".join(w))
    rows = [(7 * i + 3, t, None, i) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = op1_packing.pack_documents(docs, path, 2, 64).collect()
    t = tokens.load(path)
    import zlib

    by_doc, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text, *_ in awkward():
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 64 for r in mine[1:]) and len(mine) == -(-len(ids) // 64)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(fill) <= 1.005 * math.ceil(total / 64)
    assert op1_packing.pack_documents(empty, path).count() == 0
    twice = docs.unionByName(docs)
    assert op1_packing.pack_documents(twice, path, 2, 64).count() == 2 * len(rows)


def test_dominance():
    for sizes in ([10], [6, 4], [6, 5], [7, 2, 2], [5, 5, 5], [9, 1, 1]):
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        plan = op1_packing.plan_packing(counts, 10)
        assert sum(p[2] for p in plan) == len(sizes)
    assert op1_packing.dominant_set(op1_packing._Sizes({6: 1, 4: 1, 3: 2}), 10) == (6, 4)
    assert op1_packing.dominant_set(op1_packing._Sizes({9: 2, 5: 1}), 10) == (9,)
    assert op1_packing.dominant_set(op1_packing._Sizes({4: 1, 3: 9, 2: 9}), 10) is None


def small_optimum(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_packing_near_optimum():
    rnd = random.Random(2)
    worse = 0
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        used = {f + r // per for _, _, n, f, _, per in op1_packing.plan_packing(counts, 20) for r in range(n)}
        worse += len(used) - small_optimum(sizes, 20)
    assert worse <= 2


def test_dominance_goes_on():
    """A size without a dominating set does not end the reduction for the smaller ones."""
    plan = op1_packing.plan_packing({15: 1, 14: 1, 10: 1, 5: 3, 3: 2}, 20)
    assert len({f + r // per for _, _, n, f, _, per in plan for r in range(n)}) == 3 == small_optimum([15, 14, 10, 5, 5, 5, 3, 3], 20)


def jaccard_brute(rows, size=5, t=75):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_join.jaccard_components(docs).collect()}
    assert got == jaccard_brute(awkward())
    assert op2_ngram_join.jaccard_components(empty).count() == 0
    kept = {r.doc_id for r in op2_ngram_join.near_dedup(docs).collect()}
    assert kept == {c for _, c in jaccard_brute(awkward()).values()}
    assert op2_ngram_join.near_dedup(docs).columns == docs.columns


def test_ngram_chains(spark):
    """Links that no hub sees: a chain whose ends do not link."""
    words = [f"v{i}" for i in range(60)]
    rows = []
    for k in range(12):
        w = list(words)
        for j in range(k):
            w[5 * j] = f"n{j}"
        rows.append((k, " ".join(w), None, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    for stars in (1, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_join.jaccard_components(df, stars=stars).collect()}
        assert got == jaccard_brute(rows)


def test_prefix_theorem():
    """Any two sets that link share the asked number of shingles in their prefixes, in hash order."""
    rnd = np.random.default_rng(4)
    for _ in range(300):
        n = int(rnd.integers(1, 120))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > 0.1], rnd.integers(0, 2**63, int(rnd.integers(0, 12))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            pa, pb = (x[: op2_ngram_join.prefix_length(len(x), 75)] for x in (a, b))
            need = max(op2_ngram_join.slack(op2_ngram_join.least_overlap(len(x), 75)) for x in (a, b))
            assert len(np.intersect1d(pa, pb)) >= need


def test_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokens.load(path)
    got = {r.doc_id: r for r in op4_bpe.encode_decode(docs, path).collect()}
    for i, text, *_ in awkward():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert op4_bpe.encode_decode(empty, path).count() == 0


def test_bpe_small_chunks():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, t = op4_bpe.ChunkEncoder(path, mean=8, cache_bytes=2000), tokens.load(path)
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("ab é\n\t'漢９. \U0001f600") for _ in range(rnd.randint(0, 300)))
        raw = text.encode()
        cuts = np.asarray(sorted(rnd.sample(range(len(raw) + 1), min(len(raw), 20))), np.int64)
        assert np.frombuffer(encoder.encode(raw, cuts), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, text, *_ in awkward():
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op5_exact_dedup.exact_groups(docs).collect()}
    assert got == want
    kept = op5_exact_dedup.exact_dedup(docs)
    assert {r.doc_id for r in kept.collect()} == {k for k, *_ in want.values()} and kept.columns == docs.columns
    assert op5_exact_dedup.exact_groups(empty).count() == 0
    assert op5_exact_dedup.exact_dedup(docs.unionByName(docs)).count() == len(groups)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (2, "ab"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in op5_exact_dedup.exact_groups(df).collect()}
    assert got == {(None, None, 2), (2, None, 2), (None, None, 1)}
    assert op2_ngram_join.jaccard_components(df).count() == 3
    assert op8_suffix.suffix_dedup(df).count() == 3


def test_license(spark, empty):
    texts = [None, "", "Apache License, Apache license", "see GNU General Public License v2 (cc-by) CC BY", "MIT license.", "mit é license", "K" * 70, LONG,
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
             "redistribution and use in source and forms binary"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, "filler words") for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r for r in op7_license.license_scan(df).collect()}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        at = [(k, label) for p, label in op7_license.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[8].labels == "mit" and got[8].score > 0.9 and got[9].labels == "bsd" and got[10].labels == ""
    assert op7_license.license_scan(empty).count() == 0


@pytest.mark.parametrize("mit, other", [(1, 0), (1, 1), (2, 17), (66, 134), (200, 0)])
def test_license_common(spark, mit, other):
    """A template is found however many of the rows carry it, in tables of any size."""
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(i, text) for i in range(mit)] + [(1000 + i, "filler words") for i in range(other)], "doc_id long, text string")
    got = op7_license.license_scan(df).collect()
    assert len(got) == mit + other and all((r.labels, r.score) == (("mit", 1.0) if r.doc_id < 1000 else ("", 0.0)) for r in got)


def test_license_many(spark):
    """All templates of one text are found, and each of many copies costs its own words only."""
    every = " and then ".join(text for _, text, _ in op7_license.TEMPLATES)
    long = " ".join(f"{text} {'x ' * k}" for k in range(250) for _, text, _ in op7_license.TEMPLATES)
    df = spark.createDataFrame([(1, every), (2, long), *((100 + i, "filler words") for i in range(200))], "doc_id long, text string")
    got = {r.doc_id: r for r in op7_license.license_scan(df).collect()}
    labels = sorted({label for label, _, _ in op7_license.TEMPLATES})
    assert got[1].labels.split(",") == labels and got[2].labels.split(",") == labels and got[1].score == 1.0


def suffix_brute(rows, n=100):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = True
            seen.add(b[k : k + n])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length", [20, 100])
def test_suffix_dedup(docs, empty, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix.suffix_dedup(docs, length).collect()}
    assert got == suffix_brute(awkward(), length)
    assert op8_suffix.suffix_dedup(empty).count() == 0


def test_run_length_index():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        text = np.append(rnd.integers(97, 97 + int(rnd.integers(1, 4)), int(rnd.integers(1, 120))), 255).astype(np.uint8)
        raw, n = text.tobytes(), len(text)
        order = sorted(range(n), key=lambda i: raw[i:])
        index = op8_suffix.RunLengthIndex(text)
        prev, common = index.matching_statistics()
        assert len(index.at) <= len(index.run_starts) + 1
        for k, i in enumerate(order):
            want = order[k - 1] if k else -1
            assert prev[i] == want
            if k:
                m = 0
                while max(i, want) + m < n and raw[i + m] == raw[want + m]:
                    m += 1
                assert common[i] == m


def test_cdc(docs, empty):
    rows = awkward()
    got = {r.doc_id: r for r in op9_cdc.cdc_dedup(docs, keep_text=True).collect()}
    seen = {}
    from snapstrata.llm.common import flat
    import pyarrow as pa

    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        data, offsets = flat(pa.array([text]))
        gone, a = np.zeros(len(b), bool), 0
        for e in op9_cdc.chunk_ends(data, offsets, op9_cdc.RATE, op9_cdc.MIN_CHUNK, op9_cdc.MAX_CHUNK)[0]:
            if e - a >= op9_cdc.MIN_CHUNK:
                gone[a:e] = b[a:e] in seen
                seen[b[a:e]] = i
            a = e
        assert a == len(b)
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(left).hexdigest())
    assert op9_cdc.cdc_dedup(empty).count() == 0


def test_cdc_resists_shifts(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    df = spark.createDataFrame([(1, passage), (2, "shifted by this " + passage[:1500] + "!" + passage[1500:])], "doc_id long, text string")
    got = {r.doc_id: r for r in op9_cdc.cdc_dedup(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 2500
