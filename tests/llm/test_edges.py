"""Awkward tables in every operator and stage: clashing columns, repeated and null rows, forced collisions."""

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from snapstrata.llm import common, op1_packing, op2_ngram_join, op3_quality, op4_bpe, op5_exact_dedup, op6_embedding, op7_license, op8_suffix, op9_cdc, op10_chat, spans, tokens  # noqa: E402
from test_text_ops import FOLD, awkward, jaccard_brute, suffix_brute  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use for columns of their own.
TAKEN = ("spans", "__rk", "__spans", "rk", "ord", "cls", "digest", "norm", "n", "rank", "label", "piece", "length", "hits", "words", "copy", "sha", "h", "tree", "msg")
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def texts():
    rnd = random.Random(11)
    rows = [(1, None), (2, ""), (3, "one word"), (4, PASSAGE), (5, PASSAGE), (6, "before it " + PASSAGE + " and behind"), (7, "mit license " * 3), (None, "no id " + PASSAGE), (8, "\n \t")]
    rows += [(20 + i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(80)))) for i in range(20)]
    return rows


@pytest.fixture(scope="module")
def clashing(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    for name in TAKEN:
        df = df.withColumn(name, F.lit(name))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        1: lambda d: op1_packing.pack_documents(d, BYTES, 2, 64).drop("sequence_id", "offset"),
        2: lambda d: op2_ngram_join.jaccard_components(d),
        3: lambda d: op3_quality.quality_scores(d, labels),
        4: lambda d: op4_bpe.encode_decode(d, WORDS),
        5: lambda d: op5_exact_dedup.exact_groups(d),
        7: lambda d: op7_license.license_scan(d),
        8: lambda d: op8_suffix.suffix_dedup(d),
        9: lambda d: op9_cdc.cdc_dedup(d),
    }


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9])
def test_columns_clash(clashing, labels, n):
    run = operators(labels)[n]
    assert same(run(clashing.select("doc_id", "text")), run(clashing))


def test_other_tables_clash(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 10], i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int")
    turns = spark.createDataFrame([(c, t, "user", f"t{t}") for c in range(3) for t in range(4)], "conv_id long, turn long, role string, text string")
    for df, run in ((vectors, op6_embedding.embedding_components), (turns, lambda d: op10_chat.digests(op10_chat.format_trees(op10_chat.as_messages(d))))):
        more = df
        for name in ("rid", "codes", "unit", "sha", "tree", "msg", "parent", "score", "leaf"):
            more = more.withColumn(name, F.lit(name))
        assert same(run(df), run(more))


def test_stages_clash(spark, clashing, tmp_path, labels):
    import corpus_pipeline as c

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    twice = clashing.unionByName(clashing)
    for docs in (clashing, twice, clashing.limit(0)):
        for name, stage in c.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r[x] == x for r in rows for x in TAKEN) and len(rows) <= docs.count()
            if docs is not clashing and name in ("exact dedup", "n-gram Jaccard join"):
                assert {str((r.doc_id, r.text)) for r in rows} == {str((r.doc_id, r.text)) for r in stage(spark, docs.distinct(), str(tmp_path)).collect()} and len(rows) == len({str((r.doc_id, r.text)) for r in rows})
        packed = c.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id", "text" if "text" in packed.columns else "doc_id").count() >= docs.count()
    kept = {r.doc_id: r for r in c.passages(spark, clashing, "").collect()}
    assert 5 not in kept and kept[6].text == "before it  and behind" and kept[4].text == PASSAGE and kept[1].text is None


def test_repeated_rows(spark, labels):
    """Each row gives its own result, equal rows equal ones, and nothing else changes."""
    rows = [r for r in texts() if r[0] is not None]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    twice = once.unionByName(once).repartition(4)
    by = operators(labels)
    for n in (2, 4, 7, 8, 9):
        one, two = by[n](once).collect(), by[n](twice).collect()
        drop = {"rk"}
        key = lambda r: str({k: v for k, v in r.asDict().items() if k not in drop})
        assert sorted(map(key, two)) == sorted(map(key, one + one)), n


def test_forced_collisions(spark):
    """Names and digests that nearly all contents share tell nothing apart by themselves."""
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string, rk string, cls int").repartition(3)
    assert same(op5_exact_dedup.exact_groups(docs), op5_exact_dedup.exact_groups(docs, digest=lambda sha: F.substring(sha, 1, 1)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_join.jaccard_components(docs, class_bits=4).collect()}
    assert got == jaccard_brute(rows)


def test_row_keys(spark):
    """Ids and texts that run together in other ways have other keys."""
    rows = [("1", "2"), ("12", ""), ("", "12"), (None, "12"), ("1:", "2"), ("1", ":2"), ("1", None), ("1", "")]
    keys = [bytes(r.k) for r in spark.createDataFrame(rows, "a string, b string").select(spans.row_key("a", "b").alias("k")).collect()]
    assert all(len(k) == 16 for k in keys) and len(set(keys)) == len(rows) - 1  # null and empty texts are the same


@pytest.mark.parametrize("hot", [1, 8])
def test_hot_grams(spark, hot):
    """Strings of hot k-grams travel one by one, with the same result."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    rows = awkward() + [(1000 + i, " ".join(word() for _ in range(rnd.randint(0, 12))) + PASSAGE + " ".join(word() for _ in range(rnd.randint(0, 12))), None, 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rk string, cls int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix.suffix_dedup(docs, hot=hot).collect()}
    assert got == suffix_brute(rows)


def test_jaccard_pairs(spark):
    """All links between different sets, and every row's class."""
    rows = awkward()
    pairs, members = op2_ngram_join.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string, rk string, cls int"))
    sets = {}
    for i, text, *_ in rows:
        w = [x for x in (text or "").translate(FOLD).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    of = {r.doc_id: r.class_id for r in members.collect()}
    assert {i for i, c in of.items() if c is None} == {i for i, s in sets.items() if not s}
    different = {c: sets[i] for i, c in of.items() if c is not None}
    assert len(different) == len({s for s in sets.values() if s})
    ids = sorted(different)
    want = {(a, b) for a in ids for b in ids if a < b and 100 * len(different[a] & different[b]) >= 75 * len(different[a] | different[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_reduction_places_pieces():
    """On the lengths of a real table the dealt reduction fixes pieces of many sizes before best fit sees them."""
    import pyarrow.parquet as pq

    encoder = tokens.ByteLevelEncoder(BYTES)
    sizes = []
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(encoder.encode(text or "")) // 4 + 1
        sizes += [1024] * (n // 1024) + ([n % 1024] if n % 1024 else [])
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(sizes, return_counts=True)), strict=True))
    fixed = []
    plan = op1_packing.plan_packing(counts, 1024, fixed)
    short = sum(n for s, n in fixed if s < 1024)
    assert short >= 2 * 221  # the pairs that fill a sequence exactly, at least
    bins = {first + r // per for _, _, n, first, _, per in plan for r in range(n)}
    assert len(bins) <= 964 and sum(n for _, _, n, *_ in plan) == len(sizes)


def test_license_against_aligner(spark):
    """labels and score of every awkward row, by trying all places of all templates."""
    rnd = random.Random(2)
    pool = [w for _, text, _ in op7_license.TEMPLATES for w in text.split()]
    rows = [(i, t) for i, t, *_ in awkward()] + texts()[:9]
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            w = rnd.choice(op7_license.TEMPLATES)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(pool)
            parts += [rnd.choice(pool) for _ in range(rnd.randint(0, 5))] + w
        rows.append((5000 + i, " ".join(parts)))
    found = op7_license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "PythonUDF" not in op7_license.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().toString()
    import re

    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add((r.labels, round(r.score, 9)))
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        labels, best = set(), 0.0
        for phrase, label in op7_license.BASE.items():
            p = phrase.split()
            if any(w[k : k + len(p)] == p for k in range(len(w))):
                labels.add(label)
                best = max(best, 0.5)
        for label, body, key in op7_license.TEMPLATES:
            body, key = body.split(), key.split()
            at = next(k for k in range(len(body)) if body[k : k + len(key)] == key)
            for o in range(-len(body), len(w)):
                share = sum(0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(body)) / len(body)
                if share >= 0.5 and o + at >= 0 and w[o + at : o + at + len(key)] == key:
                    labels.add(label)
                    best = max(best, share)
        assert (",".join(sorted(labels)), round(best, 9)) in got[i], (i, text)


def test_embedding_components_whole(spark):
    """Components and link counts of close families with copies, by all pairs."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(8):
        base = rng.standard_normal(24)
        family = [(base + rng.standard_normal(24) * 0.02).tolist() for _ in range(int(rng.integers(1, 9)))]
        rows += [(0, v, int(c % 2)) for v in family for _ in range(int(rng.integers(1, 4)))]
    rows = [(100 - k, v, label) for k, (_, v, label) in enumerate(rows)]
    x = np.asarray([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.asarray([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    ids = np.asarray([r[0] for r in rows])
    root = ids.copy()
    for _ in rows:
        root = np.minimum(root, np.where(link, root[None], 10**9).min(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op6_embedding.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(1), root, strict=True)}


def slow_chunks(b: bytes, rate: int, least: int, most: int) -> list[int]:
    """Chunk ends one byte at a time, from the rule alone."""
    ends, start, h = [], 0, 0
    for k, x in enumerate(b):
        h = ((h << 1) + int(op4_bpe._GEAR[x])) & 0xFFFFFFFF
        if k + 1 - start > most:
            start += most
            ends.append(start)
        if k + 1 >= op9_cdc.WINDOW and h < 2**32 // rate and k + 1 - start >= least:
            start = k + 1
            ends.append(start)
    return ends if not b or start == len(b) else [*ends, len(b)]


def test_chunk_ends():
    rnd = random.Random(6)
    for _ in range(60):
        parts = [rnd.randbytes(rnd.choice([0, 5, 40, 700, 3000])) for _ in range(3)]
        data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        for rate, least, most in ((24, 32, 1024), (8, 40, 100)):
            got = op9_cdc.chunk_ends(data, offsets, rate, least, most)
            assert got == [slow_chunks(p, rate, least, most) for p in parts]


def test_chunk_runs(spark):
    """Repeated chunks go where their run is long enough; a phrase stays."""
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("klmnopqrst ") for _ in range(n))
    passage = noise(1200)
    rows = [(1, noise(300) + passage), (2, noise(400) + passage + noise(100)), (3, noise(200) + passage[600:720] + noise(200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op9_cdc.cdc_dedup(df, least_run=160).collect()}
    free = {r.doc_id: r for r in op9_cdc.cdc_dedup(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 900 and got[3].n_removed == 0 <= free[3].n_removed
    assert all(free[i].n_removed >= got[i].n_removed for i in got)


def test_other_tokenizers_are_refused(tmp_path):
    import json

    for encoder, path in ((tokens.WordEncoder, WORDS), (tokens.ByteLevelEncoder, BYTES)):
        settings = json.load(open(path, encoding="utf-8"))
        settings["pre_tokenizer"] = {"type": "Whitespace"}
        other = tmp_path / f"{encoder.__name__}.json"
        other.write_text(json.dumps(settings))
        encoder(path)
        with pytest.raises(ValueError, match="another way"):
            encoder(str(other))


class _Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode(self, text, **options):
        self.texts += 1
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def test_new_words_need_only_the_merges():
    """A new plain word costs a run of the model, not one of the whole tokenizer."""
    encoder, t = tokens.WordEncoder(WORDS), tokens.load(WORDS)
    encoder.cache.tokenizer = count = _Counting(t)
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("abcdEFG'.,;-stre019äÉßñЖщœ_|", k=rnd.randint(1, 12))) for _ in range(2000))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert count.texts == 0


def test_words_as_the_tokenizer_cuts_them():
    encoder, t = tokens.WordEncoder(WORDS), tokens.load(WORDS)
    rnd = random.Random(4)
    marks = "\0\x0b\x1c\x7f\x85\xa0ªµ²¼×÷İıŉſǅΣςϐйи\u0301\u0306\u0344\u2000\u2019\u2028\u212aﬁ漢\U0001f600\U0001d400٣Ⅷ각"
    texts = [f"{c} a{c} {c}B9{c}'s" for c in map(chr, [*range(1, 0x530), *range(0x2010, 0x2030)])]
    texts += ["".join(rnd.choices("aZé'stREvelLmd9.« \n" + marks, k=rnd.randint(1, 40))) for _ in range(3000)]
    texts += [f"x {s} {s}y'{s}'s {s.upper()} {s[:-1]} {s}{s}" for s in ("<|startoftext|>", "<|endoftext|>")] + ["w" * 5000, "'" * 300, "'ſ 'S 'RE's"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_byte_level_settings(tmp_path):
    """Under settings that the cutting of words does not stand for, the whole tokenizer encodes them."""
    import json

    settings = json.load(open(WORDS, encoding="utf-8"))
    settings["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    other = tmp_path / "prefix.json"
    other.write_text(json.dumps(settings))
    text = "Some words, and 12 more of them's"
    got = np.frombuffer(tokens.WordEncoder(str(other)).encode(text), "<u4").tolist()
    assert got == tokens.load(str(other)).encode(text, add_special_tokens=False).ids != tokens.load(WORDS).encode(text, add_special_tokens=False).ids


def test_joins_agree():
    """Windows that disagree grow, and in the end the text is encoded at once."""
    encoder = op4_bpe.ChunkEncoder(WORDS, mean=16)
    text = "several words stand here, and some more of them behind; the end. " * 5
    raw = text.encode()
    cuts = np.arange(7, len(raw), 13)
    want = tokens.load(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(raw, cuts), "<u4").tolist() == want and encoder.agreed[1] > 10
    for found in encoder.known.values():  # ids that no window can agree with
        if found is not None and found.last[1]:
            found.last = (found.last[0], [b"\0\0\0\0"] * len(found.last[1]))
    assert np.frombuffer(encoder.encode(raw, cuts), "<u4").tolist() == want


def test_shared_folder_is_needed():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("local[4]")).startswith("file:///")
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(session("spark://host:7077"))


def test_cycle_ends_early(spark, monkeypatch):
    """A reply cycle costs as many rounds as its tree is deep, not a fixed number."""
    made = []
    real = op10_chat.table
    monkeypatch.setattr(op10_chat, "table", lambda df, tag: made.append(tag) or real(df, tag))
    m = [(1, k, (k % 6) + 1, "user", "x", 1.0) for k in range(1, 7)] + [(2, 1, None, "user", "y", 1.0)]
    got = op10_chat.format_trees(spark.createDataFrame(m, "tree long, msg long, parent long, role string, text string, score double")).collect()
    assert [(r.tree, r.leaf) for r in got] == [(2, 1)] and len(made) < 12


def test_held_out_rule(spark):
    got = spark.range(50).select(F.col("id"), op3_quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
