"""Quality, embeddings, chat formatting, components and the pipeline."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from snapstrata.llm import common, op3_quality, op6_embedding, op10_chat, queries  # noqa: E402
from snapstrata.llm.common import components, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_oracles(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLES.items():
        ours, theirs = queries.QUERIES[name](spark, SF), con.sql(sql)
        cols = sorted(theirs.columns)
        assert sorted(ours.columns) == cols, name
        assert sorted(map(str, map(tuple, ours.select(cols).collect()))) == sorted(map(str, theirs.project(", ".join(cols)).fetchall())), name


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    ids = sorted({x for e in edges for x in e} | {9999})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in ids}
    none = components(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "a long, b long"))
    assert [tuple(r) for r in none.collect()] == [(1, 1)]


def test_forward_backward():
    rng = np.random.default_rng(2)
    counts = np.asarray([3, 1, 4, 2])
    unary, trans = rng.standard_normal(counts.sum()), rng.standard_normal((2, 2))
    p, pairs, z = op3_quality.forward_backward(unary, counts, trans)
    at, want_p, want_pairs, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in counts:
        weights = {}
        for y in np.ndindex(*[2] * int(n)):
            s = sum(unary[at + k] for k in range(n) if y[k]) + sum(trans[y[k], y[k + 1]] for k in range(n - 1))
            weights[y] = np.exp(s)
        total = sum(weights.values())
        want_z += np.log(total)
        want_p += [sum(w for y, w in weights.items() if y[k]) / total for k in range(n)]
        for y, w in weights.items():
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += w / total
        at += n
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and np.isclose(z, want_z)


@pytest.mark.parametrize("steps", [1, 2, 3, 7])
def test_long_chains_in_blocks(steps, monkeypatch):
    """Texts cut into blocks give what whole ones do."""
    rng = np.random.default_rng(steps)
    for _ in range(10):
        counts = rng.integers(1, 60, rng.integers(1, 9))
        unary, trans = rng.standard_normal(counts.sum()) * 3, rng.standard_normal((2, 2))
        whole = op3_quality.forward_backward(unary, counts, trans)
        with monkeypatch.context() as m:
            m.setattr(op3_quality, "STEPS", steps)
            cut = op3_quality.forward_backward(unary, counts, trans)
        assert all(np.allclose(x, y, rtol=1e-9, atol=1e-9) for x, y in zip(whole, cut, strict=True))


def test_features_in_blocks(monkeypatch):
    """Blocks of lines change no score, and a million lines are no trouble."""
    texts = ["", "\n", "a plain line.\n### 00\n\n", "no end", "\n\n", "é x x\n" * 40, ""]
    data, offsets = common.flat(pa.array(texts))
    starts, ends, counts = op3_quality.text_lines(data, offsets)
    assert counts.tolist() == [t.count("\n") + 1 for t in texts] and (ends[:-1] == starts[1:]).all()
    rng = np.random.default_rng(4)
    model = op3_quality.LineCRF(rng.standard_normal(46), rng.standard_normal((2, 2)), rng.standard_normal(45), np.ones(45))
    whole = model.score(data, offsets)
    monkeypatch.setattr(op3_quality, "BLOCK_COST", 70)
    assert len(op3_quality.line_blocks(starts, ends)) > 20 and np.allclose(model.score(data, offsets), whole)
    monkeypatch.undo()
    for empty in (np.zeros(1, np.int64), np.zeros(3, np.int64)):
        assert len(model.score(np.zeros(0, np.uint8), empty)) == len(empty) - 1
    many = model.score(np.full(1_000_000, 10, np.uint8), np.asarray([0, 1_000_000]))
    assert 0 <= many[0] <= 1


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in op3_quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    right = wrong = 0
    for r in labels.collect():
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        if x.held_out:
            right, wrong = right + (x.predicted == r.quality), wrong + (x.predicted != r.quality)
    assert right / (right + wrong) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (3, "\n\n", 1), (None, "x " * 50_000, 1), (4, "a\n" * 3000, 1)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op3_quality.quality_scores(docs, none).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = op3_quality.quality_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert op3_quality.keep_good(docs, labels).columns == docs.columns
    assert op3_quality.quality_scores(docs.limit(0), labels).count() == 0


def teaching(n):
    return [i for i in range(10 * n) if zlib.crc32(str(i).encode()) % 3 != 1][:n]


def test_quality_fits_whole_texts(spark, monkeypatch):
    """Every line of a sampled text teaches, as what tells the labels apart may stand at its end only."""
    ids = teaching(20)
    texts = ["A plain sentence.\n" * 100 + ("### $$$ 000\n" * 50 if k % 2 else "") for k in range(20)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(op3_quality.LineCRF, "fit", lambda x, counts, y: seen.append((x, counts, y)))
    op3_quality.fit_quality(docs, labels)
    x, counts, y = seen[0]
    assert sorted(zip(y.tolist(), counts.tolist(), strict=True)) == [(0, 101)] * 10 + [(1, 151)] * 10 and len(x) == 10 * 101 + 10 * 151
    assert (x[:, 6] > 0).sum() == 10 * 50  # the lines of marks


def test_quality_repeated_ids(spark):
    """Each sampled id teaches once, with the least of its texts, however many rows it has and in whatever order."""
    ids = teaching(30)
    rows = [(i, ("Good words stand here, in order.\n" if k % 2 else "@@@ 11 || !! x\n") * (1 + k % 3)) for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    hot = [(ids[1], rows[1][1])] * 9000 + [(ids[1], "~ another text")]
    once = op3_quality.fit_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = op3_quality.fit_quality(spark.createDataFrame(hot + rows, "doc_id long, text string").repartition(5), labels)
    assert np.allclose(once.weights, many.weights) and np.allclose(once.trans, many.trans) and np.allclose(once.mean, many.mean)


def embedding_brute(rows, least=0.93):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, float)
        if len(x) and np.isfinite(x).all() and x.any():
            good.append((i, x / np.sqrt(x @ x), label))
    links = {i: set() for i in range(len(rows))}
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y >= least:
                links[i].add(j)
    return links


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        base = rng.standard_normal(16)
        for _ in range(int(rng.choice([1, 2, 5, 60]))):
            rows.append((len(rows), (base + rng.standard_normal(16) * 0.05).astype("float32").tolist(), int(c % 3)))
    rows += [(len(rows) + k, v, label) for k, (v, label) in enumerate([(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), (rows[0][1], None), ([], 1), ([1.0, 0.0], 1), ([1.0, 0.0], 1)])]
    rows.append(rows[0])  # a repeated row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    want, got = embedding_brute(rows), op6_embedding.embedding_components(df, block=16).collect()
    assert len(got) == len(rows)
    truth = {}
    for i, r in enumerate(rows):
        truth.setdefault(r[0], []).append(len(want[i]))
    found = total = 0
    for r in got:
        assert r.n_links <= max(truth[r.vec_id])
        found, total = found + r.n_links, total + max(truth[r.vec_id])
        assert r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id
    assert found >= 0.97 * total
    assert op6_embedding.embedding_components(df.limit(0)).count() == 0


def test_embedding_recall(spark):
    """Pairs right at the threshold."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        x, y = rng.standard_normal(64), rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = rng.uniform(0.931, 0.97)
        rows += [(len(rows), x.tolist(), 1), (len(rows) + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 1)]
    got = op6_embedding.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.n_links for r in got) >= 0.95 * len(rows)


def test_escape():
    rnd = random.Random(4)
    bits = ["<", "|", "\\", "/", "s", ">", "[", "INST", "]", "</s>", "<|end|>\n", "<|turn|>", "<<SYS>>", "[/INST]", "\n", "é"]
    for _ in range(3000):
        turns = [("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) if rnd.random() < 0.3 else rnd.choice(["user", "assistant"]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for _ in range(rnd.randint(0, 4))]
        text, starts, ends = op10_chat.format_turns(turns)
        assert op10_chat.parse(text) == turns
        assert [op10_chat.unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)] == [t for r, t in turns if r == "assistant"]
        assert not any(x in text for x in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_trees(spark):
    #   1 - 2 - 4 - 5        6 and 7 answer one another; 8's parent is missing
    #     \ 3
    m = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", None, 1.0), (1, 5, 4, None, "d", 1.0), (1, 6, 7, "x", "x", 1.0), (1, 7, 6, "x", "x", 1.0), (2, 8, 99, "user", "lone", None)]
    df = spark.createDataFrame(m, "tree long, msg long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in op10_chat.format_trees(df).collect()}
    assert set(got) == {(1, 5), (1, 3), (2, 8)}
    assert op10_chat.parse(got[1, 5].formatted) == [("user", "q"), ("assistant", "a"), ("user", ""), ("", "d")]
    assert (got[1, 3].branch_rank, got[1, 3].branch_score, got[1, 5].branch_rank) == (1, 6.0, 2)
    best = op10_chat.format_trees(df, branches=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {(1, 3), (2, 8)}
    assert op10_chat.format_trees(df.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system"]), f"t{t} </s>" if t % 3 else None) for c in range(20) for t in range(c * 3)]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op10_chat.digests(op10_chat.format_trees(op10_chat.as_messages(df))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in [*rows, rows[0]] if r[0] == c), key=lambda r: r[1])
        whole = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_null_conversation(spark):
    """Rows without conv_id are one conversation; large ids beside it stay exact."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c in (None, 2**60 + 1) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = op10_chat.digests(op10_chat.format_trees(op10_chat.as_messages(df))).collect()
    assert {r.conv_id for r in got} == {None, 2**60 + 1} and len(got) == 2
    assert len({tuple(r)[1:] for r in got}) == 1 and got[0].n_turns == 5


def test_table_is_shared(spark):
    df = table(spark.range(5), "test")
    assert df.count() == 5 and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0].replace("file:///", "file:///")


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        docs = table(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and len(now) == docs.count()
        before = now
    packed = c.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
    per = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in per) <= 1024
    # the stages against plain models of each
    from test_text_ops import jaccard_brute, suffix_brute

    rows = [(r.doc_id, r.text) for r in table(c.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "q").collect()]
    import re

    best = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    rows = [x for x in rows if x[0] in {b for _, b in best.values()}]
    comp = jaccard_brute(rows)
    rows = [x for x in rows if comp[x[0]][1] == x[0]]
    gone = {i for i, (n, removed, *_) in suffix_brute(rows).items() if n and removed == n}
    assert before == {i for i, _ in rows} - gone
