"""A repository on disk: backup, restore, delete, prune, encrypt, resume."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from snapstrata.functions import codec, scalars
from snapstrata.operators import chunking, select
from snapstrata.repo import Catalog, ConflictError, EngineConfig, NotFoundError, Repository, Storage, progress
from snapstrata.sources.tree import list_files, list_storage, read_tree, register

AUTHOR = EngineConfig("Ada Lovelace <ada@mail.org>")
C = 64


def make(root, files):
    for name, (body, mode) in files.items():
        full = os.path.join(root, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(body)
        os.chmod(full, mode)


def snapshot(root):
    return {os.path.relpath(p, root): (open(p, "rb").read(), os.stat(p).st_mode & 0o777) for p in list_files(str(root))}


FILES = {"empty": (b"", 0o644), "one": (b"a" * (C - 1), 0o600), "full": (b"b" * C, 0o755), "more": (b"b" * (C + 1), 0o644), "same": (b"c" * 3 * C, 0o644), ".hidden": (b"h", 0o644), "_x": (b"x", 0o644), "a": (b"file", 0o644), "ab/z": ("é".encode() * C, 0o644)}


def test_round_trip(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    make(src, FILES)
    repo = Repository(spark, str(tmp_path / "store"), "k", AUTHOR)
    total = sum(len(b) for b, _ in FILES.values())
    a = repo.backup(f"{src}/", "first", timestamp=1, chunk_size=C)
    assert a["files_total"] == len(FILES) and a["written_bytes"] + a["deduplicated_bytes"] == total
    b = repo.backup(f"{src}/", "second", timestamp=2, chunk_size=C)
    assert b["written_bytes"] == 0 and b["deduplicated_bytes"] == total
    assert [r.message for r in repo.log().collect()] == ["second", "first"]
    r = repo.restore("", str(out))
    assert r["restored"] == len(FILES) and snapshot(out) == {k: v for k, v in FILES.items()}
    make(out, {"extra/deep/x": (b"1", 0o644), "one": (b"changed", 0o600)})
    r = repo.restore(a["backup"], str(out), prune_local=True)
    assert (r["restored"], r["skipped"], r["deleted_local"]) == (1, len(FILES) - 1, 1)
    assert snapshot(out) == FILES and not (out / "extra").exists()
    part = tmp_path / "part"
    assert repo.restore(a["backup"], str(part), only=["./ab/", "one"])["restored"] == 2
    with pytest.raises(ValueError):
        repo.restore(a["backup"], str(part), only=["a"], prune_local=True)
    with pytest.raises(ValueError):
        repo.restore(a["backup"], str(part), only=["nothing/here"])
    with pytest.raises(NotFoundError):
        repo.restore("zz", str(part))
    with pytest.raises(NotFoundError):
        repo.tree("0123456789")
    assert repo.delete(a["backup"])["deleted_chunks"] == 0
    assert repo.delete(b["backup_short"])["deleted_chunks"] > 0
    assert repo._table("chunk_index").count() == 0 and repo._chunks().count() == 0
    assert repo.prune(yes=True)["deleted_items"] == 0


def test_encrypt_and_prune(spark, tmp_path):
    src = tmp_path / "src"
    make(src, FILES)
    plain = Repository(spark, str(tmp_path / "store"), "k", AUTHOR)
    a = plain.backup(f"{src}/", "m", timestamp=1, chunk_size=C)
    n = plain._chunks().count()
    # two index tables, the chunks and one list of files
    assert plain.encrypt("pw") == {"encrypted": n + 3, "already_encrypted": 0}
    assert plain.encrypt("pw") == {"encrypted": 0, "already_encrypted": n + 3}
    assert plain._chunks().where(codec.is_encrypted(F.col("payload"))).count() == n
    assert plain.contents(a["backup"]).count() == len(FILES)
    with pytest.raises(PermissionError):
        Repository(spark, str(tmp_path / "store"), "k", AUTHOR).contents(a["backup"])
    with pytest.raises(Exception, match="wrong password"):
        Repository(spark, str(tmp_path / "store"), "k", AUTHOR, "no").contents(a["backup"]).collect()
    # chunks that no index names and a pending log
    stray = spark.createDataFrame([("ff" * 32, bytearray(b"x"), "ff")], "chunk_hash string, payload binary, prefix string")
    stray.write.mode("append").partitionBy("prefix").parquet(f"{plain.base}/chunks")
    log = spark.createDataFrame([("p" * 64, "m", 3, C, [], 0, [])], "hash string, message string, compress int, chunk_size bigint, ignore_patterns array<string>, concurrency int, processed_chunks array<string>")
    plain._commit(plain.version(), pending=log)
    assert plain.pending().count() == 1
    assert plain.prune() == {"deleted_items": 0, "aborted": True}
    assert plain.prune(yes=True)["deleted_items"] == 2
    assert plain.pending().count() == 0 and plain._chunks().count() == n


def test_resume_and_conflict(spark, tmp_path):
    src = tmp_path / "src"
    make(src, FILES)
    repo = Repository(spark, str(tmp_path / "store"), "k", AUTHOR)
    log = spark.createDataFrame([("a" * 64, "broken off", 3, C, [], 0, [])], "hash string, message string, compress int, chunk_size bigint, ignore_patterns array<string>, concurrency int, processed_chunks array<string>")
    repo._commit(0, pending=log)
    done = repo.backup(f"{src}/", "", timestamp=3, resume="a")
    assert done["message"] == "broken off" and repo.pending().count() == 0
    with pytest.raises(NotFoundError):
        repo.backup(f"{src}/", "", resume="a")
    with pytest.raises(ConflictError):
        repo._commit(0, pending=log)
    with pytest.raises(ValueError):
        Repository(spark, str(tmp_path), "k").backup(f"{src}/", "m")


def test_two_writers(spark, tmp_path):
    """B looks at the newest version, A commits the next one, B fails to: A's tables stay."""
    a, b = (Repository(spark, str(tmp_path / "store"), "k", AUTHOR) for _ in "ab")
    row = lambda h: spark.createDataFrame([(1, h, "m", 1, 1)], "ord bigint, hash string, message string, timestamp bigint, size bigint")
    base = b.version()
    assert a._commit(base, summaries=row("a")) == 1
    with pytest.raises(ConflictError):
        b._commit(base, summaries=row("b"))
    assert [r.hash for r in b._table("summaries").collect()] == ["a"]
    # a change is made again on what the other wrote
    slow = []

    def change(s):
        now = b.table("summaries", s)
        if not slow:
            slow.append(a._commit(a.version(), summaries=a._table("summaries").unionByName(row("c"))))
        return {"summaries": now.unionByName(row("d"))}

    b.update(change)
    assert sorted(r.hash for r in a._table("summaries").collect()) == ["a", "c", "d"]


class Stop(Exception):
    pass


def stopping(repo, monkeypatch, at):
    """Every write, marker and deletion of a repository counts as a step; the at-th raises."""
    steps = [0]

    def step(f):
        def run(*args, **kwargs):
            steps[0] += 1
            if steps[0] == at:
                raise Stop
            return f(*args, **kwargs)

        return run

    for name in ("write", "_create", "_delete", "new_pack"):
        monkeypatch.setattr(repo, name, step(getattr(repo, name)))
    return steps


def test_crashes(spark, tmp_path, monkeypatch):
    """Wherever delete, prune or encrypt stops, every committed backup can be read, and a later prune leaves no garbage."""
    import shutil

    rows = lambda **files: spark.createDataFrame([(k, bytearray(v), 0o644) for k, v in files.items()], "path string, content binary, permissions int")
    store = tmp_path / "store"
    repo = Repository(spark, str(store), "k", AUTHOR)
    one = repo.backup(rows(x=b"a" * 150 + b"b" * 50, y=b"c" * 90), "one", timestamp=1, chunk_size=C)["backup"]
    two = repo.backup(rows(x=b"a" * 150, z=b"d" * 90), "two", timestamp=2, chunk_size=C)["backup"]
    shutil.copytree(store, tmp_path / "kept")
    want = {r.path: bytes(r.content) for r in repo.contents(two).collect()}
    for what in (lambda r: r.delete(one), lambda r: r.encrypt("pw")):
        at, stopped = 1, True
        while stopped:
            shutil.rmtree(store)
            shutil.copytree(tmp_path / "kept", store)
            broken = Repository(spark, str(store), "k", AUTHOR)
            with monkeypatch.context() as m:
                stopping(broken, m, at)
                try:
                    what(broken)
                    stopped = False
                except Stop:
                    pass
            again = Repository(spark, str(store), "k", AUTHOR, "pw")
            assert {r.path: bytes(r.content) for r in again.contents(two).collect()} == want
            at += 1
        assert at > 4
    # prune of a store that a stopped deletion left behind
    shutil.rmtree(store)
    shutil.copytree(tmp_path / "kept", store)
    repo = Repository(spark, str(store), "k", AUTHOR)
    with monkeypatch.context() as m:
        m.setattr(repo, "_sweep", lambda files: (_ for _ in ()).throw(Stop))
        with pytest.raises(Stop):
            repo.delete(one)
    repo = Repository(spark, str(store), "k", AUTHOR)
    assert repo.prune(yes=True)["deleted_items"] > 0 and repo.prune(yes=True)["deleted_items"] == 0
    assert {r.path: bytes(r.content) for r in repo.contents(two).collect()} == want
    assert repo._chunks().count() == repo._table("chunk_index").count()


def test_changing_file(spark, tmp_path, monkeypatch):
    """A file that changes between the passes is read again; what is committed can be restored."""
    src, out = tmp_path / "src", tmp_path / "out"
    make(src, {"log": (b"1" * 200, 0o644), "still": (b"2" * 200, 0o644)})
    repo = Repository(spark, str(tmp_path / "store"), "k", AUTHOR)
    pack = repo.new_pack

    def grow(sealed):
        if not (src / "grown").exists():
            make(src, {"log": (b"3" * 300, 0o644)})
            (src / "grown").touch()
        return pack(sealed)

    monkeypatch.setattr(repo, "new_pack", grow)
    done = repo.backup(f"{src}/", "m", timestamp=1, chunk_size=C)
    repo.restore(done["backup"], str(out))
    assert snapshot(out) == {"log": (b"3" * 300, 0o644), "still": (b"2" * 200, 0o644)} and len(repo.warnings) == 1


def test_encrypted_metadata(spark, tmp_path):
    src = tmp_path / "src"
    make(src, FILES)
    store = str(tmp_path / "store")
    done = Repository(spark, store, "k", AUTHOR, "pw").backup(f"{src}/", "secret message", timestamp=1, chunk_size=C)["backup"]
    right, wrong, none = (Repository(spark, store, "k", AUTHOR, p) for p in ("pw", "no", None))
    assert [r.message for r in right.log().collect()] == ["secret message"] and right.tree(done).count() == len(FILES) and right.pending().count() == 0
    for calls in ("log", "pending"), ("tree", "contents", "delete"):
        for name in calls:
            args = () if calls[0] == "log" else (done,)
            for repo, text in ((wrong, "wrong password"), (none, "password is needed")):
                with pytest.raises(PermissionError, match=text):
                    getattr(repo, name)(*args)
    for repo in (wrong, none):
        with pytest.raises(PermissionError):
            repo.backup(f"{src}/", "m", timestamp=2)
        with pytest.raises(PermissionError):
            repo.restore(done, str(tmp_path / "out"))
    text = b"".join(open(p, "rb").read() for p in list_files(store))
    assert b"secret message" not in text and b"ab/z" not in text
    assert right.backup(f"{src}/", "again", timestamp=2, chunk_size=C)["written_bytes"] == 0


def test_progress_and_resume(spark, tmp_path, monkeypatch):
    """A run that is stopped after some steps shows what it uploaded; values given on resuming go before the log's."""
    rnd = random.Random(1)
    src, out = tmp_path / "src", tmp_path / "out"
    make(src, {f"f{k}": (rnd.randbytes(3 * C), 0o644) for k in range(20)})
    lines = []
    repo = Repository(spark, str(tmp_path / "store"), "k", AUTHOR, on_event=lines.append)
    with monkeypatch.context() as m:
        made, pack = [], repo.new_pack

        def some(sealed):
            made.append(1)
            if len(made) == 4:
                raise Stop
            return pack(sealed)

        m.setattr(repo, "new_pack", some)
        with pytest.raises(Stop):
            repo.backup(f"{src}/", "long", timestamp=1, chunk_size=C, compress=5, ignore=["none"], checkpoint_bytes=10 * C)
    left = repo.pending().collect()
    assert len(left) == 1 and 0 < left[0].uploaded_chunks < 60 and (left[0].compress, left[0].chunk_size_bytes, left[0].ignored_entries) == (5, C, 1)
    before = repo._chunks().count()
    done = repo.backup(f"{src}/", timestamp=2, resume="", compress=7, chunk_size=C)
    assert done["message"] == "long" and done["written_bytes"] == 60 * C and repo._chunks().count() == 60 > before >= left[0].uploaded_chunks
    assert repo.warnings == [f"reusing from {left[0].backup[:8]}: uploaded chunks, message, ignore_patterns"]
    assert any('"type": "progress"' in x for x in lines) and any('"type": "warning"' in x for x in lines)
    repo.restore(done["backup"], str(out))
    assert snapshot(out) == snapshot(src) and repo.pending().count() == 0
    with pytest.raises(ValueError):
        repo.backup(f"{src}/", timestamp=3)


def test_unsafe_paths(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "store"), "k", AUTHOR)
    for path in ("../evil", "/etc/x", "a/../../x", "a//b", "", "."):
        rows = spark.createDataFrame([(path, bytearray(b"x"), 0o644)], "path string, content binary, permissions int")
        with pytest.raises(Exception, match="unsafe path"):
            repo.backup(rows, "m", timestamp=1)
    twice = spark.createDataFrame([("a", bytearray(b"x"), 0o644)] * 2, "path string, content binary, permissions int")
    with pytest.raises(ValueError, match="twice"):
        repo.backup(twice, "m", timestamp=1)
    # a list of files that somebody else made
    done = repo.backup(twice.limit(1), "m", timestamp=1)["backup"]
    row = repo._table("backups").where(F.col("hash") == done).first()
    evil = repo.tree(done).drop("backup_hash").withColumn("path", F.lit("../evil"))
    evil.write.parquet(f"{repo.base}/objects/evil")
    repo._commit(repo.version(), backups=spark.createDataFrame([row.asDict() | {"objects": "objects/evil"}], repo._table("backups").schema))
    with pytest.raises(ValueError, match="unsafe path"):
        repo.restore(done, str(tmp_path / "out" / "in"))
    assert not (tmp_path / "out" / "evil").exists()


def test_reads_in_proportion(spark, tmp_path):
    """One file's restore opens the chunk files that hold its chunks, and no others."""
    repo = Repository(spark, str(tmp_path / "store"), "k", AUTHOR)
    rnd, ids = random.Random(3), []
    for k in range(3):
        rows = [(f"b{k}/{i}", bytearray(rnd.randbytes(200)), 0o644) for i in range(8)]
        ids.append(repo.backup(spark.createDataFrame(rows, "path string, content binary, permissions int"), "m", timestamp=k, chunk_size=C)["backup"])
    state = repo.state()
    _, _, files = repo._wanted(ids[0], ["b0/3"], state)
    read = repo._payloads_of(repo._named(files, state), state)
    opened = {p for p in read.inputFiles() if "/chunks/" in p}
    assert 0 < len(opened) <= 4 and len(opened) < len(repo.physical().inputFiles())
    assert {os.path.basename(os.path.dirname(p)) for p in opened} <= {r.file.split("/")[0] for r in repo._named(repo.tree(ids[0]), state).collect()}


def test_large_file(spark, tmp_path):
    """A file that no cell could hold, backed up and restored by chunks."""
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    n = (2 << 30) + 12_345
    with open(src / "large", "wb") as f:
        f.truncate(n)
        f.seek(n - 5)
        f.write(b"tail!")
    repo = Repository(spark, str(tmp_path / "store"), "k", AUTHOR)
    done = repo.backup(f"{src}/", "large", timestamp=1, chunk_size="16 MB")
    assert done["files_total"] == 1 and done["written_bytes"] + done["deduplicated_bytes"] == n and done["written_bytes"] < 40_000_000
    repo.restore(done["backup"], str(out))
    assert os.path.getsize(out / "large") == n and os.listdir(out) == ["large"]
    with open(out / "large", "rb") as f:
        f.seek(n - 6)
        assert f.read() == b"\0tail!"


def test_settings_stay(tmp_path):
    cat = Catalog(str(tmp_path / "storages"))
    cat.add(Storage("disk", "local", "/x", access_key="k", secret_key="s"))
    cat.add(Storage("far", "s3", "bucket/x", "r", "http://e"))
    again = Catalog(str(tmp_path / "storages"))
    assert again.list() == cat.list() and again.get("disk").secret_key == "s" and os.stat(tmp_path / "storages" / "disk.json").st_mode & 0o777 == 0o600
    again.remove("disk")
    assert [s["name"] for s in Catalog(str(tmp_path / "storages")).list()] == ["far"]
    with pytest.raises(NotFoundError):
        EngineConfig.load(str(tmp_path / "own"))
    AUTHOR.save(str(tmp_path / "own"))
    assert EngineConfig.load(str(tmp_path / "own")).whoami() == AUTHOR.whoami()


def test_tree_sources(spark, tmp_path):
    make(tmp_path / "t", FILES | {"skip/me": (b"1", 0o644), "ab/skip": (b"1", 0o644)})
    os.symlink(tmp_path / "t" / "one", tmp_path / "t" / "link")
    got = {r.path: bytes(r.content) for r in read_tree(spark, f"{tmp_path}/t/", ["skip"]).collect()}
    assert got == {k: v[0] for k, v in FILES.items()} | {"link": FILES["one"][0]}
    assert "link" not in list_storage(str(tmp_path / "t")) and list_storage(str(tmp_path / "none")) == []
    register(spark)
    assert spark.read.format("filetree").option("ignore", "skip").load(f"{tmp_path}/t/").count() == len(FILES) + 1


def test_chunks_against_model(spark):
    rnd = random.Random(5)
    files = [(f"f{i}", bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 1, 6, 7, 8, 21, 50])))) for i in range(60)]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")
    got = sorted((r.path, r.seq, r.chunk_hash, r.n) for r in chunking.chunk(df, 7).collect())
    want = sorted((p, i // 7, hashlib.sha256(b[i : i + 7]).hexdigest(), len(b[i : i + 7])) for p, b in files for i in range(0, len(b), 7))
    assert got == want
    objects = {r.path: r.chunks for r in chunking.objects(df.withColumn("permissions", F.lit(0o100644)), 7).collect()}
    assert objects == {p: [hashlib.sha256(b[i : i + 7]).hexdigest() for i in range(0, len(b), 7)] for p, b in files}


def test_selection_rules(spark):
    paths = spark.createDataFrame([(p,) for p in ("a", "a/x", "ab/y", "c/d/e", "c/d/f")], "path string")
    pick = lambda *w: [r.path for r in select.only_select(paths, list(w)).collect()]
    assert pick("a") == ["a"]  # the file of that name hides what is below it
    assert pick("c/", "./ab") == ["ab/y", "c/d/e", "c/d/f"]
    for bad in (["zz"], [" "], []):
        with pytest.raises(ValueError):
            select.only_select(paths, bad)
    assert select.path_search(paths, "").count() == 5


def test_small_things(spark):
    assert scalars.parse_size("5 MB") == 5_000_000 and scalars.parse_size("64KiB") == 65536
    with pytest.raises(ValueError):
        scalars.parse_size("many")
    one = spark.range(1)
    x = one.select(scalars.rfc3339(F.lit(0)).alias("t"), scalars.human_size(F.lit(1_500_000)).alias("h"), scalars.local_time(F.lit(0), "Asia/Tokyo").alias("l"), scalars.relative_path(F.lit("/r/a\\b"), "/r").alias("r"), scalars.percent(F.lit(1), F.lit(0)).alias("p"), codec.is_encrypted(F.lit(b"abc")).alias("e")).first()
    assert (x.t, x.h, x.l, x.r, x.p, x.e) == ("1970-01-01T00:00:00Z", "1.50 MB", "1970-01-01 09:00:00", "a/b", 0, False)
    cat = Catalog()
    cat.add(Storage("disk-1", "local", "/x", access_key="k", secret_key="s"))
    assert "secret_key" not in cat.list()[0] and cat.remove("disk-1") == {"name": "disk-1", "removed": True}
    with pytest.raises(ValueError):
        cat.add(Storage("a b", "local", "/x"))
    with pytest.raises(NotFoundError):
        cat.get("none")
    with pytest.raises(ValueError):
        EngineConfig("Ada")
    big = spark.range(1).select((F.lit(9 * 10**16) - 1).alias("done"), F.lit(9 * 10**16).alias("all")).select(scalars.percent(F.col("done"), F.col("all")).alias("p"), scalars.page_count(F.col("all") + 1).alias("n")).first()
    assert (big.p, big.n) == (99, 9 * 10**15 + 1)
    assert '"percent": 0' in progress(0, 0) and '"percent": 33' in progress(1, 3)


def test_modes_and_progress(spark):
    rows = spark.createDataFrame([("a/b.EXE", True), ("a.b/c", True), ("x.txt", False), ("run.ps1", False), (".exe", False)], "p string, ro boolean")
    assert [r[0] for r in rows.select(scalars.fallback_mode(F.col("p"), F.col("ro"))).collect()] == [0o555, 0o444, 0o644, 0o755, 0o644]
    from types import SimpleNamespace

    from snapstrata.streaming.stream import ProgressListener

    seen = []
    listener = ProgressListener(4, seen.append)
    listener.onQueryStarted(None)
    listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=3)))
    assert [x["percent"] for x in seen] == [0, 75]


def test_stream_goes_on(spark, tmp_path):
    """A second run on one folder sees only new files, and counts go on."""
    from snapstrata.streaming import stream

    src = str(tmp_path / "in")
    for k, props in enumerate((["a", "b", "a"], ["a", "c"])):
        spark.createDataFrame([(p,) for p in props], "props string").coalesce(1).write.mode("append").parquet(src)
        chunks = stream.as_chunks(stream.read_stream(spark, src, 1), "props")
        counts = sorted(r.refcount for r in stream.run_refcount(spark, chunks, str(tmp_path / "rc")).collect())
        seen = stream.run_first_seen(spark, chunks, str(tmp_path / "fs")).count()
        assert (counts, seen) == (([1, 2], 2) if not k else ([1, 1, 3], 3))
