"""The query registry: each entry takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstrata.functions import codec, scalars
from snapstrata.operators import chunking, history, refs, select
from snapstrata.plans import fixtures as fx
from snapstrata.repo import EngineConfig, Repository
from snapstrata.sources import tree as tree_source
from snapstrata.streaming import stream

CHUNK = 1000
KEY = "repo"
ONLY = ["src0/de", "src1", "#7"]
IGNORE = ["de", "src3", "5.txt"]
RAW_PATHS = ["  ./a/b/ ", "././x", "/abs//path//", "a\\b\\c", ".//./y", "plain", "..//z/"]
PREFIXES = ["", "a", "0", "ff", "0123", "zz", "0123456789abcdef"]
PENDING_PREFIXES = ["", "a", "f", "00", "zz"]
PASSWORD = "correct horse"
SIZES = ["5 MB", "64 KiB", "0", "1.5k", "12b", " 2GB ", "3 tib"]
EXTENSIONS = [".exe", ".BAT", ".txt", "", ".ps1", ".exe.log", ".", ".msi"]


def backup_totals(spark: SparkSession, d: str) -> DataFrame:
    files = fx.tree(spark, d)
    return refs.backup_totals(fx.tree_paths(spark, d), chunking.chunk(files.select("content"), CHUNK))


def chunk_files(spark, d):
    return chunking.chunk(fx.tree(spark, d).select("path", "content"), CHUNK)


def chunk_refcount(spark, d):
    return refs.refcount(chunking.chunk(fx.tree(spark, d).select("content"), CHUNK))


def chunk_refs(spark, d):
    return chunking.objects(fx.tree(spark, d), CHUNK).select("path", F.posexplode("chunks").alias("seq", "chunk_hash")).select("path", F.col("seq").cast("bigint").alias("seq"), "chunk_hash")


def ref_index(spark, d):
    return refs.refcount(fx.refs(spark, d), "chunk")


def file_hashes(spark, d):
    return chunking.file_hashes(fx.tree(spark, d))


def tree_listing(spark, d):
    return fx.tree_paths(spark, d).select("path").orderBy("path")


def chunk_paths(spark, d):
    h = fx.refs(spark, d).select("chunk").distinct().select(F.sha2("chunk", 256).alias("chunk_hash"))
    return h.select("chunk_hash", scalars.chunk_path(KEY, F.col("chunk_hash")).alias("chunk_path"))


def physical_chunks(spark, d):
    """Stored chunks found by listing their paths: the hash is the last two parts of the path."""
    parts = F.split("chunk_path", "/")
    return chunk_paths(spark, d).select("chunk_path", F.concat(F.element_at(parts, -2), F.element_at(parts, -1)).alias("chunk_hash"))


def snapshot_accounting(spark, d):
    return refs.snapshot_accounting(chunking.chunk(fx.versions(spark, d).select("snap", "content"), 512))


def snapshot_tree(spark, d):
    return fx.versions(spark, d).select("snap", "path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("bigint").alias("size"))


def backup_against_index(spark, d):
    files = fx.tree(spark, d)
    stored = refs.refcount(chunking.chunk(files.where("doc_id % 2 = 0").select("content"), CHUNK))
    return refs.against_index(chunking.chunk(files.where("doc_id % 2 = 1").select("content"), CHUNK), stored)


def resume_backup(spark, d):
    files = fx.tree(spark, d)
    done = chunking.chunk(files.where("doc_id % 3 = 0").select("content"), CHUNK).select("chunk_hash")
    return refs.resume(chunking.chunk(files.select("content"), CHUNK), done.limit(0), done)


def _deleted(spark, d):
    r = fx.refs(spark, d).withColumnRenamed("chunk", "chunk_hash")
    return refs.after_delete(refs.refcount(r), r.where("backup % 4 = 0"))


def delete_orphans(spark, d):
    return refs.orphan_counts(_deleted(spark, d))


def delete_index_after(spark, d):
    return _deleted(spark, d).where("refcount > 0").select(F.col("chunk_hash").alias("chunk"), "refcount")


def delete_summary(spark, d):
    gone = fx.summaries(spark, d).agg(F.max_by("hash", "ord").alias("gone"))  # one row
    return fx.summaries(spark, d).join(gone, F.col("hash") == F.col("gone"), "left_anti").select("hash", "message", "timestamp", "size")


def prune_candidates(spark, d):
    r = fx.refs(spark, d).withColumnRenamed("chunk", "chunk_hash")
    return refs.prune_candidates(r.select("chunk_hash").distinct(), r.where("backup % 4 <> 0").select("chunk_hash"), fx.pending(spark, d))


def encrypt_worklist(spark, d):
    """Two index files, every chunk and every backup document; pending logs stay as they are."""
    fixed = spark.createDataFrame([(f"{KEY}/indexes/chunks",), (f"{KEY}/indexes/backups",)], "path string")
    return fixed.unionByName(chunk_paths(spark, d).select(F.col("chunk_path").alias("path"))).unionByName(fx.summaries(spark, d).select(F.concat(F.lit(f"{KEY}/backups/"), F.col("hash")).alias("path")))


def encrypt_status(spark, d):
    magic = F.when(F.col("doc_id") % 3 == 0, F.lit(codec.MAGIC)).otherwise(F.lit(b""))
    payloads = fx.tree(spark, d).select(F.concat(magic, F.col("content")).alias("payload"))
    already = codec.is_encrypted(F.col("payload"))
    return payloads.agg(F.count(F.when(~already, 1)).cast("bigint").alias("encrypted"), F.count(F.when(already, 1)).cast("bigint").alias("already_encrypted"))


def maybe_decrypt(spark, d):
    """How many payloads open with the password: the plain ones as they are, the others decrypted."""
    salt = b"0123456789abcdef"
    files = fx.tree(spark, d)
    sealed = F.when(F.col("doc_id") % 2 == 0, codec.encrypt(F.col("content"), PASSWORD, salt)).otherwise(F.col("content"))
    opened = files.select("doc_id", "content", sealed.alias("payload")).select("doc_id", (codec.maybe_decrypt(F.col("payload"), PASSWORD, [salt]) == F.col("content")).alias("ok"))
    return opened.groupBy((F.col("doc_id") % 2 == 0).alias("was_encrypted")).agg(F.count(F.when(F.col("ok"), 1)).cast("bigint").alias("opened"))


def only_select(spark, d):
    paths = fx.tree_paths(spark, d)
    seventh = paths.where("doc_id = 7").select("path").first()
    return select.only_select(paths.select("path"), [seventh.path if x == "#7" else x for x in ONLY])


def only_normalize(spark, d):
    raw = spark.createDataFrame([(x,) for x in RAW_PATHS], "raw string").unionByName(fx.tree_paths(spark, d).select(F.concat(F.lit("./"), F.col("path"), F.lit("/")).alias("raw")))
    return raw.select("raw", scalars.normalise_only(F.col("raw")).alias("normalized"))


def path_search(spark, d):
    return select.path_search(fx.tree_paths(spark, d).select("path"), "SRC1/EN")


def ignore_filter(spark, d):
    return select.ignore_filter(fx.tree_paths(spark, d).select("path"), IGNORE)


def dir_tree(spark, d):
    return select.dir_tree(fx.tree_paths(spark, d).select("path"))


def selection_rollup(spark, d):
    """Labelled documents are selected; below 'all' every file is, so that each state occurs."""
    chosen = fx.read(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    files = fx.tree_paths(spark, d).join(chosen, "doc_id", "left").select("path", F.coalesce("hit", F.lit(False)).alias("selected"))
    more = files.where("selected").select(F.concat(F.lit("all/"), F.col("path")).alias("path"), "selected")
    return select.selection_rollup(files.unionByName(more))


def cleanup_dirs(spark, d):
    return select.cleanup_dirs(fx.tree_paths(spark, d).select("path"))


def _plan(spark, d):
    v = fx.versions(spark, d).select("snap", "conv_id", "path", F.sha2("content", 256).alias("hash"))
    return history.restore_plan(v.where("snap = 3 and conv_id % 7 <> 0"), v.where("snap = 7 and conv_id % 5 <> 0"))


def restore_plan(spark, d):
    return _plan(spark, d)


def restore_plan_counts(spark, d):
    return _plan(spark, d).groupBy("action").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def restore_reassemble(spark, d):
    """Chunks are stored once by hash, fetched for every reference and joined in order."""
    files = fx.tree(spark, d)
    cut = chunking.chunk(files.select("path", "content"), 700, keep_bytes=True)
    store = cut.select("chunk_hash", "bytes").dropDuplicates(["chunk_hash"])
    back = chunking.reassemble(cut.select("path", "seq", "chunk_hash").join(store, "chunk_hash"), ["path"])
    whole = files.select("path", F.sha2("content", 256).alias("hash")).join(back.select("path", F.sha2("content", 256).alias("r")), "path", "left")
    r = F.coalesce("r", F.sha2(F.lit(b""), 256))
    return whole.select("path", "hash", r.alias("reassembled_hash"), (F.col("hash") == r).alias("ok"))


def log(spark, d):
    return history.log(fx.summaries(spark, d))


def log_page(spark, d):
    return history.log_page(fx.summaries(spark, d), 2)


def recent_top10(spark, d):
    return history.log_page(fx.summaries(spark, d), 1)


def resolve_prefix(spark, d):
    return history.resolve_prefix(fx.summaries(spark, d), PREFIXES)


def resolve_pending(spark, d):
    return history.resolve_pending(fx.pending(spark, d), PENDING_PREFIXES)


def pending_list(spark, d):
    return history.pending_list(fx.pending(spark, d))


def progress_percent(spark, d):
    x = fx.read(spark, d, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_id") % 3 == 0, 1)).alias("processed"), F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("total"))
    return x.select("user_id", F.col("processed").cast("bigint").alias("processed"), F.col("total").cast("bigint").alias("total"), scalars.percent(F.col("processed"), F.col("total")).alias("percent"), scalars.page_count(F.col("total")).alias("pages"))


def author_check(spark, d):
    k = F.col("c_custkey").cast("string")
    value = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Ada Lovelace <c"), k, F.lit("@mail.org>"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_name"), F.lit(" <x@y.z>"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("Ada <"), k, F.lit("@b.c>"))).otherwise(F.concat(F.lit("Ada B Lovelace<"), k, F.lit("@h.co>")))
    return fx.read(spark, d, "customer").select("c_custkey", value.alias("value"), scalars.valid_author(value).alias("valid"), scalars.valid_storage_name(F.col("c_name")).alias("name_ok"), scalars.valid_storage_name(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("dashed_ok"))


def permission_bits(spark, d):
    mode = (F.col("p_partkey") * 37 + F.lit(32768)).cast("int")
    return fx.read(spark, d, "part").select("p_partkey", scalars.mode_bits(mode).cast("bigint").alias("bits"))


def backup_names(spark, d):
    """The name of a snapshot: hash of message, author and time."""
    s = fx.read(spark, d, "orders")
    ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    h = scalars.backup_hash(F.col("o_orderpriority"), F.lit("Ada Lovelace <ada@mail.org>"), ts)
    return s.select("o_orderkey", h.alias("hash"), scalars.short(h).alias("backup_short"))


def stream_refcount(spark, d):
    events = stream.read_stream(spark, f"{d}/events.parquet", 1)
    return stream.run_refcount(spark, stream.as_chunks(events, "props"))


def stream_first_seen(spark, d):
    events = stream.read_stream(spark, f"{d}/events.parquet", 1)
    return stream.run_first_seen(spark, stream.as_chunks(events, "props"))


def codec_roundtrip(spark, d):
    """path, ok: compress, encrypt, decrypt, decompress."""
    salt = b"fedcba9876543210"
    packed = fx.tree(spark, d).select("path", "content", codec.compress(3)("content").alias("z"))
    sealed = packed.select("path", "content", codec.encrypt(F.col("z"), PASSWORD, salt).alias("e"))
    opened = sealed.select("path", "content", codec.decrypt(F.col("e"), PASSWORD, [salt]).alias("z2"))
    return opened.select("path", (codec.decompress("z2") == F.col("content")).alias("ok"))


def tree_scan(spark, d):
    """A small generated tree, read back: empty, hidden and underscore files are kept, ignored folders are not."""
    root = stream.mounted(stream.scratch(spark, "tree"))
    for name, body in {"a/empty": b"", "a/.hidden": b"h", "_x": b"x", "skip/y": b"y", "ab/z": b"zz" * 600}.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as f:
            f.write(body)
    files = tree_source.read_tree(spark, root + "/", ["skip"], parts=2)
    return files.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("hash"))


def relative_paths(spark, d):
    full = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("/r")).otherwise(F.lit("/s\\")), F.when(F.col("doc_id") % 2 == 0, F.lit("/")).otherwise(F.lit("\\")), F.col("path"))
    return fx.tree_paths(spark, d).select(full.alias("full")).select("full", scalars.relative_path(F.col("full"), "/r").alias("path"))


def local_times(spark, d):
    return fx.summaries(spark, d).select("hash", scalars.local_time(F.col("timestamp"), "Asia/Tokyo").alias("local"))


def human_sizes(spark, d):
    """Sizes of every unit from bytes to petabytes."""
    k = F.col("o_orderkey")
    n = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.element_at(F.array(*[F.lit(10**p).cast("bigint") for p in (0, 2, 4, 6, 8)]), (k % 5 + 1).cast("int"))
    return fx.read(spark, d, "orders").select(F.when(k % 7 == 0, k % 1000).otherwise(n).alias("bytes")).distinct().select("bytes", scalars.human_size(F.col("bytes")).alias("shown"))


def parse_sizes(spark, d):
    return spark.createDataFrame([(x, scalars.parse_size(x)) for x in SIZES], "text string, bytes bigint")


def fallback_modes(spark, d):
    """Permissions where a file system has no bits: programs by extension, writable unless read-only."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("d.x/"), F.col("p_partkey").cast("string"), ext)
    return fx.read(spark, d, "part").select(path.alias("path"), scalars.fallback_mode(path, F.col("p_partkey") % 5 == 0).cast("bigint").alias("mode"))


def progress_events(spark, d):
    """The lines of JSON that a reader of progress gets, one per user of the event table (driver-made text, SQL-made text)."""
    x = progress_percent(spark, d)
    body = F.to_json(F.struct(F.lit("progress").alias("type"), F.struct("percent", "total", "processed").alias("data")))
    return x.select("user_id", body.alias("line"))


# A repository in the shared folder, driven through its own methods.

AUTHOR = "Ada Lovelace <ada@mail.org>"


def _repository(spark, d, password=None):
    """Two backups: documents with even ids, then all."""
    repo = Repository(spark, stream.scratch(spark, "repository"), KEY, EngineConfig(AUTHOR), password)
    files = fx.tree(spark, d)
    first = repo.backup(files.where("doc_id % 2 = 0").select("path", "content", "permissions"), "even", timestamp=1_700_000_000, chunk_size=CHUNK)
    second = repo.backup(files.select("path", "content", "permissions"), "all", timestamp=1_700_086_400, chunk_size=CHUNK)
    return repo, first, second


def repository_results(spark, d):
    """What the two backups report."""
    _, *done = _repository(spark, d)
    keys = ("backup", "backup_short", "message", "author", "timestamp_unix", "files_total", "written_bytes", "deduplicated_bytes")
    return spark.createDataFrame([tuple(x[k] for k in keys) for x in done], "backup string, backup_short string, message string, author string, timestamp_unix bigint, files_total bigint, written_bytes bigint, deduplicated_bytes bigint")


def repository_log(spark, d):
    return _repository(spark, d, PASSWORD)[0].log()


def repository_tree(spark, d):
    repo, first, _ = _repository(spark, d, PASSWORD)
    return repo.tree(first["backup"]).select("backup_hash", "path", "hash", "size", "content_type", "permissions", F.size("chunks").cast("bigint").alias("n_chunks"))


def repository_contents(spark, d):
    """Encrypted, decrypted and joined again."""
    repo, first, _ = _repository(spark, d, PASSWORD)
    return repo.contents("").select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("bigint").alias("size"), "permissions")


def repository_index(spark, d):
    """Reference counts once the newer backup is deleted."""
    repo, _, second = _repository(spark, d)
    repo.delete(second["backup_short"])
    return repo.table("chunk_index", repo.state()).select("chunk_hash", "refcount")


def stored_chunks(spark, d):
    """A listing of what lies in the store itself after a deletion: orphans are gone, each other chunk is there once."""
    repo, first, _ = _repository(spark, d)
    repo.delete(first["backup"])
    return repo.physical().groupBy("chunk_hash").agg(F.count(F.lit(1)).cast("bigint").alias("copies"))


def repository_encrypt(spark, d):
    """What is encrypted by the first call and found so by the second."""
    repo, *_ = _repository(spark, d)
    done = [repo.encrypt(PASSWORD) for _ in range(2)]
    return spark.createDataFrame([(k, x["encrypted"], x["already_encrypted"]) for k, x in enumerate(done)], "run int, encrypted bigint, already_encrypted bigint")


def repository_prune(spark, d):
    """Chunks of a backup that never was committed, and its log."""
    repo, *_ = _repository(spark, d)
    stray = fx.tree(spark, d).where("doc_id % 5 = 0").select(F.concat(F.lit("stray"), F.col("path")).alias("p")).select(F.sha2("p", 256).alias("chunk_hash"), F.encode("p", "UTF-8").alias("payload"))
    stray.write.parquet(f"{repo.base}/chunks/{repo.new_pack(False)}")
    done = [repo.prune(), repo.prune(yes=True), repo.prune(yes=True)]
    return spark.createDataFrame([(k, x["deleted_items"], x.get("aborted", False)) for k, x in enumerate(done)], "run int, deleted_items bigint, aborted boolean")


def repository_restore(spark, d):
    """Restored files as they lie on disk, read back; those of one folder only."""
    repo, *_ = _repository(spark, d)
    target = stream.mounted(stream.scratch(spark, "restored"))
    repo.restore("", target, only=["src1"])
    return chunking.file_hashes(tree_source.read_tree(spark, target + "/")).select("path", "hash", "size")


QUERIES = {f.__name__: f for f in (
    backup_totals, chunk_files, chunk_refcount, chunk_refs, ref_index, file_hashes, tree_listing, chunk_paths, physical_chunks, snapshot_accounting, snapshot_tree,
    backup_against_index, resume_backup, delete_orphans, delete_index_after, delete_summary, prune_candidates, encrypt_worklist, encrypt_status, maybe_decrypt,
    only_select, only_normalize, path_search, ignore_filter, dir_tree, selection_rollup, cleanup_dirs, restore_plan, restore_plan_counts, restore_reassemble,
    log, log_page, recent_top10, resolve_prefix, resolve_pending, pending_list, progress_percent, author_check, permission_bits, backup_names,
    stream_refcount, stream_first_seen, codec_roundtrip, tree_scan, relative_paths, local_times, human_sizes, parse_sizes, fallback_modes, progress_events,
    repository_results, repository_log, repository_tree, repository_contents, repository_index, stored_chunks, repository_encrypt, repository_prune, repository_restore,
)}
