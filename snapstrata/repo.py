"""A versioned, deduplicating repository of file trees on any folder that Spark can write.

Versions, tables and chunk files are those of ``store``: a commit either makes the next version whole or leaves
nothing that any version names. Metadata is committed before data is deleted; what a crash leaves behind is garbage that
``prune`` finds, never a hole."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstrata import schema
from snapstrata.functions import codec, scalars
from snapstrata.operators import chunking, history, refs, select
from snapstrata.sources import tree as tree_source
from snapstrata.store import PLAIN, TABLES, ConflictError, State, Store

__all__ = ["TABLES", "Catalog", "ConflictError", "EngineConfig", "NotFoundError", "Repository", "Storage", "event", "progress"]

#: Defaults of a backup; a pending log's other values go before them.
LEVEL, CHUNK_SIZE, CONCURRENCY = 3, "5 MB", 0
#: New bytes between two progress records of a backup.
CHECKPOINT_BYTES = 64 << 30
#: Times that files which change while they are read are read again.
RESCANS = 3


class NotFoundError(LookupError):
    pass


@dataclass
class EngineConfig:
    author: str

    def __post_init__(self):
        if not re.match(scalars.AUTHOR, self.author):
            raise ValueError(f"not an author: {self.author!r}")

    def whoami(self) -> dict:
        return {"author": self.author}

    def save(self, folder: str) -> None:
        """Keeps the author in a folder of the user's."""
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "config.json"), "w") as f:
            json.dump(asdict(self), f)

    @classmethod
    def load(cls, folder: str) -> EngineConfig:
        at = os.path.join(folder, "config.json")
        if not os.path.exists(at):
            raise NotFoundError("no author is configured")
        with open(at) as f:
            return cls(**json.load(f))


@dataclass
class Storage:
    name: str
    storage_type: str  # "local" or "s3"
    path: str
    region: str | None = None
    endpoint: str | None = None
    access_key: str | None = None
    secret_key: str | None = None

    def info(self) -> dict:
        """Without the keys."""
        return {"name": self.name, "storage_type": self.storage_type, "path": self.path, "region": self.region, "endpoint": self.endpoint}

    def url(self) -> str:
        return f"s3a://{self.path.lstrip('/')}" if self.storage_type == "s3" else self.path

    def configure(self, spark: SparkSession) -> None:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        if self.storage_type == "s3":
            for k, v in (("access.key", self.access_key), ("secret.key", self.secret_key), ("endpoint", self.endpoint), ("endpoint.region", self.region)):
                if v:
                    conf.set(f"fs.s3a.{k}", v)


class Catalog:
    """Named storages; with a folder they are kept there, one file each, readable by their owner alone."""

    def __init__(self, folder: str | None = None):
        self.folder = folder
        self.storages: dict[str, Storage] = {}
        if folder:
            os.makedirs(folder, mode=0o700, exist_ok=True)
            for name in sorted(os.listdir(folder)):
                if name.endswith(".json"):
                    with open(os.path.join(folder, name)) as f:
                        storage = Storage(**json.load(f))
                    self.storages[storage.name] = storage

    def _file(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.json")

    def add(self, storage: Storage) -> dict:
        if not storage.name or not all(c.isascii() and (c.isalnum() or c in "_-") for c in storage.name):
            raise ValueError(f"not a storage name: {storage.name!r}")
        if storage.storage_type not in ("local", "s3"):
            raise ValueError(f"unknown storage type: {storage.storage_type!r}")
        if self.folder:
            draft = f"{self._file(storage.name)}.{uuid.uuid4().hex}"
            with os.fdopen(os.open(draft, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
                json.dump(asdict(storage), f)
            os.replace(draft, self._file(storage.name))
        self.storages[storage.name] = storage
        return storage.info()

    def list(self) -> list[dict]:
        return [self.storages[k].info() for k in sorted(self.storages)]

    def get(self, name: str) -> Storage:
        if name not in self.storages:
            raise NotFoundError(f"no storage named {name!r}")
        return self.storages[name]

    def remove(self, name: str) -> dict:
        self.get(name)
        if self.folder and os.path.exists(self._file(name)):
            os.remove(self._file(name))
        del self.storages[name]
        return {"name": name, "removed": True}


class _Folder:
    """A local tree as the source of a backup: read by pieces, so files of any size fit."""

    def __init__(self, spark: SparkSession, root: str, ignore: list[str], size: int, level: int):
        self.files, self.size, self.level = tree_source.listing(spark, root, ignore), size, level

    def scan(self, only: DataFrame | None = None) -> DataFrame:
        return tree_source.scan_objects(self.files if only is None else self.files.join(only, "path", "left_semi"), self.size)

    def pack(self, wanted: DataFrame, tasks: int) -> DataFrame:
        units = tree_source.units_of(wanted).join(self.files, "path")
        return tree_source.read_pieces(units.repartitionByRange(tasks, "path", F.col("pieces")[0]["seq"]), self.size, self.level)


class _Rows:
    """A table (path, content, permissions) as the source of a backup."""

    def __init__(self, files: DataFrame, ignore: list[str], size: int, level: int):
        path = F.when(scalars.safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.coalesce("path", F.lit("null")))))
        self.files, self.size, self.level = select.ignore_filter(files.withColumn("path", path), ignore), size, level

    def scan(self, only: DataFrame | None = None) -> DataFrame:
        return chunking.objects(self.files if only is None else self.files.join(only, "path", "left_semi"), self.size)

    def pack(self, wanted: DataFrame, tasks: int) -> DataFrame:
        some = self.files.select("path", "content").join(tree_source.units_of(wanted), "path").select("content", F.explode("pieces").alias("p"))
        cut = some.select(F.col("p.chunk_hash"), F.expr(f"substring(content, cast(p.seq * {self.size} + 1 as int), {self.size})").alias("bytes"))
        return cut.where(F.sha2("bytes", 256) == F.col("chunk_hash")).select("chunk_hash", codec.compress(self.level)("bytes").alias("payload"))


def _put_pieces(batches, root: str, token: str):
    """Writes decompressed pieces (path, at, payload) at their places in draft files; again is harmless."""
    import zstandard

    unpack, n = zstandard.ZstdDecompressor(), 0
    for b in batches:
        for path, at, payload in zip(b.column("path").to_pylist(), b.column("at").to_pylist(), b.column("payload"), strict=True):
            full = _draft(root, path, token)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            fd = os.open(full, os.O_WRONLY | os.O_CREAT, 0o600)
            try:
                data, done = memoryview(unpack.decompress(payload.as_buffer())), 0
                while done < len(data):
                    done += os.pwrite(fd, data[done:], at + done)
            finally:
                os.close(fd)
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def _draft(root: str, path: str, token: str) -> str:
    """Beside the file itself, so that it can replace it in one step."""
    return os.path.join(root, os.path.dirname(path), f".{token}-{hashlib.sha256(path.encode()).hexdigest()[:24]}.part")


def _finish(batches, root: str, token: str):
    """Checks drafts against the hashes of their files and puts them in place; (path, problem) of those that fail."""
    for b in batches:
        bad = []
        for path, size, want, mode in zip(*(b.column(c).to_pylist() for c in ("path", "size", "hash", "permissions")), strict=True):
            draft, full = _draft(root, path, token), os.path.join(root, path)
            if not size:
                os.makedirs(os.path.dirname(full), exist_ok=True)
                open(draft, "wb").close()
            if not os.path.exists(draft):  # an earlier try of this task may have put the file in place
                if tree_source.file_hash(full) != want:
                    bad.append((path, "missing"))
                continue
            if tree_source.file_hash(draft) != want:
                os.remove(draft)
                bad.append((path, "damaged"))
                continue
            os.chmod(draft, mode)
            os.replace(draft, full)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in bad], pa.string()) for k in (0, 1)], names=["path", "problem"])


def _remove(batches, root: str):
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            try:
                os.remove(os.path.join(root, path))
                out.append(None)
            except FileNotFoundError:
                out.append(None)  # an earlier try of this task
            except OSError as e:
                out.append(str(e))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], names=["path", "problem"])


class Repository(Store):
    def __init__(self, spark: SparkSession, root: str, key: str, config: EngineConfig | None = None, password: str | None = None, on_event=None):
        """on_event gets a line of JSON (see ``event``) for each progress step and warning."""
        super().__init__(spark, f"{root.rstrip('/')}/{key}", password)
        self.key, self.config, self.warnings, self.on_event = key, config, [], on_event

    def _warn(self, text: str, code: str) -> None:
        self.warnings.append(text)
        if self.on_event:
            self.on_event(event("warning", {"message": text, "code": code}))

    def _progress(self, done: int, total: int, message: str) -> None:
        if self.on_event:
            self.on_event(progress(done, total, message))

    def _table(self, name: str, version: int | None = None) -> DataFrame:
        return self.table(name, self.state(version))

    def _commit(self, base: int, **changed: DataFrame) -> int:
        """A new version with the changed tables and the others as they were in ``base``."""
        return self.commit(self.state(base), changed).version

    def _chunks(self) -> DataFrame:
        return self.physical()

    # reading

    def log(self) -> DataFrame:
        return history.log(self._table("summaries"))

    def pending(self) -> DataFrame:
        """Unfinished backups by name; uploaded_chunks counts those of finished steps."""
        p = self._table("pending")
        done = F.coalesce("uploaded", F.when(F.col("processed_chunks").isNotNull(), F.size("processed_chunks")), F.lit(0))
        return p.select(F.col("hash").alias("backup"), scalars.short(F.col("hash")).alias("backup_short"), "message", done.cast("bigint").alias("uploaded_chunks"), F.col("chunk_size").alias("chunk_size_bytes"), "compress", "concurrency", F.size("ignore_patterns").cast("bigint").alias("ignored_entries")).orderBy("backup")

    def resolve(self, prefix: str, state: State | None = None) -> str:
        """Up to 8 characters: the newest backup that starts so; longer: taken as it is."""
        found = history.resolve_prefix(self.table("summaries", state or self.state()), [prefix]).first().hash
        if found is None:
            raise NotFoundError(f"no backup found that matches {prefix!r}")
        return found

    def _backup(self, backup: str, state: State):
        """(name, its row of backups)."""
        h = self.resolve(backup, state)
        row = self.table("backups", state).where(F.col("hash") == h).first()
        if row is None:
            raise NotFoundError(f"backup {h} not found or is empty")
        return h, row

    def _objects(self, row, state: State) -> DataFrame:
        return self.read(row.objects, schema.SCANNED, self.data_key(state) if row.sealed else None)

    def tree(self, backup: str) -> DataFrame:
        """The files of a backup; no other backup's are read."""
        state = self.state()
        h, row = self._backup(backup, state)
        return self._objects(row, state).select(F.lit(h).alias("backup_hash"), "*")

    # writing

    def backup(self, source: DataFrame | str, message: str | None = None, timestamp: int | None = None, compress: int | None = None, chunk_size: int | str | None = None, ignore: list[str] | None = None, resume: str | None = None, encrypt: bool | None = None, concurrency: int | None = None, checkpoint_bytes: int = CHECKPOINT_BYTES) -> dict:
        """Stores a tree (path, content, permissions; or a local folder).

        1. One pass hashes all files by chunks; their list is the backup. Everything else follows from it.
        2. Of each chunk that is not stored yet one occurrence is read again, compressed, encrypted and written, in steps of
           about ``checkpoint_bytes``; after each, the pending log names what is uploaded. Nothing else is read
           twice. A file that changed between the passes is found by hash and scanned again.
        3. One commit merges the counts into the newest index, whoever wrote it meanwhile.

        A run that is broken off leaves a pending log, which ``resume`` goes on with: values that are not given here come from
        the log where they differ from the defaults. Paths must be relative and distinct."""
        if self.config is None:
            raise ValueError("configure an author first")
        began, state = time.time(), self.state()
        old, reused = None, []
        if resume is not None:
            found = history.resolve_pending(self.table("pending", state), [resume]).first().hash
            if found is None:
                raise NotFoundError("no pending backup found")
            old = self.table("pending", state).where(F.col("hash") == found).first()
            message = message or None
            if old.uploaded:
                reused.append("uploaded chunks")

        def pick(name: str, given, default):
            kept = None if old is None else old[name]
            if given is not None or kept in (None, default):
                return default if given is None else given
            reused.append(name)
            return kept

        message = pick("message", message, None)
        if message is None:
            raise ValueError("a message is needed")
        level = pick("compress", compress, LEVEL)
        size = pick("chunk_size", scalars.parse_size(chunk_size) if isinstance(chunk_size, str) else chunk_size, scalars.parse_size(CHUNK_SIZE))
        ignore = pick("ignore_patterns", None if ignore is None else list(ignore), [])
        concurrency = pick("concurrency", concurrency, CONCURRENCY)
        if size < 1:
            raise ValueError("a chunk has one byte at least")
        if reused:
            self._warn(f"reusing from {old.hash[:8]}: " + ", ".join(reused), "pending_backup_reuse")
        ts = int(time.time()) if timestamp is None else timestamp
        name = hashlib.sha256(f"{message}:{self.config.author}:{ts}".encode()).hexdigest()
        run = name if old is None else old.hash
        packs, uploaded = list(old.packs or []) if old is not None else [], 0

        new_key = None
        if self.password is not None and encrypt is not False and state.key is None:
            new_key = self.new_key(self.password)
            if self.table("chunk_index", state).limit(1).count():
                self._warn("the repository holds plain data; only new chunks are encrypted", "unencrypted_chunks")

        def register(s: State) -> dict:
            """The log comes first: packs of a run that stops are known to a later one."""
            row = self.spark.createDataFrame([(run, message, level, size, ignore, concurrency, None, uploaded, packs)], schema.PENDING)
            return {"pending": self.table("pending", s).where(F.col("hash") != run).unionByName(row, allowMissingColumns=True)}

        self.table("pending", state)  # a wrong password ends here
        state = self.update(register, new_key)
        key = self.data_key(state)
        index = self.table("chunk_index", state)
        files = _Folder(self.spark, source, ignore, size, level) if isinstance(source, str) else _Rows(source, ignore, size, level)
        at, dead = f"objects/{name}-{uuid.uuid4().hex}", []
        self.write(files.scan(), at, key)
        for again in range(RESCANS + 1):
            objects = self.read(at, schema.SCANNED, key)
            twice = objects.groupBy("path").count().where("count > 1").first()
            if twice:
                raise ValueError(f"a path stands twice: {twice.path}")
            n = F.least(F.lit(size), F.col("size") - F.col("seq") * F.lit(size)).cast("bigint").alias("n")
            uses = objects.select("path", "size", F.posexplode("chunks").alias("seq", "chunk_hash")).select("path", F.col("seq").cast("bigint").alias("seq"), "chunk_hash", n)
            per = uses.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("rc"), F.max("n").alias("n"), F.min(F.struct("path", "seq")).alias("at"))
            ready = self._pack_rows(packs)
            per = per.join(index.select("chunk_hash", F.lit(True).alias("known")), "chunk_hash", "left").join(ready, "chunk_hash", "left")
            delta_at = f"tables/{state.version + 1}-delta-{uuid.uuid4().hex}"
            columns = "chunk_hash string, rc bigint, n bigint, path string, seq bigint, known boolean, file string"
            self.write(per.select("chunk_hash", "rc", "n", "at.path", "at.seq", F.coalesce("known", F.lit(False)).alias("known"), "file"), delta_at, key)
            dead.append(delta_at)
            delta = self.read(delta_at, columns, key)
            sums = delta.agg(F.sum(F.when(~F.col("known"), F.col("n"))).alias("new"), F.sum(F.col("n") * F.col("rc")).alias("all"), F.sum(F.when(~F.col("known") & F.col("file").isNull(), F.col("n"))).alias("todo"), F.count(F.when(~F.col("known") & F.col("file").isNotNull(), 1)).alias("ready")).first()
            todo, uploaded = sums.todo or 0, sums.ready
            steps, first = -(-todo // checkpoint_bytes), len(packs)
            missing = delta.where("not known and file is null")
            for k in range(steps):
                packs.append(self.new_pack(key is not None))
                self.update(register)
                wanted = missing.where(F.pmod(F.xxhash64("path"), F.lit(steps)) == k).select("path", "seq", "chunk_hash")
                rows = files.pack(wanted, max(self.spark.sparkContext.defaultParallelism, -(-todo // steps // (256 << 20))))
                rows = rows if key is None else rows.withColumn("payload", codec.seal(F.col("payload"), key))
                rows.write.parquet(f"{self.base}/chunks/{packs[-1]}")
                uploaded += self.pack_rows(packs[-1]).count()
                self._progress(k + 1, steps, f"backing up to {name[:8]}")
            if steps:
                self.update(register)
            stored = self._pack_rows(packs[first:]).withColumnRenamed("file", "stored")
            lost = missing.join(stored, "chunk_hash", "left_anti")
            if not steps or not lost.limit(1).count():
                break
            if again == RESCANS or not isinstance(source, str):
                raise RuntimeError("files change while they are read; nothing was committed")
            changed = uses.join(lost.select("chunk_hash"), "chunk_hash", "left_semi").select("path").distinct()
            self._warn("files changed while they were read; they are read again", "changed_files")
            dead.append(at)
            at = f"objects/{name}-{uuid.uuid4().hex}"
            self.write(objects.join(changed, "path", "left_anti").unionByName(files.scan(changed)), at, key)
        added = delta.join(stored, "chunk_hash", "left").select("chunk_hash", F.col("rc").alias("refcount"), F.coalesce("file", "stored").alias("file"))

        def finish(s: State) -> dict:
            if not self.table("pending", s).where(F.col("hash") == run).limit(1).count():
                raise ConflictError("the pending log is gone: the repository was pruned")
            latest = self.table("chunk_index", s)
            if added.where("file is null").join(latest, "chunk_hash", "left_anti").limit(1).count():
                raise ConflictError("chunks were deleted meanwhile: resume the backup")
            none = F.lit(None).cast("string")
            both = latest.withColumn("own", none).unionByName(added.select("chunk_hash", "refcount", none.alias("file"), F.col("file").alias("own")))
            merged = both.groupBy("chunk_hash").agg(F.sum("refcount").cast("bigint").alias("refcount"), F.coalesce(F.max("file"), F.max("own")).alias("file"))
            ord_ = (self.table("summaries", s).agg(F.max("ord")).first()[0] or 0) + 1
            one = lambda row, columns: self.spark.createDataFrame([row], columns)
            return {
                "chunk_index": merged,
                "backups": self.table("backups", s).where(F.col("hash") != name).unionByName(one((name, message, self.config.author, ts, size, at, key is not None), schema.BACKUPS)),
                "summaries": self.table("summaries", s).unionByName(one((ord_, name, message, ts, sums.new or 0), schema.SUMMARIES)),
                "pending": self.table("pending", s).where(F.col("hash") != run),
            }

        self.update(finish)
        total = objects.count()
        self._delete(dead)
        return {"backup": name, "backup_short": name[:8], "message": message, "author": self.config.author, "timestamp_unix": ts, "files_total": total, "written_bytes": sums.new or 0, "deduplicated_bytes": (sums["all"] or 0) - (sums.new or 0), "elapsed_ms": int(1000 * (time.time() - began))}

    def _pack_rows(self, packs: list[str]) -> DataFrame:
        """chunk_hash, file (one of them) in finished packs."""
        out = self.spark.createDataFrame([], "chunk_hash string, file string")
        for p in packs:
            out = out.unionByName(self.pack_rows(p))
        return out.groupBy("chunk_hash").agg(F.min("file").alias("file"))

    def _named(self, files: DataFrame, state: State) -> DataFrame:
        """path, seq, chunk_hash, file of the chunks of files."""
        uses = files.select("path", F.posexplode("chunks").alias("seq", "chunk_hash"))
        return uses.join(self.table("chunk_index", state).select("chunk_hash", "file"), "chunk_hash", "left").select("path", F.col("seq").cast("bigint").alias("seq"), "chunk_hash", "file")

    def _payloads_of(self, named: DataFrame, state: State) -> DataFrame:
        """named with payload (still compressed), read from the files that hold these chunks and no others."""
        at = [r.file for r in named.where("file is not null").select("file").distinct().collect()]  # names of files, as a listing
        sealed = codec.unseal(F.col("payload"), self.data_key(state))
        return self.payloads(at).join(named, ["chunk_hash", "file"]).withColumn("payload", sealed)

    def _wanted(self, backup: str, only: list[str] | None, state: State):
        h, row = self._backup(backup, state)
        files = self._objects(row, state)
        if only is not None:
            files = select.only_select(files.select("path"), only).join(files, "path")
        return h, row, files

    def contents(self, backup: str, only: list[str] | None = None) -> DataFrame:
        """path, content, permissions of a backup (or of selected paths), each file in one cell (2 GB at most; ``restore``
        has no such limit); raises where a chunk is missing or bytes differ."""
        state = self.state()
        _, _, files = self._wanted(backup, only, state)
        parts = self._payloads_of(self._named(files, state), state).select("path", "seq", codec.decompress("payload").alias("bytes"))
        back = chunking.reassemble(parts, ["path"])
        whole = files.join(back, "path", "left").withColumn("content", F.when(F.size("chunks") == 0, F.lit(b"")).otherwise(F.col("content")))
        ok = F.sha2("content", 256).eqNullSafe(F.col("hash"))
        return whole.select("path", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("damaged or missing chunk in "), F.col("path"))).cast("binary")).alias("content"), "permissions")

    def restore(self, backup: str, target: str, only: list[str] | None = None, prune_local: bool = False) -> dict:
        """Writes a backup's files below a folder that all executors reach; files that are the same stay untouched.

        Chunks of one size have known places, so they are written in any order and by any task into drafts, which take the
        files' places when their hashes are right: a run that fails leaves every file as it was or as it should be. Only
        chunk files with wanted chunks are read; a worker holds a batch of chunks, whatever the files' sizes."""
        if only is not None and prune_local:
            raise ValueError("only and prune_local exclude each other")
        began, state = time.time(), self.state()
        h, row, files = self._wanted(backup, only, state)
        bad = files.where(~scalars.safe_path(F.col("path"))).first()
        if bad:
            raise ValueError(f"unsafe path: {bad.path}")
        os.makedirs(target, exist_ok=True)
        root, token = target.rstrip("/") + "/", uuid.uuid4().hex[:12]
        here = tree_source.listing(self.spark, root)
        hashed = tree_source.hash_files(here.join(files.select("path"), "path", "left_semi"))
        local = here.select("path").join(hashed, "path", "left")
        plan = history.restore_plan(files, local).cache()
        counts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
        gone = [r.path for r in plan.where("action = 'delete_local'").select("path").collect()] if prune_local else []  # names of local files, which the driver has listed
        wanted = files.join(plan.where(F.col("action").isin("restore_missing", "restore_changed")).select("path"), "path", "left_semi")
        todo = counts.get("restore_missing", 0) + counts.get("restore_changed", 0)
        deleted = 0
        if todo:
            self._progress(0, todo, f"restoring {h[:8]}")
            named = self._named(wanted, state)
            pieces = self._payloads_of(named, state).select("path", (F.col("seq") * row.chunk_size).alias("at"), "payload")
            pieces.mapInArrow(lambda b: _put_pieces(b, root, token), "n long").agg(F.sum("n")).collect()
            done = tree_source._spread(wanted.select("path", "size", "hash", "permissions")).mapInArrow(lambda b: _finish(b, root, token), "path string, problem string")
            problems = done.limit(20).collect()
            if problems:
                raise RuntimeError("damaged or missing chunk in " + ", ".join(sorted(r.path for r in problems)))
            self._progress(todo, todo, f"restoring {h[:8]}")
        if gone:
            rows = self.spark.createDataFrame([(p,) for p in gone], "path string")
            failed = [r for r in tree_source._spread(rows).mapInArrow(lambda b: _remove(b, root), "path string, problem string").where("problem is not null").collect()]
            for r in failed:
                self._warn(f"{r.path}: {r.problem}", "cleanup_failed")
            deleted = len(gone) - len(failed)
        if prune_local:
            for folder, _, _ in os.walk(root, topdown=False):
                if os.path.normpath(folder) != os.path.normpath(root) and not os.listdir(folder):
                    os.rmdir(folder)
        plan.unpersist()
        return {"backup": h, "backup_short": h[:8], "restored": todo, "skipped": counts.get("skip", 0), "deleted_local": deleted, "target_path": target, "elapsed_ms": int(1000 * (time.time() - began))}

    def delete(self, backup: str) -> dict:
        """Takes a backup off the index and removes chunks that nothing refers to: metadata first, data last."""
        began, state = time.time(), self.state()
        h, row = self._backup(backup, state)
        removed = self._objects(row, state).select(F.explode("chunks").alias("chunk_hash"))
        dropped: list[DataFrame] = []

        def change(s: State) -> dict:
            index = self.table("chunk_index", s)
            if not self.table("backups", s).where(F.col("hash") == h).limit(1).count():
                raise NotFoundError(f"backup {h} is gone")
            after = refs.after_delete(index, removed).join(index.select("chunk_hash", "file"), "chunk_hash")
            dropped[:] = [after.where("refcount = 0").select("chunk_hash", "file")]
            kept = lambda t: self.table(t, s).where(F.col("hash") != h)
            return {"chunk_index": after.where("refcount > 0"), "backups": kept("backups"), "summaries": kept("summaries")}

        self.update(change)
        n = dropped[0].count()
        if n:
            self._sweep([r.file for r in dropped[0].select("file").distinct().collect()])  # names of files
        self._delete([row.objects])
        return {"backup": h, "backup_short": h[:8], "deleted_chunks": n, "elapsed_ms": int(1000 * (time.time() - began))}

    def _sweep(self, files: list[str], seal: bool = False) -> None:
        """Moves what the index names in these files into a new pack and deletes them. Readers see the old files until
        the index names the new one; a crash leaves either."""
        state = self.state()
        key, index = self.data_key(state), self.table("chunk_index", state)
        old = self.spark.createDataFrame([(f,) for f in files], "file string")
        stay = index.join(old, "file", "left_semi").select("chunk_hash", "file")
        if stay.limit(1).count():
            pack = self.new_pack(key is not None)
            rows = self.payloads(files).join(stay, ["chunk_hash", "file"], "left_semi").select("chunk_hash", "payload")
            if key is not None:
                rows = rows.withColumn("payload", F.when(codec.is_encrypted(F.col("payload")), F.col("payload")).otherwise(codec.seal(F.col("payload"), key)))
            rows.write.parquet(f"{self.base}/chunks/{pack}")
            moved = self._pack_rows([pack]).withColumnRenamed("file", "new")

            def change(s: State) -> dict:
                now = self.table("chunk_index", s).join(old.withColumn("old", F.lit(True)), "file", "left").join(moved, "chunk_hash", "left")
                there = F.when(F.col("old"), F.coalesce("new", F.raise_error(F.lit("a chunk was lost on its way")))).otherwise(F.col("file"))
                return {"chunk_index": now.select("chunk_hash", "refcount", there.alias("file"))}

            self.update(change)
        self._delete([f"chunks/{f}" for f in files])

    def prune(self, yes: bool = False) -> dict:
        """Removes chunks that no index entry names, and all pending logs (their chunks are not indexed yet and go, too; a
        backup that is still running fails at its commit). Dead tables and lists of files go with them."""
        began, state = time.time(), self.state()
        stored = self.physical().select("chunk_hash", "file")
        garbage = stored.join(self.table("chunk_index", state).select("chunk_hash", "file"), ["chunk_hash", "file"], "left_anti")
        logs, n = self.table("pending", state).count(), garbage.count()
        if not n + logs:
            return {"deleted_items": 0, "elapsed_ms": int(1000 * (time.time() - began))}
        if not yes:
            return {"deleted_items": 0, "aborted": True}
        if logs:
            self.update(lambda s: {"pending": self.table("pending", s).limit(0)})
        at = [(r.pack, r.file) for r in garbage.select(F.split("file", "/")[0].alias("pack"), "file").distinct().collect()]  # names of files
        own = {f for p, f in at if self._exists(f"chunks/{f}")}
        self._sweep(sorted(own))
        self._delete([f"chunks/{p}" if re.match(r"\w-", p) is None else f"chunks/{f}" for p, f in at if f not in own])
        state = self.state()
        live = {os.path.basename(x) for x in state.tables.values() if x}
        self._delete([f"tables/{x}" for x in self._names("tables") if int(x.split("-")[0]) <= state.version and x not in live])
        named = {os.path.basename(r.objects) for r in self.table("backups", state).select("objects").collect()}  # one a backup
        self._delete([f"objects/{x}" for x in self._names("objects") if x not in named])
        return {"deleted_items": n + logs, "elapsed_ms": int(1000 * (time.time() - began))}

    def encrypt(self, password: str) -> dict:
        """Encrypts what is plain among the two index tables, the indexed chunks and the lists of files of the backups (pending
        logs do not count); the rest stays. Each is replaced by a new file that the next version names."""
        if not password:
            raise ValueError("a password is needed")
        self.password = password
        state = self.state()
        self.data_key(state)  # a wrong password ends here
        backups = self.table("backups", state)
        plain = F.startswith("file", F.lit(f"{PLAIN}-")) | ~F.startswith("file", F.lit("e-"))
        chunks = self.table("chunk_index", state).agg(F.count(F.when(plain, 1)).alias("plain"), F.count(F.when(~plain, 1)).alias("sealed")).first()
        lists = backups.agg(F.count(F.when(~F.col("sealed"), 1)).alias("plain"), F.count(F.when(F.col("sealed"), 1)).alias("sealed")).first()
        tables = sum(t in state.sealed for t in ("chunk_index", "summaries"))
        if state.key is None or tables < 2:
            self.update(lambda s: {t: self.table(t, s) for t in TABLES}, self.new_key(password))
        key, old = self.data_key(self.state()), {}
        if chunks.plain:
            self._sweep([r.file for r in self._table("chunk_index").where(plain).select("file").distinct().collect()])  # names of files
        for r in backups.where(~F.col("sealed")).collect():  # one a backup
            old[r.hash] = (r.objects, f"objects/{r.hash}-{uuid.uuid4().hex}")
            self.write(self.read(r.objects, schema.SCANNED, None), old[r.hash][1], key)
        if old:
            new = self.spark.createDataFrame([(h, at) for h, (_, at) in old.items()], "hash string, moved string")
            self.update(lambda s: {"backups": self.table("backups", s).join(new, "hash", "left").withColumn("objects", F.coalesce("moved", "objects")).withColumn("sealed", F.col("sealed") | F.col("moved").isNotNull()).drop("moved")})
            self._delete([at for at, _ in old.values()])
        return {"encrypted": 2 - tables + chunks.plain + lists.plain, "already_encrypted": tables + chunks.sealed + lists.sealed}


def event(kind: str, data: dict) -> str:
    """A line of newline-delimited JSON: output, progress, warning, error, help or version."""
    if kind not in ("output", "progress", "warning", "error", "help", "version"):
        raise ValueError(kind)
    return json.dumps({"type": kind, "data": data})


def progress(processed: int, total: int, message: str | None = None) -> str:
    data = {"percent": processed * 100 // total if total else 0, "total": total, "processed": processed}
    return event("progress", data | ({"message": message} if message else {}))
