"""Versioned tables with optimistic commits, and chunk files that never change.

Layout below a base folder:
  HEAD/<n>        the map of version n: table name -> folder, whether it is sealed, and the wrapped data key. It is created
                  with its content in one step that fails where it exists, so two writers cannot both make version n, and the
                  loser's tables lie in folders of their own;
  tables/<n>-...  tables written for version n; never changed, dead once another writer has made version n;
  objects/...     one folder a backup: its files and their chunks;
  chunks/<pack>/  Parquet files of (chunk_hash, payload), one folder a write. The index names the file of every chunk; a
                  file that no index names is garbage, whoever left it."""

from __future__ import annotations

import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstrata import schema
from snapstrata.functions import codec

TABLES = {"chunk_index": schema.CHUNK_INDEX, "backups": schema.BACKUPS, "summaries": schema.SUMMARIES, "pending": schema.PENDING}
#: First letters of pack names: their payloads are encrypted or plain.
SEALED, PLAIN = "e", "p"


class ConflictError(RuntimeError):
    """Another writer was first."""


@dataclass
class State:
    version: int = 0
    tables: dict[str, str | None] = field(default_factory=lambda: dict.fromkeys(TABLES))
    sealed: list[str] = field(default_factory=list)
    key: dict[str, str] | None = None  # salt and wrapped data key, in hex

    def text(self) -> str:
        return json.dumps({"tables": self.tables, "sealed": sorted(self.sealed), "key": self.key})


class Store:
    def __init__(self, spark: SparkSession, base: str, password: str | None = None):
        self.spark, self.base, self.password = spark, base, password
        self._opened: dict[str, bytes] = {}

    # files

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        fs, p = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _delete(self, names: list[str]) -> None:
        """Files or folders; those that are gone already do not matter."""
        fs = self._fs()
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda n: fs.delete(self._path(n), True), names))

    def _read_text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """A file together with its content; False where it exists. Atomic: a link to a finished file on mounted folders, a
        conditional put on S3, a rename that never replaces elsewhere."""
        path, fs, data = self._path(name), self._fs(), text.encode()
        scheme = fs.getUri().getScheme()
        if scheme == "file":
            target = path.toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = f"{target}.{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        if fs.exists(path):
            return False
        if scheme == "s3a":
            out = fs.createFile(path).overwrite(False).must("fs.option.create.conditional.overwrite", "true").build()
            try:
                out.write(bytearray(data))
                out.close()
            except Exception as e:
                if fs.exists(path):
                    return False
                raise e
            return True
        draft = self._path(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if not fs.rename(draft, path):
            fs.delete(draft, False)
            return False
        return True

    # versions

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max((int(x) for x in self._names("HEAD") if x.isdigit()), default=0)

    def state(self, version: int | None = None) -> State:
        v = self.version() if version is None else version
        if not v:
            return State()
        x = json.loads(self._read_text(f"HEAD/{v}"))
        return State(v, dict.fromkeys(TABLES) | x["tables"], x["sealed"], x["key"])

    def data_key(self, state: State) -> bytes | None:
        """The key of an encrypted store; raises without the right password. None for a plain store."""
        if state.key is None:
            return None
        if self.password is None:
            raise PermissionError("the data is encrypted: a password is needed")
        if state.key["wrapped"] not in self._opened:
            key = codec.unwrap_key(self.spark, bytes.fromhex(state.key["wrapped"]), self.password, bytes.fromhex(state.key["salt"]))
            if key is None:
                raise PermissionError("wrong password or damaged key")
            self._opened[state.key["wrapped"]] = key
        return self._opened[state.key["wrapped"]]

    def new_key(self, password: str) -> dict[str, str]:
        """One data key for a store's life, wrapped by the password: one derivation, however many writes follow."""
        salt = codec.new_salt()
        return {"salt": salt.hex(), "wrapped": codec.wrap_key(self.spark, os.urandom(32), password, salt).hex()}

    # tables

    def write(self, df: DataFrame, name: str, key: bytes | None) -> None:
        """A folder of rows; with a key each row is one encrypted JSON object."""
        if key is not None:
            df = df.select(codec.seal(F.to_json(F.struct(*df.columns)).cast("binary"), key).alias("sealed"))
        df.write.parquet(f"{self.base}/{name}")

    def read(self, name: str, columns: str, key: bytes | None) -> DataFrame:
        if key is None:
            return self.spark.read.schema(columns).parquet(f"{self.base}/{name}")
        rows = self.spark.read.schema("sealed binary").parquet(f"{self.base}/{name}")
        return rows.select(F.from_json(codec.unseal(F.col("sealed"), key).cast("string"), columns).alias("x")).select("x.*")

    def table(self, name: str, state: State) -> DataFrame:
        """A table as of a state; absent is empty, unreadable raises."""
        key = self.data_key(state)
        at = state.tables[name]
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.read(at, TABLES[name], key if name in state.sealed else None)

    def commit(self, state: State, changed: dict[str, DataFrame], key: dict[str, str] | None = None) -> State:
        """The version after ``state`` with these tables; raises ConflictError where another writer made it."""
        new = State(state.version + 1, dict(state.tables), list(state.sealed), key or state.key)
        data_key = self.data_key(new)
        for name, df in changed.items():
            new.tables[name] = f"tables/{new.version}-{name}-{uuid.uuid4().hex}"
            self.write(df, new.tables[name], data_key)
            if data_key is not None and name not in new.sealed:
                new.sealed.append(name)
        if not self._create(f"HEAD/{new.version}", new.text()):
            raise ConflictError(f"version {new.version} of {self.base} exists")
        return new

    def update(self, change, key: dict[str, str] | None = None, tries: int = 8) -> State:
        """Commits change(state) -> tables on the newest state; a writer that comes second looks again and tries anew."""
        for k in range(tries):
            state = self.state()
            try:
                return self.commit(state, change(state), None if state.key else key)
            except ConflictError:
                if k == tries - 1 or self.version() == state.version:
                    raise
        raise ConflictError(f"no quiet moment for a commit to {self.base}")

    # chunks

    def new_pack(self, sealed: bool) -> str:
        return f"{SEALED if sealed else PLAIN}-{uuid.uuid4().hex}"

    def physical(self) -> DataFrame:
        """chunk_hash, payload, file of all stored rows, whoever wrote them; file is <pack>/<name>."""
        if not self._names("chunks"):
            return self.spark.createDataFrame([], schema.CHUNKS)
        return self._files(self.spark.read.option("recursiveFileLookup", "true").schema(schema.PAYLOADS).parquet(f"{self.base}/chunks"))

    def payloads(self, files: list[str]) -> DataFrame:
        """chunk_hash, payload, file of these files alone."""
        if not files:
            return self.spark.createDataFrame([], schema.CHUNKS)
        return self._files(self.spark.read.schema(schema.PAYLOADS).parquet(*(f"{self.base}/chunks/{f}" for f in files)))

    def _files(self, rows: DataFrame) -> DataFrame:
        parts = F.split("_metadata.file_path", "/")
        return rows.select("chunk_hash", "payload", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("file"))

    def pack_rows(self, pack: str) -> DataFrame:
        """chunk_hash, file of a finished pack; an unfinished one has no rows."""
        if not self._exists(f"chunks/{pack}/_SUCCESS"):
            return self.spark.createDataFrame([], "chunk_hash string, file string")
        return self._files(self.spark.read.schema(schema.PAYLOADS).parquet(f"{self.base}/chunks/{pack}")).select("chunk_hash", "file")
