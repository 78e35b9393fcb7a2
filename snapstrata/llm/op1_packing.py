"""Best-fit packing of token sequences with Martello-Toth dominance reduction."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from snapstrata.llm.common import table
from snapstrata.llm.tokens import ByteLevelEncoder

_ENCODERS: dict[str, ByteLevelEncoder] = {}


def _pieces(batches, path: str, end_id: int, capacity: int):
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    encode, end = _ENCODERS[path].encode, np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        rows, piece, start, length, crc = [], [], [], [], []
        for k, text in enumerate(batch.column("text")):
            ids = encode(text.as_py() or "") + end
            n, at, i = len(ids) // 4, 0, 0
            size = n % capacity or capacity  # only the first piece may be shorter
            while at < n:
                rows.append(k)
                piece.append(i)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                at, i, size = at + size, i + 1, capacity
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and end_id, cut into pieces of at most capacity."""
    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(lambda batches: _pieces(batches, path, end_id, capacity), f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


class _Sizes:
    """A multiset of sizes: how many documents of each length are left to place."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            del self.order[bisect.bisect_left(self.order, size)]

    def fit(self, room: int, without: tuple[int, ...] = ()) -> int:
        """The largest size that fits and is left once ``without`` is set aside; 0 if there is none."""
        i = bisect.bisect_right(self.order, room)
        while i:
            i -= 1
            s = self.order[i]
            if self.n[s] > without.count(s):
                return s
        return 0


def dominant_set(left: _Sizes, capacity: int, j: int | None = None) -> tuple[int, ...] | None:
    """A set with size j (the largest left by default) that provably dominates every other set with j, or None.

    Martello and Toth: a set F dominates a set G if G's members can be split into groups that each fit into the
    place of one member of F; some optimal packing then has F as a sequence. With r the room
    beside j and k the largest other size that fits r:
      * nothing fits: {j};
      * k = r, or the two smallest others do not fit r together: {j, k} (whatever else goes with j fits into k's place);
      * the three smallest others do not fit together, and k with its best partner b leaves no pair whose
        smaller member exceeds b: {j, k, b} (a pair's larger member fits k's place, its smaller one b's)."""
    j = left.order[-1] if j is None else j
    r = capacity - j
    k = left.fit(r, (j,))
    if not k:
        return (j,)
    if k == r:
        return (j, k)
    smallest = []
    for s in left.order:
        smallest += [s] * min(3 - len(smallest), left.n[s] - (s == j))
        if len(smallest) == 3:
            break
    if sum(smallest[:2]) > r or len(smallest) < 2:
        return (j, k)
    if sum(smallest) > r or len(smallest) < 3:
        b = left.fit(r - k, (j, k))
        above = bisect.bisect_right(left.order, b)
        if b and (above == len(left.order) or 2 * left.order[above] > r):
            return (j, k, b)
    return None


def plan_packing(counts: dict[int, int], capacity: int, fixed: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """Where the documents of each length go: (size, first rank, count, first sequence, offset, per sequence).

    The r-th document (from 0) of a length, first rank <= r < first rank + count, goes to sequence
    first + (r - first rank) div per and there to offset + ((r - first rank) mod per) * size. Works on the
    histogram of lengths alone, so its cost depends on the capacity, not on the number of documents.

    Dominating sets are fixed, as many of a kind at once as the counts allow, and the instance shrinks, until no
    size left has a provably dominating set. Best fit, largest first, packs the remainder. fixed gets (size, count) of what
    the reduction placed."""
    left, out, rank, bins = _Sizes(counts), [], defaultdict(int), 0

    def put(size: int, n: int, first: int, offset: int, per: int = 1) -> None:
        out.append((size, rank[size], n, first, offset, per))
        rank[size] += n

    before = -1
    while before != bins:  # what a pass fixes can free sizes that it had to skip
        before = bins
        for j in left.order[::-1]:
            while j in left.n and (chosen := dominant_set(left, capacity, j)):
                times = min(left.n[s] // chosen.count(s) for s in chosen)
                offset = 0
                for s in chosen:
                    put(s, times, bins, offset)
                    if fixed is not None:
                        fixed.append((s, times))
                    left.take(s, times)
                    offset += s
                bins += times
    # best fit, largest first, on groups of sequences with the same room: room -> [(first sequence, count)]
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms or not rooms[room]:
                bisect.insort(order, room)
            rooms[room].append((first, n))

    for size in reversed(left.order):
        todo = left.n[size]
        while todo:
            i = bisect.bisect_left(order, size)
            if i == len(order):  # new sequences
                per = capacity // size
                full, rest = divmod(todo, per)
                if full:
                    put(size, full * per, bins, 0, per)
                    give(capacity - per * size, bins, full)
                if rest:
                    put(size, rest, bins + full, 0, rest)
                    give(capacity - rest * size, bins + full, 1)
                bins += full + bool(rest)
                break
            room = order[i]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del order[i]
            per = room // size
            used = min(n, todo // per)
            if used:
                put(size, used * per, first, capacity - room, per)
                todo -= used * per
                give(room - per * size, first, used)
            if used < n and todo and todo < per:
                put(size, todo, first + used, capacity - room, todo)
                give(room - todo * size, first + used, 1)
                used, todo = used + 1, 0
            give(room, first + used, n - used)
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset; every sequence is gapless from 0.

    1. A histogram of lengths (at most ``capacity`` rows reach the driver).
    2. ``plan_packing`` on it: dominance reduction, then best fit.
    3. Each piece's rank within its length, counted in salted parts so that a length which many documents share
       is never one task's work, selects its place in the plan."""
    columns = pieces.columns
    salts = int(min(4096, max(64, pieces.count() // 50_000)))
    rows = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    part = rows.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r.length): int(r.n) for r in part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(plan_packing(counts, capacity))
    before = part.select("length", "__salt", (F.sum("n").over(W.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before"))
    inner = F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("__inner", inner).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__inner")).select(*columns, "__rank")
    table_ = np.asarray(plan, np.int64).reshape(-1, 6)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches):
        key = (table_[:, 0] << 44) + table_[:, 1]
        for b in batches:
            size, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("__rank").to_numpy(zero_copy_only=False)
            row = table_[np.searchsorted(key, (size << 44) + rank, "right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 3] + at // row[:, 5], row[:, 4] + at % row[:, 5] * size
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents packed into sequences.

    Null texts count as empty (one token, end_id). Repeated rows are packed each. An empty table gives
    an empty result. Very long texts are encoded whole, one at a time. Equal lengths are interchangeable: ids break ties. Extra
    columns are ignored."""
    return pack(table(token_pieces(docs, path, end_id, capacity, id_col, text_col), "token-pieces"), capacity)
