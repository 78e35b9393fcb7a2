"""Finds, by one packed shuffle, the keys that several owners hold.

A row of the shuffle is a bucket of a slice of texts: thousands of 64-bit keys with their owners as bytes. A key
that a slice already sees with two owners is known to be shared; one entry then tells the other slices, the
rest of its entries are dealt out evenly, so that a key which a third of all owners hold loads no task. The
known byte of that entry also tells how many owners the slice has for the key, as a power of two."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from snapstrata.llm.common import mix

SCHEMA = "bucket int, keys binary, owners binary, known binary"
_SLOTS: dict[int, np.ndarray] = {}


#: Entries of one bucket, about 17 bytes each, that a worker holds and sorts.
ENTRIES = 8_000_000


def buckets(df: DataFrame, entries: int = 0) -> int:
    """As many as shuffle partitions, and more where so many entries would make a bucket too large for a worker."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES))


def _hash_int(v: np.ndarray) -> np.ndarray:
    """Spark's hash of an int column (Murmur3, seed 42)."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    k = turn(v.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def slots(n: int) -> np.ndarray:
    """For each of n shuffle partitions an int that hashing sends there, so that buckets fill partitions evenly."""
    if n not in _SLOTS:
        found, start = np.full(n, -1, np.int64), 0
        while (found < 0).any():
            v = np.arange(start, start + 16 * n + 64, dtype=np.int32)
            at = _hash_int(v).astype(np.int64) % n
            for p, x in zip(at[::-1].tolist(), v[::-1].tolist(), strict=True):
                if found[p] < start:
                    found[p] = x
            start += len(v)
        _SLOTS[n] = found.astype(np.int32)
    return _SLOTS[n]


def _packed(at: np.ndarray, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; the entries come sorted by bucket."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) if len(at) else first
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(slots(n)[at[first]], pa.int32()), *map(cut, columns.values())], names=["bucket", *columns])


def send(key: np.ndarray, owner: np.ndarray, known: np.ndarray, n: int) -> pa.RecordBatch:
    """Packed rows of a slice's entries; key (uint64) and owner (int64) should be distinct pairs."""
    order = np.argsort(key, kind="stable")
    key, owner, known = key[order], owner[order], known[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    known = np.where(known | np.repeat(size > 1, size), 1, 0).astype(np.uint8)
    known[new] += np.floor(np.log2(size)).astype(np.uint8)
    at = np.where(new, key, mix(owner.view(np.uint64) + key)) % np.uint64(n)
    order = np.lexsort((owner, at))  # equal owners together: they compress
    return _packed(at[order].astype(np.int64), n, keys=key[order], owners=owner[order], known=known[order])


def _meet(batches, n: int, hot: int):
    keys, owners, known = [], [], []
    for b in batches:
        keys += [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("keys")]
        owners += [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("owners")]
        known += [np.frombuffer(x.as_buffer(), np.uint8) for x in b.column("known")]
    if not keys:
        return
    key, owner, known = np.concatenate(keys), np.concatenate(owners), np.concatenate(known)
    order = np.lexsort((owner, key))
    key, owner, known = key[order], owner[order], known[order]
    if hot:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.add.reduceat(1 << np.maximum(known.astype(np.int64) - 1, 0), first) if len(key) else first
        common = np.flatnonzero(count > hot)
        if len(common):
            yield pa.RecordBatch.from_arrays([pa.array([int(slots(n)[0])], pa.int32()), pa.array([key[first[common]].tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([count[common].astype(np.int64).tobytes()], pa.binary())], names=["bucket", "keys", "owners", "counts"])
    known = known > 0
    met = (key[1:] == key[:-1]) & (owner[1:] != owner[:-1])
    known[1:] |= met
    known[:-1] |= met
    key, owner = key[known], owner[known]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    at = (mix(owner.view(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    out = _packed(at[order], n, keys=key[order], owners=owner[order])
    yield out.append_column("counts", pa.nulls(out.num_rows, pa.binary()))


def _gather(batches):
    """(owner, keys) of the owners of a bucket, and (null, keys, counts) of hot keys."""
    keys, owners = [], []
    names = ["owner", "keys", "counts"]
    for b in batches:
        for k, o, c in zip(b.column("keys"), b.column("owners"), b.column("counts"), strict=True):
            found = np.frombuffer(k.as_buffer(), np.uint64)
            if o.is_valid:
                keys.append(found)
                owners.append(np.frombuffer(o.as_buffer(), np.int64))
            else:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64())), pa.array([np.frombuffer(c.as_buffer(), np.int64)], pa.list_(pa.int64()))], names=names)
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    for a in range(0, len(first), 20_000):
        f = first[a : a + 20_000]
        end = first[a + 20_000] if a + 20_000 < len(first) else len(key)
        lists = pa.ListArray.from_arrays(pa.array(np.append(f, end) - f[0], pa.int32()), pa.array(key[f[0] : end].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(owner[f]), lists, pa.nulls(len(f), pa.list_(pa.int64()))], names=names)


def shared_keys(sent: DataFrame, n: int, hot: int = 0) -> DataFrame:
    """(owner, keys, counts): for every owner its keys that another owner holds as well, or that were sent as known, to n
    buckets. With ``hot`` also rows without owner: keys that more owners than that hold, and about how many (half as many at least).

    Both hops are packed, by key and then by owner, so rows grow with tasks and owners and not with their product."""
    met = sent.repartition(n, "bucket").mapInArrow(lambda b: _meet(b, n, hot), "bucket int, keys binary, owners binary, counts binary")
    return met.repartition(n, "bucket").mapInArrow(_gather, "owner long, keys array<long>, counts array<long>")
