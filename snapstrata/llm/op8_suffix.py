"""Suffix-array deduplication with a run-length index: long matches in repetitive corpora.

Texts are cut into fragments that keep equal strings together, so that the index of one bucket decides all
strings of that bucket: every string of ``length`` bytes goes where its least k-gram hash sends it, and
strings with the same least k-gram that follow one another travel as one fragment."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.llm import meet
from snapstrata.llm.common import BYTE_VALUE, dropped, flat, forget, mix, powers, sliced, table
from snapstrata.llm.spans import covered, keyed, remove_spans

#: Bytes of the k-grams whose hashes route strings, and fragment bytes indexed at a time (more for one k-gram).
GRAM, BLOCK_BYTES = 16, 1 << 20
#: A k-gram in more different texts than about this is hot: its strings travel one by one, each by its own hash. So many k-grams,
#: the hottest, can be hot (8 bytes each reach the workers); what is beyond them is rarer than all keys / HOT_GRAMS.
HOT, HOT_GRAMS = 4096, 1 << 16


def least_grams(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments: (text index, first byte in the text, number of strings, least k-gram hash, whether that k-gram
    may be in the fragment twice, as in periodic text)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), none.astype(bool)
    h, k = BYTE_VALUE[data], 1
    while k < GRAM:
        h = h[:-k] * powers(GRAM + 1)[k] + h[k:]
        k *= 2
    gram = h = mix(h)
    k, span = 1, length - GRAM + 1
    while 2 * k <= span:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    if k < span:
        h = np.minimum(h[: len(h) - (span - k)], h[span - k :])
    # k-grams that are least in some string; neighbours of one value stand in one fragment
    top, k = np.concatenate([np.zeros(span - 1, np.uint64), h, np.zeros(span - 1, np.uint64)]), 1
    while 2 * k <= span:
        top = np.maximum(top[:-k], top[k:])
        k *= 2
    if k < span:
        top = np.maximum(top[: len(top) - (span - k)], top[span - k :])
    least = np.flatnonzero(gram == top)
    near = (np.diff(least) <= span) & (gram[least[1:]] == gram[least[:-1]])
    periodic = np.unique(gram[least[1:][near]])
    # h[i]: of the string that starts at i; strings that leave their text do not count
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
    ok = np.arange(len(h)) + length <= offsets[text + 1]
    new = ok.copy()
    new[1:] &= (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    end = ok.copy()
    end[:-1] &= new[1:] | ~ok[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    return text[first], first - offsets[text[first]], last - first + 1, h[first], np.isin(h[first], periodic)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) by prefix doubling from eight bytes on; suffixes whose rank is settled
    are not sorted again."""
    n = len(text)
    key = eight_bytes(text)
    order = np.argsort(key)
    key, slots, rank, step = key[order], np.arange(n), np.empty(n, np.int64), 8
    where = order
    while True:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        rank[where] = np.repeat(slots[start], size)  # a group is named by its first slot
        open_ = np.repeat(size > 1, size)
        slots, where = slots[open_], where[open_]
        if not len(slots):
            return order, rank
        after = where + step
        second = np.zeros(len(where), np.int64)
        inside = after < n
        second[inside] = rank[after[inside]] + 1
        key = rank[where].astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        again = np.argsort(key)
        key, where = key[again], where[again]
        order[slots] = where
        step *= 2


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)


def common_prefix(text: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of different suffixes; words: eight_bytes(text)."""
    n, out = len(text), np.zeros(len(a), np.int64)
    for values, step in ((words, 8), (text, 1)):
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            same = (x + step <= n) & (y + step <= n)
            same[same] = values[x[same]] == values[y[same]]
            live = live[same]
            out[live] += step
    return out


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of a text with a sample at the end of every run.

    Kept are the runs' bytes and, for each run border, one text position with its lexicographic predecessor and the
    length of their common prefix: as many samples as runs, few in repetitive texts. Between samples, predecessor
    and length follow by counting, as text neighbours inside one run have neighbouring predecessors."""

    def __init__(self, text: np.ndarray):
        order, rank = suffix_array(text)
        bwt = text[order - 1]
        head = np.ones(len(text), bool)
        head[1:] = bwt[1:] != bwt[:-1]
        runs = np.flatnonzero(head)
        self.run_bytes, self.run_starts = bwt[runs], runs
        at = np.sort((order[runs] - 1) % len(text))
        at = at if at[-1] == len(text) - 1 else np.append(at, len(text) - 1)
        r = rank[at]
        prev = np.where(r > 0, order[r - 1], -1)
        lcp = np.zeros(len(at), np.int64)
        some = prev >= 0
        lcp[some] = common_prefix(text, eight_bytes(text), at[some], prev[some])
        self.at, self.prev, self.lcp, self.n = at, prev, lcp, len(text)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position, streamed from the samples: its lexicographic predecessor and their common length."""
        i = np.arange(self.n)
        s = np.searchsorted(self.at, i)
        back = self.at[s] - i
        prev = np.where(self.prev[s] >= 0, self.prev[s] - back, -1)
        return prev, np.where(prev >= 0, self.lcp[s] + back, 0)


def earlier_matches(parts: list[bytes], ords: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(part, first, stop): runs of strings of the parts that also start earlier in another place, in text bytes."""
    sizes = np.asarray([len(p) for p in parts])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # a byte that UTF-8 never has
    begin = np.cumsum(sizes + 1) - sizes - 1
    prev, common = RunLengthIndex(text).matching_statistics()
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    i = np.arange(len(text))
    valid = i + length <= begin[part] + sizes[part]
    linked = valid & (common >= length)
    if not linked.any():
        return []
    # equal strings form chains of predecessors; each finds the end of its chain by pointer doubling
    root = np.where(linked, prev, i)
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    chained = linked.copy()
    chained[prev[linked]] = True
    members = np.flatnonzero(chained)
    group, doc = root[members], ords[part[members]]
    place = starts[part[members]] + members - begin[part[members]]
    order = np.lexsort((place, doc, group))
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = (doc[order] > doc[order][lead]) | (place[order] > place[order][lead])
    hit = np.sort(members[order][later])
    if not len(hit):
        return []
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (part[hit[1:]] != part[hit[:-1]])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(hit)) - 1
    p = part[hit[a]]
    shift = starts[p] - begin[p]
    return list(zip(p.tolist(), (hit[a] + shift).tolist(), (hit[b] + shift + length).tolist(), strict=True))


def _grams(batches, length: int, n: int):
    """Least k-gram hashes of each text, packed for the meeting of equal ones; copies of a text share an owner."""
    for batch in batches:
        for part in sliced(batch):
            data, offsets = flat(part.column("text"))
            text, _, _, h, twice = least_grams(data, offsets, length)
            copy = part.column("copy").to_numpy()[text]
            order = np.lexsort((~twice, text, copy, h))
            text, copy, h, twice = text[order], copy[order], h[order], twice[order]
            own = np.ones(len(h), bool)
            own[1:] = (h[1:] != h[:-1]) | (copy[1:] != copy[:-1])
            twice[:-1] |= ~own[1:] & (text[1:] == text[:-1])  # in two fragments of one text
            first = np.maximum.accumulate(np.where(own, np.arange(len(h)), 0))
            any_twice = np.zeros(len(h), bool)
            np.logical_or.at(any_twice, first, twice)
            yield meet.send(h[own], copy[own], any_twice[own], n)


def _fragments(batches, length: int, hot: set[int]):
    """(h, ord, rk, start, bytes, own, gone): fragments whose k-gram repeats, or their single strings where it is hot. Of
    equal ones in a slice of texts only the earliest carries its bytes on; the others are already decided and go, joined to
    spans, in one row a text (bytes null, gone: starts and stops), dealt out evenly."""
    for batch in batches:
        for part in sliced(batch):
            data, offsets = flat(part.column("text"))
            text, start, count, h, twice = least_grams(data, offsets, length)
            wanted = part.column("grams")
            lens = np.asarray(wanted.value_lengths().fill_null(0))
            row = np.repeat(np.arange(part.num_rows), lens)
            # pairs (text, k-gram) as one sortable key each
            want = np.sort(mix(wanted.flatten().to_numpy().view(np.uint64) + mix(row.astype(np.uint64))))
            own = mix(h + mix(text.astype(np.uint64)))
            at = np.minimum(np.searchsorted(want, own), len(want) - 1)
            keep = np.flatnonzero(want[at] == own) if len(want) else np.zeros(0, np.int64)
            raw, ords, rks = data.tobytes(), part.column("ord").to_numpy(), part.column("rk").to_pylist()
            best: dict[bytes, tuple] = {}
            gone: dict[bytes, tuple[list, list]] = {}
            out = []

            def meet_earlier(found: dict[bytes, tuple], body: bytes, me: tuple) -> None:
                """The earliest of equal ones stays in found; any later one is put as decided."""
                other = found.get(body)
                if other is None or me[:2] < other[:2]:
                    found[body] = me
                    me = other
                if me is not None and me[:2] != found[body][:2]:
                    starts, stops = gone.setdefault(me[2], ([], []))
                    starts.append(me[1])
                    stops.append(me[1] + len(body))

            for j in keep.tolist():
                t, s, n = int(text[j]), int(start[j]), int(count[j]) + length - 1
                body = raw[int(offsets[t]) + s : int(offsets[t]) + s + n]
                meet_earlier(best, body, (int(ords[t]), s, rks[t], int(h[j].view(np.int64)), bool(twice[j])))
            singles: dict[bytes, tuple] = {}
            for body, (o, s, k, key, own) in best.items():
                if key not in hot:
                    out.append((key, o, k, s, body, own, None))
                    continue
                for i in range(len(body) - length + 1):
                    meet_earlier(singles, body[i : i + length], (o, s + i, k))
            for body, (o, s, k) in singles.items():
                out.append((int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True), o, k, s, body, False, None))
            for k, (starts, stops) in gone.items():
                spans = np.asarray(covered(np.asarray(starts, np.int32), np.asarray(stops, np.int32)), np.int32)
                out.append((int.from_bytes(k[:8], "little", signed=True), 0, k, 0, None, False, spans.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=["h", "ord", "rk", "start", "bytes", "own", "gone"])


def _decide(leads: dict[bytes, list], periodic: set[bytes], length: int):
    """Spans to remove among different fragments, each with its earliest rows (h, ord, start, stop, rk)."""
    out, parts, lead = [], [], []
    variants: dict[int, int] = {}
    for seen in leads.values():
        variants[seen[0][0]] = variants.get(seen[0][0], 0) + 1
    for body, seen in leads.items():
        if variants[seen[0][0]] > 1 or body in periodic:  # other strings could be equal to some of its own
            parts.append(body)
            lead.append(seen[0])
    if parts:
        for p, a, b in earlier_matches(parts, np.asarray([x[1] for x in lead]), np.asarray([x[2] for x in lead]), length):
            out += [(x[4], a, b) for x in leads[parts[p]]]
    return _spans(out)


def _spans(rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.int32())], names=["rk", "start", "stop"])


def _index(batches, length: int, block: int):
    """Rows sorted by h, bytes, ord and start; blocks end between two values of h. Of equal fragments the first leads, later
    ones are decided at once, so that a block holds different fragments only."""
    leads: dict[bytes, list] = {}
    periodic: set[bytes] = set()
    used, last = 0, None
    for batch in batches:
        done = []
        for h, o, k, s, body, own, gone in zip(*(batch.column(c).to_pylist() for c in ("h", "ord", "rk", "start", "bytes", "own", "gone")), strict=True):
            if body is None:
                done += [(k, a, b) for a, b in np.frombuffer(gone, np.int32).reshape(2, -1).T.tolist()]
                continue
            e = s + len(body)
            if used > block and h != last:
                yield _decide(leads, periodic, length)
                leads, periodic, used = {}, set(), 0
            last = h
            if own:
                periodic.add(body)
            seen = leads.get(body)
            if seen is None:
                leads[body] = [(h, o, s, e, k)]
                used += len(body)
            elif (o, s) == seen[0][1:3]:  # rows of one id
                seen.append((h, o, s, e, k))
            else:
                done.append((k, s, e))
        yield _spans(done)
    if leads:
        yield _decide(leads, periodic, length)


def repeated_spans(rows: DataFrame, length: int = 100, block: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(rk, start, stop): bytes covered by strings of ``length`` bytes that also start earlier. rows: ord, rk, text.

    A table; what led to it is deleted."""
    text = F.col("text")
    place = rows.select("rk", "ord", F.xxhash64(text).alias("copy"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("sha"), F.octet_length(text).alias("stop"))
    place = table(place.where(F.col("stop") >= length), "suffix-places")
    total = place.agg(F.sum(F.col("stop").cast("long"))).first()[0] or 0
    cells = meet.buckets(rows, total // ((length - GRAM + 2) // 2))  # one fragment in so many bytes
    sent = rows.select(F.xxhash64(text).alias("copy"), "text").mapInArrow(lambda b: _grams(b, length, cells), meet.SCHEMA)
    # of equal texts the first row speaks for all; the others are covered from end to end
    first = table(place.groupBy("sha").agg(F.min(F.struct("ord", "rk", "copy")).alias("first"), F.count(F.lit(1)).alias("n")), "suffix-first")
    copies = place.join(first.where("n > 1"), "sha").where("ord > first.ord").select("rk", F.lit(0).alias("start"), F.col("stop").cast("int").alias("stop"))
    shared = table(meet.shared_keys(sent, cells, hot), "suffix-shared")
    forget(rows.sparkSession)
    common = shared.where("owner is null").select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    common = {int(r.g) for r in common.select(F.col("x.keys").alias("g")).orderBy(F.desc("x.counts"), "g").limit(HOT_GRAMS).collect()}
    wanted = shared.where("owner is not null").withColumnRenamed("owner", "copy").join(first.select("first.copy", "first.rk"), "copy").select("rk", F.col("keys").alias("grams"))
    fragments = rows.select("rk", "ord", "text").join(wanted, "rk").mapInArrow(lambda b: _fragments(b, length, common), "h long, ord long, rk binary, start int, bytes binary, own boolean, gone binary")
    spans = fragments.repartition(cells, "h").sortWithinPartitions("h", "bytes", "ord", "start").mapInArrow(lambda b: _index(b, length, block), "rk binary, start int, stop int")
    out = table(spans.unionByName(copies), "suffix-spans")
    dropped(place, first, shared)
    forget(rows.sparkSession)
    return out


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, rk, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, cut at whole characters); one row per row of docs.

    rk is the row key of spans.row_key. Texts are bytes in UTF-8 (null: empty). Removed is every byte covered by a string of ``length`` bytes that also
    starts earlier: in a smaller id, or in the same text further left. Judged on the input, exact
    by comparing the strings themselves.

    0. Equal texts: all but the first are covered from end to end, and only the first goes on.
    1. Least k-gram hashes of all strings; those that occur twice anywhere are found by one shuffle of hashes.
    2. Fragments around them go to buckets by that hash (combined before the shuffle: a passage that many
       documents share sends one row a slice of texts). Where a k-gram is hot, as at the ends of such a passage with a
       different neighbourhood in each document, its strings go one by one by their own hashes.
    3. Each bucket builds its run-length index and streams matching statistics; strings with a match of full
       length are chained, and all but the earliest are marked.
    Rows with one id count as one place: equal starts are not compared, and repeated rows are cut alike. A null id comes last.
    Empty and short texts stay; long ones are read whole, by slices of rows; an empty table gives an empty result; extra columns
    are ignored."""
    rows = keyed(docs, id_col, text_col)
    return remove_spans(rows, repeated_spans(rows, length, hot=hot), keep_text)
