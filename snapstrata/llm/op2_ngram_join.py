"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.llm import meet
from snapstrata.llm.common import BASE, components, dropped, flat, lower_table, mix, sliced, table, words
from snapstrata.llm.spans import keyed, one_of_each

#: Fixed: words are runs of other bytes than these; A-Z are lower-cased.
BLANK = b" \t\n\x0b\x0c\r"
#: Classes of equal sets that a task remembers to send once.
SEEN = 1_000_000
#: 64-bit words of a set's bitmap: where two bitmaps differ in more bits than linked sets can differ in shingles, sets do not link.
BITMAP = 16
#: Hubs of a posting in the second and later rounds.
HUBS = 8
#: Counters of the frequency sketch (4 MB whatever the corpus), its parts, and how many of them one task adds up.
COUNTERS, PARTS, ADDED = 1 << 20, 64, 64

_WORD = np.ones(256, bool)
_WORD[np.frombuffer(BLANK, np.uint8)] = False
_FOLD = lower_table()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its ascending distinct shingle hashes: of ``size`` words, or of all words where there are fewer."""
    _, _, h, text = words(data, offsets, _WORD, _FOLD)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    counts = np.diff(bounds)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * BASE + h[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for k, n in enumerate(counts.tolist()):
        a = int(bounds[k])
        if n >= size:
            out.append(np.unique(rolled[a : a + n - size + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for x in h[a : a + n]:
                whole = whole * BASE + x
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_class(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two numbers of 64 bits for equal sets; the first, cut to ``bits``, names the class unless others have it as well."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True) & ((1 << bits) - 1 if bits < 64 else -1), int.from_bytes(d[8:], "little", signed=True)


# Sizes in whole numbers: 100 * overlap >= t * union, t in hundredths.
def least_overlap(n, t: int):
    """ceil(t% of n): what a set of n shares at least with any partner."""
    return -(-t * n // 100)


def slack(n):
    """How many shared shingles are asked of a prefix: one and an eighth of the size."""
    return 1 + n // 8


def prefix_length(n, t: int):
    """Two sets that link share slack(smaller) of their so many first shingles, in any common order."""
    return n - least_overlap(n, t) + slack(n)


def _classes(batches, size: int, bits: int):
    for batch in batches:
        for part in sliced(batch):
            sets = shingle_sets(*flat(part.column("text")), size)
            names = [set_class(s, bits) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rk"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1))], names=["doc_id", "rk", "n", "cls", "alt"])


def _prefixes(batches, size: int, t: int, cells: int, bits: int, taken: set[int]):
    seen: set[int] = set()
    for batch in batches:
        for part in sliced(batch):
            keys, owners = [], []
            for s in shingle_sets(*flat(part.column("text")), size):
                if not len(s):
                    continue
                c, alt = set_class(s, bits)
                c = alt if c in taken else c
                if c not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    keys.append(s[: prefix_length(len(s), t)])
                    owners.append(np.full(len(keys[-1]), c, np.int64))
            if keys:
                key = np.concatenate(keys)
                yield meet.send(key, np.concatenate(owners), np.zeros(len(key), bool), cells)


def _sets(batches, size: int):
    for batch in batches:
        for part in sliced(batch):
            sets = shingle_sets(*flat(part.column("text")), size)
            yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("n"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(list(map(_bitmap, sets)), pa.list_(pa.int64()))], names=["cls", "n", "items", "bits"])


def _bitmap(s: np.ndarray) -> np.ndarray:
    on = np.zeros(64 * BITMAP, np.uint8)
    on[(mix(s) >> np.uint64(8)) % np.uint64(64 * BITMAP)] = 1
    return np.packbits(on).view(np.int64)


def _send_sets(batches, cells: int):
    for batch in batches:
        for part in sliced(batch, "items"):
            data, offsets = flat(part.column("items"))
            key = np.frombuffer(data.tobytes(), np.uint64)
            yield meet.send(key, np.repeat(part.column("cls").to_numpy(), np.diff(offsets) // 8), np.zeros(len(key), bool), cells)


def _counter(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(44)).astype(np.int64)


def _count(batches):
    """One row for each part of the sketch, with the number of the task."""
    from pyspark import TaskContext

    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(_counter(batch.column("keys").flatten().to_numpy().view(np.uint64)), minlength=COUNTERS)
    cut = COUNTERS // PARTS
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array([total[k * cut : (k + 1) * cut].astype("<u4").tobytes() for k in range(PARTS)], pa.binary())], names=["part", "task", "counts"])


def _add_counts(rows):
    import pandas as pd

    return pd.DataFrame({"part": [rows.part.iloc[0]], "task": [rows.task.iloc[0]], "counts": [np.sum([np.frombuffer(c, "<u4") for c in rows.counts], 0, np.uint64).clip(0, 2**32 - 1).astype("<u4").tobytes()]})


def _rarest(batches, t: int, counts: np.ndarray):
    """(cls, n, s, prefix): the s shared shingles of a class, rarest first, as far as a link must reach into them."""
    for batch in batches:
        lists, ns = batch.column("keys"), batch.column("n").to_pylist()
        s, out = [], []
        for k, n in enumerate(ns):
            key = lists[k].values.to_numpy().view(np.uint64)
            order = np.lexsort((key, counts[_counter(key)]))
            s.append(len(key))
            out.append(key[order[: len(key) - least_overlap(n, t) + 1]].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(s, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["cls", "n", "s", "prefix"])


def _verify(batches, t: int):
    for batch in batches:
        a, b = batch.column("items_a"), batch.column("items_b")
        ok = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            x, y = np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            ok[k] = 100 * both >= t * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "ok"])


class _Candidates:
    """What both forms of the join start from: member (doc_id, rk, n, cls), sets (cls, n, items, bits) of the classes that may link,
    grouped (cls, n, s, g, prefix) and posting (g, n, s, pos, token), one row per group and prefix shingle."""

    def __init__(self, docs: DataFrame, size: int, t: int, id_col: str, text_col: str, class_bits: int):
        rows = keyed(docs, id_col, text_col)
        kinds = dict(rows.dtypes)
        member = table(rows.select("doc_id", "rk", "text").mapInArrow(lambda b: _classes(b, size, class_bits), f"doc_id {kinds['doc_id']}, rk binary, n long, cls long, alt long"), "ngram-classes")
        named = member.where("cls is not null")
        # names that more than one class has: none or a few, as names have 64 bits
        taken = {r.cls for r in named.groupBy("cls").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select("cls").collect()}
        if taken:
            member = member.withColumn("cls", F.when(F.col("cls").isin(*taken), F.col("alt")).otherwise(F.col("cls")))
            named = member.where("cls is not null")
        classes = named.groupBy("cls").agg(F.min("n").alias("n"), F.min("rk").alias("rk"))
        cells = meet.buckets(docs, (member.agg(F.sum("n")).first()[0] or 0) * 3 // 8)
        sent = rows.select("text").mapInArrow(lambda b: _prefixes(b, size, t, cells, class_bits, taken), meet.SCHEMA)
        need = f"(1 + int((int(({t} * n + 99) / 100)) / 8))"
        alive = meet.shared_keys(sent, cells).drop("counts").withColumnRenamed("owner", "cls").join(classes, "cls").where(f"size(keys) >= {need}").select("cls", "n", "rk")
        # whole sets, once for each class that is still here
        one = rows.select("rk", "text").join(alive, "rk").dropDuplicates(["cls"])
        sets = table(one.select("cls", "n", "text").mapInArrow(lambda b: _sets(b, size), "cls long, n long, items binary, bits array<long>"), "ngram-sets")
        cells = meet.buckets(docs, sets.agg(F.sum("n")).first()[0] or 0)
        again = meet.shared_keys(sets.select("cls", "items").mapInArrow(lambda b: _send_sets(b, cells), meet.SCHEMA), cells).drop("counts").withColumnRenamed("owner", "cls")
        shared = table(again.join(sets.select("cls", "n"), "cls").where(f"100 * size(keys) >= {t} * n").select("cls", "n", "keys"), "ngram-shared")
        schema = "part int, task int, counts binary"
        parts = shared.select("keys").mapInArrow(_count, schema)
        for _ in range(3):  # at most ADDED rows in a group up to ADDED ** 3 tasks
            parts = parts.withColumn("task", (F.col("task") / ADDED).cast("int")).groupBy("part", "task").applyInPandas(_add_counts, schema)
        parts = parts.groupBy("part").applyInPandas(_add_counts, schema).orderBy("part").collect()  # PARTS rows, 4 MB in all
        counts = np.frombuffer(b"".join(bytes(r.counts) for r in parts), "<u4") if parts else np.zeros(COUNTERS, np.uint32)
        prefix = shared.mapInArrow(lambda b: _rarest(b, t, counts), "cls long, n long, s long, prefix array<long>")
        prefix = table(prefix.withColumn("sig", F.xxhash64("prefix")), "ngram-prefix")
        group = prefix.groupBy("sig", "n").agg(F.min("cls").alias("g"))
        grouped = table(prefix.join(group, ["sig", "n"]).select("cls", "n", "s", "g", "prefix"), "ngram-groups")
        dropped(shared, prefix)
        # a group's members may share more than its first: the most that any shares
        most = grouped.groupBy("g").agg(F.max("s").alias("most"))
        self.posting = table(grouped.where("cls = g").join(most, "g").select("g", "n", F.col("most").alias("s"), F.posexplode("prefix").alias("pos", "token")), "ngram-postings")
        self.member, self.sets, self.grouped, self.t = member.drop("alt"), sets, grouped, t
        # sizes allow a link, and behind the rarest common shingle both still share as much as it takes
        self.fits = f"100 * least(n, hn) >= {t} * greatest(n, hn) and {100 + t} * least(s - pos, hs - hpos) >= {t} * (n + hn)"
        # linked sets differ in (n + hn) * (100 - t) / (100 + t) shingles at most, and in as many bits
        differ = " + ".join(f"bit_count(bits[{k}] ^ hbits[{k}])" for k in range(BITMAP))
        self.close = f"{100 + t} * ({differ}) <= {100 - t} * (n + hn)"

    def verified(self, pairs: DataFrame, tag: str) -> DataFrame:
        """a, b, ok of pairs (a, b) of classes, by their whole sets."""
        t = self.t
        left = self.sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
        right = self.sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
        both = pairs.join(left, "a").join(right, "b")
        return table(both.select("a", "b", "items_a", "items_b").mapInArrow(lambda x: _verify(x, t), "a long, b long, ok boolean"), tag)


def jaccard_pairs(docs: DataFrame, size: int = 5, t: int = 75, id_col: str = "doc_id", text_col: str = "text", class_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every link between different sets as a pair of classes (a < b), and doc_id, n_shingles, class_id of
    every row. The join in full, with as many rows as there are such links; ``jaccard_components`` needs but a few of them.

    Groups (same prefix and size) are paired by prefix shingle where sizes, shared counts and positions allow a link;
    pairs of groups and the members of one group are expanded and verified. Nulls, short texts, repeated rows, empty tables and
    extra columns are handled as in ``jaccard_components``."""
    c = _Candidates(docs, size, t, id_col, text_col, class_bits)
    y = c.posting.select("token", F.col("g").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"), F.col("pos").alias("hpos"))
    met = c.posting.join(y, "token").where(f"g < h and {c.fits}").select("g", "h").distinct()
    named = c.grouped.select("g", "cls", "n").join(c.sets.select("cls", "bits"), "cls")
    one = named.select("g", F.col("cls").alias("x"), "n", "bits")
    two = named.select(F.col("g").alias("h"), F.col("cls").alias("y"), F.col("n").alias("hn"), F.col("bits").alias("hbits"))
    across = met.join(one, "g").join(two, "h").where(c.close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    inside = one.join(two, (one.g == two.h) & (one.x < two.y)).where(c.close).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = c.verified(across.unionByName(inside), "ngram-pairs").where("ok").select("a", "b")
    return pairs, c.member.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"))


def jaccard_components(docs: DataFrame, size: int = 5, t: int = 75, stars: int = 2, id_col: str = "doc_id", text_col: str = "text", row_keys: bool = False, class_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id; one row per row of docs.

    Two texts link when 100 * |A and B| >= t * |A or B| for their sets of distinct shingles of ``size`` words (a shorter text:
    all its words as one); without words (null, empty) a text links with nothing. class_id names equal sets (null
    without words), component_id is the smallest id reachable by links.

    1. Equal sets collapse into classes by a 64-bit digest.
    2. Each class sends its prefix, the first shingles in hash order, to one meeting of equal shingles over the whole
       corpus. The prefix is longer than the shortest valid one by slack(n); in return a class needs that many
       shared shingles to stay. Texts that share only a passage go here.
    3. Whole sets of those that stay meet once more. A class that shares less than t% of its set is done; a
       sketch of fixed size, counted over all of them, orders shared shingles rarest first, and the prefix
       principle holds once more among them. Classes with identical prefixes and size form one group.
    4. Groups meet by prefix shingle, if their sizes, shared counts and the shingle's positions allow a link. Within a posting every group is first
       paired with one hub only (at first the one that shares most of its set, the likely original), groups are expanded and their pairs verified on whole sets, and links join components; ``stars`` such
       rounds (later ones with HUBS hubs) leave near copies in one component. All pairs of a posting that are then still in
       different components are verified too, if their bitmaps do not rule a link out, so no link between components is lost, while
       pairs inside one need no look.
    Hashes of 64 bits stand for shingles; classes have 128 (``class_bits`` is there to force names to collide). Rows with one id are rows of their own; a null id never is a component's name
    unless all its ids are null. Repeated rows are rows of one class. Long texts are read whole, by slices of rows; extra columns
    are ignored. An empty table gives an empty result. With row_keys: rk and keep_rk as well, the keys
    (spans.row_key) of the row and of its component's first row."""
    c = _Candidates(docs, size, t, id_col, text_col, class_bits)
    member, grouped, posting, fits, verified = c.member, c.grouped, c.posting, c.fits, c.verified
    nodes = grouped.select(F.col("cls").alias("id"))
    inside = grouped.where("cls <> g").select(F.least("cls", "g").alias("a"), F.greatest("cls", "g").alias("b"))
    tried, label = None, grouped.select("cls", F.col("cls").alias("label"))
    for k in range(stars):
        spread = posting.join(label.select(F.col("cls").alias("g"), "label"), "g")
        rank = F.struct((F.col("s") / F.col("n") if k == 0 else F.xxhash64("g", F.lit(k))).alias("rank"), "g")
        mixed = spread.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
        hub = spread.groupBy("token", F.pmod(F.xxhash64("g", F.lit(-k)), F.lit(HUBS if k else 1)).alias("part")).agg(F.max_by(F.struct("g", "n", "s", "pos", "label"), rank).alias("hub")).join(mixed, "token", "left_semi")
        hub = hub.select("token", F.col("hub.g").alias("hg"), F.col("hub.n").alias("hn"), F.col("hub.s").alias("hs"), F.col("hub.pos").alias("hpos"), F.col("hub.label").alias("hl"))
        pairs = spread.join(hub, "token").where(f"label <> hl and {fits}")
        pairs = pairs.select(F.least("g", "hg").alias("a"), F.greatest("g", "hg").alias("b"))
        pairs = (pairs if k else pairs.unionByName(inside)).distinct()
        pairs = pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        new = verified(pairs, f"ngram-star{k}")
        tried = new if tried is None else tried.unionByName(new)
        label = table(components(nodes, tried.where("ok").select("a", "b"), f"ngram-cc{k}").select(F.col("id").alias("cls"), F.col("component").alias("label")), f"ngram-label{k}")
    # what is left: pairs of one posting, groups expanded, in different components. Members of a posting's largest component
    # need not meet one another; a pair comes from its first common shingle alone, and only if its bitmaps are close
    size_of = label.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    spread = grouped.select("cls", "n", "s", F.posexplode("prefix").alias("pos", "token")).join(label.join(size_of, "label"), "cls")
    mixed = spread.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("label", F.struct("size", "label")).alias("top")).where("lo <> hi").select("token", "top")
    x = table(spread.drop("size").join(mixed, "token"), "ngram-mixed")
    # bitmaps and prefixes for the classes of such postings alone
    x = x.join(c.sets.select("cls", "bits"), "cls").join(grouped.select("cls", "prefix"), "cls")
    y = x.select("token", F.col("cls").alias("hc"), F.col("n").alias("hn"), F.col("s").alias("hs"), F.col("pos").alias("hpos"), F.col("label").alias("hl"), F.col("bits").alias("hbits"), F.col("prefix").alias("hprefix"))
    once = "(hl = top or label < hl) and label <> hl"
    rest = x.where("label <> top").join(y, "token").where(f"{once} and {fits} and {c.close} and array_intersect(prefix, hprefix)[0] = token").select(F.least("cls", "hc").alias("a"), F.greatest("cls", "hc").alias("b")).distinct()
    last = verified(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "ngram-rest")
    links = last.where("ok")
    if links.limit(1).count():
        label = components(nodes, tried.where("ok").select("a", "b").unionByName(links.select("a", "b")), "ngram-cc").select(F.col("id").alias("cls"), F.col("component").alias("label"))
    named = member.join(label, "cls", "left").select("doc_id", "rk", "n", "cls", F.coalesce("label", "cls").alias("root"))
    named = table(named, "ngram-named")
    # a table of its own, so that adaptive execution can split a root that many rows have
    first = table(named.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("first")), "ngram-first")
    out = named.join(first, "root", "left")
    keys = ["rk", F.coalesce("first.rk", "rk").alias("keep_rk")] if row_keys else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), *keys)


def near_dedup(docs: DataFrame, size: int = 5, t: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that with the smallest id. Of rows that agree in id and text one stays."""
    found = jaccard_components(docs, size, t, id_col=id_col, text_col=text_col, row_keys=True)
    return one_of_each(docs, found.where("rk = keep_rk").select("rk"), id_col, text_col)
