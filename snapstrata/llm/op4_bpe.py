"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from snapstrata.llm.common import BYTE_VALUE, flat, sliced
from snapstrata.llm.tokens import PLAIN_SPACE, WordEncoder, load

#: Mean chunk length in bytes (a power of two) and the bytes of remembered chunks in a worker.
MEAN_CHUNK, CACHE_BYTES = 1024, 48 << 20
#: Words on either side of a join that are encoded anew with it, if the window before did not agree.
WINDOWS = (1, 8)
_SPACE = re.compile(f"[{PLAIN_SPACE}]")
_GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear rolling hash of the 32 bytes that end at each byte, by doubling; earlier bytes count as absent."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)  # numpy evaluates the right side before it adds
    return h


def cut_points(data: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Ends of chunks that the content alone decides: after a byte whose gear hash is below 2**32 / mean."""
    return np.flatnonzero(gear(data) < np.uint32(2**32 // mean)) + 1


@dataclass
class _Chunk:
    """A chunk encoded by itself. Its text up to the first white space and from the last one on may belong to words that go on
    in its neighbours; ids are those of the words between."""

    head: str = ""
    tail: str = ""
    ids: bytes = b""
    first: tuple[list[str], list[bytes]] = ((), ())  # the outermost words between, and their ids
    last: tuple[list[str], list[bytes]] = ((), ())


class ChunkEncoder:
    """Encodes texts from chunks that are shared across documents; each remembered chunk is encoded once, by itself.

    At every join the tokenizer itself encodes a window anew: what lies between the words known on both sides, and with it
    the outermost of those words. Where the new ids begin with the left words' kept ids and end with the right words', old and new
    agree on both sides, and what stands between them is the join. Otherwise the window grows, and in the end the whole text
    is encoded at once."""

    def __init__(self, path: str, mean: int = MEAN_CHUNK, cache_bytes: int = CACHE_BYTES):
        self.words, self.mean, self.room = WordEncoder(path), mean, cache_bytes
        self.known: OrderedDict[bytes, _Chunk | None] = OrderedDict()
        self.used = self.hits = self.misses = 0
        self.agreed = dict.fromkeys(WINDOWS, 0)

    def chunk(self, text: str, raw: bytes) -> _Chunk | None:
        """None for a chunk without white space."""
        if raw in self.known:
            self.hits += 1
            self.known.move_to_end(raw)
            return self.known[raw]
        self.misses += 1
        first, found = _SPACE.search(text), None
        if first is not None:
            a, b = first.start(), max(text.rfind(c) for c in PLAIN_SPACE)
            words = self.words.words(text[a:b])
            ids = self.words.pieces(words)
            k = WINDOWS[-1]
            found = _Chunk(text[:a], text[b:], b"".join(ids), (words[:k], ids[:k]), (words[-k:], ids[-k:]))
        self.known[raw] = found
        self.used += self.size(raw)
        while self.used > self.room:
            old = next(iter(self.known))
            self.used -= self.size(old)
            del self.known[old]
        return found

    def size(self, raw: bytes) -> int:
        found = self.known[raw]
        return len(raw) + (0 if found is None else len(found.ids))

    def join(self, left: _Chunk, between: str, right: _Chunk) -> bytes | None:
        """The ids of the text between two chunks' known words; None if no window agrees with both."""
        if not between.strip(PLAIN_SPACE):
            return b""
        for k in WINDOWS:
            before, after = (list(left.last[0])[-k:], list(left.last[1])[-k:]), (list(right.first[0])[:k], list(right.first[1])[:k])
            head, tail = b"".join(before[1]), b"".join(after[1])
            # known words stand behind white space: that of between, or one space for what parts them
            new = self.words.anew(" ".join(before[0]) + between + (" " + " ".join(after[0]) if after[0] else ""))
            if len(new) >= len(head) + len(tail) and new.startswith(head) and new.endswith(tail):
                self.agreed[k] += 1
                return new[len(head) : len(new) - len(tail)]
        return None

    def encode(self, raw: bytes, cuts: np.ndarray) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; cuts: byte positions inside it, ascending."""
        out, between, left, at = [], [], _Chunk(), 0
        for end in [*cuts.tolist(), len(raw)]:
            # a cut inside a character moves behind it
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            if end <= at:
                continue
            piece = raw[at:end]
            text = piece.decode("utf-8", "replace")
            at = end
            right = self.chunk(text, piece)
            if right is None:
                between.append(text)
                continue
            between.append(right.head)
            joined = self.join(left, "".join(between), right)
            if joined is None:
                return self.words.anew(raw.decode("utf-8", "replace"))
            out += (joined, right.ids)
            left, between = right, [right.tail]
        joined = self.join(left, "".join(between), _Chunk())
        if joined is None:
            return self.words.anew(raw.decode("utf-8", "replace"))
        return b"".join([*out, joined])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if keep_ids), decoded (if keep_ids), ids_sha256, decoded_sha256; one row per document.

    ids are those of the file's tokenizer over the whole text without added special tokens; decoded is its
    decode(ids, skip_special_tokens=False). Null counts as an empty text (no ids). No shuffle; a
    worker holds one slice of texts (a long text alone) and a bounded store of chunks. Repeated rows give repeated results, an
    empty table an empty one; extra columns are ignored. A tokenizer file of another kind is an error."""
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, " + ("ids array<int>, decoded string, " if keep_ids else "") + "ids_sha256 string, decoded_sha256 string"
    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(lambda batches: _run(batches, path, keep_ids), schema)


_ENCODERS: dict[str, ChunkEncoder] = {}
_TABLES: dict[str, list[str]] = {}


def _decode(path: str, ids: bytes) -> str:
    """The tokenizer's decode; a tokenizer without a decoder joins tokens by spaces."""
    t = load(path)
    if t.decoder is not None:
        return t.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    if path not in _TABLES:
        _TABLES[path] = [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]
    return " ".join(map(_TABLES[path].__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _run(batches, path: str, keep_ids: bool):
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    encoder = _ENCODERS[path]
    for batch in batches:
        for part in sliced(batch):
            data, offsets = flat(part.column("text"))
            cuts = cut_points(data, encoder.mean)
            # the hash looks back 32 bytes; a cut nearer to a text's start would depend on its neighbour
            own = offsets[np.searchsorted(offsets, cuts, "left") - 1]
            cuts = cuts[cuts - own >= 32]
            where = np.searchsorted(cuts, offsets, "right")
            raw = data.tobytes()
            ns, all_ids, texts, hashes, decoded_hashes = [], [], [], [], []
            for k in range(part.num_rows):
                a, b = int(offsets[k]), int(offsets[k + 1])
                ids = encoder.encode(raw[a:b], cuts[where[k] : where[k + 1]] - a)
                text = _decode(path, ids)
                ns.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded_hashes.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                    texts.append(text)
            cols = [part.column("doc_id"), pa.array(ns, pa.int64())]
            cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if keep_ids else []
            names = ["doc_id", "n_tokens", *(["ids", "decoded"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(hashes, pa.string()), pa.array(decoded_hashes, pa.string())], names=names)
