"""Exact encoding with public tokenizer files, faster by reuse: texts are cut where the tokenizer itself
always cuts, and the ids of a piece are remembered."""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by a worker before it forgets them all, and the longest piece remembered, in characters.
CACHE_PIECES, CACHE_CHARS = 800_000, 64

#: White space, or a run of anything else with one space before it: cuts that byte-level BPE makes as well.
_BYTE_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these four as white space; the tokenizers do not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters that are white space for everyone; texts may be cut around them for a tokenizer that drops white space.
PLAIN_SPACE = " \t\n\r"
_WORDS = re.compile(r"[^ \t\n\r]+")
#: Other characters at which str.split() cuts.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Characters that no normal form changes, alone or beside each other, and that each have one character as their small letter: ASCII
#: without white space and controls, Latin and Cyrillic letters, common punctuation.
_LETTERS = "\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f\u0400-\u045f"
_EASY = re.compile(f"[!-~{_LETTERS}¡«»¿–—‘’“”…]+")

#: Fixed: how byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed: the declarations of tokenizer files that the two encoders stand for. Texts may be cut around white space only under these.
BYTE_LEVEL = {"normalizer": [], "pre_tokenizer": [("ByteLevel", None)]}
WORD_LEVEL = {"normalizer": [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)], "pre_tokenizer": [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)]}

#: How WORD_LEVEL cuts a word of easy characters in small letters, and the settings under which it does.
_WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^a-z{_LETTERS}0-9]+")
_WORD_SETTINGS = [
    {"type": "Split", "pattern": {"Regex": WORD_LEVEL["pre_tokenizer"][0][1]}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_LOADED: dict[str, object] = {}


def declared(tokenizer) -> dict[str, list]:
    """(type, pattern) of a tokenizer's normalizers and pre-tokenizers, in order."""
    settings = json.loads(tokenizer.to_str())
    out = {}
    for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")):
        found = settings[part] or {"type": "Sequence", inner: []}
        out[part] = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in found.get(inner, [found])]
    return out


def require(tokenizer, kind: dict[str, list], path: str) -> None:
    if declared(tokenizer) != kind:
        raise ValueError(f"{path} normalises or cuts texts in another way than this encoder: {declared(tokenizer)}")


def load(path: str):
    """The tokenizer of a file, without truncation or padding; once per worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


class _Cache(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        out = self.ids(piece)
        self.keep(piece, out)
        return out

    def keep(self, piece: str, out: bytes) -> None:
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _byte_ranks(tokenizer) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE whose ids follow its merges; None if they do not."""
    model = json.loads(tokenizer.to_str())["model"]
    byte_of = {c: b for b, c in enumerate(_byte_chars())}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    if any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merged)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class ByteLevelEncoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False).ids gives them for a byte-level BPE file.

    New pieces are encoded by the same merges in tiktoken's core, which starts faster on a short string; texts
    that hold a special token or odd white space go whole to the tokenizers library."""

    def __init__(self, path: str):
        self.cache = _Cache(load(path))
        require(self.cache.tokenizer, BYTE_LEVEL, path)
        special = [t.content for t in self.cache.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_ODD_SPACE.pattern, *map(re.escape, special)]))
        ranks = _byte_ranks(self.cache.tokenizer)
        if ranks is not None:
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.cache.ids = lambda text: np.asarray(core.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.whole.search(text):
            return _Cache.ids(self.cache, text)
        return b"".join(map(self.cache.__getitem__, _BYTE_PIECES.findall(text)))


class WordEncoder:
    """Ids of a BPE file whose tokenizer cuts at, and drops, white space.

    A new word of easy characters is put in small letters and cut here, as the file declares it, and the file's own model merges each
    piece; every other word goes to the whole tokenizer."""

    def __init__(self, path: str):
        self.cache = _Cache(load(path))
        t = self.cache.tokenizer
        require(t, WORD_LEVEL, path)
        self.special = re.compile("|".join(re.escape(x.content.lower()) for x in t.get_added_tokens_decoder().values()) or "(?!)")
        if json.loads(t.to_str())["pre_tokenizer"]["pretokenizers"] == _WORD_SETTINGS:
            self.model, self.chars = t.model, dict(enumerate(_byte_chars()))
            self.cache.ids = self.word

    def words(self, text: str) -> list[str]:
        return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()

    def word(self, word: str) -> bytes:
        """The ids of a new word."""
        small = word.lower()
        if not _EASY.fullmatch(word) or self.special.search(small):
            return self.anew(word)
        return b"".join(map(self.piece, _WORD_PIECES.findall(small)))

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, which is a word as well."""
        out = self.cache.get(piece)
        if out is None:
            # printable ASCII stands for itself
            chars = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.chars)
            ids = [x.id for x in self.model.tokenize(chars)]
            out = struct.pack(f"<{len(ids)}I", *ids)
            self.cache.keep(piece, out)
        return out

    def pieces(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        return list(map(self.cache.__getitem__, words))

    def anew(self, text: str) -> bytes:
        """The ids of a text as the tokenizer itself gives them, whatever is remembered."""
        return np.asarray(self.cache.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(self.words(text)))
