"""Token ids of whole texts with a given ``tokenizers`` file, one BPE call per distinct word of a batch.

The tokenizer's pre-tokenizer never joins characters across white space, and its
normaliser treats each character (with its combining marks) on its own, so the
ids of a text are those of its white-space-separated pieces, concatenated. A
trailing ``.`` or ``,`` after an ASCII letter is a piece of its own as well. The
file's special tokens are cut out before anything else, as the library does: where
a text holds one's string it gives that token's id. A batch is cut into such
pieces, every distinct piece is encoded once, and the ids are gathered back.
``ids_of`` equals ``Tokenizer.from_file(path).encode(text).ids`` (tested).
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from tokenizers.models import BPE

from segspark.llm.textbytes import LOWER, NON_SPACE, U, as_bytes, chunks, mix64, prefix_hash, ragged, range_hash, spans

_loaded: dict = {}
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord("."), ord(",")]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str):
    """The tokenizer of this process for pieces between special tokens: what is left of their strings is ordinary text."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


@lru_cache
def specials(path: str) -> dict[bytes, int]:
    """Strings and ids of the special tokens, which match as they stand anywhere in a text."""
    import json
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("only added tokens that match exactly are supported")
    return {t["content"].encode(): t["id"] for t in added}


def special_hash(token_id: int) -> int:
    return int(mix64(np.array([token_id], np.uint64) + U(0x5DEECE66D))[0])


def special_spans(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the special tokens' strings, leftmost first, inside one document each."""
    found, raw = [], data.tobytes()
    for content, token_id in specials(path).items():
        at = raw.find(content)
        while at >= 0:
            found.append((at, -len(content), special_hash(token_id)))
            at = raw.find(content, at + 1)
    found.sort()
    out, end = [], 0
    for at, size, h in found:
        if at >= end and np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at - size, "left"):
            out.append((at, at - size, h))
            end = at - size
    s, e, h = zip(*out) if out else ((), (), ())
    return np.array(s, np.int64), np.array(e, np.int64), np.array(h, np.uint64)


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + n) for n, b in enumerate(rest)}}


_BYTE_CHARS = _byte_chars()


@lru_cache
def _clip_like(path: str) -> bool:
    """Whether the file lower-cases, splits at runs of letters and maps bytes to characters, as ``word_bpe_49k.json`` does."""
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return ("Lowercase" in str(spec["normalizer"]) and "[\\\\p{L}]+" in json.dumps(spec["pre_tokenizer"]) and "ByteLevel" in str(spec["pre_tokenizer"])
            and not spec["model"].get("ignore_merges"))


def _split_trailing(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray):
    """Cut the pieces ``word.`` and ``word,`` in two where an ASCII letter stands before the mark."""
    cut = (e - s > 1) & _PUNCT[data[e - 1]] & _LETTER[data[np.maximum(e - 2, 0)]]
    n = np.cumsum(cut)
    extra = np.concatenate([[0], n])
    at = np.arange(len(s)) + extra[:-1]
    starts, ends = np.empty(len(s) + extra[-1], np.int64), np.empty(len(s) + extra[-1], np.int64)
    starts[at], ends[at] = s, np.where(cut, e - 1, e)
    starts[at[cut] + 1], ends[at[cut] + 1] = e[cut] - 1, e[cut]
    return starts, ends, first + extra[first]


class _Pieces:
    """Ids of the distinct pieces met so far in this process, by piece hash; emptied beyond ``LIMIT`` pieces."""

    LIMIT = 2_000_000

    def __init__(self, path: str) -> None:
        self.path = path
        self.special = {special_hash(k): k for k in specials(path).values()}
        self.clear()

    def clear(self) -> None:
        self.hash, self.mark = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def _encode(self, words: list[str], hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t, got, rest = tokenizer(self.path), [None] * len(words), []
        plain = isinstance(t.model, BPE) and _clip_like(self.path)
        tokenize = t.model.tokenize
        for k, w in enumerate(words):
            if hashes[k] in self.special:
                got[k] = [self.special[hashes[k]]]
                continue
            # a lower-case word of letters is one pre-token: straight to the BPE model
            if plain and w.isalpha() and w.islower() and (w.isascii() or is_normalized("NFC", w)):
                got[k] = [x.id for x in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS))]
            else:
                rest.append(k)
        for k, x in zip(rest, t.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            got[k] = x.ids
        size = np.fromiter(map(len, got), np.int32, len(got))
        return size, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))

    def lookup(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray):
        """(begin, size) into ``flat`` for pieces with distinct hashes ``h`` (ascending) at raw[s:e]."""
        mark = ((e - s) << 16) | (raw[s].astype(np.int64) << 8) | raw[e - 1]
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        known = (self.hash[at] == h) & (self.mark[at] == mark) if len(self.hash) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        if len(new):
            text = raw.tobytes()
            size, flat = self._encode([text[a:b].decode("utf-8", "replace") for a, b in zip(s[new].tolist(), e[new].tolist())],
                                      h[new].tolist())
            if len(self.hash) + len(new) > self.LIMIT:
                old = np.flatnonzero(known)
                keep = ragged(self.begin[at[old]], self.size[at[old]])
                hash_, mark_, size_, flat_ = h[old], mark[old], self.size[at[old]], self.flat[keep]
            else:
                hash_, mark_, size_, flat_ = self.hash, self.mark, self.size, self.flat[ragged(self.begin, self.size)]
            self.hash, self.mark = np.concatenate([hash_, h[new]]), np.concatenate([mark_, mark[new]])
            self.size, self.flat = np.concatenate([size_, size]), np.concatenate([flat_, flat])
            self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
            order = np.argsort(self.hash, kind="stable")
            self.hash, self.mark, self.size, self.begin = self.hash[order], self.mark[order], self.size[order], self.begin[order]
            return self.lookup(raw, s, e, h)
        return self.begin[at], self.size[at]


_pieces: dict[str, _Pieces] = {}


def ids_of(column: pa.Array, path: str, end_id: int | None = None):
    """Yield (first row, end row, ids uint32, offsets) over runs of rows; ``end_id`` closes every document."""
    data, offsets = as_bytes(column)
    cache = _pieces.setdefault(path, _Pieces(path))
    for i, j, raw, off in chunks(data, offsets):
        at, end, own = special_spans(raw, off, path)
        raw = LOWER[raw]
        plain = raw
        if len(at):
            plain = raw.copy()
            plain[ragged(at, end - at)] = 32
        s, e, first = _split_trailing(plain, *spans(plain, off, NON_SPACE))
        h = range_hash(prefix_hash(raw), s, e)
        if len(at):
            s, e, h = np.concatenate([s, at]), np.concatenate([e, end]), np.concatenate([h, own])
            order = np.argsort(s, kind="stable")
            s, e, h = s[order], e[order], h[order]
            first = np.searchsorted(s, off).astype(np.int64)
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        one = order[new]
        back = np.empty(len(h), np.int64)
        back[order] = np.cumsum(new) - 1
        if not np.array_equal((e - s)[one][back], e - s):
            raise ValueError("two pieces of one hash")  # 2**-64 a pair
        begin, size = cache.lookup(raw, s[one], e[one], sorted_h[new])
        size = size.astype(np.int64)[back]
        if end_id is None:
            ids = cache.flat[ragged(begin[back], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[first]
        else:
            before = np.cumsum(size) - size
            ends = np.concatenate([before, [before[-1] + size[-1] if len(size) else 0]])[first] + np.arange(len(first))
            ids = np.full(ends[-1], end_id, np.uint32)
            inside = np.ones(len(ids), bool)
            inside[ends[1:] - 1] = False
            ids[inside] = cache.flat[ragged(begin[back], size)]
        yield i, j, ids.astype(np.uint32, copy=False), ends
