"""Token ids by the ``tokenizers`` library, with what repeats encoded once.

Two kinds of pre-tokenizer are known here, and both cut at a lone space or newline between two characters that aren't white
space, and before a mark after a letter. So a text's ids are those of its chunks in a row, and each distinct chunk goes to
the tokenizer once while it stays in a worker's lexicon. Chunks of up to 15 bytes are found there by their bytes, all those
of a slice of texts at a time. A plain Latin word goes to the model directly; every other chunk, every text with other white
space between chunks, and every text of another kind of tokenizer, is encoded as a whole.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode

import numpy as np

from loomwork.llm.textkit import LOWER, mix, slices

#: Slots of a lexicon, of which half are used at most; then it starts anew: the frequent chunks are back after a few texts.
SLOT_BITS = 21
#: Bytes of texts that are cut up at once.
CUT_BYTES = 1 << 19
#: Longest chunk found by its bytes; longer ones are looked up one by one.
KEY_BYTES = 15
#: Letters whose NFC form and lower case are one letter each.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = b".,;:!?"
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
_IS_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
_cached: dict[str, Encoder] = {}


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_CHARS = "".join(_byte_chars())


class Lexicon:
    """Ids of chunks: entry e has ``size[e]`` ids from ``first[e]`` on in ``ids``; a size of -1 stands for a chunk that its neighbours change.

    Keys are two 64-bit numbers: the first eight bytes, the others with a byte that tells whether a space comes before.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((1 << SLOT_BITS, 2), np.uint64)
        self.entry = np.zeros(1 << SLOT_BITS, np.int32)
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids, self.n_ids, self.n = np.zeros(1 << 14, np.uint32), 0, 0
        self.long: dict[tuple[bytes, bool], int] = {}

    def room(self) -> int:
        return max(0, (1 << SLOT_BITS - 1) - self.n)

    def add(self, found: list[list[int] | None]) -> np.ndarray:
        """Entries for lists of ids."""
        size = np.array([-1 if x is None else len(x) for x in found], np.int32)
        flat = np.array([i for x in found if x for i in x], np.uint32)
        for name, now, n in (("first", self.n, len(found)), ("size", self.n, len(found)), ("ids", self.n_ids, len(flat))):
            held = getattr(self, name)
            if now + n > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(now + n, held.dtype)]))
        out = np.arange(self.n, self.n + len(found))
        used = np.maximum(size, 0)
        self.size[out], self.first[out] = size, self.n_ids + np.cumsum(used) - used
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n, self.n_ids = self.n + len(found), self.n_ids + len(flat)
        return out

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (mix(keys[:, 0] + keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot = self._slots(keys)
        todo = None
        while True:
            held = self.keys[slot]
            hit = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1])
            at = np.flatnonzero(hit)
            out[at if todo is None else todo[at]] = self.entry[slot[at]]
            on = np.flatnonzero(~hit & (held[:, 1] != 0))
            if not len(on):
                return out
            todo = on if todo is None else todo[on]
            keys, slot = keys[on], slot[on] + 1 & (1 << SLOT_BITS) - 1

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Store keys that are all different and not there yet."""
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot, 1] == 0)
            _, one = np.unique(slot[free], return_index=True)
            now = free[one]
            self.keys[slot[now]], self.entry[slot[now]] = keys[now], entries[now]
            left = np.ones(len(keys), bool)
            left[now] = False
            keys, entries, slot = keys[left], entries[left], slot[left] + 1 & (1 << SLOT_BITS) - 1


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokenize = self.tokenizer.model.tokenize
        self.newline = self._list("\n") if self.kind == "bytes" else []
        self.marks = np.zeros(256, np.uint32)
        self.by_mark = self.kind is not None and all(len(self._list(chr(m))) == 1 for m in _MARKS) and len(self.newline) < 2
        if self.by_mark:
            self.marks[list(_MARKS)] = [self._list(chr(m))[0] for m in _MARKS]
        self.lexicon = Lexicon()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _cached:
            _cached[path] = cls(path)
        return _cached[path]

    def _list(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: bytes) -> bytes:
        return np.array(self._list(text.decode()), "<u4").tobytes()

    def _chunk(self, chunk: bytes, space: bool) -> list[int] | None:
        """Ids of a chunk, after a space or not; None if it begins or ends with white space, or holds a special token."""
        body = chunk.decode()
        if body.isascii() and body.isalpha():
            shown = body
        elif _WORD.fullmatch(body):
            shown = charmap_decode((body if self.kind == "bytes" else body.lower()).encode(), "strict", _CHARS)[0]
        elif body[0].isspace() or body[-1].isspace() or (self.special is not None and self.special.search(body)):
            return None
        else:
            return self._list(" " + body if space else body)
        return [t.id for t in self.tokenize("Ġ" + shown if space and self.kind == "bytes" else shown)]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of ``encode(text, add_special_tokens=False)`` of each text, given in UTF-8."""
        if not self.by_mark:
            return [self.whole(t) for t in texts]
        return [x for a, b in slices(texts, CUT_BYTES) for x in self._slice(texts[a:b])]

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        buf = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(16), np.uint8)
        if self.kind == "lower":
            buf = LOWER[buf]
        end = np.flatnonzero((buf[:-16] == 32) | (buf[:-16] == 10))
        start = np.r_[0, end[:-1] + 1]
        last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # each text's closing newline
        at = np.r_[0, np.searchsorted(end, last) + 1]  # chunks of text i: at[i] to at[i + 1]
        space = (start > 0) & (buf[start - 1] == 32)
        line = ~space
        line[at[:-1]] = False
        mark = buf[np.maximum(end - 1, 0)]
        marked = (end - start > 1) & _IS_MARK[mark] & _IS_LETTER[buf[np.maximum(end - 2, 0)]]
        entry = self._entries(buf, start, end - marked, space if self.kind == "bytes" else np.zeros(len(space), bool))
        size = self.lexicon.size[entry]
        size[entry < 0] = -1
        bad = np.add.reduceat(size < 0, at[:-1]) > 0
        some = np.maximum(size, 0)
        before = line & bool(self.newline)
        total = some + before + marked
        place = np.cumsum(total) - total
        out = np.empty(int(total.sum()), "<u4")
        if self.newline:
            out[place[before]] = self.newline[0]
        inner = place + before
        out[np.repeat(inner - (np.cumsum(some) - some), some) + np.arange(some.sum())] = self.lexicon.ids[np.repeat(self.lexicon.first[entry] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
        out[(inner + some)[marked]] = self.marks[mark[marked]]
        raw = out.tobytes()
        edge = (4 * np.r_[place, len(out)][at]).tolist()
        return [(self.whole(t) if t else b"") if x else raw[a:b] for t, x, a, b in zip(texts, bad.tolist(), edge[:-1], edge[1:], strict=True)]

    def _entries(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, space: np.ndarray) -> np.ndarray:
        """The lexicon's entry of each chunk, new ones included; -1 for an empty one."""
        words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        size = end - start
        keys = np.empty((len(start), 2), np.uint64)
        keys[:, 0] = words[start] & _KEEP[np.minimum(size, 8)]
        keys[:, 1] = words[start + np.minimum(size, 8)] & _KEEP[np.clip(size - 8, 0, 7)] | np.where(space, np.uint64(2 << 56), np.uint64(1 << 56))
        short = size <= KEY_BYTES
        lexicon, known = self.lexicon, short & (size > 0)
        out = np.where(known, lexicon.find(keys), -1)
        new = np.flatnonzero(known & (out < 0))
        if len(new) > lexicon.room():
            lexicon.clear()
            out[:] = -1
            new = np.flatnonzero(known)
        if len(new):
            order = new[np.lexsort((keys[new, 1], keys[new, 0]))]
            a, b = keys[order, 0], keys[order, 1]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            one = order[first]
            found = [self._chunk(buf[a:b].tobytes(), s) for a, b, s in zip(start[one].tolist(), end[one].tolist(), space[one].tolist(), strict=True)]
            room = lexicon.room()
            entries = lexicon.add(found)
            lexicon.put(keys[one[:room]], entries[:room])  # a very long text may have more chunks than there are slots
            out[order] = entries[np.cumsum(first) - 1]
        for i in np.flatnonzero(~short).tolist():
            key = (buf[start[i] : end[i]].tobytes(), bool(space[i]))
            if key not in lexicon.long:
                lexicon.long[key] = int(lexicon.add([self._chunk(*key)])[0])
            out[i] = lexicon.long[key]
        return out


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _kind(spec: dict) -> str | None:
    """bytes: byte-level BPE as it is; lower: NFC, white space and case folded, white space dropped; None: unknown."""
    norm, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec["model"]
    if model["type"] != "BPE" or model.get("dropout"):
        return None
    if norm is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return "bytes"
    if norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
        return "lower" if pre["pretokenizers"][0]["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"} and pre["pretokenizers"][0]["invert"] else None
    return None
