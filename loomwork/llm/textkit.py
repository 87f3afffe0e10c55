"""Words and their hashes for many texts at once, as numpy arrays.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Texts are handled as UTF-8 bytes in slices of half a MB; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 19
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII marks: what is left between them are letters, digits and all beyond ASCII.
IS_MARK = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    held = SLICE_BYTES + (1 << 16)
    many = lambda size: [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _BASE_INV)]
    if n > held:  # a very long text's are not kept
        return tuple(many(n))
    if not _powers:
        _powers[:] = many(held)
    return _powers[0][:n], _powers[1][:n]


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, texts) of an Arrow string column, about ``limit`` bytes at a time; see :func:`as_bytes`."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for x, y in _ranges(sizes, limit):
        yield x, y, as_bytes(column.slice(x, y - x))
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system; a worker that waits for its next task would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes together; a longer text stands alone."""
    return _ranges(list(map(len, texts)), limit)


def _ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n + 1
    if first < len(sizes):
        yield first, len(sizes)


class Words:
    """The words of some texts: ``start`` and ``end`` in ``buf``; those of text i are ``at[i]:at[i + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False, breaks: np.ndarray = IS_SPACE):
        """``breaks``: the bytes that end a word, newline among them."""
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.r_[0, np.cumsum(lengths + 1)]
        space = breaks[self.buf]
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.buf) and not space[0]:
            turn = np.r_[0, turn]
        self.start, self.end = turn[0::2], turn[1::2]
        self.at = np.searchsorted(self.start, self.text_at)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """Each word's text number."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, the same in every batch."""
        return spans_hash(self.buf, self.start, self.end)


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, mixed with their lengths."""
    up, down = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n successive words; the last n - 1 words start none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out + hashes[j : len(hashes) - n + 1 + j]) if j else mix(hashes[: len(out)])
    return out


def whole_windows(words: Words, n: int) -> np.ndarray:
    """Numbers of the words at which a window of n words begins that lies in one text."""
    last = np.repeat(words.at[1:], np.diff(words.at))
    return np.flatnonzero(np.arange(len(words)) + n <= last)
