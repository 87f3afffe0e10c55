"""Katz backoff: Good-Turing discounted bigram counts, exactly normalised backoff weights, evaluated per token.

With c the counts in training texts, d the discounts and N the number of training tokens:

    P(w | h) = d(c(h w)) c(h w) / c(h)      if h w was seen
             = a(h) P(w)                    if only h was seen
             = P(w)                         else
    P(w)     = d(c(w)) c(w) / N, and for all unknown words together what that leaves of 1
    a(h)     = what the seen w leave of 1 after h / what they leave of 1 in P(w)

A document's score is a sum over its tokens. Its terms fall apart: log d c(h w) or log P(w) needs what is known of w,
-log c(h) what is known of h as a token of its own, and log a(h) c(h), for unseen pairs alone, what is known of all pairs
after h. So tokens are dealt out once, to buckets by w: tables of counts of about BUCKET_TOKENS tokens, one in memory at a
time. Each bucket gives every token's two counts back to its document, its share of each context's masses, and the unseen
pairs, which then meet their contexts.

Head words, the HEAD_WORDS most frequent, are dealt out by pair instead, and pairs with over 1/PAIR_SHARE of the tokens by
document; their counts are put together on the driver, and the backoff weights of head words are broadcast. A token travels as two bytes for a head word,
eight for another, the same for its context, and its document, in the order of documents; so its size doesn't depend on the
number of buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import staged
from loomwork.llm.textkit import Words, mix, release_memory, text_slices

#: Hashes of the end token and of the context before the first token.
END, BEGIN = (mix(np.array([x], np.uint64))[0] for x in (0xE0D, 0xB06))
#: Counts up to this are discounted by Good-Turing.
K = 5
#: Tokens that a worker packs at once (with the slice of texts that fills it), and tokens of a bucket.
FLUSH_TOKENS = 1 << 19
BUCKET_TOKENS = 1 << 19
#: Head words, at most so many; pairs with more than such a share of the tokens are heavy, about so many at most.
HEAD_WORDS = 0xFFFE
PAIR_SHARE = 1 << 13
#: A word is counted for the choice of head words where it has such a share of what a worker holds.
WORD_SHARE = 1 << 17
#: Head words are known by a table of their hashes' top bits; of two with equal ones the rarer is no head word.
_SLOT_BITS = 20
_TAIL = 0xFFFF
#: Documents are held out where crc32(doc_id as text) mod FOLDS is 0.
FOLDS = 10
#: Size of the bitmap of contexts of unseen pairs, in bits; contexts outside it need no masses.
CONTEXT_BITS = 23


@dataclass(frozen=True)
class Discounts:
    """d(r) for r = 0..k, and the absolute discount of larger counts, which keeps every context some mass for unseen words."""

    small: tuple[float, ...]
    tail: float

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """d(r) r."""
        counts = counts.astype(float)
        k = len(self.small) - 1
        return np.where(counts <= k, np.array(self.small)[np.minimum(counts, k).astype(int)] * counts, counts - self.tail)


def discounts(n: list[int] | np.ndarray) -> Discounts:
    """Good-Turing discounts by Katz from n[r], the number of types with count r, r up to K + 1.

    k falls until all d(r) lie between 0 and 1. Where no k does, counts lose n1 / (n1 + 2 n2), or 1/2 without singletons.
    """
    for k in range(min(K, len(n) - 2), 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            top = (k + 1) * n[k + 1] / n[1]
            if top < 1:
                d = [((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return Discounts((0.0, *d), k * (1 - d[-1]))
    loss = n[1] / (n[1] + 2 * n[2]) if len(n) > 2 and n[1] else 0.5
    return Discounts((0.0, 1 - loss), loss) if 0 < loss < 1 else Discounts((0.0, 0.5), 0.5)


def _token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, h, text number) of each token of the texts, with the end of each."""
    words = Words(texts, lower=True)
    n = len(texts)
    sizes = np.diff(words.at)
    w = np.empty(len(words) + n, np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    is_end = np.zeros(len(w), bool)
    is_end[ends] = True
    w[~is_end], w[is_end] = words.hashes(), END
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.r_[0, ends[:-1] + 1] if n else ends] = BEGIN
    return w, h, np.repeat(np.arange(n), sizes + 1)


def pair_hash(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(w) + h)


_KINDS = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f8")]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: whole numbers in as few bytes as they fit in, and of several bytes each place on its own, compressed where that helps."""
    import zstandard

    squeeze, out = zstandard.ZstdCompressor(1).compress, []
    for a in arrays:
        if a.dtype.kind in "iu":
            low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            a = a.astype(next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max))
        elif a.dtype == bool:
            a = a.view(np.uint8)
        out.append(bytes([_KINDS.index(a.dtype)]) + len(a).to_bytes(4, "little"))
        for place in np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T:
            raw = place.tobytes()
            small = squeeze(raw) if len(raw) > 48 else raw
            out.append(len(small).to_bytes(4, "little") + small if len(small) < len(raw) else b"\0\0\0\0" + raw)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    open_up, out, at = zstandard.ZstdDecompressor().decompress, [], 0
    while at < len(data):
        kind, n = _KINDS[data[at]], int.from_bytes(data[at + 1 : at + 5], "little")
        at += 5
        made = np.empty((n, kind.itemsize), np.uint8)
        for k in range(kind.itemsize):
            size = int.from_bytes(data[at : at + 4], "little")
            raw = open_up(data[at + 4 : at + 4 + size]) if size else data[at + 4 : at + 4 + n]
            made[:, k] = np.frombuffer(raw, np.uint8, n)
            at += 4 + (size or n)
        out.append(made.reshape(-1).view(kind))
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys begin to differ from the row before."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _in(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether, and where, x lies in the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x, at


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Heavy:
    """Hashes of head words, the most frequent first and the two marks before them; hashes of heavy pairs, sorted."""

    words: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, pairs: np.ndarray) -> Heavy:
        words = np.r_[np.array([END, BEGIN]), words[words != END]][:_TAIL]
        _, first = np.unique(_top(words, _SLOT_BITS), return_index=True)
        return cls(words[np.sort(first)], np.sort(pairs))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The head word of each slot, and its number."""
        keys, codes = np.zeros(1 << _SLOT_BITS, np.uint64), np.full(1 << _SLOT_BITS, _TAIL, np.uint16)
        at = _top(self.words, _SLOT_BITS)
        keys[at], codes[at] = self.words, np.arange(len(self.words))
        return keys, codes


def _codes(table: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
    """Numbers of head words; _TAIL for the others."""
    keys, codes = table
    at = _top(words, _SLOT_BITS)
    return np.where(keys[at] == words, codes[at], np.uint16(_TAIL))


@dataclass
class Model:
    """What all buckets need to know: bounded counts of head words and heavy pairs, and sums over all tokens."""

    heavy: Heavy
    word_counts: np.ndarray
    pair_counts: np.ndarray
    tokens: int
    types: int
    word_discounts: Discounts
    pair_discounts: Discounts
    unknown: float
    contexts: bytes

    def log_word(self, count: np.ndarray) -> np.ndarray:
        """log10 P(w) from c(w)."""
        return _log10(np.where(count > 0, self.word_discounts.kept(count) / max(self.tokens, 1), self.unknown))


def find_heavy(spark: SparkSession, texts: DataFrame) -> tuple[Heavy, int]:
    """Head words and heavy pairs, and the number of tokens.

    Whatever has such a share of all tokens has it in one portion of a worker's tokens at least, and is counted where it has
    half of it; so it is found, and its count falls short by half the share at most. Others may be taken for heavy, which
    does no harm.
    """
    word_share, pair_share, head_words = WORD_SHARE, PAIR_SHARE, HEAD_WORDS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            w, h = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = [(0, 0, len(w))]
            for kind, keys, share in ((1, w, word_share), (2, pair_hash(w, h), pair_share)):
                keys.sort()
                first = _groups(keys)
                counts = np.diff(np.r_[first, len(keys)])
                often = counts * 2 * share > len(w)
                rows += [(kind, k, c) for k, c in zip(keys[first[often]].view(np.int64).tolist(), counts[often].tolist(), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["kind", "key", "n"])

        for b in batches:
            for _, _, texts in text_slices(b.column(0)):
                held.append(_token_stream(texts)[:2])
                if sum(len(x[0]) for x in held) >= FLUSH_TOKENS:
                    yield out()
        if held:
            yield out()
        release_memory()

    counted = staged(spark, texts.select("text").mapInArrow(run, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "heavy")
    total = counted.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    found = []
    for kind, least, most in ((1, 0, head_words), (2, total // (2 * pair_share), 2 * pair_share)):
        rows = counted.filter((F.col("kind") == kind) & (F.col("n") > least)).orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
        found.append(rows.column("key").to_numpy().astype(np.int64).view(np.uint64))
    return Heavy.of(*found), total


def packed_tokens(docs: DataFrame, heavy: Heavy, buckets: int, folds: int) -> DataFrame:
    """(bucket, task, flush, kind, data), dealt out and sorted by bucket: packed tokens (kind 0) and tables of documents (kind 3).

    A flush is what a worker packs at once; documents are numbered within it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), held_out.alias("held_out"))
    names = ["bucket", "task", "flush", "kind", "data"]
    held_heavy = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        heavy, table = held_heavy.value, held_heavy.value.table()
        task, flush = TaskContext.get().partitionId(), 0
        streams, ids, flags, sizes = [], [], [], []

        def out() -> Iterator:
            w, h, doc = (np.concatenate(c) for c in zip(*streams, strict=True))
            streams.clear()
            held = np.array(flags, bool)
            to = (w >> np.uint64(16)) % np.uint64(buckets)
            code = _codes(table, w)
            pairs = pair_hash(w, h) >> np.uint64(16)
            big = code != _TAIL
            to[big] = pairs[big] % np.uint64(buckets)
            hot, _ = _in(heavy.pairs >> np.uint64(16), pairs[big])  # a pair may be heavy only if its word is
            hot = np.flatnonzero(big)[hot]
            hot = hot[_in(heavy.pairs, pair_hash(w[hot], h[hot]))[0]]
            to[hot] = mix(mix(doc[hot].astype(np.uint64) + np.uint64(flush << 32)) + np.uint64(task)) % np.uint64(buckets)
            order = np.argsort(to.astype(np.int64) * 2 + held[doc], kind="stable")
            to, w, h, doc, code = (x[order] for x in (to, w, h, doc, code))
            code_h = _codes(table, h)
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]).tolist()
            rows = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                s = slice(a, b)
                n = int((~held[doc[s]]).sum())
                steps = np.r_[np.diff(doc[a : a + n], prepend=0), np.diff(doc[a + n : b], prepend=0)]
                rows.append((int(to[a]), 0, pack(np.array([n]), code[s], code_h[s], w[s][code[s] == _TAIL], h[s][code_h[s] == _TAIL], steps)))
            table_of = pack(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], bool), held, np.array(sizes, np.int64))
            rows.append(((task + flush) % buckets, 3, table_of))
            n = len(rows)
            cols = list(zip(*rows, strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([task] * n, pa.int32()), pa.array([flush] * n, pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=names)
            for x in (ids, flags, sizes):
                x.clear()
            for a in range(0, n, 256):
                yield made.slice(a, 256)

        held = 0
        for b in batches:
            for x, y, texts in text_slices(b.column(1)):
                w, h, doc = _token_stream(texts)
                streams.append((w, h, (doc + len(ids)).astype(np.int32)))
                sizes += np.bincount(doc, minlength=y - x).tolist()
                ids += b.column(0).slice(x, y - x).to_pylist()
                flags += b.column(2).slice(x, y - x).to_pylist()
                held += len(w)
                if held >= FLUSH_TOKENS:
                    yield from out()
                    flush, held = flush + 1, 0
        if ids:
            yield from out()
        release_memory()

    packed = rows.mapInArrow(run, "bucket int, task int, flush int, kind int, data binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket")


@dataclass
class Bucket:
    """The tokens of a bucket, sorted by word and context, and their counts in training texts."""

    w: np.ndarray
    h: np.ndarray
    order: np.ndarray
    pair: np.ndarray
    train: np.ndarray
    hot: np.ndarray
    word: np.ndarray
    count: np.ndarray
    big: np.ndarray
    blobs: list[tuple[int, int, np.ndarray]]

    @classmethod
    def of(cls, rows: list, heavy: Heavy, table: tuple[np.ndarray, np.ndarray]) -> Bucket:
        """``rows``: (task, flush, data). pair and word: where each begins; train and count: their counts; hot and big: numbers of heavy ones, or -1."""
        w, h, train, blobs = [], [], [], []
        for task, flush, data in rows:
            n, code_w, code_h, tail_w, tail_h, steps = unpack(data)
            n = int(n[0])
            for code, tail, out in ((code_w, tail_w, w), (code_h, tail_h, h)):
                code = code.astype(np.int64)
                words = heavy.words[np.minimum(code, len(heavy.words) - 1)]
                words[code == _TAIL] = tail
                out.append(words)
            train.append(np.arange(len(code_w)) < n)
            steps = steps.astype(np.int64)
            blobs.append((task, flush, np.r_[np.cumsum(steps[:n]), np.cumsum(steps[n:])].astype(np.int32)))
        w, h, train = np.concatenate(w), np.concatenate(h), np.concatenate(train)
        order = np.lexsort((h, w)).astype(np.int32)
        w = w[order]
        h = h[order]
        train = train[order]
        pair = _groups(w, h)
        in_train = np.add.reduceat(train, pair, dtype=np.int64)
        word = _groups(w[pair])
        count = np.add.reduceat(in_train, word)
        big = _codes(table, w[pair][word]).astype(np.int64)
        big[big == _TAIL] = -1
        hot = np.full(len(pair), -1)
        may = np.flatnonzero(np.repeat(big >= 0, np.diff(np.r_[word, len(pair)])))
        found, hot_at = _in(heavy.pairs, pair_hash(w[pair[may]], h[pair[may]]))
        hot[may[found]] = hot_at[found]
        return cls(w, h, order, pair, in_train, hot, word, count, big, blobs)


def _buckets(part: Iterable, heavy: Heavy) -> Iterator[Bucket | tuple]:
    """The buckets of a sorted partition, one after the other; tables of documents as they are."""
    now, rows, table = None, [], heavy.table()
    for bucket, task, flush, kind, data in part:
        if kind:
            yield task, flush, bytes(data)
            continue
        if bucket != now and rows:
            yield Bucket.of(rows, heavy, table)
            rows = []
        now = bucket
        rows.append((task, flush, bytes(data)))
    if rows:
        yield Bucket.of(rows, heavy, table)


def _statistics(part: Iterable, heavy: Heavy) -> Iterator:
    """One partition's share: counts of counts of words and pairs, tokens and training texts, heavy counts, contexts of unseen pairs."""
    of, sums = np.zeros((2, K + 3), np.int64), np.zeros(2, np.int64)
    words, pairs = np.zeros(len(heavy.words), np.int64), np.zeros(len(heavy.pairs), np.int64)
    bits, some = np.zeros(1 << CONTEXT_BITS, bool), False
    for b in _buckets(part, heavy):
        if isinstance(b, tuple):
            continue
        some = True
        of += [np.bincount(np.minimum(x, K + 2), minlength=K + 3) for x in (b.count[b.big < 0], b.train[b.hot < 0])]
        words += np.bincount(b.big[b.big >= 0], b.count[b.big >= 0], minlength=len(words)).astype(np.int64)
        pairs += np.bincount(b.hot[b.hot >= 0], b.train[b.hot >= 0], minlength=len(pairs)).astype(np.int64)
        # a heavy pair may be unseen here and seen elsewhere: its context is asked for without need then
        bits[_top(b.h[b.pair][b.train == 0], CONTEXT_BITS)] = True
        sums += int(b.count.sum()), int(b.train[b.h[b.pair] == BEGIN].sum())
        del b
    release_memory()
    if some:
        yield of, sums, words, pairs, zlib.compress(np.packbits(bits).tobytes(), 1)


def _merge(a, b):
    bits = np.frombuffer(zlib.decompress(a[4]), np.uint8) | np.frombuffer(zlib.decompress(b[4]), np.uint8)
    return (*(x + y for x, y in zip(a[:4], b[:4], strict=True)), zlib.compress(bits.tobytes(), 1))


def _log10(x):
    with np.errstate(divide="ignore"):
        return np.log10(x)


def _references(counts: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Twice the count, or twice the number of a heavy one and 1."""
    return np.where(heavy >= 0, 2 * heavy + 1, 2 * counts)


def _resolved(references: np.ndarray, heavy_counts: np.ndarray) -> np.ndarray:
    references = references.astype(np.int64)
    if not len(heavy_counts):
        return references >> 1
    return np.where(references & 1, heavy_counts[np.minimum(references >> 1, len(heavy_counts) - 1)], references >> 1)


def _score(part: Iterable, model: Model) -> Iterator:
    """One partition's share of scores, as (kind, task, flush, packed columns): 0 counts of tokens, 1 contexts, 2 unseen pairs, 3 tables of documents."""
    told = np.unpackbits(np.frombuffer(zlib.decompress(model.contexts), np.uint8)).astype(bool)
    table, heads = model.heavy.table(), np.zeros((2, len(model.heavy.words)))
    for b in _buckets(part, model.heavy):
        if isinstance(b, tuple):
            yield 3, *b
            continue
        entries = np.diff(np.r_[b.pair, len(b.w)])
        pairs_n = np.diff(np.r_[b.word, len(b.pair)])
        back = np.empty(len(b.w), np.int32)
        back[b.order] = np.repeat(np.arange(len(b.pair)), entries)  # each token's pair, in the order of the blobs
        pair_ref, word_ref = _references(b.train, b.hot), np.repeat(_references(b.count, b.big), pairs_n)
        train, count = _resolved(pair_ref, model.pair_counts), _resolved(word_ref, model.word_counts)
        h = b.h[b.pair]
        at = 0
        for task, flush, doc in b.blobs:
            pair = back[at : at + len(doc)]
            at += len(doc)
            yield 0, task, flush, pack(np.diff(doc, prepend=0), pair_ref[pair], word_ref[pair])
            miss = np.flatnonzero(train[pair] == 0)
            if len(miss):
                yield 2, task, flush, pack(doc[miss], h[pair[miss]].view(np.int64), _codes(table, h[pair[miss]]) != _TAIL)
        # of a heavy pair each bucket gives that share of its masses which it holds of its count
        share = np.where(b.hot >= 0, b.train / np.maximum(train, 1), 1.0)
        asked = np.flatnonzero((train > 0) & told[_top(h, CONTEXT_BITS)])
        c = train[asked]
        freed = share[asked] * (c - model.pair_discounts.kept(c))
        mass = share[asked] * model.word_discounts.kept(count[asked]) / max(model.tokens, 1)
        head = _codes(table, h[asked])
        own = head != _TAIL
        heads[0] += np.bincount(head[own], freed[own], minlength=heads.shape[1])
        heads[1] += np.bincount(head[own], mass[own], minlength=heads.shape[1])
        context, which = np.unique(h[asked[~own]], return_inverse=True)
        yield 1, 0, 0, pack(context.view(np.int64), np.zeros(len(context), bool), *(np.bincount(which, x[~own], minlength=len(context)) for x in (freed, mass)))
        del b, back, h
    some = np.flatnonzero(heads.any(axis=0))  # the masses of head words, once for all buckets of the partition
    if len(some):
        yield 1, 0, 0, pack(model.heavy.words[some].view(np.int64), np.ones(len(some), bool), heads[0, some], heads[1, some])
    release_memory()


def _contexts(packed: DataFrame) -> DataFrame:
    """(context, head, freed, mass) of each bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for data in b.column(0):
                cols = unpack(data.as_py())
                kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)], names=["context", "head", "freed", "mass"])

    return packed.filter("kind = 1").select("data").mapInArrow(run, "context long, head boolean, freed double, mass double")


def _unseen(packed: DataFrame) -> DataFrame:
    """(task, flush, doc, context, head) of the unseen pairs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for task, flush, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                doc, context, head = unpack(data.as_py())
                n = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, flush, np.int32)), pa.array(doc.astype(np.int32)), pa.array(context.astype(np.int64)), pa.array(head.astype(bool))], names=["task", "flush", "doc", "context", "head"])

    return packed.filter("kind = 2").select("task", "flush", "data").mapInArrow(run, "task int, flush int, doc int, context long, head boolean")


def _document_sums(packed: DataFrame, model) -> DataFrame:
    """(task, flush, doc, doc_id, no_id, held_out, n_tokens, score, base, known): the tokens of each document added up, a flush at a time.

    A flush has a bounded number of tokens, and each comes back once, whatever the number of buckets.
    """
    shape = "task int, flush int, doc int, doc_id long, no_id boolean, held_out boolean, n_tokens long, score double, base double, known long"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m: Model = model.value
        for b in batches:
            for task, flush, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                parts = parts.as_py()
                ids, null, held, sizes = unpack(next(p["data"] for p in parts if p["kind"] == 3))
                n = len(ids)
                score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
                for p in parts:
                    if p["kind"]:
                        continue
                    doc, pair, word = unpack(p["data"])
                    doc = np.cumsum(doc.astype(np.int64))
                    is_end = word == 1  # the first head word
                    pair, word = _resolved(pair, m.pair_counts), _resolved(word, m.word_counts)
                    term = np.where(pair > 0, _log10(m.pair_discounts.kept(np.maximum(pair, 1))), m.log_word(word))
                    term -= np.where(is_end | (word == 0), 0, _log10(np.maximum(word, 1)))
                    score += np.bincount(doc, term, n)
                    base += np.bincount(doc, _log10((word + 0.1) / (m.tokens + 0.1 * (m.types + 1))), n)
                    known += np.bincount(doc[word > 0], minlength=n)
                cols = [np.full(n, task, np.int32), np.full(n, flush, np.int32), np.arange(n, dtype=np.int32), ids.astype(np.int64), null.astype(bool), held.astype(bool), sizes.astype(np.int64), score, base, known.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
        release_memory()

    shares = packed.filter("kind IN (0, 3)").groupBy("task", "flush").agg(F.collect_list(F.struct("kind", "data")).alias("parts"))
    return shares.select("task", "flush", "parts").mapInArrow(run, shape)


def score_documents(spark: SparkSession, docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10 probabilities of whole texts.

    The model learns from rows whose crc32(doc_id as text) mod ``folds`` is not 0; a null doc_id is one of them. Tokens are
    words with A-Z in lower case, then one end. base_score: additive smoothing of single tokens. A null or empty text is the
    end alone. Repeated rows each count and come back. An empty table gives no rows; if every row is held out, all words are
    unknown and score comes from the unknown class alone. A very long text is tokenised whole: a worker then holds its tokens,
    some 60 bytes for each of its bytes. Other columns play no part.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    heavy, total = find_heavy(spark, texts)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TOKENS))
    tables = packed_tokens(docs, heavy, buckets, folds).rdd  # one exchange, read twice
    first = spark.sparkContext.broadcast(heavy)
    found = tables.mapPartitions(lambda part: _statistics(part, first.value))
    none = (np.zeros((2, K + 3), np.int64), np.zeros(2, np.int64), np.zeros(len(heavy.words), np.int64), np.zeros(len(heavy.pairs), np.int64), zlib.compress(bytes(1 << CONTEXT_BITS - 3)))
    of, sums, words, pairs, contexts = found.treeAggregate(none, _merge, _merge, 2) if total else none
    of, tokens, begin = of.copy(), int(sums[0]), int(sums[1])
    for k, counts in enumerate((words, pairs)):
        of[k] += np.bincount(np.minimum(counts, K + 2), minlength=K + 3)
    types = int(of[0][1:].sum())
    unigram, bigram = discounts(of[0].tolist()), discounts(of[1].tolist())
    small = np.arange(K + 1)
    kept = float((unigram.kept(small) * of[0][: K + 1]).sum()) + tokens - int((small * of[0][: K + 1]).sum()) - unigram.tail * int(of[0][K + 1 :].sum())
    unknown = 1 - kept / tokens if tokens else 1.0
    model = spark.sparkContext.broadcast(Model(heavy, words, pairs, tokens, types, unigram, bigram, unknown, contexts))
    packed = staged(spark, spark.createDataFrame(tables.mapPartitions(lambda part: _score(part, model.value)), "kind int, task int, flush int, data binary"), "scores")
    tables.cleanShuffleDependencies(True)  # all that is read from now on is stored
    asked, doc = _unseen(packed), ["task", "flush", "doc"]
    masses = _contexts(packed).groupBy("context", "head").agg(F.sum("freed").alias("freed"), F.sum("mass").alias("mass"))
    masses = staged(spark, masses.select("context", "head", F.log10(F.col("freed") / (1 - F.col("mass"))).alias("backoff")), "backoff")
    # of head words there are a bounded number; no other word is frequent enough to be skewed
    backed = [asked.filter(which).select(*doc, "context").join(side(masses.filter(which).select("context", "backoff")), "context", "left") for which, side in ((F.col("head"), F.broadcast), (~F.col("head"), lambda x: x))]
    backed = backed[0].unionByName(backed[1]).groupBy(*doc).agg(F.sum(F.coalesce("backoff", F.lit(0.0))).alias("backoff"))
    start = float(np.log10(begin)) if begin else 0.0
    out = _document_sums(packed, model).join(backed, doc, "left")
    score = F.col("score") + F.coalesce("backoff", F.lit(0.0)) - F.lit(start)
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))
