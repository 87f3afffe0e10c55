"""Each operator against brute force on small tables, odd rows among them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k long, key string, `start` long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    vocab = ["the", "of", "Alpha", "beta", "gamma,", "delta.", "été", "über", "x1", "%%%", "long" * 8] + [f"w{i}" for i in range(80)]
    line = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [line(9) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [line(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared))
        out.append("\n".join(parts))
    for i in range(0, 12):  # copies, near copies, changed case and spaces
        t = out[i]
        out += [t, t.upper() if i % 2 else t.replace("beta", "BETA "), re.sub(r"w1\b", "w2", t, count=1)]
    return out


@pytest.fixture(scope="module")
def rows():
    data = [(i, t) for i, t in enumerate(texts())]
    data += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "word word word word"), (None, "no id here at all"), (905, "a\n\nb"), (17, texts()[17])]
    return data


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_words_and_windows():
    from loomwork.llm.textkit import Words, whole_windows, windows_hash

    t = [x.encode() for x in texts(20)] + [b"", b" ", b"a", b"x\x00y\x1cz \xc2\xa0"]
    w = Words(t)
    got = [[bytes(w.buf[w.start[i] : w.end[i]]) for i in range(w.at[k], w.at[k + 1])] for k in range(len(t))]
    assert got == [x.split() for x in t]
    h = w.hashes()
    by = {}
    for k, ws in enumerate(got):
        for j, x in enumerate(ws):
            assert by.setdefault(x, h[w.at[k] + j]) == h[w.at[k] + j]
    assert len(set(by.values())) == len(by)
    at = whole_windows(w, 3)
    assert len(at) == sum(max(0, len(x) - 2) for x in got)
    assert len(windows_hash(h, 3)) == len(h) - 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_tokens_equal_whole_ones(name, monkeypatch):
    from tokenizers import Tokenizer

    from loomwork.llm import tokens
    from loomwork.llm.tokens import Encoder

    own, lib = Encoder(tokenizer(name)), Tokenizer.from_file(tokenizer(name))
    rnd = random.Random(5)
    bits = ["a", "B", "é", "́", "'s", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "1", "23", "%", "<|endoftext|>", "中", "😀", "\r\n", " the", ".", ",", "÷", "İ", "ß", "K"]
    cases = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + texts(30)
    cases += [" ".join(cases[i : i + 40]) for i in range(0, 3000, 40)] + ["", "thisisoneverylongwordindeed, " * 3, "Word. " * 200_000 + "end"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in cases]
    for bits in (21, 7):  # a lexicon that is full again and again
        monkeypatch.setattr(tokens, "SLOT_BITS", bits)
        own.lexicon.clear()
        for a in range(0, len(cases), 1 if bits == 21 else 5):
            part = cases[a : a + (1 if bits == 21 else 5)]
            got = [np.frombuffer(x, "<u4").tolist() for x in own.batch([t.encode() for t in part])]
            assert got == want[a : a + len(part)], repr(part)[:300]
    assert own.batch([]) == []


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    from loomwork.llm.packing import pack_documents, piece_lengths

    assert piece_lengths(2500) == [1024, 1024, 256, 128, 64, 4] and piece_lengths(0) == []
    with pytest.raises(ValueError):
        piece_lengths(5, 1000)
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    out = pack_documents(spark, docs, tokenizer("byte_bpe_50k.json"), 64).collect()
    want = Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    pieces = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) // 4 and r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    for (i, ids), n in want.items():
        starts = sorted(pieces[i])
        joined = [x for s, p in starts[::n] for x in p] if n > 1 else [x for s, p in starts for x in p]
        assert joined == list(ids)
    assert pack_documents(spark, none, tokenizer("byte_bpe_50k.json")).count() == 0


def simhash(t, n=3):
    w = WORDS.findall(lower(t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def clusters(nodes, linked):
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(nodes))]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(spark, docs, rows, none, bucket):
    from loomwork.llm import simhash as m

    fps = [simhash(t) for _, t in rows]
    root = clusters(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    big = (1 << 63) - 1
    least = defaultdict(lambda: big)
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least[r], big if i is None else i)
    want = sorted(((i, f, least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=repr)
    got = m.groups(spark, docs, max_bucket=bucket).select("doc_id", "f0", "component").collect()
    assert sorted(((r.doc_id, r.f0 % 2**64, r.component) for r in got), key=repr) == want
    assert m.near_groups(spark, none).count() == 0


def test_forest_and_components_of_random_graphs(spark):
    from loomwork.llm.common import components
    from loomwork.llm.simhash import forest

    rnd = np.random.default_rng(2)
    words = rnd.integers(0, 2**12, (200, 1), dtype=np.uint64)
    edges = forest(words, 1)
    root = clusters(words[:, 0].tolist(), lambda a, b: (a ^ b).bit_count() <= 1)
    assert len(edges) == 200 - len(set(root)) and all(root[a] == root[b] for a, b in edges)
    path = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = components(spark, spark.createDataFrame(path, "a long, b long")).collect()
    labels = {r.node: r.label for r in got}
    assert len(got) == 61 + 40 and len({labels[i] for i in range(61)}) == 1 and len({labels[i] for i in range(100, 140)}) == 1 and labels[0] != labels[100]
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_by_similarity(spark, none):
    from loomwork.llm.simhash import drop_near_duplicates

    rnd = random.Random(8)
    out, groups = [], []
    for g in range(40):
        base = [f"v{rnd.randrange(5000)}" for _ in range(160)]
        size = 30 if g == 0 else 4 if g % 2 else 1
        for k in range(size):
            w = list(base)
            for _ in range(0 if k == 0 else 2):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            groups.append(g)
            out.append((len(out), " ".join(w)))
    out += [(len(out), None), (len(out) + 1, ""), (3, out[3][1])]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, "k", 2) for i, t in out], SCHEMA)
    kept = sorted(r.doc_id for r in drop_near_duplicates(spark, df).collect())
    first = {}
    for i, g in enumerate(groups):
        first.setdefault(g, i)
    assert kept == sorted([*first.values(), len(groups)])
    assert drop_near_duplicates(spark, none).count() == 0


def katz_by_hand(rows, folds=10):
    """Plain recursion over dictionaries."""
    from loomwork.llm.katz import K, discounts

    stream = lambda t: [*WORDS.findall(lower(t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == 0
    uni, bi, begin = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            s = stream(t)
            uni.update(s)
            bi.update(zip([0, *s[:-1]], s, strict=True))
            begin += 1
    n = sum(uni.values())
    of = lambda c: [sum(v == r for v in c.values()) for r in range(K + 2)]
    d1, d2 = discounts(of(uni)), discounts(of(bi))
    keep = lambda d, c: float(d.kept(np.array([c]))[0])
    p1 = {w: keep(d1, c) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c
    ch = {h: sum(ws.values()) for h, ws in after.items()}
    alpha = {h: (1 - sum(keep(d2, c) for c in ws.values()) / ch[h]) / (1 - sum(p1[w] for w in ws)) for h, ws in after.items()}

    def prob(h, w):
        if w in after.get(h, {}):
            return keep(d2, after[h][w]) / ch[h]
        return alpha.get(h, 1.0) * p1.get(w, unknown)

    for h in list(after)[:25]:  # each context's probabilities, the unknown class among them, sum to 1
        assert math.isclose(sum(prob(h, w) for w in uni) + prob(h, "never seen"), 1.0, rel_tol=1e-9)
    out = []
    for i, t in rows:
        s = stream(t)
        base = sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in s)
        score = sum(math.log10(prob(h, w)) for h, w in zip([0, *s[:-1]], s, strict=True))
        out.append((i, held(i), len(s), sum(w in uni for w in s), n, base, score))
    return out


@pytest.mark.parametrize(("head", "pair", "flush", "bucket"), [(0xFFFE, 1 << 13, 1 << 19, 1 << 20), (8, 8, 100, 60), (16, 1 << 13, 1, 1 << 20), (0, 8, 1000, 60)])
def test_katz(spark, docs, rows, none, head, pair, flush, bucket, monkeypatch):
    from loomwork.llm import katz

    for name, value in (("HEAD_WORDS", head), ("PAIR_SHARE", pair), ("FLUSH_TOKENS", flush), ("BUCKET_TOKENS", bucket)):
        monkeypatch.setattr(katz, name, value)
    if flush == 1:  # every slice of texts is a flush
        monkeypatch.setattr("loomwork.llm.textkit.text_slices.__defaults__", (200,))
    want = sorted(katz_by_hand(rows), key=repr)
    got = collected(katz.score_documents(spark, docs))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert katz.score_documents(spark, none).count() == 0


def test_packed_arrays_come_back():
    from loomwork.llm.katz import pack, unpack

    arrays = [np.array([], np.int64), np.array([-1, 1 << 40]), np.array([(1 << 64) - 1, 0], np.uint64), np.array([0.5, -2.0]), np.array([True, False]), np.array([255, 0]), np.array([-128, 127])]
    back = unpack(pack(*arrays))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back, strict=True))


def test_katz_beats_single_tokens_on_held_out_texts(spark):
    from loomwork.llm.katz import score_documents

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = score_documents(spark, df).filter("held_out").groupBy().sum("base_score", "score").first()
    assert r[1] > r[0]


def test_discounts():
    from loomwork.llm.katz import discounts

    d = discounts([0, 100, 40, 22, 14, 9, 6])
    assert all(0 < x < 1 for x in d.small[1:]) and 0 < d.tail < 5
    assert discounts([0, 0, 0, 0, 0, 0, 0]).tail == 0.5
    assert discounts([0, 5, 9, 1, 4, 0, 2]).small[1] < 1


def test_decontamination(spark, none):
    from loomwork.llm.decontam import drop_contaminated, find_overlaps, overlap

    assert overlap(np.array([0, 1, 1, 1, 0, 1, 1, 0], bool)) [:2] in ((1, 3), (1, 6))
    rnd = random.Random(4)
    word = lambda: f"{rnd.choice('abcdefgh')}{rnd.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (30, 16, 14, 40, 7)]
    noise = lambda n: [word() for _ in range(n)]
    swapped = [w if i % 6 != 3 else "zzz" for i, w in enumerate(items[3])]
    docs = [noise(80), noise(40) + items[0] + noise(9), noise(5) + [w.upper() + "," for w in items[1]] + noise(50), noise(30) + swapped, items[2], noise(20) + items[0][:5] + noise(20), noise(10) + items[4] + noise(4), items[0][4:20] + noise(60)]
    data = [(i, " ".join(d), "en", "s", 1, 1, "k", 2) for i, d in enumerate(docs)] + [(50, None, "en", "s", 0, 1, "k", 2), (51, "", "en", "s", 0, 1, "k", 2)]
    df = spark.createDataFrame(data, SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_overlaps(spark, df, bench).collect()}
    assert got == {(1, 0), (2, 1), (3, 3), (4, 2), (6, 4), (7, 0)}
    left = drop_contaminated(spark, df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [0, 5, 50, 51]
    import loomwork.llm.decontam as m

    parts = list(m.indexes(spark, bench, part_bytes=100))
    assert len(parts) > 1 and sum(len(p.ids) for p in parts) == 7
    assert find_overlaps(spark, none, bench).count() == 0 and find_overlaps(spark, df, bench.limit(0)).count() == 0


def test_line_dedup(spark, docs, rows, none):
    from loomwork.llm.linededup import drop_repeated_lines

    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    big = (1 << 63) - 1
    held = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                held[key(s)].add(big if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [s for s in lines if not (len(key(s)) >= 10 and len(held[key(s)]) > 1 and min(held[key(s)]) < (big if i is None else i))]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    out = drop_repeated_lines(spark, docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert collected(out.select("doc_id", "n_lines", "n_dropped", "text")) == sorted(want, key=repr)
    assert drop_repeated_lines(spark, none).count() == 0
    three = collected(drop_repeated_lines(spark, docs, min_docs=3).select("n_dropped"))
    assert sum(r[0] for r in three) < sum(w[2] for w in want)


def test_sharding(spark, docs, rows, none):
    from loomwork.llm import sharding as m

    out = m.shard_documents(spark, docs, 4, 64).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    bytes_of, slots = Counter(), defaultdict(list)
    for r in out:
        bytes_of[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(bytes_of) == 4
    assert max(bytes_of.values()) < 1.05 * min(bytes_of.values())
    assert m.shard_documents(spark, none, 4, 64).count() == 0
    slots = m.slot_bytes(m.with_slots(docs, 64), 64)
    one = m.first_map(slots, 4)
    two = m.rebalanced_map(one, slots, 5)
    a, b = ({r.virtual_slot: r.shard for r in x.collect()} for x in (one, two))
    assert len(a) == len(b) == 64 and two.first().version == 2
    assert sum(a[s] != b[s] for s in a) < 32 and all(b[s] in range(5) for s in b)

    # a stored map goes on: more rows, then one more shard
    half = docs.filter("doc_id < 40 OR doc_id IS NULL")
    first = m.next_map(spark, half, 4, 64)
    grown = m.next_map(spark, docs, 4, 64, first)
    wider = m.next_map(spark, docs, 5, 64, grown)
    of = {v: {r.virtual_slot: r.shard for r in wider.filter(f"version = {v}").collect()} for v in (1, 2, 3)}
    assert wider.count() == 3 * 64 and of[1] == {r.virtual_slot: r.shard for r in first.collect()}
    load = Counter()
    for r in m.slot_bytes(m.with_slots(docs, 64), 64).collect():
        load[of[1][r.virtual_slot]] += r.bytes
    share = sum(load.values()) / 4
    moved = [s for s in of[1] if of[1][s] != of[2][s]]
    assert moved and all(load[of[1][s]] > share for s in moved)  # only out of shards that hold too much
    by = {v: {(r.doc_id, r.text_crc32): r.shard for r in m.shard_documents(spark, docs, versions=x, n_slots=64).collect()} for v, x in ((2, grown), (3, wider))}
    sizes = Counter()
    for r in m.shard_documents(spark, docs, versions=wider, n_slots=64).collect():
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(5)) and max(sizes.values()) < 1.2 * min(sizes.values())
    assert sum(by[2][k] != by[3][k] for k in by[2]) < len(by[2]) / 2


def test_quality_cascade(spark, docs, rows, none):
    from loomwork.llm import quality as m

    def stats(t):
        t = t or ""
        w = WORDS.findall(t)
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(wins)
        cover = {i + j for i, x in enumerate(wins) if c[x] > 1 for j in range(3)}
        real = [s for s in t.split("\n") if WORDS.search(s)]
        lettered = Counter(x for x in w if re.search(r"[A-Za-z]|[^\x00-\x7f]", x))
        letters = len(re.findall(r"[A-Za-z]|[^\x00-\x7f]", t))
        ends = [re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", s) for s in real]
        bullets, opened = sum(s[0] in "-*" for s in ends), sum(s.endswith(("...", "…")) for s in ends)
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(real) - len(set(real)), len(cover), len(real), max(lettered.values(), default=0), letters, bullets, opened

    def kept(s):
        n, chars, sym, dup, rep, real, top, letters, bullets, opened = s
        base = n < 50 or 100 * rep > 50 * n or 10 * sym > 5 * n or chars < 2 * n or chars > 20 * n or 2 * dup > real
        return not (base or 100 * top > 30 * n or 2 * letters < chars or 10 * bullets > 9 * real or 10 * opened > 3 * real)

    out = m.apply_rules(docs, stats=True)
    want = sorted(((i, *stats(t)[:5], kept(stats(t))) for i, t in rows), key=repr)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.rejected_by is None) for r in out.collect()]
    assert sorted(got, key=repr) == want and any(w[-1] for w in want)
    assert sorted(((r.doc_id, r.text) for r in m.keep_good(docs).collect()), key=repr) == sorted(((i, t) for i, t in rows if kept(stats(t))), key=repr)
    assert m.keep_good(none).count() == 0
    assert {r.name for r in m.fit_order(docs)} == {r.name for r in m.RULES}
    # each further rule on texts that only it rejects
    line = lambda i: " ".join(f"word{i}x{j}" for j in range(12))
    odd = {"one_word": "\n".join(f"the {line(i)} the the the the the the the" for i in range(9)), "few_letters": " ".join(f"{7 * i}:{i * i}" for i in range(99)), "bullet_lines": "\n".join(f" - {line(i)}" for i in range(9)), "open_lines": "\n".join(f"{line(i)} {e}" for i, e in enumerate(["...", "…", "end... ", "", "", ".", ".."])), None: "\n".join(f"{line(i)} {e}" for i, e in enumerate(["...", "…", "", "", "", ".", "..", "-"]))}
    odd_docs = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(odd.items())], "doc_id long, text string")
    for order in (m.RULES, m.RULES[::-1]):
        assert [r.rejected_by for r in sorted(m.apply_rules(odd_docs, order).collect())] == list(odd)


def repeated(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in data for i in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for j in range(len(t) - window + 1):
            if seen[t[j : j + window]] > 1:
                gone[j : j + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,many", [(40, 1 << 15), (60, 1), (33, 3)])
def test_suffix_dedup(spark, docs, rows, none, window, many):
    from loomwork.llm.suffix import drop_repeats

    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in drop_repeats(spark, docs, window, many).collect()]
    assert sorted(got, key=repr) == repeated(rows, window)
    assert drop_repeats(spark, none).count() == 0


def test_suffix_array():
    from loomwork.llm.suffix import repeated_starts, suffix_array

    rnd = random.Random(6)
    for _ in range(300):
        s = [rnd.randint(1, rnd.choice([1, 2, 5, 300])) for _ in range(rnd.randint(0, 60))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    t = b"abcabcabc--abca"
    assert repeated_starts(t, np.arange(len(t) - 3), 4).tolist() == [t.count(t[i : i + 4]) + (t[i : i + 4] in (b"abca", b"bcab", b"cabc")) > 1 for i in range(len(t) - 3)]


def test_licenses(spark, none):
    from loomwork.llm import licenses
    from loomwork.llm.licenses import scan_licenses

    plain = [t for t in texts(40, seed=9)]
    data = [(i, t) for i, t in enumerate(plain)]
    lines = {100: ("Released under the MIT License.", "MIT"), 101: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), 102: ("This work is licensed under the GNU General Public License, version 3.", "GPL"), 103: ("All rights reserved.", "All-rights-reserved")}
    data += [(i, plain[i - 100] + "\n" + t) for i, (t, _) in lines.items()] + [(200, None), (201, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, "k", 2) for i, t in data], SCHEMA)
    out = {r.doc_id: r for r in scan_licenses(spark, df).collect()}
    for i, (_, family) in lines.items():
        assert [f.family for f in out[i].found] == [family] and out[i].found[0].paragraph == data[i - 100][1].count("\n") + 1
    assert not any(out[i].found for i in [*range(40), 200, 201])
    assert scan_licenses(spark, none).count() == 0

    def holds(text, family):  # by the plain rule: all of a notice's words, or most pairs of a licence's sentence
        words = re.findall(r"[^\W_]+", text.lower())
        pairs = set(zip(words, words[1:], strict=False))
        for t, name in licenses.templates()[family]:
            w, n = (re.findall(r"[^\W_]+", x.lower()) for x in (t, name))
            p = set(zip(w, w[1:], strict=False))
            if not p:  # a name of one word is a template for itself alone
                if words == w:
                    return True
                continue
            both = len(p & pairs)
            if both >= min(len(p), 3) and set(n) <= set(words) and (both / len(p) >= 0.5 or (not n and both >= 6 and both / len(pairs) >= 0.5)):
                return True
        return False

    near = ["under the terms", "the work", "The the", "The the ththou.", "All rights of the people.", "terms of the", "this program is free", "Released under the moon.", "Permission is granted to leave.", "Licensed under the Foo License."]
    inside = " ".join(plain[:3]).replace("\n", " ")
    real = [("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), (f"{inside} Licensed under the Apache License, Version 2.0. {inside}", "Apache-2.0"), ("Released under the Unlicense.", "Unlicense"), ("Licensed under the MIT License.", "MIT")]
    got = [r.found for r in scan_licenses(spark, spark.createDataFrame([(i, t, "en", "s", 1, 1, "k", 2) for i, t in enumerate([*near, *(t for t, _ in real)])], SCHEMA), licenses.fit(df)).orderBy("doc_id").collect()]
    for t, found in zip(near, got, strict=False):
        assert all(f.family == licenses.UNKNOWN for f in found) and not any(holds(t, f) for f in licenses.NAMES), t
    for (t, family), found in zip(real, got[len(near) :], strict=True):
        assert [f.family for f in found] == [family] and holds(t, family), (t[:60], found)


def test_simple8b(spark, docs, rows, none):
    from tokenizers import Tokenizer

    from loomwork.llm import simple8b as m

    rnd = np.random.default_rng(1)
    for top in (1, 2, 3, 100, 2**16, 2**32, 2**60):
        for n in (0, 1, 2, 239, 240, 241, 3000):
            ids = rnd.integers(0, top, n, dtype=np.uint64)
            assert (m.decode(m.encode(ids)) == ids).all()
    with pytest.raises(ValueError):
        m.encode(np.array([1 << 60], np.uint64))
    ids = rnd.integers(0, 50_000, 20_000).astype("<u4")
    block = m.pack_block(np.array([15_000, 0, 5_000]), ids)
    lengths, back = m.unpack_block(block)
    assert lengths.tolist() == [15_000, 0, 5_000] and (back == ids).all()
    for a, n in ((0, 5), (7_777, 3_000), (19_990, 10)):
        assert (m.read_ids(block, a, n) == ids[a : a + n]).all()
    with pytest.raises(ValueError):
        m.unpack_block(block[:-1] + b"\xff")
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = sorted(m.tokens_round_trip(spark, docs, tokenizer("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    at = 0
    order = sorted(rows, key=lambda r: ((1 << 63) - 1 if r[0] is None else r[0], r[1] or ""))
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, order, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(ids), ids)
        at += len(ids)
    assert m.tokens_round_trip(spark, none, tokenizer("word_bpe_49k.json")).count() == 0
