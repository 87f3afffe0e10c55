"""Very long texts, and columns whose names an operator uses itself."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline

LONG = "".join(f"Line {i} holds some words of no great weight, number {i * 7919 % 10007}.\n" for i in range(42_000))


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 2_200_000
    rows = [(1, LONG), (2, "a short text of a few words"), (3, LONG[:1000] + " and an end"), (4, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_tokens_of_a_very_long_text(spark, docs):
    from tokenizers import Tokenizer

    from loomwork.llm.packing import pack_documents
    from loomwork.llm.simple8b import tokens_round_trip

    want = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode(LONG, add_special_tokens=False).ids + [0]
    pieces = pack_documents(spark, docs, tokenizer("byte_bpe_50k.json")).filter("doc_id = 1").orderBy("start").collect()
    assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
    back = tokens_round_trip(spark, docs, tokenizer("word_bpe_49k.json")).filter("doc_id = 1").first()
    assert np.frombuffer(back.ids, "<u4").tolist() == Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode(LONG, add_special_tokens=False).ids + [2]


def test_other_operators_on_a_very_long_text(spark, docs):
    from loomwork.llm.decontam import find_overlaps
    from loomwork.llm.katz import score_documents
    from loomwork.llm.licenses import scan_licenses
    from loomwork.llm.linededup import drop_repeated_lines
    from loomwork.llm.quality import apply_rules
    from loomwork.llm.sharding import shard_documents
    from loomwork.llm.simhash import near_groups
    from loomwork.llm.suffix import drop_repeats

    one = lambda df: df.filter("doc_id = 1").first()
    words = LONG.split()
    assert one(apply_rules(docs, stats=True)).n_words == len(words)
    assert one(score_documents(spark, docs)).n_tokens == len(words) + 1
    kept = {r.doc_id: r for r in drop_repeated_lines(spark, docs).collect()}
    assert kept[1].n_lines == LONG.count("\n") + 1 and kept[1].text == LONG and kept[3].n_dropped == LONG[:1000].count("\n")
    cut = {r.doc_id: r for r in drop_repeats(spark, docs).collect()}
    assert cut[1].n_bytes == len(LONG) and cut[1].n_removed == 1000 and bytes(cut[1].kept) == LONG[1000:].encode() and cut[3].n_removed == 1000
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in shard_documents(spark, docs, 4, 64).collect()}
    assert sizes[1] == (len(LONG) + 1, zlib.crc32(LONG.encode())) and len(sizes) == 4
    groups = {r.doc_id: r.component for r in near_groups(spark, docs).collect()}
    assert groups[1] == 1 and len(groups) == 4
    assert one(scan_licenses(spark, docs)).n_paragraphs == LONG.count("\n")
    bench = spark.createDataFrame([(9, " ".join(words[200_000:200_030]))], "item_id long, text string")
    found = one(find_overlaps(spark, docs, bench))
    assert found.item_id == 9 and found.equal == found.item_tokens == found.length


def test_columns_of_any_name_come_back(spark):
    names = ["_k", "_th", "_ld_doc", "_ld_th", "_row", "_ld_row", "rejected_by", "n_lines", "n_dropped", "component", "id", "data"]
    text = "many different words that stand in one long line so that no rule rejects this text here " * 4
    rows = [(i, f"{text} {i}\n" + " ".join(f"w{i}x{j}" for j in range(120)), "en", "s", 5, *(77 + j for j in range(len(names)))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all([r[n] for n in names] == [77 + j for j in range(len(names))] for r in got), name
