"""Byte-level BPE by Spark's folds against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from flightline.llm import bytepairs, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = dict(bytepairs.read_ranks(RANKS))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def both_ways(table, **options):
    encoded = bytepairs.encode_documents(table, RANKS, PATTERN, **options)
    return bytepairs.decode_documents(encoded, RANKS)


def check(rows, library):
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.text or ""), repr(r.text)[:200]
        assert bytes(r.decoded) == (r.text or "").encode()


def test_query_equals_the_library(spark, sf_dir, documents, library):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    found = queries.op11_bpe(spark, sf_dir).collect()
    assert len(found) == documents.count()
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_and_an_empty_table(odd, nothing, library):
    found = both_ways(odd).collect()
    check(found, library)
    assert len(found) == odd.count() and {r.kept for r in found} == {"clash"}
    assert both_ways(nothing).collect() == []


@pytest.mark.parametrize("most", [0, 1_000])
def test_strings_of_every_kind(spark, library, most):
    draw = random.Random(11)
    signs = [chr(c) for c in range(128)] + list("éèñ  　中文字日本語한국тест😀́\u0085ࡰ٣¼\U00031350\U00011f50'")
    signs += ["'s", "'ll", " the", "aaaa", "    ", "\r\n", "<|endoftext|>"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 50))) for _ in range(600)]
    texts += ["".join(draw.choice("ab ") for _ in range(draw.randint(0, 300))) for _ in range(80)]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(20)]
    texts += ["".join(draw.choice("中文字日本語的一是不了人我在有他这") for _ in range(120)) for _ in range(20)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    check(both_ways(table, most=most).collect(), library)


def test_very_long_words(spark, library):
    texts = [" " * 50_000, "a" * 50_000, "ab" * 3_000, "é" * 5_000, "\n" * 30_000, "\x01\x02\x03" * 2_000]
    check(both_ways(spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)).collect(), library)


def test_ids_outside_the_vocabulary_decode_to_nothing(spark):
    table = spark.createDataFrame([([64, None, 10**6, 64],), (None,)], "ids array<int>")
    found = [bytes(r.decoded) for r in bytepairs.decode_documents(table, RANKS).collect()]
    piece = {rank: p for p, rank in bytepairs.read_ranks(RANKS).items()}[64]
    assert found == [piece + piece, b""]


def test_a_vocabulary_that_merges_do_not_reach_is_refused(tmp_path):
    assert bytepairs.merged_in_order(b"ab", {b"a": 0, b"b": 1, b"ab": 2})
    assert not bytepairs.merged_in_order(b"abc", {b"a": 0, b"b": 1, b"c": 2, b"abc": 3})
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        bytepairs.Merges.bound(str(tmp_path / "ranks"), lambda merges: merges)


def test_plans_do_not_spell_out_the_arrays_and_rows_do_not_carry_them(spark, documents):
    encoded = bytepairs.encode_documents(documents, RANKS, PATTERN)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000 and "_held" not in plan


def test_common_words_that_meet_at_a_place(spark, documents, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "PLACE_BITS", (3, 2))
    check(both_ways(documents.limit(40).select("text")).collect(), library)
