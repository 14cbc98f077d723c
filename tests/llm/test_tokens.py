"""Packing and SentencePiece against the tokenizer libraries."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from flightline.llm import packing, pieces, queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check_packed(found, texts):
    """Every id lies in one piece, pieces match the library, windows have neither gap nor overflow."""
    library = Tokenizer.from_file(BYTES)
    want = collections.Counter()
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[(doc_id, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert want == collections.Counter(
        (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found
    )
    windows = collections.defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
    room = []
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        room.append(2048 - at)
    assert sorted(room) == brute.best_fit_decreasing([r.length for r in found], 2048)


def test_packing_equals_one_by_one_placement(spark, sf_dir, documents):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check_packed(queries.op1_packing(spark, sf_dir).collect(), texts)


def test_packing_odd_rows(odd, nothing):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check_packed(queries.packed(odd).collect(), texts)
    assert queries.packed(nothing).collect() == []
    whole = packing.pack_documents(odd, BYTES, public_tokenizers.PATTERN)
    assert {len(r.ids) // 4 - r.length for r in whole.collect()} == {0}


def test_runs_of_equal_pieces_are_placed_like_single_pieces():
    draw = random.Random(5)
    for _ in range(60):
        window = draw.choice([8, 16, 50])
        lengths = [draw.randint(1, window) for _ in range(draw.randint(0, 80))]
        placed = packing.place(collections.Counter(lengths), window)
        used = collections.Counter()
        for length, first, into, per, count in zip(
            placed.length, placed.first, placed.into, placed.per, _counts(placed, lengths), strict=True
        ):
            for k in range(count):
                used[into + k // per] += length
        room = sorted(window - used[w] for w in range(placed.windows))
        assert room == brute.best_fit_decreasing(lengths, window)


def _counts(placed, lengths):
    totals = collections.Counter(lengths)
    out = []
    for k, (length, first) in enumerate(zip(placed.length, placed.first, strict=True)):
        later = [f for n, f in zip(placed.length, placed.first, strict=True) if n == length and f > first]
        out.append((min(later) if later else totals[length]) - first)
    return out


def test_room_tree_finds_the_tightest():
    tree, draw, open_ = packing.RoomTree(30), random.Random(1), collections.Counter()
    for _ in range(500):
        room = draw.randint(1, 30)
        if open_[room] and draw.random() < 0.5:
            tree.add(room, -1)
            open_[room] -= 1
        else:
            tree.add(room, 1)
            open_[room] += 1
        least = draw.randint(1, 30)
        assert tree.tightest(least) == min((r for r, n in open_.items() if n and r >= least), default=None)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_pieces_equal_the_library(name, request):
    table = request.getfixturevalue(name).select("doc_id", "text")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = pieces.decode_documents(
        pieces.encode_documents(table.withColumn("copy", F.col("text")), PIECES), PIECES
    ).collect()
    assert len(found) == table.count()
    for r in found:
        want = model.encode(r["copy"] or "")
        assert r.ids == want and r.decoded == model.decode(want)


def test_marked_words_with_every_kind_of_space(spark):
    draw, model = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["".join(draw.choice([" ", "  ", "▁", "a", "the", "\n", "é", "\t", "\u3000"]) for _ in range(n % 12)) for n in range(400)]
    table = pieces.WordTable(PIECES, limit=20)
    for at in range(0, 400, 40):
        assert table.encode(texts[at : at + 40]) == [model.encode(t) for t in texts[at : at + 40]]


def test_pieces_of_an_empty_table(nothing):
    assert pieces.encode_documents(nothing, PIECES).collect() == []


@pytest.mark.parametrize("sign", [" ", "\n", "　", "a", "7", "#", "é"])
def test_packing_takes_two_million_equal_characters(spark, sign):
    size = 2_000_000 if sign in " \n" else 200_000
    text = "x" + sign * size + "y"
    library = Tokenizer.from_file(BYTES)
    encoding, special = packing.tokenizer(BYTES, public_tokenizers.PATTERN)
    want = [*library.encode(text, add_special_tokens=False).ids, 1]
    assert packing.document_ids(text, encoding, special, BYTES).tolist() == want
    if sign == " ":
        found = queries.packed(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert sum(r.length for r in found) == len(want) and {r.doc_tokens for r in found} == {len(want)}
