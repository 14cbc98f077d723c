"""Packing documents into training windows by best-fit decreasing.

Token ids come from a byte-level vocabulary file; each document ends with a separator id. Documents
longer than a window are first cut into full windows, the rest of each document is one piece. Pieces
are placed by decreasing length, each into the open window with the least room that still takes it;
a segment tree indexed by remaining room finds that window.

The placement only depends on how many pieces of each length there are, so it is worked out on the
histogram of lengths (never more than ``window`` rows, whatever the corpus) for whole runs of
equally long pieces at once, with exactly the result of placing them one by one. Pieces get their
place from their rank among pieces of the same length; ranks are prefix sums over blocks, so a length
that a third of all pieces share is numbered by many tasks.

Results for odd input: a null or empty text is the separator alone; documents of any length are cut
into windows without loss; repeated rows are packed once each; null ids are kept; an empty table
gives an empty result; other columns are only carried when named in ``keep``.
"""

from __future__ import annotations

import array
import functools
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightline.functions.prefix import running_before
from flightline.plans.durable import durable

WINDOW = 2_048
SEPARATOR = 1
#: Pieces that one numbering block should hold, and the fewest blocks.
BLOCK_PIECES = 100_000
LEAST_BLOCKS = 64

_RANK_BITS = 44
#: Runs of white space from here on go to the vocabulary file's own library: the faster one looks
#: ahead from every character of a run and ends the process when a run is long enough.
_LONG_SPACE = re.compile(r"\s{50000}")


# --- tokens -----------------------------------------------------------------------------------


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def tokenizer(path: str, pattern: str) -> tuple[tiktoken.Encoding, tuple[str, ...]]:
    """A ``tokenizers`` byte-level vocabulary file for the faster encoder, and its special strings."""
    with open(path, encoding="utf-8") as file:
        document = json.load(file)
    special = {t["content"]: t["id"] for t in document.get("added_tokens", []) if t.get("special")}
    symbols = _byte_of_symbol()
    ranks = {
        bytes(symbols[c] for c in piece): number
        for piece, number in document["model"]["vocab"].items()
        if piece not in special
    }
    made = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return made, tuple(special)


@functools.cache
def _own_library(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def document_ids(text: str | None, encoding: tiktoken.Encoding, special: Sequence[str], path: str) -> array.array:
    if not text:
        return array.array("I", [SEPARATOR])
    if _LONG_SPACE.search(text):
        ids = _own_library(path).encode(text, add_special_tokens=False).ids
    elif any(s in text for s in special):
        ids = encoding.encode(text, allowed_special="all")
    else:
        ids = encoding.encode_ordinary(text)
    ids.append(SEPARATOR)
    return array.array("I", ids)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Pieces of at most ``window`` tokens: ``start``, ``length``, ``doc_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema.fields[0]
    schema = T.StructType(
        [
            id_field,
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, special = tokenizer(tokenizer_path, pattern)
        for batch in batches:
            row, start, length, total, blobs = [], [], [], [], []
            for at, value in enumerate(batch.column(1)):
                ids = document_ids(value.as_py(), encoding, special, tokenizer_path)
                for cut in range(0, len(ids), window):
                    piece = ids[cut : cut + window]
                    row.append(at)
                    start.append(cut)
                    length.append(len(piece))
                    total.append(len(ids))
                    blobs.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(blobs, pa.binary()),
                ],
                schema.names,
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


# --- placement --------------------------------------------------------------------------------


class RoomTree:
    """Segment tree over remaining room 1..window; a leaf counts the open windows with that room."""

    def __init__(self, window: int) -> None:
        self._leaves = 1 << window.bit_length()
        self._sums = [0] * (2 * self._leaves)

    def add(self, room: int, windows: int) -> None:
        node = self._leaves + room
        while node:
            self._sums[node] += windows
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open window has."""
        node = self._leaves + least
        if self._sums[node]:
            return least
        while node > 1:
            if not node & 1 and self._sums[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node if self._sums[2 * node] else 2 * node + 1
                return node - self._leaves
            node >>= 1
        return None


@dataclass
class Placement:
    """Runs of equally long pieces: ranks ``first`` on go to windows ``into`` on, ``per`` in each."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    into: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    windows: int = 0

    def add(self, length: int, first: int, into: int, per: int, offset: int) -> None:
        self.length.append(length)
        self.first.append(first)
        self.into.append(into)
        self.per.append(per)
        self.offset.append(offset)


def place(counts: Mapping[int, int], window: int = WINDOW) -> Placement:
    """Best-fit decreasing over a histogram of lengths."""
    tree, made = RoomTree(window), Placement()
    # Windows with the same room are interchangeable: runs of (first window, number).
    runs: dict[int, list[tuple[int, int]]] = {}

    def put_back(room: int, first: int, number: int) -> None:
        if number and room:
            runs.setdefault(room, []).append((first, number))
            tree.add(room, number)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = window, window // length
                first, number = made.windows, -(-left // per)
                made.windows += number
            else:
                per = room // length
                first, number = runs[room].pop()
                tree.add(room, -number)
            # A window just used has less room than its equals, so it is filled before the next one.
            full = min(number, left // per)
            if full:
                made.add(length, rank, first, per, window - room)
                put_back(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < number:
                if left:
                    made.add(length, rank, first + full, left, window - room)
                    put_back(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put_back(room, first + full, number - full)
    return made


def assign_windows(pieces: DataFrame, *, window: int = WINDOW, keep: Sequence[str] = ()) -> DataFrame:
    """Pieces (``doc_id``, ``start``, ``length``, ``doc_tokens``, ``keep``) with their place.

    ``pieces`` is read three times; hand over a stored table.
    """
    columns = ["doc_id", "start", "length", "doc_tokens", *keep]
    total = pieces.count()
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_PIECES))
    blocked = pieces.select(*columns).withColumn(
        "_block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks))
    )
    totals = blocked.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    counts = {
        row["length"]: row["n"]
        for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    order = Window.partitionBy("length", "_block").orderBy(
        "doc_id", "start", "doc_tokens", F.xxhash64(*columns)
    )
    ranked = (
        blocked.withColumn("_local", F.row_number().over(order))
        .join(running_before(totals, ["length"], "_block", "_n"), ["length", "_block"])
        .withColumn("_rank", F.col("_before") + F.col("_local") - 1)
        .select(*columns, "_rank")
    )
    placed = place(counts, window)
    length, first = np.array(placed.length, np.int64), np.array(placed.first, np.int64)
    key = (length << _RANK_BITS) + first
    sort = np.argsort(key)
    table = pieces.sparkSession.sparkContext.broadcast(
        [key[sort]]
        + [np.array(x, np.int64)[sort] for x in (placed.first, placed.into, placed.per, placed.offset)]
    )
    schema = T.StructType(
        [
            *[f for f in ranked.schema.fields if f.name != "_rank"],
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, into, per, offset = table.value
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (size << _RANK_BITS) + rank, side="right") - 1
            along = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in columns]
                + [pa.array(into[at] + along // per[at]), pa.array(offset[at] + along % per[at] * size)],
                schema.names,
            )

    return ranked.select(*columns, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, *, window: int = WINDOW) -> DataFrame:
    """Every piece of every document with its token ids and its place in a window."""
    return assign_windows(
        durable(token_pieces(docs, tokenizer_path, pattern, window=window)), window=window, keep=["ids"]
    )
