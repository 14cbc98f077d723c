"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model crosses from a character to a following white-space marker, so a marked word
(one or more markers with the characters up to the next marker) is segmented the same way wherever
it stands. A task therefore keeps a bounded table from distinct marked words to their ids, asks the
model once for the words of a batch that are not in it yet, and joins the ids back by position. A
model for which this does not hold is refused. Nothing is shuffled.

Results for odd input: a null or empty text has no ids and decodes to the empty text; runs of
spaces, leading and trailing spaces and literal marker characters come out exactly as the model
itself segments them; null ids of documents, repeated rows and extra columns are carried along;
texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Words a task remembers; the table is emptied when it is full, so memory stays bounded.
TABLE_WORDS = 150_000
#: Texts segmented at a time; ids are Python numbers only inside such a group.
GROUP_ROWS = 128

_RUN = re.compile(" +[^ ]*")


@functools.cache
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def words_are_independent(path: str) -> bool:
    """True if no piece has a marker after another character and plain text is left as it is."""
    model = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    crossing = any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces)
    probe = "ﬁ Éa　é  x"
    return not crossing and model.decode(model.encode(probe)) == probe


def marked_words(text: str) -> list[str]:
    """Marked words, each without its first marker, which the model puts back itself."""
    text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [run[1:] for run in _RUN.findall(" " + text)]
    return text.split(" ")


class WordTable:
    """Ids of distinct marked words, bounded in size."""

    def __init__(self, path: str, limit: int = TABLE_WORDS) -> None:
        self._model = _model(path)
        self._limit = limit
        self._ids: dict[str, list[int]] = {}

    def encode(self, texts: Sequence[str | None]) -> list[list[int]]:
        split = [marked_words(text) if text else [] for text in texts]
        if len(self._ids) > self._limit:
            self._ids.clear()
        table = self._ids
        fresh = {word for words in split for word in words}.difference(table)
        if "" in fresh:
            # A lone marker: the model adds none to an empty text, so it is looked up by name.
            table[""] = [self._model.piece_to_id(MARK)]
            fresh.discard("")
        asked = list(fresh)
        if asked:
            table.update(zip(asked, self._model.encode(asked, num_threads=1), strict=True))
        out = []
        for words in split:
            ids: list[int] = []
            for word in words:
                ids += table[word]
            out.append(ids)
        return out


@functools.cache
def _table(path: str) -> WordTable:
    return WordTable(path)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP_ROWS):
            yield batch.slice(at, GROUP_ROWS)


def _lists(rows: Sequence[Sequence[int]]) -> pa.Array:
    flat: list[int] = []
    offsets = [0]
    for row in rows:
        flat += row
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_documents(df: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the text column replaced by its piece ids."""
    if not words_are_independent(model_path):
        raise ValueError("pieces of this model cross word borders; encode whole texts instead")
    rest = [f for f in df.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for batch in groups(batches):
            found = table.encode(batch.column(text).to_pylist())
            columns = [batch.column(n) for n in names] + [_lists(found)]
            yield pa.RecordBatch.from_arrays(columns, [*names, ids])

    return df.select(*names, text).mapInArrow(run, schema)


def decode_documents(
    df: DataFrame, model_path: str, *, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``df`` with the text its ids stand for, by the model's own decoder."""
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in groups(batches):
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            texts, at = [], 0
            for size in column.value_lengths().to_pylist():
                size = size or 0
                texts.append(model.decode(flat[at : at + size].tolist()) if size else "")
                at += size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, decoded]
            )

    return df.mapInArrow(run, schema)
