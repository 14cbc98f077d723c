"""Language identification by compression.

For every language of the labelled rows a raw-content zstandard dictionary is filled from a bounded
sample. A text is folded to lower-case letters and single spaces, cut into blocks, and every block
is compressed with each dictionary; the language whose dictionary gives the fewest bytes over the
whole text wins. When the runner-up is closer than ``min_margin`` of its size, the text is rejected
(the prediction is still reported).

``SAMPLE_DOCS`` documents a language at most, taken in the order of a hash of their id, fill a
dictionary of ``DICTIONARY_BYTES`` at most. Of a long document ``SLICES`` slices are read, spread
evenly over the whole text; every sampled document gives the same share of the dictionary, or all it
has where that is less. Only the dictionaries are bounded, predictions read whole texts.

Results for odd input: a null text, or one without a letter, is ``und`` with score 0 and rejected;
a tie goes to the language with more labelled rows, then to the smaller name, and is rejected;
labelled rows with a null id, text or language are not learned from, repeated ones once; without any labelled row every
text is ``und``; repeated rows, null ids, extra columns and texts of any length are carried through.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
SAMPLE_DOCS = 400
#: Slices of a sampled text and characters of each, before folding.
SLICES = 8
SLICE_CHARS = 500
DICTIONARY_BYTES = 250_000
BLOCK_BYTES = 8_192
LEVEL = 3
MIN_MARGIN = 0.002

_SALTS = 64
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Lower-case letters of a text, everything else collapsed to single spaces."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def sample_per_language(labelled: DataFrame, *, doc_id: str, text: str, lang: str) -> DataFrame:
    """At most ``SAMPLE_DOCS`` rows a language, the smallest hashes of the id."""
    usable = labelled.filter(
        F.col(doc_id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull()
    )
    # A repeated row is one key.
    ranked = usable.select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("h"), F.xxhash64(text).alias("t")
    ).distinct()
    # Salted first: a language that holds most rows is cut down in many tasks.
    for keys in (("lang", "salt"), ("lang",)):
        window = Window.partitionBy(*keys).orderBy("h", "doc_id", "t")
        ranked = (
            ranked.withColumn("salt", F.pmod("h", F.lit(_SALTS)))
            .withColumn("rank", F.row_number().over(window))
            .filter(F.col("rank") <= SAMPLE_DOCS)
        )
    # At most SAMPLE_DOCS keys a language; rows with the same key hold the same text.
    keys = F.broadcast(ranked.select("lang", "doc_id", "h", "t"))
    each = usable.select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("t"), _slices(text).alias("slices")
    )
    return each.join(keys, ["lang", "doc_id", "t"]).groupBy("lang", "h", "doc_id", "t").agg(F.first("slices").alias("slices"))


def _slices(text: str) -> Column:
    """Slices spread evenly over a text, or the whole of a short one."""
    long = F.length(text) > SLICES * SLICE_CHARS
    step = (F.length(text) - SLICE_CHARS) / (SLICES - 1)
    spread = F.array(
        *[F.substring(F.col(text), F.floor(step * i).cast("int") + 1, F.lit(SLICE_CHARS)) for i in range(SLICES)]
    )
    return F.when(long, spread).otherwise(F.array(text))


def even_share(sizes: Sequence[int], most: int) -> int:
    """The largest share of which every size gives at most so much, all together ``most``."""
    left = most
    for given, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - given)
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def train(
    labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> list[tuple[str, bytes]]:
    """Languages with their dictionary content, the most frequent first."""
    counts = {
        row["lang"]: row["n"]
        for row in labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .groupBy(F.col(lang).alias("lang"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    content: dict[str, list[list[bytes]]] = {}
    rows = sample_per_language(labelled, doc_id=doc_id, text=text, lang=lang).collect()
    for row in sorted(rows, key=lambda r: (r["h"], r["doc_id"], r["t"])):
        content.setdefault(row["lang"], []).append([(folded(part) + " ").encode() for part in row["slices"]])
    order = sorted(content, key=lambda name: (-counts.get(name, 0), name))
    return [(name, _dictionary(content[name])) for name in order]


def _dictionary(documents: Sequence[Sequence[bytes]]) -> bytes:
    share = even_share([sum(map(len, parts)) for parts in documents], DICTIONARY_BYTES)
    return b"".join(part[: share // len(parts)] for parts in documents for part in parts)


class Classifier:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, languages: Sequence[tuple[str, bytes]]) -> None:
        self.names = [name for name, _ in languages]
        self._compressors = []
        for _, content in languages:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self._compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL,
                    dict_data=made,
                    write_content_size=False,
                    write_checksum=False,
                    write_dict_id=False,
                )
            )

    def classify(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        """Language, score (share saved against the runner-up, 0 to 1) and whether it is rejected."""
        if not self.names or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0, True
        data = folded(text).encode() + b" "
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self._compressors]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.names[0], 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / second
        return self.names[order[0]], margin, margin < min_margin


@functools.lru_cache(maxsize=2)
def _classifier(state: bytes) -> Classifier:
    return Classifier(pickle.loads(state))


def identify(
    df: DataFrame,
    languages: Sequence[tuple[str, bytes]],
    *,
    text: str = "text",
    min_margin: float = MIN_MARGIN,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected`` (``names`` gives other column names)."""
    called = {"lang_pred": "lang_pred", "score": "score", "rejected": "rejected"} | dict(names or {})
    state = df.sparkSession.sparkContext.broadcast(pickle.dumps(list(languages)))
    rest = [f for f in df.schema.fields if f.name not in called.values()]
    schema = T.StructType(
        [
            *rest,
            T.StructField(called["lang_pred"], T.StringType()),
            T.StructField(called["score"], T.DoubleType()),
            T.StructField(called["rejected"], T.BooleanType()),
        ]
    )
    kept = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _classifier(state.value)
        for batch in batches:
            found = [model.classify(t, min_margin) for t in batch.column(text).to_pylist()]
            columns = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + columns, [*kept, *called.values()]
            )

    return df.select(*kept).mapInArrow(run, schema)
