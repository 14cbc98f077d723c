"""Scoring texts with a log-bilinear language model.

Tokens are the words of a text, A-Z folded, then one end token. Counting covers every training text:
a table of all words with their counts stays distributed; words with at least 1 in ``FREQUENT``
training tokens (so ``FREQUENT`` words at most) and the end token, whatever its share, go to the tasks,
counts of all others meet the texts in one join. The model predicts the class of a token from the classes of the two tokens before it.
``TOP_WORDS`` words are classes of their own, other words fall into ``BUCKETS`` buckets by their first
letters; inside a bucket a word has its smoothed share of the bucket's training tokens.

Training covers every training text once, in ``ROUNDS`` parts: in each round every task starts from
the last round's parameters and learns from its own texts, and the parameters are averaged by the
number of tokens. Only the averaged parameters (a fixed size) and the counts of frequent words meet
the driver.

Results for odd input: a null or empty text is the end token alone; a row with a null id is scored but
not learned from; repeated rows are scored one by one; texts of any length are read whole; columns
other than id and text are not read; without training texts N, V and all counts are zero, the base
score is a whole multiple of log10(0.5 / 0.5) = 0 and the model's score is null; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.lbl import Model, Scorer, Trainer
from flightline.llm.text import lower_ascii, words_of
from flightline.plans.durable import durable

FREQUENT = 2_000_000
TOP_WORDS = 383
BUCKETS = 128
BUCKET_BYTES = 4
ROUNDS = 3
#: Texts handled at a time inside a task.
GROUP_ROWS = 512

#: No word holds a space, so this stands for the end token in the table of counts.
END = " "
_CLASSES = 1 + BUCKETS + TOP_WORDS


def bucket_of(word: bytes) -> int:
    return 1 + zlib.crc32(word[:BUCKET_BYTES]) % BUCKETS


class _BucketTable(dict):
    """Buckets by first letters; words have far fewer beginnings than forms."""

    def __missing__(self, letters: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[letters] = found = bucket_of(letters)
        return found


def bucket_column(word: Column) -> Column:
    """``bucket_of`` as a column."""
    return (F.lit(1) + F.crc32(F.substring(word.cast("binary"), 1, BUCKET_BYTES)) % F.lit(BUCKETS)).cast("int")


@dataclass
class Words:
    """What tasks know about words. Class 0 is the end, then the buckets, then the top words."""

    place: dict[bytes, int]
    classes: np.ndarray
    counts: np.ndarray
    shares: np.ndarray
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    tokens: int
    distinct: int

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def bucket_total(self) -> np.ndarray:
        """log10 of what shares inside a bucket are divided by."""
        return np.log10(self.bucket_tokens + 0.5 * (self.bucket_words + 1))


def token_counts(training: DataFrame, *, text: str = "text") -> DataFrame:
    """``word`` and ``c`` of every distinct training token, the end token included."""
    tokens = F.concat(words_of(lower_ascii(F.col(text))), F.array(F.lit(END)))
    return training.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def known_words(counts: DataFrame) -> Words:
    """Totals, frequent words and bucket sizes from the stored table of counts."""
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).head()
    tokens, distinct = totals["n"] or 0, totals["v"]
    frequent = [
        (row["word"], row["c"])
        for row in counts.filter((F.col("c") * FREQUENT >= tokens) | (F.col("word") == END))
        .orderBy(F.desc("c"), "word")
        .collect()
    ]
    top = [word for word, _ in frequent if word != END][:TOP_WORDS]
    own = {END: 0} | {word: 1 + BUCKETS + k for k, word in enumerate(top)}
    sizes = np.zeros(_CLASSES)
    bucket_tokens, bucket_words = np.zeros(_CLASSES), np.zeros(_CLASSES)
    in_buckets = counts.filter(~F.col("word").isin([END, *top])) if top else counts.filter(F.col("word") != END)
    for row in (
        in_buckets.groupBy(bucket_column(F.col("word")).alias("b"))
        .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
        .collect()
    ):
        bucket_tokens[row["b"]], bucket_words[row["b"]] = row["n"], row["v"]
        sizes[row["b"]] = row["n"]
    place, classes, held = {}, [], []
    for word, count in frequent:
        place[word.encode()] = len(held)
        classes.append(own[word] if word in own else bucket_of(word.encode()))
        held.append(count)
        if word in own:
            sizes[own[word]] = count
    shares = (sizes + 0.5) / (sizes + 0.5).sum()
    return Words(
        place, np.array(classes, np.int64), np.array(held, np.int64), shares,
        bucket_tokens, bucket_words, tokens, distinct,
    )


def _words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: bytes fold A-Z and split at the six ASCII white spaces only."""
    return text.lower().split() if text else []


def _contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the last token and the one before it; texts begin after two ends."""
    last, before = np.zeros_like(classes), np.zeros_like(classes)
    last[1:], before[2:] = classes[:-1], classes[:-2]
    last[starts], before[starts] = 0, 0
    second = starts + 1
    before[second[second < len(before)]] = 0
    return last, before


class _Tokens:
    """Tokens of a group of texts: place among the frequent words (-1 if rare), class, text."""

    def __init__(self, texts: list[bytes | None], words: Words, buckets: _BucketTable) -> None:
        place, classes, lengths = [], [], []
        #: Rare words of every text.
        self.rare: list[list[bytes]] = []
        end = words.place.get(END.encode(), -1)
        get = words.place.get
        for text in texts:
            tokens = _words(text)
            found = [get(w, -1) for w in tokens]
            rare = [w for w, p in zip(tokens, found, strict=True) if p < 0]
            self.rare.append(rare)
            place += found
            place.append(end)
            classes += [buckets[w[:BUCKET_BYTES]] for w in rare]
            lengths.append(len(found) + 1)
        self.place = np.array(place, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths) - 1
        self.starts = self.ends - self.lengths + 1
        self.known = self.place >= 0
        self.classes = np.zeros(len(self.place), np.int64)
        self.classes[self.known] = words.classes[self.place[self.known]] if len(words.classes) else 0
        unknown = ~self.known
        unknown[self.ends] = False
        self.classes[unknown] = classes
        self.last, self.before = _contexts(self.classes, self.starts)


def _group_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP_ROWS):
            yield batch.slice(at, GROUP_ROWS)


def train(training: DataFrame, words: Words, *, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model after ``ROUNDS`` rounds of averaging, each over its part of the training texts."""
    context = training.sparkSession.sparkContext
    shared = context.broadcast(words)
    model = Model.start(words.shares)
    part = F.pmod(F.xxhash64(doc_id, F.lit("round")), F.lit(ROUNDS))
    for turn in range(ROUNDS):
        start = context.broadcast(model.flat())

        def learn(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            known = shared.value
            own = Model.from_flat(start.value.copy(), _CLASSES)
            trainer, seen, buckets = Trainer(own, known.shares, turn), 0, _BucketTable()
            for group in _group_texts(batches):
                tokens = _Tokens(group.column(0).cast(pa.binary()).to_pylist(), known, buckets)
                trainer.learn(tokens.last, tokens.before, tokens.classes)
                seen += len(tokens.classes)
            if seen:
                values = own.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(values), dtype=np.int32)),
                        pa.array(values * seen),
                        pa.array(np.full(len(values), float(seen))),
                    ],
                    ["i", "weighted", "weight"],
                )

        rows = (
            training.filter(part == turn)
            .select(text)
            .mapInArrow(learn, "i int, weighted double, weight double")
            .groupBy("i")
            .agg((F.sum("weighted") / F.sum("weight")).alias("value"))
            .collect()
        )
        if rows:
            values = np.empty(len(rows), np.float32)
            for row in rows:
                values[row["i"]] = row["value"]
            model = Model.from_flat(values, _CLASSES)
    return model


@functools.lru_cache(maxsize=1)
def _scorer(state: bytes) -> Scorer:
    return Scorer(Model.from_flat(np.frombuffer(state, np.float32), _CLASSES))


_ROWS = (
    "_row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, model double, "
    "word string, n long"
)


def score(
    docs: DataFrame,
    counts: DataFrame,
    words: Words,
    model: Model,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    held_out: str = "held_out",
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    context = docs.sparkSession.sparkContext
    shared, state = context.broadcast(words), context.broadcast(model.flat().tobytes())
    id_type = dict(docs.dtypes)[doc_id]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = _scorer(state.value)
        inside = known.bucket_total()
        base_log = known.base_log(known.counts)
        in_bucket = (known.classes > 0) & (known.classes <= BUCKETS)
        own_log = np.where(in_bucket, np.log10(known.counts + 0.5) - inside[known.classes], 0.0)
        # What a rare word adds besides log10(c + 0.5), which the join brings.
        rare_base = -np.log10(known.tokens + 0.5 * (known.distinct + 1))
        row, buckets = TaskContext.get().partitionId() << 40, _BucketTable()
        for group in _group_texts(batches):
            tokens = _Tokens(group.column(1).cast(pa.binary()).to_pylist(), known, buckets)
            base, own = np.full(len(tokens.place), rare_base), -inside[tokens.classes]
            at = tokens.place[tokens.known]
            base[tokens.known], own[tokens.known] = base_log[at], own_log[at]
            own[tokens.ends] = 0.0
            if not known.tokens:
                base[:] = 0.0
            total = scorer.log10(tokens.last, tokens.before, tokens.classes) + own
            sums = [np.add.reduceat(x, tokens.starts) if len(x) else x for x in (base, total, tokens.known * 1)]
            source, words_out, numbers = [], [], []
            for k, rare in enumerate(map(Counter, tokens.rare)):
                # Texts without a rare word send one row, under a key of their own.
                source += [k] * max(1, len(rare))
                words_out += rare.keys() or [f"{END}{row + k}".encode()]
                numbers += rare.values() or [0]
            source = np.array(source, np.int64)
            first = np.ones(len(source), bool)
            first[1:] = source[1:] != source[:-1]
            only = lambda values: pa.array(np.asarray(values)[source], mask=~first)
            places = pa.array(source)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + source),
                    group.column(0).take(places),
                    group.column(2).take(places),
                    only(tokens.lengths),
                    only(sums[2].astype(np.int64)),
                    only(sums[0]),
                    only(sums[1]),
                    pa.array(words_out, pa.binary()).cast(pa.string()),
                    pa.array(numbers, pa.int64()),
                ],
                ["_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "word", "n"],
            )
            row += group.num_rows

    parts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(held_out).alias("held_out"))
    rows = parts.mapInArrow(measure, _ROWS.format(id=id_type))
    # Frequent words never leave the tasks as words, so only the rare rows of the counts are met.
    rare = counts.filter(F.col("c") * FREQUENT < words.tokens)
    found = F.coalesce("c", F.lit(0))
    extra = F.when(F.lit(words.tokens > 0), F.col("n") * F.log10(found + 0.5)).otherwise(F.lit(0.0))
    summed = (
        rows.join(rare, "word", "left")
        .groupBy("_row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)))).alias("n_known"),
            (F.max("base") + F.sum(extra)).alias("base_score"),
            (F.max("model") + F.sum(extra)).alias("score"),
        )
    )
    modelled = F.col("score") if words.tokens else F.lit(None).cast("double")
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        "base_score",
        modelled.alias("score"),
    )


def score_documents(docs: DataFrame, is_training: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows of ``is_training`` and score every row; ``held_out`` are the others."""
    chosen = F.coalesce(is_training, F.lit(False)) & F.col(doc_id).isNotNull()
    training = docs.filter(chosen)
    counts = durable(token_counts(training, text=text))
    words = known_words(counts)
    model = train(training, words, doc_id=doc_id, text=text)
    marked = docs.select(F.col(doc_id), F.col(text), (~chosen).alias("held_out"))
    return score(marked, counts, words, model, doc_id=doc_id, text=text)
