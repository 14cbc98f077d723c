"""Spelling variants: pairs of words one edit apart, and the form each rare spelling belongs to.

Two words one edit apart agree on all but one stretch of a few characters. Every word is listed once
for each of ``STRETCHES`` stretches under what lies around it (and under the length of the shorter
word of a pair, its own or one less), so that words of a pair meet in at least one list. A list that
would hold more than ``LIST_WORDS`` words is divided: its stretch is halved, and its words are listed
again under one half and under the other. A stretch of one character ends that, so lists are bounded
by the alphabet.

Inside a list the stretches are sorted and scanned for every word of the shorter length: rows of the
edit matrix, three cells wide, are kept for the prefix that neighbours share, and when a prefix is
more than one edit away, all words that share it are skipped.

Results for odd input: null and empty texts have no words; without an id no character is deleted;
words of any length are compared whole; rows that repeat count again; other columns are not carried;
an empty table gives an empty result. Among near words of equal count the smallest one is the form;
counts grow tenfold along forms, so following them ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightline.functions.spread import spread
from flightline.llm.text import lower_ascii
from flightline.plans.durable import durable

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form occurs at least so many times as often.
RATIO = 10
#: One in so many runs loses a character in the query's own noise rule.
NOISE = 31

STRETCHES = 3
LIST_WORDS = 2_000

_LETTERS = r"[A-Za-zÀ-ÿ]"


# --- words ------------------------------------------------------------------------------------


def noisy_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lower-cased runs of letters (column ``word``), one in ``NOISE`` without one character."""
    # Shorter runs cannot become words: a greedy match of so many letters is a whole run.
    found = F.regexp_extract_all(F.col(text), F.lit(rf"{_LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.col(doc_id).cast("string").alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    return hashed.select(F.when(F.col("h") % NOISE == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the words long and frequent enough."""
    return (
        words.filter(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_COUNT)
    )


# --- lists ------------------------------------------------------------------------------------


def _listed(words: DataFrame) -> DataFrame:
    """Words under their lists: ``shorter`` (length of a pair's shorter word), ``head`` and ``tail``."""
    lengths = words.withColumn("shorter", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    ends = [F.floor(F.col("shorter") * i / STRETCHES).cast("int") for i in range(STRETCHES + 1)]
    stretches = F.array(
        *[F.struct(ends[i].alias("head"), (F.col("shorter") - ends[i + 1]).alias("tail")) for i in range(STRETCHES)]
    )
    each = lengths.filter("shorter > 0").select("word", "n", "shorter", F.explode(stretches).alias("at"))
    return each.select("word", "n", "shorter", "at.head", "at.tail")


def _with_key(listed: DataFrame) -> DataFrame:
    size = F.length("word")
    around = F.concat(
        F.substring(F.col("word"), F.lit(1), F.col("head")),
        F.lit("\n"),
        F.substring(F.col("word"), size - F.col("tail") + 1, F.col("tail")),
    )
    return listed.withColumn("around", around)


def _halved(listed: DataFrame) -> DataFrame:
    inside = F.col("shorter") - F.col("head") - F.col("tail")
    half = F.floor(inside / 2).cast("int")
    first = F.struct(F.col("head"), (F.col("tail") + inside - half).alias("tail"))
    second = F.struct((F.col("head") + half).alias("head"), F.col("tail"))
    each = listed.select("word", "n", "shorter", F.explode(F.array(first, second)).alias("at"))
    return each.select("word", "n", "shorter", "at.head", "at.tail")


def bounded_lists(words: DataFrame, limit: int = LIST_WORDS) -> DataFrame:
    """All lists that hold a pair of words, those of more than ``limit`` words divided."""
    key = ["shorter", "head", "tail", "around"]
    waiting, done = _listed(words), None
    while True:
        keyed = _with_key(waiting)
        held = keyed.groupBy(*key).agg(
            F.count(F.lit(1)).alias("held"), F.count(F.when(F.length("word") == F.col("shorter"), 1)).alias("asking")
        )
        can_halve = F.col("shorter") - F.col("head") - F.col("tail") > 1
        wanted = held.filter((F.col("held") > 1) & (F.col("asking") > 0))
        sized = durable(
            keyed.join(wanted.select(*key, ((F.col("held") > limit) & can_halve).alias("large")), key)
        )
        small = sized.filter(~F.col("large")).drop("large")
        done = small if done is None else done.unionByName(small)
        large = sized.filter("large")
        if large.isEmpty():
            return done
        waiting = _halved(large)


# --- scan -------------------------------------------------------------------------------------


def near_in_list(stretches: Sequence[str], shorter: int) -> Iterator[tuple[int, int]]:
    """Places of the stretches one edit apart, the first of them ``shorter`` characters long.

    ``stretches`` are sorted and distinct, each ``shorter`` or one more character long.
    """
    count = len(stretches)
    shared = [0] * (count + 1)
    for i in range(1, count):
        a, b, k = stretches[i - 1], stretches[i], 0
        while k < len(a) and k < len(b) and a[k] == b[k]:
            k += 1
        shared[i] = k
    # The next place whose shared prefix with its neighbour is shorter.
    lower = [count] * (count + 1)
    open_: list[int] = []
    for i in range(count):
        while open_ and shared[open_[-1]] > shared[i]:
            lower[open_.pop()] = i
        open_.append(i)
    # rows[d] holds the cells d-1, d and d+1 of row d: edits from d characters of the scanned
    # stretch to so many of the asking one; 2 stands for more than one edit.
    rows = [(2, 0, 1)] + [(2, 2, 2)] * (shorter + 1)
    for asking, own in enumerate(stretches):
        if len(own) != shorter:
            continue
        place = kept = 0
        while place < count:
            other = stretches[place]
            depth = min(kept, shared[place])
            left, mid, right = rows[depth]
            dead = False
            while depth < len(other):
                sign = other[depth]
                # Row depth + 1 has the cells depth, depth + 1 and depth + 2 of the asking stretch.
                one = min(left + (0 < depth <= shorter and own[depth - 1] != sign) if depth else 1, mid + 1)
                two = min(mid + (own[depth] != sign), right + 1, one + 1) if depth < shorter else 2
                three = min(right + (own[depth + 1] != sign), two + 1) if depth + 1 < shorter else 2
                left, mid, right = min(one, 2), min(two, 2), min(three, 2)
                depth += 1
                rows[depth] = (left, mid, right)
                if left > 1 and mid > 1 and right > 1:
                    dead = True
                    break
            if not dead:
                # The end of the asking stretch, seen from a row of its own length or one more.
                if (mid if len(other) == shorter else left) == 1 and place != asking:
                    yield asking, place
                kept = depth
                place += 1
                continue
            kept = depth
            place += 1
            while place < count and shared[place] >= depth:
                place = lower[place]
    return


def near_pairs(lists: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near`` and ``near_n`` of all pairs one edit apart, both ways round."""
    key = ["shorter", "head", "tail", "around"]
    inside = F.substring(F.col("word"), F.col("head") + 1, F.length("word") - F.col("head") - F.col("tail"))
    rows = spread(lists.select(*key, inside.alias("inside"), "word", "n"), *key).sortWithinPartitions(*key, "inside")
    schema = T.StructType(
        [
            T.StructField("word", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("near", T.StringType()),
            T.StructField("near_n", T.LongType()),
        ]
    )

    def scanned(group: Sequence[tuple], shorter: int) -> Iterator[tuple]:
        for a, b in near_in_list([g[0] for g in group], shorter):
            yield group[a][1], group[a][2], group[b][1], group[b][2]
            if len(group[b][0]) > shorter:
                yield group[b][1], group[b][2], group[a][1], group[a][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for *place, inside, word, n in zip(*columns, strict=True):
                if place != now:
                    if len(group) > 1:
                        out += scanned(group, now[0] - now[1] - now[2])
                    now, group = place, []
                group.append((inside, word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema.names)
                out = []
        if len(group) > 1:
            out += scanned(group, now[0] - now[1] - now[2])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema.names)

    return rows.mapInArrow(run, schema).dropDuplicates(["word", "near"])


# --- forms ------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for the words with a form; forms are doubled until none has a further one."""
    roots = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(
            roots.join(step, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            )
        )
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def group_variants(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of a vocabulary."""
    counted = durable(words)
    pairs = near_pairs(bounded_lists(counted))
    # Of the near words with the largest count the smallest one.
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = durable(
        pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    )
    joined = durable(
        counted.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.order") >= RATIO * F.col("n"), F.col("best.near")).alias("form"),
            F.when(-F.col("best.order") >= RATIO * F.col("n"), -F.col("best.order")).alias("form_n"),
        )
    )
    roots = _roots(joined.filter(F.col("form").isNotNull()))
    return joined.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def spelling_variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return group_variants(vocabulary(noisy_runs(docs, doc_id=doc_id, text=text)))
