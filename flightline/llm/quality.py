"""Quality rules from a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into ``BUCKETS`` cells. Two multinomials over the cells are counted,
one over all documents and one over trusted ones, both smoothed; a document's score is the mean over
its words and word pairs of the log ratio of trusted to raw probability. A document is kept if it
passes the base rules and its score is not below ``THRESHOLD``. The raw counts cover every document.
The trusted side is fitted on labelled rows and bounded: ``TRUSTED_DOCS`` documents at most, those
with the smallest hash of their id, so the set of ids can be broadcast.

The cell weights (``BUCKETS`` doubles, a fixed size) come to the driver and go back as one literal
array. Documents are never shuffled: all columns of a document are computed where it is read.

Results for odd input: a null text, or one without a word, has zero words and counts, fails the base
rules, has a null score and is not kept; repeated rows are judged one by one; a null id is kept and
never counts as trusted; without trusted documents all weights are zero and the base rules alone
decide; a score equal to the threshold is kept; texts of any length are read whole; columns other
than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.text import SPACES, let, words_of

BUCKETS = 16_384
SMOOTHING = 1.0
TRUSTED_DOCS = 20_000
THRESHOLD = -0.1
WINDOW_WORDS = 8

# Fixed characters and limits of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30


def count_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def count_duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    bare = lambda line: F.length(F.translate(line, SPACES, "")) > 0
    lines = F.filter(F.split(text, "\n"), bare)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def count_repeated_words(words: Column) -> Column:
    """Words covered by windows of ``WINDOW_WORDS`` words that occur twice or more in the text."""
    width = WINDOW_WORDS
    windows = F.when(
        F.size(words) >= width,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - F.lit(width - 1)),
            lambda i: F.xxhash64(F.slice(words, i, width)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        )
        repeated = let(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, i: F.struct(
                                x["at"].alias("at"),
                                (
                                    F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
                                    | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
                                ).alias("again"),
                            ),
                        ),
                        lambda x: x["again"],
                    ),
                    lambda x: x["at"],
                )
            ),
        )
        return F.aggregate(
            repeated,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
            lambda a, at: F.struct(
                (at + F.lit(width)).alias("end"),
                (a["total"] + F.least(F.lit(width), at + F.lit(width) - a["end"])).alias("total"),
            ),
            lambda a: a["total"].cast("long"),
        )

    # Most texts repeat no window: sorting is only paid for where the distinct count shows one.
    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")),
    )


def cells(words: Column) -> Column:
    """Cells of all words, then of all neighbouring pairs."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    cell = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    return let(
        hashes,
        lambda hs: F.concat(
            F.transform(hs, cell),
            F.when(
                F.size(hs) > 1,
                F.transform(
                    F.sequence(F.lit(1), F.size(hs) - 1),
                    lambda i: cell(F.xxhash64(F.get(hs, i - 1), F.get(hs, i))),
                ),
            ).otherwise(F.array().cast("array<int>")),
        ),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic, ``TRUSTED_DOCS`` at most, in the order of their hash."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    ids = good.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_DOCS)


def cell_weights(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row with an array of the log ratio of trusted to raw probability for every cell."""
    ids = F.broadcast(trusted_ids(labels).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))
    counted = (
        docs.select(F.col(doc_id).alias("_id"), words_of(F.col(text)).alias("_words"))
        .join(ids, "_id", "left")
        .select("_good", F.explode(cells(F.col("_words"))).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good"))
    )
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("cell"))
    filled = every.join(counted, "cell", "left").select(
        "cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")
    )
    ordered = filled.agg(
        F.sort_array(F.collect_list(F.struct("cell", "raw", "good"))).alias("cells"),
        F.sum("raw").alias("raw"),
        F.sum("good").alias("good"),
    )
    log_share = lambda n, total: F.log(
        (n + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * BUCKETS))
    )
    return ordered.select(
        F.transform(
            "cells",
            lambda c: F.when(F.col("good") == 0, F.lit(0.0)).otherwise(
                log_share(c["good"], F.col("good")) - log_share(c["raw"], F.col("raw"))
            ),
        ).alias("weights")
    )


def weight_array(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The cell weights as a constant array; runs the counting job."""
    weights = cell_weights(docs, labels, doc_id=doc_id, text=text).head()["weights"]
    # One string that the optimizer folds into an array literal, instead of an expression per cell.
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``keep`` columns with counts, ``base_failed``, ``score`` and ``kept`` for every row."""
    weights = weight_array(docs, labels, doc_id=doc_id, text=text)
    whole = F.coalesce(F.col(text), F.lit(""))
    measured = F.transform(
        F.array(words_of(whole)),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.when(F.size(words) > 0, F.length(F.translate(whole, SPACES, "")))
            .otherwise(F.lit(0))
            .cast("long")
            .alias("word_chars"),
            count_symbols(whole).alias("n_symbols"),
            count_duplicate_lines(whole).alias("n_dup_lines"),
            count_repeated_words(words).alias("n_repeat_words"),
            let(
                cells(words),
                lambda cs: F.when(
                    F.size(cs) > 0,
                    F.aggregate(cs, F.lit(0.0), lambda a, c: a + F.get(weights, c)) / F.size(cs),
                ),
            ).alias("score"),
        ),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # A generator's output is never copied into later expressions, so each text is measured once.
    flat = docs.select(*keep, F.explode(measured).alias("_m")).select(
        *keep, *[F.col(f"_m.{n}") for n in [*names, "score"]]
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return flat.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    )
