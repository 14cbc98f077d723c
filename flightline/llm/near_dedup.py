"""Near-duplicate documents from bottom-k sketches of one hash function.

A document is the set of its 5-word shingles, each a 64-bit hash. Its sketch is the ``SKETCH`` (k)
smallest hashes. Documents with equal sets form one class, so a group of exact copies is one entry
whatever its size, and classes are linked when 100 * intersection >= 75 * union on the full sets.

* *Inverted lists.* For every retained value the classes that hold it. Two linked classes share at
  least ``needed`` retained values: all of them where the sketches are whole sets (up to 48
  shingles, an exact bound), else ``LEAST_SHARED`` of k (a linked pair shares fewer with a
  probability under 1e-7). So each class is only listed under its ``k - needed + 1`` least frequent
  values, and a class that shares fewer than ``needed`` values with anyone is in no list. A line or
  passage that a third of all documents hold is among the most frequent values and makes no list.
* *Union sketch.* The k smallest values of both sketches estimate the similarity of a pair; pairs
  with fewer than ``needed`` common ones are dropped.
* *Exact check* on the full sets, which are built only for classes that stand in a list.

Lists are not expanded into pairs. Every round compares the members of a list with one pivot, a
member of the list's largest component, and merges what is linked; after ``PIVOT_ROUNDS`` rounds the
members still outside that component are compared with all members of another component, in blocks
that only give links back, so no link between components is lost and no pair is written that is not
a link. Components are found by joins, nothing is collected.

Results for odd input: a null, empty or blank text has no shingle and is linked with nothing; a text
of one to four words is one shingle; equal texts are one component; rows that share an id count as
one document; a row with a null id is linked with nothing, has a null component and is kept; other
columns are not read; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.components import smallest_reachable
from flightline.llm.text import let, lower_ascii, words_of
from flightline.plans.durable import durable

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
SKETCH = 64
#: Shared values that a linked pair of large documents has at least (48 expected, deviation 3.5; fewer
#: than this once in 4e7).
LEAST_SHARED = 28
PIVOT_ROUNDS = 2
#: Lists with at most so many open pairs are compared by a join, the others in blocks of rows with
#: sketches of ``WIDE`` values. Of the ``WIDE`` smallest values of their union linked pairs share 192
#: or more, whatever the sizes of the two (deviation 6.9), and under ``WIDE_SHARED`` less than once in 1e7.
PAIRS_JOINED = 1_000
BLOCK_ROWS = 2_048
WIDE = 256
WIDE_SHARED = 153

_EMPTY = "array<bigint>"


def shingle_set(text: Column) -> Column:
    """Sorted distinct hashes of the 5-word shingles of a text."""

    def hashed(words: Column) -> Column:
        return (
            F.when(
                F.size(words) >= SHINGLE_WORDS,
                F.transform(
                    F.sequence(F.lit(1), F.size(words) - F.lit(SHINGLE_WORDS - 1)),
                    lambda i: F.xxhash64(F.slice(words, i, SHINGLE_WORDS)),
                ),
            )
            .when(F.size(words) > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast(_EMPTY))
        )

    return F.sort_array(F.array_distinct(let(words_of(lower_ascii(text)), hashed)))


def needed(n: Column) -> Column:
    """Retained values that a class of ``n`` shingles shares with every class it is linked with."""
    whole = F.ceil(n * F.lit(SIMILAR_PERCENT) / 100).cast("int")
    return F.when(n <= SKETCH * SIMILAR_PERCENT // 100, whole).otherwise(F.lit(LEAST_SHARED))


def sketches(docs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, set size ``n``, digest of the set (``d1``, ``d2``) and ``sketch`` of every row."""
    sets = F.transform(
        F.array(shingle_set(F.col(text))),
        lambda s: F.struct(
            F.size(s).alias("n"),
            F.xxhash64(s).alias("d1"),
            F.hash(s).alias("d2"),
            F.slice(s, 1, SKETCH).alias("sketch"),
        ),
    )
    # A generator's output is never copied into later expressions, so each set is built once.
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(sets).alias("_s")).select(
        "doc_id", "_s.n", "_s.d1", "_s.d2", "_s.sketch"
    )


def inverted_lists(classes: DataFrame) -> DataFrame:
    """Entries ``v``, ``c``, ``n``: each class under its least frequent shared values."""
    entries = classes.select("c", "n", F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    held = (
        entries.join(shared, "v")
        .groupBy("c", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    )
    size = F.least(F.col("n"), F.lit(SKETCH))
    alone = size - F.size("held")
    prefix = size - needed(F.col("n")) + 1
    return held.filter(F.size("held") >= needed(F.col("n"))).select(
        F.explode(F.slice("held", 1, F.greatest(prefix - alone, F.lit(0)))).alias("_e"), "c", "n"
    ).select("_e.v", "c", "n")


def estimated_common(left: Column, right: Column) -> Column:
    """Values of both sketches among the k smallest of their union."""
    union = F.slice(F.sort_array(F.array_union(left, right)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(left, right)))


def linked_pairs(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the class pairs ``a``, ``b`` that are linked."""
    side = lambda t, c, *more: t.select(
        F.col("c").alias(c), *[F.col(m).alias(f"{m}_{c}") for m in more]
    )
    likely = (
        pairs.join(side(classes, "a", "n", "sketch"), "a")
        .join(side(classes, "b", "n", "sketch"), "b")
        .filter(
            (100 * F.least("n_a", "n_b") >= SIMILAR_PERCENT * F.greatest("n_a", "n_b"))
            & (
                estimated_common(F.col("sketch_a"), F.col("sketch_b"))
                >= F.greatest(needed(F.col("n_a")), needed(F.col("n_b")))
            )
        )
        .select("a", "b")
    )
    common = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    return (
        likely.join(side(sets, "a", "set"), "a")
        .join(side(sets, "b", "set"), "b")
        .filter((100 + SIMILAR_PERCENT) * common >= SIMILAR_PERCENT * total)
        .select("a", "b")
    )


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("c"))
    known = labels.select(F.col("node").alias("c"), F.col("label").alias("_label"))
    return lists.join(known, "c", "left").select(
        "v", "c", "n", F.coalesce("_label", "c").alias("label")
    )


def _pivots(lists: DataFrame, turn: int) -> DataFrame:
    """A member of the largest component of every list that spans several components."""
    parts = lists.groupBy("v", "label").agg(
        F.count(F.lit(1)).alias("m"),
        F.min(F.struct((F.xxhash64("v", "c", F.lit(turn)) if turn else F.col("c")).alias("h"), "c")).alias("p"),
    )
    return (
        parts.groupBy("v")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.max(F.struct("m", -F.col("label"), F.col("label").alias("label"), "p")).alias("best"),
        )
        .filter(F.col("parts") > 1)
        .select("v", F.col("best.label").alias("major"), F.col("best.p.c").alias("pivot"))
    )


def _ordered(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.select(
        F.least(left, right).alias("a"), F.greatest(left, right).alias("b")
    ).distinct()


def _common_in_union(left: np.ndarray, right: np.ndarray) -> int:
    """Values of both wide sketches among the ``WIDE`` smallest of their union."""
    values = np.sort(np.concatenate([left, right]))
    twice = values[1:] == values[:-1]
    # A value's place in the union is its place in the list less the repetitions before it.
    return int(np.count_nonzero(twice[np.arange(len(twice)) - np.cumsum(twice) + twice < WIDE]))


def _matches(minors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a block that are linked, or that sketches of ``WIDE`` values cannot tell from it.

    Where both sketches are whole sets the counts are exact and one link to each other component is
    enough. Other pairs are given once, from the smallest value whose list both are in.
    """
    found: list[tuple[int, int, bool]] = []
    if len(minors) and len(others):
        v = minors["v"].iloc[0]
        kept, sizes = others["wide"].map(len).to_numpy(), others["n"].to_numpy()
        values = np.concatenate(others["wide"].to_numpy())
        order = np.argsort(values, kind="stable")
        values, owners = values[order], np.repeat(np.arange(len(others)), kept)[order]
        labels, names, lists = others["label"].to_numpy(), others["c"].to_numpy(), others["lists"].to_numpy()
        wide = others["wide"].to_numpy()
        for c, label, n, own, mine in zip(
            minors["c"], minors["label"], minors["n"], minors["wide"], minors["lists"], strict=True
        ):
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            total = int((high - low).sum())
            steps = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low)
            common = np.bincount(owners[steps + np.arange(total)], minlength=len(others))
            apart = labels != label
            whole = (n <= WIDE) & (sizes <= WIDE)
            exact = whole & ((100 + SIMILAR_PERCENT) * common >= SIMILAR_PERCENT * (n + sizes))
            hits = np.nonzero(apart & exact)[0]
            _, first = np.unique(labels[hits], return_index=True)
            found += [(c, names[h], True) for h in hits[first]]
            likely = ~whole & (common >= WIDE_SHARED) & (
                100 * np.minimum(n, sizes) >= SIMILAR_PERCENT * np.maximum(n, sizes)
            )
            found += [
                (c, names[h], False)
                for h in np.nonzero(apart & likely)[0]
                if _common_in_union(own, wide[h]) >= WIDE_SHARED and np.intersect1d(mine, lists[h])[0] == v
            ]
    return pd.DataFrame(
        {
            "a": np.array([min(x, y) for x, y, _ in found], np.int64),
            "b": np.array([max(x, y) for x, y, _ in found], np.int64),
            "exact": np.array([e for _, _, e in found], bool),
        }
    )


def remaining_links(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components that still meet in a list.

    Members outside a list's largest component are compared with all of its members: where that is
    few pairs by a join, else in blocks of about ``BLOCK_ROWS`` a side that only give links and
    near misses back. Both ways are exact.
    """
    open_lists = _pivots(members, 0).select("v", "major")
    beside = members.join(open_lists, "v").withColumn("minor", F.col("label") != F.col("major"))
    sizes = beside.groupBy("v").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("minor").alias("minors")
    )
    beside = durable(beside.join(sizes, "v"))
    few = F.col("members") * F.col("minors") <= PAIRS_JOINED
    others = beside.filter(few).select("v", F.col("c").alias("o"), F.col("n").alias("m"), F.col("label").alias("olabel"))
    close = (F.col("label") != F.col("olabel")) & (
        100 * F.least("n", "m") >= SIMILAR_PERCENT * F.greatest("n", "m")
    )
    joined = beside.filter(few & F.col("minor")).join(others, "v").filter(close)

    big = beside.filter(~few)
    listed = members.join(big.select("c").distinct(), "c", "left_semi").groupBy("c").agg(
        F.sort_array(F.collect_list("v")).alias("lists")
    )
    wide = sets.select("c", F.slice("set", 1, WIDE).alias("wide")).join(listed, "c")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    entries = big.join(wide, "c").select(
        "v", "c", "n", "label", "minor", "wide", "lists",
        blocks("minors").alias("xs"), blocks("members").alias("ys"), F.xxhash64("c", F.lit("block")).alias("h"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    names = ["v", "c", "n", "label", "wide", "lists"]
    asked = entries.filter("minor").select(*names, own("xs").alias("x"), every("ys").alias("y"))
    # New names for the second use of the same rows, as both sides meet in one operator.
    again = [F.col(name).alias(name) for name in names]
    offered = entries.select(*again, every("xs").alias("x"), own("ys").alias("y"))
    keys = ["v", "x", "y"]
    matched = durable(
        asked.groupBy(*keys)
        .cogroup(offered.groupBy(*keys))
        .applyInPandas(_matches, "a long, b long, exact boolean")
        .distinct()
    )
    unsure = _ordered(joined, "c", "o").union(matched.filter(~F.col("exact")).select("a", "b")).distinct()
    return matched.filter("exact").select("a", "b").union(linked_pairs(unsure, classes, sets))


def link_classes(classes: DataFrame, docs: DataFrame, *, doc_id: str, text: str) -> DataFrame | None:
    """``node`` and ``label`` of every class that is linked with another one; None without lists."""
    lists = durable(inverted_lists(classes))
    listed = lists.select("c").distinct()
    rows = docs.select(F.col(doc_id).alias("c"), F.col(text).alias("_text"))
    # A class is named after the smallest id that has its set, so that row's text stands for it.
    sets = durable(
        rows.join(listed, "c", "left_semi").select("c", shingle_set(F.col("_text")).alias("set"))
    )
    labels: DataFrame | None = None
    links: DataFrame | None = None

    def merge(linked: DataFrame) -> None:
        nonlocal labels, links
        fresh = durable(linked)
        links = fresh if links is None else links.union(fresh)
        labels = smallest_reachable(links)

    for turn in range(PIVOT_ROUNDS):
        members = _labelled(lists, labels)
        beside = members.join(_pivots(members, turn), "v").filter(F.col("label") != F.col("major"))
        merge(linked_pairs(_ordered(beside, "c", "pivot"), classes, sets))
    members = durable(_labelled(lists, labels))
    merge(remaining_links(members, classes, sets))
    return labels


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` of every row."""
    rows = durable(sketches(docs, doc_id=doc_id, text=text))
    digest: Sequence[str] = ("n", "d1", "d2")
    linkable = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = durable(
        linkable.groupBy(*digest).agg(F.min("doc_id").alias("c"), F.first("sketch").alias("sketch"))
    )
    labels = link_classes(classes, docs, doc_id=doc_id, text=text)
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select(
        *digest, F.coalesce("label", "c").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(named, list(digest), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
