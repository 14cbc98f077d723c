"""A Merkle tree over a dataset: a subtree per source, a tree over the sources, and proofs per row.

Rows are numbered per source, and every aligned block of ``BLOCK`` consecutive nodes keeps its
lowest level as one string of hexadecimal digests. Parents are hashes of fixed-width substrings, so
a level is one string as well; the siblings of a node are the substrings to its left and right in
its run. The digests on top of the blocks are the nodes of the next climb, up to one digest per
source; those are the nodes of a last tree, numbered by source. A row's path is the path in its
block followed by the path of its block.

A block is a bounded group whatever the source, so one source with most rows is spread like many.
Texts are hashed where they are read and never moved; a proof is put together from its block and the
path of the block.

Results for odd input: a null is hashed as ``-``; rows without a source form the first subtree; rows
without an id come first in theirs; rows that share an id are in the order of their digests, and
repeated rows are leaves of their own; a source with one row is that leaf, a dataset with one source
is that subtree; the proof of a single row is the hash of nothing; texts of any length are hashed
whole; other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions.prefix import running_before
from flightline.llm.text import id_remainder
from flightline.plans.durable import durable

RUN = 3
#: Levels that a block climbs, and nodes of a block.
LEVELS = 6
BLOCK = RUN**LEVELS
DIGEST = 64

#: Rows that one numbering block should hold, and the fewest blocks.
NUMBERED = 100_000
LEAST_BLOCKS = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_POWERS = [RUN**level for level in range(LEVELS)]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as the leaves hash it: its length in bytes and its text, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return digest(*[field(changed.get(name, F.col(name))) for name in COLUMNS])


def numbered(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str]) -> DataFrame:
    """``pos`` from 0 by ``order`` per key, where ``block`` never falls along that order."""
    blocked = df.withColumn("_block", block)
    totals = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    window = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        blocked.withColumn("_local", F.row_number().over(window))
        .join(running_before(totals, keys, "_block", "_n"), [*keys, "_block"])
        .withColumn("pos", F.col("_before") + F.col("_local") - 1)
        .drop("_block", "_before", "_local")
    )


def _parents(level: Column) -> Column:
    """The level above, from one as text in bytes."""
    width = RUN * DIGEST
    starts = F.sequence(F.lit(1), F.octet_length(level), F.lit(width))
    return F.array_join(
        F.transform(starts, lambda at: F.sha2(F.substring(level, at, F.lit(width)), 256)), ""
    ).cast("binary")


def _path(levels: Column, at: Column) -> Column:
    """Siblings to the left and right of the node ``at`` on every level below the top."""
    powers = F.array(*[F.lit(p) for p in _POWERS])

    def siblings(level: Column, number: Column) -> Column:
        node = F.floor(at / F.get(powers, number)).cast("int")
        first = node - node % RUN
        left = F.substring(level, first * DIGEST + 1, (node - first) * DIGEST)
        right = F.substring(level, (node + 1) * DIGEST + 1, (first + RUN - 1 - node) * DIGEST)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), siblings)


def climb(nodes: DataFrame, most: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The path of every node up to the end of what ``above`` adds to the top of its tree.

    ``nodes`` has ``key``, ``pos`` (from 0 per key), ``n`` (nodes of the key), ``digest`` and
    ``held``, a struct that is carried along; no key has more than ``most`` nodes. ``above`` takes
    ``key`` and ``digest`` of every top and returns ``key``, ``path``, ``top`` and ``root``. The
    result has ``held``, ``digest``, ``path``, ``top`` and ``root``.
    """
    item = F.struct((F.col("pos") % BLOCK).cast("int").alias("at"), "digest", "held")
    grouped = (
        nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
        .groupBy("key", "block")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item), lambda a, b: a["at"] - b["at"]).alias("items"))
    )
    lowest = F.array_join(F.col("items.digest"), "").cast("binary")
    # A tree that ends in its only block is as high as it needs to be.
    steps = F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.col("n"))
    levels = F.aggregate(
        steps, F.array(lowest), lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1))))
    )
    blocks = durable(grouped.withColumn("levels", levels))
    tops = blocks.select("key", F.col("block").alias("pos"), "n", F.element_at("levels", -1).cast("string").alias("digest"))
    if most > BLOCK:
        held = F.struct(F.col("key").alias("tree"), F.col("pos").alias("block"))
        upper = tops.withColumn("n", F.ceil(F.col("n") / BLOCK)).withColumn("held", held)
        found = climb(upper, -(-most // BLOCK), above)
        higher = found.select(F.col("held.tree").alias("key"), F.col("held.block").alias("block"), "path", "top", "root")
    else:
        higher = above(tops.select("key", "digest")).withColumn("block", F.lit(0).cast("long"))
    rest = higher.select("key", "block", F.col("path").alias("rest"), "top", "root")
    each = blocks.join(rest, ["key", "block"]).select("levels", "rest", "top", "root", F.explode("items").alias("item"))
    return each.select(
        F.col("item.held").alias("held"),
        F.col("item.digest").alias("digest"),
        F.concat(_path(F.col("levels"), F.col("item.at")), F.col("rest")).alias("path"),
        "top",
        "root",
    )


def _root_paths(tops: DataFrame) -> DataFrame:
    """The path of every subtree to the root; ``top`` is the subtree's own digest."""
    tops = durable(tops)
    count = tops.count()
    # The first two bytes make 65,536 numbering blocks at most, in the order of the keys.
    block = F.hex(F.substring(F.col("key").cast("binary"), 2, 2))
    placed = numbered(tops, [], block, ["key"]).select(
        F.lit("").alias("key"), "pos", F.lit(count).cast("long").alias("n"), "digest", F.struct("key").alias("held")
    )

    def end(found: DataFrame) -> DataFrame:
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        return found.select("key", nothing.alias("path"), F.col("digest").alias("top"), F.col("digest").alias("root"))

    paths = climb(placed, max(count, 1), end)
    return paths.select(F.col("held.key").alias("key"), "path", F.col("digest").alias("top"), "root")


def tampered_text() -> Column:
    """The text without line ends where 2 divides the crc32 of the id."""
    changed = F.coalesce(id_remainder(F.col("doc_id"), 2) == 0, F.lit(False))
    return F.when(changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda found, step: digest(step["left"], found, step["right"]))


def manifest(docs: DataFrame, *, changed_text: Column | None = None) -> DataFrame:
    """Leaf, subroot, root, path and the refolded root of every row.

    ``path`` holds the siblings level by level; ``changed_text`` is what the text is when the root is
    folded anew from it.
    """
    now = tampered_text() if changed_text is None else changed_text
    hashed = docs.select(
        "doc_id",
        # Null first, then by bytes.
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
        leaf().alias("digest"),
        leaf(text=now).alias("changed"),
    )
    stored = durable(hashed)
    sizes = stored.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    width = 1
    if sizes.low is not None:
        width = max(1, -(-(sizes.high - sizes.low + 1) // max(LEAST_BLOCKS, sizes.n // NUMBERED)))
    block = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(sizes.low or 0))) / width), F.lit(-1))
    per_key = durable(stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    most = per_key.agg(F.max("n")).first()[0] or 1
    placed = numbered(stored, ["key"], block, ["doc_id", "digest"]).join(per_key, "key")
    nodes = placed.select("key", "pos", "n", "digest", F.struct("doc_id", "changed").alias("held"))
    found = climb(nodes, most, _root_paths)
    return found.select(
        F.col("held.doc_id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        "path",
        fold(F.col("held.changed"), F.col("path")).alias("folded_root"),
    )


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")
