"""Nearest neighbours by vantage-point trees, one tree per shard.

Vectors are scaled to unit length, where the largest cosine is the smallest Euclidean distance.
Rows are dealt by a hash of their id into shards of about ``SHARD_ROWS`` rows. Every shard builds a
vantage-point tree: a node keeps one vector and splits the others at the median of their distance to
it. Queries, in blocks of about ``BLOCK_QUERIES``, descend all trees; by the triangle inequality a
branch can only hold a nearer vector if the query's distance to the vantage point lies within the
current k-th distance of the branch's range. That slack is divided by ``relaxation``: one gives the
exact result, more visits fewer branches. The k best of each shard meet in a last ranking.

Equal vectors of a shard are one entry of its tree that carries its smallest ids (as many as can be
among the k nearest), so a vector that a third of all rows share costs one comparison.
Scores are computed again from the original vectors in double precision, one fixed order of
operations for every pair, so equal vectors get equal scores.

Results for odd input: null vectors, zero vectors and vectors with a null or non-finite component
take no part, neither do rows with a null id or a vector of another length than the query's; a query
without any candidate gives no row; with fewer than k candidates all are returned; ties go to the
smaller id; a row repeated exactly is one candidate, rows that share an id with other vectors are
candidates each, never of their own id, and ask once with the smallest vector; columns other than id
and vector are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8_192
BLOCK_QUERIES = 4_096
LEAF_ROWS = 128
RELAXATION = 1.0

#: Rounding allowance on distances between unit vectors, and on their cosines.
_SLACK = 1e-7
_ROUNDING = 1e-12


@dataclass
class Tree:
    """A node is a leaf (``rows``) or a vantage point with two branches and their distance ranges."""

    rows: np.ndarray | None = None
    point: int = -1
    near: Tree | None = None
    far: Tree | None = None
    near_range: tuple[float, float] = (0.0, 0.0)
    far_range: tuple[float, float] = (0.0, 0.0)


def build_tree(unit: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    if len(rows) <= leaf:
        return Tree(rows=rows)
    # The row farthest from the first one: a vantage point at the border separates best.
    point = int(rows[np.argmin(unit[rows] @ unit[rows[0]])])
    rest = rows[rows != point]
    away = _distance(unit[rest] @ unit[point])
    order = np.argsort(away, kind="stable")
    half = len(rest) // 2
    near, far = order[:half], order[half:]
    return Tree(
        point=point,
        near=build_tree(unit, rest[near], leaf),
        far=build_tree(unit, rest[far], leaf),
        near_range=(float(away[near[0]]), float(away[near[-1]])),
        far_range=(float(away[far[0]]), float(away[far[-1]])),
    )


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


class _Search:
    """Best cosines of a block of queries against one shard, all queries of a node at once."""

    def __init__(
        self,
        unit: np.ndarray,
        queries: np.ndarray,
        k: int,
        relaxation: float,
        originals: tuple[np.ndarray, np.ndarray],
        smallest: np.ndarray,
    ) -> None:
        """``originals`` are rows and queries as given, ``smallest`` the smallest id of every row."""
        self.unit, self.queries, self.k, self.relaxation = unit, queries, k, relaxation
        self.originals, self.smallest = originals, smallest
        self.best = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1, np.int64)
        self.bound = np.full(len(queries), -np.inf)

    def offer(self, asked: np.ndarray, rows: np.ndarray, cosine: np.ndarray) -> None:
        every = np.concatenate([self.best[asked], cosine], axis=1)
        names = np.concatenate([self.rows[asked], np.broadcast_to(rows, cosine.shape)], axis=1)
        if every.shape[1] > self.k:
            keep = np.argpartition(-every, self.k - 1, axis=1)[:, : self.k]
            least = np.take_along_axis(every, keep, 1).min(axis=1) - _ROUNDING
            tied = np.isfinite(least) & ((every >= least[:, None]).sum(axis=1) > self.k)
            for at in np.nonzero(tied)[0]:
                close = np.nonzero(every[at] >= least[at])[0]
                keep[at] = close[self._ranked(asked[at], names[at, close])[: self.k]]
            every, names = np.take_along_axis(every, keep, 1), np.take_along_axis(names, keep, 1)
        self.best[asked], self.rows[asked] = every, names

    def _ranked(self, query: int, rows: np.ndarray) -> np.ndarray:
        """Order of rows whose cosines rounding cannot tell apart: exact score, then smallest id."""
        vectors, queries = self.originals
        score = exact_scores(np.broadcast_to(queries[query], (len(rows), queries.shape[1])), vectors[rows])
        return np.lexsort((self.smallest[rows], -score))

    def descend(self, tree: Tree, asked: np.ndarray) -> None:
        """A first bound: the k-th best cosine in the one leaf that each query falls into."""
        if not len(asked):
            return
        if tree.rows is not None:
            if len(tree.rows) >= self.k:
                cosine = self.queries[asked] @ self.unit[tree.rows].T
                self.bound[asked] = np.partition(cosine, len(tree.rows) - self.k, axis=1)[:, -self.k]
            return
        away = _distance(self.queries[asked] @ self.unit[tree.point])
        near = self._gap(away, tree.near_range) <= self._gap(away, tree.far_range)
        self.descend(tree.near, asked[near])
        self.descend(tree.far, asked[~near])

    def visit(self, tree: Tree, asked: np.ndarray) -> None:
        """Every branch that can still hold a nearer row, all queries of a branch together."""
        if not len(asked):
            return
        if tree.rows is not None:
            if len(tree.rows):
                self.offer(asked, tree.rows, self.queries[asked] @ self.unit[tree.rows].T)
            return
        cosine = self.queries[asked] @ self.unit[tree.point]
        self.offer(asked, np.array([tree.point]), cosine[:, None])
        away = _distance(cosine)
        for branch, span in ((tree.near, tree.near_range), (tree.far, tree.far_range)):
            reached = np.maximum(self.best[asked].min(axis=1), self.bound[asked])
            radius = _distance(reached) / self.relaxation
            self.visit(branch, asked[self._gap(away, span) <= radius + _SLACK])

    @staticmethod
    def _gap(away: np.ndarray, span: tuple[float, float]) -> np.ndarray:
        return np.maximum(np.maximum(span[0] - away, away - span[1]), 0.0)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed from the first component to the last for every pair."""

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
        return total

    return dot(left, right) / (np.sqrt(dot(left, left)) * np.sqrt(dot(right, right)))


def search_shard(
    ids: np.ndarray,
    vectors: np.ndarray,
    query_ids: np.ndarray,
    queries: np.ndarray,
    *,
    k: int,
    relaxation: float = RELAXATION,
) -> pd.DataFrame:
    """The k nearest rows of one shard for every query: ``query_id``, ``vec_id``, ``score``."""
    _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([group.ravel(), ids], axis=1), axis=0)
    group, ids = pairs[:, 0], pairs[:, 1]
    starts = np.searchsorted(group, np.arange(len(first)))
    most = k + int(np.unique(ids, return_counts=True)[1].max())
    # Smallest ids of every distinct vector; the rest of a group can never be among the k nearest.
    sizes = np.minimum(np.diff([*starts, len(group)]), most)
    distinct = vectors[first]
    scale = lambda m: m / np.sqrt((m * m).sum(axis=1))[:, None]
    unit, asked = scale(distinct), scale(queries)
    # More than k: the query's own rows may be among them.
    search = _Search(unit, asked, most, relaxation, (distinct, queries), ids[starts])
    tree, every = build_tree(unit, np.arange(len(unit))), np.arange(len(queries))
    search.descend(tree, every)
    search.visit(tree, every)
    q, column = np.nonzero(search.rows >= 0)
    entry = search.rows[q, column]
    pair_q, pair_entry = np.repeat(q, sizes[entry]), np.repeat(entry, sizes[entry])
    inside = np.arange(len(pair_q)) - np.repeat(np.cumsum(sizes[entry]) - sizes[entry], sizes[entry])
    rows = starts[pair_entry] + inside
    other = ids[rows] != query_ids[pair_q]
    pair_q, pair_entry, rows = pair_q[other], pair_entry[other], rows[other]
    score = exact_scores(queries[pair_q], distinct[pair_entry])
    ranked = np.lexsort((ids[rows], -score, pair_q))
    pair_q, rows, score = pair_q[ranked], rows[ranked], score[ranked]
    rank = np.arange(len(pair_q)) - np.searchsorted(pair_q, pair_q)
    kept = rank < k
    return pd.DataFrame(
        {"query_id": query_ids[pair_q[kept]], "vec_id": ids[rows[kept]], "score": score[kept]}
    )


def usable(table: DataFrame, *, vec_id: str, vector: str) -> DataFrame:
    """``_id`` and ``_v`` (doubles) of the rows that take part."""
    rows = table.select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    whole = F.forall(
        "_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists("_v", lambda x: x != 0)
    return rows.filter(F.col("_id").isNotNull() & F.col("_v").isNotNull() & whole)


def nearest(
    table: DataFrame,
    is_query,
    *,
    k: int = 5,
    relaxation: float = RELAXATION,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest other rows of every query.

    ``is_query`` takes the id column and says which rows are queries.
    """
    rows = usable(table, vec_id=vec_id, vector=vector).withColumn("_d", F.size("_v"))
    sizes = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(is_query(F.col("_id")), 1)).alias("queries")
    ).head()
    shards = max(1, -(-sizes["rows"] // SHARD_ROWS))
    blocks = max(1, -(-sizes["queries"] // BLOCK_QUERIES))
    key = F.xxhash64("_id", "_v")
    candidates = rows.select(
        "*",
        F.pmod(key, F.lit(shards)).cast("int").alias("_shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    )
    # Rows that repeat a query's id ask once, with the smallest of its vectors.
    once = rows.filter(is_query(F.col("_id"))).groupBy("_id", "_d").agg(F.min("_v").alias("_v"))
    asked = once.select(
        "*",
        F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"),
    )
    empty = pd.DataFrame(
        {"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)}
    )

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty
        return search_shard(
            left["_id"].to_numpy(),
            np.stack(left["_v"].to_numpy()),
            right["_id"].to_numpy(),
            np.stack(right["_v"].to_numpy()),
            k=k,
            relaxation=relaxation,
        )

    keys = ["_shard", "_block", "_d"]
    found = (
        candidates.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(match, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
