"""Prefix sums and numbering that stay parallel when one key holds most rows.

A plain ``row_number() OVER (PARTITION BY key ORDER BY v)`` sorts a whole key in one task. Here the
order column is cut into fixed-width blocks, numbering runs inside ``(key, block)``, and the block
totals (one row per block) are accumulated separately. The result equals the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 65_536


def block_of(column: Column, width: int) -> Column:
    return F.floor(column / F.lit(width)).cast("long")


def running_before(totals: DataFrame, keys: Sequence[str], block: str, value: str) -> DataFrame:
    """Exclusive running sum of ``value`` over the block totals of every key."""
    order = Window.partitionBy(*keys).orderBy(block) if keys else Window.orderBy(block)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, block, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias("_before")
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    block_column: str | None = None,
    block_width: int = DEFAULT_BLOCK,
    dense: bool = False,
) -> DataFrame:
    """Number rows 1.. per key by ``order``; its first column is numeric and cut into blocks.

    ``dense`` numbers distinct order values instead of rows.
    """
    lead = block_column or order[0]
    blocked = df.withColumn("_block", block_of(F.col(lead), block_width))
    group = [*keys, "_block"]
    # Counted ahead of the exchange: only partial counts per block are shuffled for the totals.
    totals = blocked.groupBy(*group).agg(
        (F.countDistinct(*order) if dense else F.count(F.lit(1))).alias("_n")
    )
    offsets = running_before(totals, keys, "_block", "_n")
    window = Window.partitionBy(*group).orderBy(*order)
    local = F.dense_rank().over(window) if dense else F.row_number().over(window)
    joined = blocked.withColumn("_local", local).join(offsets, group)
    return joined.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop(
        "_block", "_local", "_before"
    )
