"""Background candidates, review verdicts and the temporal median image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import DEFAULT_BLOCK, block_of
from ..functions.spread import image_tasks, spread

TILE_ROWS = 64
METHODS = ("temporary first frame", "single frame", "stratified median")


def stratified_candidates(
    recordings: DataFrame, target: int, *, per_stratum: int = 4, seed: int
) -> DataFrame:
    """Random candidate frames in passes over equal time strata; pass 0 has one per stratum.

    Draws are ordered by a seeded hash, so they are reproducible on any cluster layout.
    """
    if target <= 0 or per_stratum <= 0:
        raise ValueError("target and candidates per stratum must be positive")
    strata = F.least(F.col("frame_count"), F.lit(target)).cast("long")
    slices = recordings.where(F.col("frame_count") > 0).select("run_id", "frame_count", strata.alias("strata")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strata") - 1)).alias("stratum")
    )
    # Stratum s of S takes the frames s * n / S .. (s + 1) * n / S - 1, in integers.
    ranges = slices.select(
        "run_id", "stratum", F.expr("stratum * frame_count div strata").alias("_from"),
        F.expr("(stratum + 1) * frame_count div strata - 1").alias("_to"),
    )
    parts = spread(
        ranges.select(
            "*", F.explode(F.sequence(block_of(F.col("_from"), DEFAULT_BLOCK), block_of(F.col("_to"), DEFAULT_BLOCK))).alias("_part")
        ),
        "run_id", "stratum", "_part",
    )
    # A row draws for its own frames and hands on the lowest: frames are neither moved nor sorted as rows.
    frames = F.sequence(
        F.greatest(F.col("_from"), F.col("_part") * DEFAULT_BLOCK),
        F.least(F.col("_to"), (F.col("_part") + 1) * DEFAULT_BLOCK - 1),
    )
    draws = F.transform(
        frames, lambda f: F.struct(F.xxhash64(F.lit(seed), F.col("run_id"), f).alias("_draw"), f.alias("frame_index"))
    )
    lowest = F.slice(F.sort_array(draws), 1, per_stratum)
    whole = Window.partitionBy("run_id", "stratum").orderBy("_draw", "frame_index")
    return (
        parts.select("run_id", "stratum", F.inline(lowest))
        .withColumn("pass_no", (F.row_number().over(whole) - 1).cast("int"))
        .where(F.col("pass_no") < per_stratum)
        .select("run_id", "pass_no", "stratum", "frame_index")
    )


def accept_candidates(candidates: DataFrame, verdicts: DataFrame, target: int) -> DataFrame:
    """Walk candidates in pass order and keep the first ``target`` accepted ones.

    Candidates per run are at most strata times passes, both fixed by settings.
    """
    judged = candidates.join(
        verdicts.where("accepted").select("run_id", "frame_index"), ["run_id", "frame_index"]
    )
    order = Window.partitionBy("run_id").orderBy("pass_no", "stratum")
    return (
        judged.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= target)
        .select("run_id", "place", "frame_index")
    )


def provenance(accepted: DataFrame, method: str, seed: int | None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown background method: {method}")
    return accepted.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "frame_index"))).alias("_f")
    ).select(
        "run_id", F.lit(method).alias("method"),
        F.transform("_f", lambda f: f["frame_index"]).alias("frame_indices"),
        F.lit(seed).cast("long").alias("candidate_seed"),
    )


def _median_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, stack = None, []

    def finish():
        tile = np.median(np.stack(stack), axis=0).astype(np.uint8)
        return (*key, tile.tobytes())

    for batch in batches:
        out = []
        for run_id, tile, height, width, data in zip(*[c.to_pylist() for c in batch.columns]):
            if (run_id, tile, height, width) != key:
                if stack:
                    out.append(finish())
                key, stack = (run_id, tile, height, width), []
            stack.append(np.frombuffer(data, dtype=np.uint8))
        if out:
            yield _tile_batch(out)
    if stack:
        yield _tile_batch([finish()])


def _tile_batch(rows):
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
        names=["run_id", "tile", "height", "width", "data"],
    )


def temporal_median(selected: DataFrame) -> DataFrame:
    """Per-pixel median over the selected frames of each run.

    Frames are cut into row tiles on the JVM side; a task holds the tile stack of one run, and the
    number of selected frames is a setting (eleven by default). A run whose frames differ in shape,
    or do not fill it, has a row with ``problem`` set and no image.
    """
    shapes = selected.groupBy("run_id").agg(
        F.min(F.struct("height", "width")).alias("_lo"), F.max(F.struct("height", "width")).alias("_hi"),
        F.bool_and(F.length("bgr") == F.col("height") * F.col("width") * 3).alias("_ok"),
    )
    equal = F.coalesce((F.col("_lo") == F.col("_hi")) & F.col("_ok"), F.lit(False))
    good = shapes.where(equal).select("run_id")
    refused = shapes.where(~equal).select(
        "run_id", F.lit("frames of unequal or unfilled shape").alias("problem")
    )
    row_bytes = F.col("width") * 3
    # Cut first, explode the pieces: a frame is copied once, not once per tile.
    tiles = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("height") - 1) / TILE_ROWS).cast("int")),
        lambda tile: F.struct(
            tile.alias("tile"),
            F.substring(
                F.col("bgr"), (tile * TILE_ROWS * row_bytes + 1).cast("int"),
                (F.lit(TILE_ROWS) * row_bytes).cast("int"),
            ).alias("data"),
        ),
    )
    cut = selected.join(good, "run_id", "left_semi").select(
        "run_id", "height", "width", F.explode(tiles).alias("_t")
    ).select(
        "run_id", "_t.tile", F.col("height").cast("int").alias("height"),
        F.col("width").cast("int").alias("width"), "_t.data",
    )
    medians = (
        spread(cut, "run_id", "tile", least=image_tasks(selected))
        .sortWithinPartitions("run_id", "tile", "height", "width")
        .mapInArrow(
            _median_rows, "run_id string, tile int, height int, width int, data binary"
        )
    )
    parts = F.sort_array(F.collect_list(F.struct("tile", "data")))
    images = medians.groupBy("run_id", "height", "width").agg(parts.alias("_p")).select(
        "run_id", "height", "width",
        F.aggregate(
            "_p", F.lit(b"").cast("binary"), lambda image, part: F.concat(image, part["data"])
        ).alias("bgr"),
        F.lit(None).cast("string").alias("problem"),
    )
    return images.unionByName(refused, allowMissingColumns=True)
