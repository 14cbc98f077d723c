"""Foreground components from raw frame tables, then filtering and ordering in Catalyst.

Frames and backgrounds are spread by run and frame block: every block gets its own copy of the
background, sorted ahead of its frames, so one very long recording is still many tasks and a task
holds one background and one Arrow batch. Segmentation output is independent of the size and solidity
limits; retuning those only re-filters the component table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import half_even
from ..functions.prefix import block_of
from ..functions.spread import image_tasks, spread
from ..settings import DetectorSettings
from . import imaging

BLOCK_FRAMES = 64
# Results leave a task whenever this many bytes of frames were read: a stage set is six times its frame.
FLUSH_BYTES = 4 << 20
COMPONENT_SCHEMA = (
    "run_id string, frame_index bigint, component int, x int, y int, width int, height int, "
    "area bigint, cx double, cy double, solidity double, blue double, green double, red double, "
    "problem string"
)
STAGE_SCHEMA = (
    "run_id string, frame_index bigint, stage_no int, stage_key string, settings array<string>, "
    "height int, width int, channels int, image binary"
)
# Fixed order: keys of the explained stages.
STAGE_KEYS = (
    "input", "grayscale", "blur", "difference", "threshold", "close", "open", "dilate",
    "components", "filtered",
)
_KINDS = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
    "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (part.split(" ") for part in ddl.split(", "))])


def _image(height, width, data) -> np.ndarray | None:
    if data is None or not height or not width or len(data) != height * width * 3:
        return None
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)


class _Segmenter:
    """Runs the image steps; the background is prepared once and kept while its run lasts."""

    def __init__(self, settings: DetectorSettings):
        self.settings = settings
        self.shape = self.background = None

    def load_background(self, image: np.ndarray | None) -> None:
        self.shape = None if image is None else image.shape
        self.background = None if image is None else self._prepare(image)[2]

    def _prepare(self, image):
        small = imaging.shrink(image, self.settings.processing_scale)
        gray = imaging.luma(small)
        return small, gray, imaging.blur(gray, self.settings.blur_kernel)

    def problem(self, frame) -> str | None:
        if frame is None:
            return "frame must be a three-channel 8-bit image"
        if self.background is None:
            return "no usable background"
        return None if frame.shape == self.shape else "frame and background dimensions differ"

    def steps(self, frame):
        s = self.settings
        small, gray, blurred = self._prepare(frame)
        difference = np.maximum(blurred, self.background) - np.minimum(blurred, self.background)
        raised = difference > s.threshold
        closed = imaging.close_gaps(raised, s.close_kernel, s.close_iterations)
        opened = imaging.remove_specks(closed, s.open_kernel, s.open_iterations)
        grown = imaging.dilate(opened, s.dilate_kernel, s.dilate_iterations)
        return small, gray, blurred, difference, raised, closed, opened, grown


def _component_rows(segmenter, run_id, frame_index, frame):
    trouble = segmenter.problem(frame)
    if trouble is not None:
        return [(run_id, frame_index, None, *(None,) * 11, trouble)]
    stages = segmenter.steps(frame)
    return [
        (run_id, frame_index, number, *part.values(), None)
        for number, part in enumerate(imaging.components(stages[-1], stages[0]), start=1)
    ]


def _native(part: dict, scale: float):
    box = (
        max(0, round(part["x"] / scale)), max(0, round(part["y"] / scale)),
        max(1, round(part["width"] / scale)), max(1, round(part["height"] / scale)),
    )
    return box, max(1, round(part["area"] / (scale * scale)))


def _stage_rows(segmenter, run_id, frame_index, frame):
    if segmenter.problem(frame) is not None:
        return []
    s = segmenter.settings
    small, gray, blurred, difference, *masks = segmenter.steps(frame)
    parts = imaging.components(masks[-1], small)
    outlined = np.repeat(gray[:, :, None], 3, axis=2)
    final = frame.copy()
    accepted = 0
    for part in parts:
        imaging.draw_box(
            outlined, (part["x"], part["y"], part["width"], part["height"]), (0, 210, 255)
        )
        box, area = _native(part, s.processing_scale)
        good = (
            s.min_area_px <= area <= s.max_area_px
            and s.min_width_px <= box[2] <= s.max_width_px
            and s.min_height_px <= box[3] <= s.max_height_px
            and part["solidity"] >= s.min_solidity
        )
        accepted += good
        imaging.draw_box(final, box, (80, 245, 120) if good else (40, 70, 180), 2 if good else 1)
    kernel = lambda name: (
        f"kernel={getattr(s, name + '_kernel')}x{getattr(s, name + '_kernel')} ellipse",
        f"iterations={getattr(s, name + '_iterations')}",
    )
    captions = (
        (f"shape={frame.shape[1]}x{frame.shape[0]}", "encoding=8-bit BGR"),
        (f"processing_scale={s.processing_scale:.2f}",),
        (f"kernel={s.blur_kernel}x{s.blur_kernel}",),
        (),
        (f"threshold={s.threshold}",),
        kernel("close"), kernel("open"), kernel("dilate"),
        ("connectivity=8", f"foreground_components={len(parts)}"),
        (
            f"area={s.min_area_px}..{s.max_area_px}px",
            f"width={s.min_width_px}..{s.max_width_px}px",
            f"height={s.min_height_px}..{s.max_height_px}px",
            f"minimum_solidity={s.min_solidity:.2f}", f"accepted={accepted}",
        ),
    )
    images = [frame, gray, blurred, difference] + [m.astype(np.uint8) * 255 for m in masks]
    images += [outlined, final]
    rows = []
    height, width = frame.shape[:2]
    for number, (key, image, values) in enumerate(zip(STAGE_KEYS, images, captions), start=1):
        if image.shape[:2] != (height, width):
            up = np.arange(height) * image.shape[0] // height
            across = np.arange(width) * image.shape[1] // width
            image = image[up][:, across]
        channels = 1 if image.ndim == 2 else image.shape[2]
        rows.append(
            (run_id, frame_index, number, key, list(values), height, width, channels,
             np.ascontiguousarray(image).tobytes())
        )
    return rows


def _job(settings: DetectorSettings, produce, ddl: str):
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, owner = _Segmenter(settings), None

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
            )

        for batch in batches:
            out, read = [], 0
            names = ("run_id", "_block", "frame_index", "height", "width", "bgr")
            columns = [batch.column(n) for n in names]
            for i in range(batch.num_rows):
                run_id, block, frame_index, height, width, data = (c[i].as_py() for c in columns)
                if (run_id, block) != owner:
                    owner = (run_id, block)
                    segmenter.load_background(None)
                image = _image(height, width, data)
                if frame_index < 0:
                    segmenter.load_background(image)
                else:
                    out += produce(segmenter, run_id, frame_index, image)
                    read += 0 if data is None else len(data)
                if out and read >= FLUSH_BYTES:
                    yield packed(out)
                    out, read = [], 0
            if out:
                yield packed(out)

    return run


def _with_background(frames: DataFrame, backgrounds: DataFrame, block_frames: int) -> DataFrame:
    columns = ["run_id", "_block", "frame_index", "height", "width", "bgr"]
    blocked = frames.withColumn("_block", block_of(F.col("frame_index"), block_frames))
    wanted = blocked.select("run_id", "_block").distinct()
    copies = backgrounds.join(wanted, "run_id").withColumn("frame_index", F.lit(-1).cast("long"))
    rows = blocked.select(*columns).unionByName(copies.select(*columns))
    placed = spread(rows, "run_id", "_block", least=image_tasks(frames))
    return placed.sortWithinPartitions("run_id", "_block", "frame_index")


def detect_components(
    frames: DataFrame,
    backgrounds: DataFrame,
    settings: DetectorSettings | None = None,
    *,
    block_frames: int = BLOCK_FRAMES,
) -> DataFrame:
    """Every foreground component of every frame, in processing-scale pixels.

    ``frames``: ``run_id, frame_index, height, width, bgr``; ``backgrounds``: the same without an
    index. Unusable images give one row with ``problem`` set.
    """
    settings = settings or DetectorSettings()
    rows = _with_background(frames, backgrounds, block_frames)
    return rows.mapInArrow(_job(settings, _component_rows, COMPONENT_SCHEMA), COMPONENT_SCHEMA)


def explain_stages(
    frames: DataFrame, backgrounds: DataFrame, settings: DetectorSettings | None = None
) -> DataFrame:
    """The ten intermediate images of selected frames, one row per stage."""
    settings = settings or DetectorSettings()
    rows = _with_background(frames, backgrounds, BLOCK_FRAMES)
    return rows.mapInArrow(_job(settings, _stage_rows, STAGE_SCHEMA), STAGE_SCHEMA)


def to_native(components: DataFrame, settings: DetectorSettings) -> DataFrame:
    """Boxes, areas and centroids in native pixels (half-even rounding)."""
    scale = F.lit(float(settings.processing_scale))

    def whole(name: str, least: int) -> Column:
        return F.greatest(F.lit(least), half_even(F.col(name) / scale)).cast("int")

    return components.where(F.col("problem").isNull()).select(
        "run_id", "frame_index", "component",
        (F.col("cx") / scale).alias("cx_px"), (F.col("cy") / scale).alias("cy_px"),
        whole("x", 0).alias("bbox_x"), whole("y", 0).alias("bbox_y"),
        whole("width", 1).alias("bbox_w"), whole("height", 1).alias("bbox_h"),
        F.greatest(F.lit(1), half_even(F.col("area") / (scale * scale))).cast("long").alias("area_px"),
        "solidity", "blue", "green", "red",
    )


def is_accepted(settings: DetectorSettings) -> Column:
    return (
        F.col("area_px").between(settings.min_area_px, settings.max_area_px)
        & F.col("bbox_w").between(settings.min_width_px, settings.max_width_px)
        & F.col("bbox_h").between(settings.min_height_px, settings.max_height_px)
        & (F.col("solidity") >= settings.min_solidity)
    )


def classify(components: DataFrame, settings: DetectorSettings | None = None) -> DataFrame:
    """All components in native pixels with their verdict."""
    settings = settings or DetectorSettings()
    return to_native(components, settings).withColumn("accepted", is_accepted(settings))


def detections(components: DataFrame, settings: DetectorSettings | None = None) -> DataFrame:
    """Accepted components in detection order."""
    order = Window.partitionBy("run_id", "frame_index").orderBy("cy_px", "cx_px")
    return (
        classify(components, settings).where("accepted").drop("accepted", "component")
        .withColumn("det_ord", F.row_number().over(order).cast("int"))
    )


def frame_verdicts(classified: DataFrame, frames: DataFrame) -> DataFrame:
    """Component and acceptance counts of every frame, zero where nothing was found."""
    counted = classified.groupBy("run_id", "frame_index").agg(
        F.count(F.lit(1)).alias("_found"), F.count_if("accepted").alias("_accepted")
    )
    return frames.select("run_id", "frame_index").join(counted, ["run_id", "frame_index"], "left").select(
        "run_id",
        "frame_index",
        F.coalesce("_found", F.lit(0)).alias("foreground_components"),
        F.coalesce("_accepted", F.lit(0)).alias("accepted"),
    )


def quarantine(components: DataFrame) -> DataFrame:
    return components.where(F.col("problem").isNotNull()).select("run_id", "frame_index", "problem")
