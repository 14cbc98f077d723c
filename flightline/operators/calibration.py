"""Metric-plane calibration: documents to fitted homographies for many cameras in one job.

The points of one hole plate, which one document lists, become one row; calibrations are spread by
one shuffle, and every fit runs on its own row, without a join of points and mappings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import INFINITY_EPSILON, inverse, project
from ..functions.mathx import is_finite
from ..functions.once import evaluate_once

# Accepted document tag and domain, hole pitch and native image size.
POINT_SCHEMAS = ("pinkplane-homography/v2",)
DOMAIN = "undistorted"
HOLE_PITCH_MM = 9.16
IMAGE_SIZE = (1456, 1088)
METRIC_SCHEMA = "flightline-metric-plane/v1"
REFINEMENTS = 4
# Points that one array computation takes together.
FIT_POINTS = 20_000
DOCUMENT = (
    "schema STRING, mapping STRUCT<coordinate_domain: STRING>, correspondence STRUCT<"
    "row_counts: ARRAY<INT>, mean_CamL_points_px: ARRAY<ARRAY<DOUBLE>>>"
)


def read_calibrations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Calibration files with content digest and a ``problem`` for those that cannot be used."""
    raw = spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("calibration_id"), F.sha2("content", 256).alias("source_sha256"),
        F.col("content").cast("string").alias("value"),
    )
    return check_documents(raw)


def check_documents(raw: DataFrame) -> DataFrame:
    """``calibration_id, value`` (JSON) to typed columns; checks run in a fixed order."""
    doc = evaluate_once(raw, doc=F.from_json("value", DOCUMENT)).select(
        *[c for c in raw.columns if c != "value"], "doc",
        F.col("doc.correspondence.row_counts").alias("row_counts"),
        F.col("doc.correspondence.mean_CamL_points_px").alias("points_px"),
    )
    total = F.aggregate("row_counts", F.lit(0), lambda a, n: a + n)
    shape = (F.size("points_px") == total) & F.forall(
        "points_px",
        lambda p: F.coalesce(
            (F.size(p) == 2) & is_finite(p[0]) & is_finite(p[1]), F.lit(False)
        ),
    )
    return doc.withColumn(
        "problem",
        F.when(
            ~F.coalesce(F.col("doc.schema").isin(*POINT_SCHEMAS), F.lit(False)),
            "unsupported calibration schema",
        )
        .when(
            ~F.col("doc.mapping.coordinate_domain").eqNullSafe(F.lit(DOMAIN)),
            "coordinates must be undistorted",
        )
        .when(
            F.col("row_counts").isNull() | (F.size("row_counts") == 0), "file has no row layout"
        )
        .when(
            ~F.coalesce(F.forall("row_counts", lambda n: n > 0), F.lit(False)),
            "row counts are invalid",
        )
        .when(~F.coalesce(shape, F.lit(False)), "points do not match the row layout")
        .when(F.size("points_px") < 4, "at least four points are required"),
    ).drop("doc")


def grid_points(documents: DataFrame, pitch_mm: float = HOLE_PITCH_MM) -> DataFrame:
    """Pair every pixel point with its ideal grid position, row by row."""
    if not np.isfinite(pitch_mm) or pitch_mm <= 0:
        raise ValueError("pitch_mm is not above zero")
    layout = F.flatten(
        F.transform(
            "row_counts",
            lambda n, row: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda col: F.struct(
                    (col * F.lit(pitch_mm)).alias("gx"), (row * F.lit(pitch_mm)).alias("gy")
                ),
            ),
        )
    )
    return (
        documents.where(F.col("problem").isNull())
        .select("calibration_id", F.posexplode(F.arrays_zip(F.col("points_px").alias("p"), layout.alias("g"))).alias("ord", "z"))
        .select(
            "calibration_id", "ord", F.col("z.p")[0].alias("px"), F.col("z.p")[1].alias("py"),
            F.col("z.g.gx").alias("gx"), F.col("z.g.gy").alias("gy"),
        )
    )


def _solved(matrices: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Solutions of many 8x8 systems; NaN where a matrix is singular."""
    try:
        return np.linalg.solve(matrices, rights[..., None])[..., 0]
    except np.linalg.LinAlgError:
        found = np.full(rights.shape, np.nan)
        for i, (matrix, right) in enumerate(zip(matrices, rights)):
            try:
                found[i] = np.linalg.solve(matrix, right)
            except np.linalg.LinAlgError:
                pass
        return found


def _least_squares(u, v, s, t, x, y, w, starts) -> np.ndarray:
    """Normal equations summed over the points of every calibration, then solved."""
    zero = np.zeros_like(u)
    first = np.stack([u, v, zero + 1, zero, zero, zero, -u * x, -v * x], 1) / w[:, None]
    second = np.stack([zero, zero, zero, u, v, zero + 1, -u * y, -v * y], 1) / w[:, None]
    outer = first[:, :, None] * first[:, None, :] + second[:, :, None] * second[:, None, :]
    right = first * s[:, None] + second * t[:, None]
    return _solved(np.add.reduceat(outer, starts), np.add.reduceat(right, starts))


def _fit(counts: np.ndarray, u, v, s, t) -> np.ndarray:
    """Eight mapping values per calibration: a linear start and ``REFINEMENTS`` Gauss-Newton steps."""
    starts = np.cumsum(counts) - counts
    h = _least_squares(u, v, s, t, s, t, np.ones_like(u), starts)
    for _ in range(REFINEMENTS):
        m = np.repeat(h, counts, axis=0).T
        w = m[6] * u + m[7] * v + 1.0
        x, y = (m[0] * u + m[1] * v + m[2]) / w, (m[3] * u + m[4] * v + m[5]) / w
        step = _least_squares(u, v, s - x, t - y, x, y, w, starts)
        h = h + np.where(np.isnan(step).any(axis=1, keepdims=True), 0.0, step)
    return h


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _fitted(u: pd.Series, v: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
    """The normalised mapping of every row's points; NULL where there is none."""
    answers: list[np.ndarray | None] = [None] * len(u)
    sizes = np.array([0 if row is None else len(row) for row in u])
    some = np.flatnonzero(sizes)
    # Groups of whole calibrations bound the temporaries.
    group = np.cumsum(sizes[some]) // FIT_POINTS
    for rows in np.split(some, np.flatnonzero(np.diff(group)) + 1) if len(some) else []:
        flat = [np.concatenate([column.iloc[i] for i in rows]) for column in (u, v, s, t)]
        with np.errstate(all="ignore"):
            found = _fit(sizes[rows], *flat)
        for i, h in zip(rows, found):
            answers[i] = None if np.isnan(h).any() else h
    return pd.Series(answers, dtype=object)


def _matmul(a: Column, b: Column) -> Column:
    return F.array(
        *[
            sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j])
            for i in range(3)
            for j in range(3)
        ]
    )


def fit_homographies(
    points: DataFrame,
    *,
    image_size_px: tuple[int, int] = IMAGE_SIZE,
    pitch_mm: float = HOLE_PITCH_MM,
) -> DataFrame:
    """Least-squares pixel-to-mm mapping per calibration, refined on the reprojection error.

    A linear start on normalised coordinates is followed by Gauss-Newton steps on sums over the
    points. The image centre becomes the metric origin. Calibrations that cannot be fitted keep a
    row with ``problem`` set and no mapping.
    """
    width, height = image_size_px
    if width <= 1 or height <= 1:
        raise ValueError("an image side has fewer than two pixels")
    key = "calibration_id"
    c = F.col
    measured = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(n).alias(f"_m_{n}") for n in ("px", "py", "gx", "gy")],
        F.greatest(F.stddev_pop("px"), F.stddev_pop("py")).alias("_sp"),
        F.greatest(F.stddev_pop("gx"), F.stddev_pop("gy")).alias("_sg"),
        F.collect_list(F.struct("px", "py", "gx", "gy")).alias("_points"),
    )
    usable = F.coalesce((c("_n") >= 4) & (c("_sp") > 0) & (c("_sg") > 0), F.lit(False))

    def scaled(name: str, spread: str) -> Column:
        values = F.transform(f"_points.{name}", lambda p: (p - c(f"_m_{name}")) / c(spread))
        return F.when(c("_usable"), values)

    one = F.lit(1.0)
    fits = measured.withColumn("_usable", usable).withColumn(
        "h", _fitted(scaled("px", "_sp"), scaled("py", "_sp"), scaled("gx", "_sg"), scaled("gy", "_sg"))
    )
    h = c("h")
    from_px = F.array(
        one / c("_sp"), F.lit(0.0), -c("_m_px") / c("_sp"),
        F.lit(0.0), one / c("_sp"), -c("_m_py") / c("_sp"), F.lit(0.0), F.lit(0.0), one,
    )
    to_grid = F.array(
        c("_sg"), F.lit(0.0), c("_m_gx"), F.lit(0.0), c("_sg"), c("_m_gy"),
        F.lit(0.0), F.lit(0.0), one,
    )
    normal = F.array(*[h[i] for i in range(8)], one)
    middle = (F.lit((width - 1) * 0.5), F.lit((height - 1) * 0.5))
    zero = F.lit(0.0)
    # Each step is evaluated once a row: the points' residuals would otherwise repeat all of them.
    raw = evaluate_once(fits, _raw=_matmul(_matmul(to_grid, normal), from_px))
    scale = c("_raw")[8]
    unit = F.transform("_raw", lambda value: value / scale)
    whole = evaluate_once(raw, _unit=F.when(F.abs(scale) >= INFINITY_EPSILON, unit))
    placed = evaluate_once(whole, _centre=project(c("_unit"), *middle))
    shift = F.array(one, zero, -c("_centre.x"), zero, one, -c("_centre.y"), zero, zero, one)
    moved = evaluate_once(placed, _moved=_matmul(shift, c("_unit")))
    plane = F.transform("_moved", lambda value: value / c("_moved")[8])
    mapped = evaluate_once(moved, px_to_mm=F.when(c("_usable"), plane))
    centred = evaluate_once(mapped, mm_to_px=inverse(c("px_to_mm")))

    def miss(point: Column) -> Column:
        at = project(c("px_to_mm"), point["px"], point["py"])
        dx, dy = at["x"] - (point["gx"] - c("_centre.x")), at["y"] - (point["gy"] - c("_centre.y"))
        return dx * dx + dy * dy

    known = F.filter("_misses", lambda m: m.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, m: a + m)
    top = project(c("px_to_mm"), middle[0], F.lit(0.0))["y"]
    bottom = project(c("px_to_mm"), middle[0], F.lit(height - 1.0))["y"]
    given = lambda value: F.when(c("_usable"), F.lit(value))
    return evaluate_once(centred, _misses=F.transform("_points", miss)).select(
        key, "px_to_mm", "mm_to_px",
        F.when(F.size(known) > 0, F.sqrt(total / F.size(known))).alias("rms_error_mm"),
        F.sqrt(F.array_max("_misses")).alias("max_error_mm"),
        top.alias("top_y_mm"), bottom.alias("bottom_y_mm"),
        given(width).alias("image_width_px"), given(height).alias("image_height_px"),
        given(pitch_mm).alias("hole_pitch_mm"),
        F.when(~c("_usable"), "fewer than four spread points")
        .when(c("mm_to_px").isNull(), "calibration homography is singular").alias("problem"),
    )


def metric_documents(fitted: DataFrame) -> DataFrame:
    """Exchange document of every fitted plane."""
    rows = lambda name: F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.slice(name, i * 3 + 1, 3)
    )
    source = [
        F.col("calibration_id").alias("path"),
        *([F.col("source_sha256").alias("sha256")] if "source_sha256" in fitted.columns else []),
        F.lit(DOMAIN).alias("coordinate_domain"),
    ]
    body = F.struct(
        F.lit(METRIC_SCHEMA).alias("schema"),
        F.struct(*source).alias("source"),
        F.array("image_width_px", "image_height_px").alias("image_size_px"),
        "hole_pitch_mm",
        F.struct(
            F.lit("pixels to fall-plane millimetres").alias("direction"),
            rows("px_to_mm").alias("matrix"), rows("mm_to_px").alias("inverse_matrix"),
        ).alias("mapping"),
        F.struct(
            F.col("rms_error_mm").alias("rms_fit_error_mm"),
            F.col("max_error_mm").alias("max_fit_error_mm"),
        ).alias("quality"),
        F.struct(
            F.col("top_y_mm").alias("top_centre_y_mm"),
            F.col("bottom_y_mm").alias("bottom_centre_y_mm"),
        ).alias("fov"),
    )
    return fitted.select("calibration_id", F.to_json(body).alias("document"))
