"""Box geometry as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxwright.sources import bindings as B

WIDTH, HEIGHT = 1280.0, 720.0


def _clip(v: Column, top: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, F.lit(top)))


def yolo_to_corners(spark, sf):
    """Absolute corners, clipped to the image."""
    a = B.annotations(spark, sf)
    c = lambda m, s, sign, top: _clip((F.col(m) + sign * F.col(s) / 2) * top, top)
    return a.select("stem", "line_no", c("x", "w", -1, WIDTH).alias("x1"), c("y", "h", -1, HEIGHT).alias("y1"), c("x", "w", 1, WIDTH).alias("x2"), c("y", "h", 1, HEIGHT).alias("y2"))


def corners_to_yolo(spark, sf):
    a = yolo_to_corners(spark, sf)
    return a.select("stem", "line_no", ((F.col("x1") + F.col("x2")) / 2 / WIDTH).alias("x"), ((F.col("y1") + F.col("y2")) / 2 / HEIGHT).alias("y"), ((F.col("x2") - F.col("x1")) / WIDTH).alias("w"), ((F.col("y2") - F.col("y1")) / HEIGHT).alias("h"))


def letterbox_boxes(spark, sf):
    """Corners after scaling by the smaller side ratio and centred padding, clamped."""
    a, size = yolo_to_corners(spark, sf), B.IMGSZ
    k = min(size / WIDTH, size / HEIGHT)
    px, py = (size - WIDTH * k) / 2, (size - HEIGHT * k) / 2
    return a.select("stem", "line_no", *[_clip(F.col(c) * k + p, size).alias(c) for c, p in (("x1", px), ("y1", py), ("x2", px), ("y2", py))])


def padded_resize_boxes(spark, sf):
    """Boxes remapped to a padded square, valid ones only: sides over 0.001 and centre inside."""
    size = int(B.IMGSZ)
    k = min(size / WIDTH, size / HEIGHT)
    w, h = int(WIDTH * k), int(HEIGHT * k)
    dx, dy = (size - w) // 2, (size - h) // 2
    a = B.annotations(spark, sf)
    out = a.select("stem", "line_no", ((F.col("x") * w + dx) / size).alias("x"), ((F.col("y") * h + dy) / size).alias("y"), (F.col("w") * w / size).alias("w"), (F.col("h") * h / size).alias("h"))
    return out.filter("w > 0.001 AND h > 0.001 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1")


def voc_truncated_flag(spark, sf):
    a = yolo_to_corners(spark, sf)
    i = {c: F.rint(c).cast("int") for c in ("x1", "y1", "x2", "y2")}
    cut = (i["x2"] >= int(WIDTH)) | (i["y2"] >= int(HEIGHT)) | (i["x1"] <= 1) | (i["y1"] <= 1)
    return a.select("stem", "line_no", cut.cast("int").alias("truncated"))


def augment_fanout(spark, sf):
    return B.images(spark, sf).select("stem", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("stem", F.concat(F.col("stem").cast("string"), F.lit("_aug_"), F.col("i").cast("string")).alias("name"))


def automl_rows(spark, sf):
    a = B.annotations(spark, sf)
    c = lambda m, s, sign: _clip(F.col(m) + sign * F.col(s) / 2, 1.0)
    return a.select("stem", "line_no", F.concat(F.lit("class"), F.col("class_id").cast("string")).alias("label"), c("x", "w", -1).alias("x_min"), c("y", "h", -1).alias("y_min"), c("x", "w", 1).alias("x_max"), c("y", "h", 1).alias("y_max"))


_C = f"WITH {B.ANN_SQL}, cor AS (SELECT stem, line_no, greatest(0, least((x - w / 2) * 1280, 1280)) AS x1, greatest(0, least((y - h / 2) * 720, 720)) AS y1, greatest(0, least((x + w / 2) * 1280, 1280)) AS x2, greatest(0, least((y + h / 2) * 720, 720)) AS y2 FROM ann) "
QUERIES = {f.__name__: f for f in (yolo_to_corners, corners_to_yolo, letterbox_boxes, padded_resize_boxes, voc_truncated_flag, augment_fanout, automl_rows)}
ORACLE = {
    "yolo_to_corners": _C + "SELECT * FROM cor",
    "corners_to_yolo": _C + "SELECT stem, line_no, (x1 + x2) / 2 / 1280 AS x, (y1 + y2) / 2 / 720 AS y, (x2 - x1) / 1280 AS w, (y2 - y1) / 720 AS h FROM cor",
    "letterbox_boxes": _C + "SELECT stem, line_no, x1 * 0.5 AS x1, y1 * 0.5 + 140 AS y1, x2 * 0.5 AS x2, y2 * 0.5 + 140 AS y2 FROM cor",
    "padded_resize_boxes": f"WITH {B.ANN_SQL}, r AS (SELECT stem, line_no, x * 640 / 640 AS x, (y * 360 + 140) / 640 AS y, w * 640 / 640 AS w, h * 360 / 640 AS h FROM ann) SELECT * FROM r WHERE w > 0.001 AND h > 0.001 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1",
    "voc_truncated_flag": _C + "SELECT stem, line_no, (round_even(x2, 0) >= 1280 OR round_even(y2, 0) >= 720 OR round_even(x1, 0) <= 1 OR round_even(y1, 0) <= 1)::INT AS truncated FROM cor",
    "augment_fanout": f"WITH {B.ANN_SQL} SELECT stem, stem || '_aug_' || i AS name FROM img, range(1, 4) t(i)",
    "automl_rows": f"WITH {B.ANN_SQL} SELECT stem, line_no, 'class' || class_id AS label, greatest(0, least(x - w / 2, 1)) AS x_min, greatest(0, least(y - h / 2, 1)) AS y_min, greatest(0, least(x + w / 2, 1)) AS x_max, greatest(0, least(y + h / 2, 1)) AS y_max FROM ann",
}
