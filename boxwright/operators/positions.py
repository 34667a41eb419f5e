"""Positions: best detections, expected boxes, verdicts, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.sources import bindings as B


def best(dets: DataFrame) -> DataFrame:
    """The most confident detection of each image and class, the first on ties."""
    w = Window.partitionBy("image", "class").orderBy(F.desc("conf"), "ord")
    return dets.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def best_detection_per_class(spark, sf):
    return best(B.detections(spark, sf)).select("image", "class", "ord", "conf")


def results(dets: DataFrame, exp: DataFrame, tolerance: float = B.TOLERANCE, size: float = B.IMGSZ) -> DataFrame:
    """image, class, status of each expected class: missing, correct or wrong (centre outside the widened box)."""
    t = tolerance / 100 * size
    exp = F.broadcast(exp)  # a configuration, of fixed size
    grid = dets.select("image").distinct().join(exp)
    inside = F.col("cx").between(F.greatest(F.lit(0.0), F.col("x1") - t), F.least(F.lit(size), F.col("x2") + t)) & F.col("cy").between(F.greatest(F.lit(0.0), F.col("y1") - t), F.least(F.lit(size), F.col("y2") + t))
    return grid.join(best(dets), ["image", "class"], "left").select("image", "class", F.when(F.col("ord").isNull(), "missing").when(inside, "correct").otherwise("wrong").alias("status"))


def position_results_single(spark, sf):
    return results(B.detections(spark, sf), B.expected(spark))


def unexpected_classes(spark, sf):
    d = B.detections(spark, sf)
    return d.join(F.broadcast(B.expected(spark).select("class")), "class", "left_anti").select("image", "class").distinct()


def position_verdict(spark, sf):
    d = B.detections(spark, sf)
    bad = results(d, B.expected(spark)).groupBy("image").agg(F.max((F.col("status") != "correct").cast("int")).alias("bad"))
    odd = unexpected_classes(spark, sf).select("image").distinct().withColumn("odd", F.lit(1))
    return bad.join(odd, "image", "left").select("image", F.when((F.col("bad") == 1) | (F.col("odd") == 1), "FAIL").otherwise("PASS").alias("verdict"))


def position_status_counts(spark, sf):
    """Counts of the three statuses, with zeros."""
    v = position_verdict(spark, sf)
    return v.agg(*[F.count_if(F.col("verdict") == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIPPED")]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s.lower()).alias("n")) for s in ("PASS", "FAIL", "SKIPPED")])).alias("r")).select("r.*")


def box_statistics(spark, sf):
    d = B.detections(spark, sf)
    return d.groupBy("class").agg(F.count("*").alias("n"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.coalesce(F.stddev_samp("cx"), F.lit(0.0)).alias("sigma_cx"), F.coalesce(F.stddev_samp("cy"), F.lit(0.0)).alias("sigma_cy"), F.rint(F.avg(F.col("cx") - F.col("half"))).cast("int").alias("x1"), F.rint(F.avg(F.col("cx") + F.col("half"))).cast("int").alias("x2"))


def per_image_class_mode(spark, sf):
    """The most frequent number of detections an image has of a class, the first seen on ties."""
    per = B.detections(spark, sf).groupBy("class", "image").agg(F.count("*").alias("k"), F.min("ord").alias("o"))
    by = per.groupBy("class", "k").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    w = Window.partitionBy("class").orderBy(F.desc("n"), "o")
    return by.withColumn("r", F.row_number().over(w)).filter("r = 1").select("class", F.col("k").alias("mode"))


def auto_tolerance(spark, sf):
    s = box_statistics(spark, sf)
    return s.agg((F.greatest(F.max(F.greatest("sigma_cx", "sigma_cy")) * 3, F.lit(5.0)) / B.IMGSZ * 100).alias("tolerance"))


_D = f"WITH {B.DET_SQL}, {B.EXP_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY conf DESC, ord) AS r FROM det) WHERE r = 1), res AS (SELECT i.image, ex.class, CASE WHEN b.ord IS NULL THEN 'missing' WHEN b.cx BETWEEN greatest(0, x1 - 32) AND least(640, x2 + 32) AND b.cy BETWEEN greatest(0, y1 - 32) AND least(640, y2 + 32) THEN 'correct' ELSE 'wrong' END AS status FROM (SELECT DISTINCT image FROM det) i CROSS JOIN ex LEFT JOIN best b ON b.image = i.image AND b.class = ex.class), odd AS (SELECT DISTINCT image, class FROM det WHERE class NOT IN (SELECT class FROM ex)), ver AS (SELECT image, CASE WHEN bool_or(status <> 'correct') OR image IN (SELECT image FROM odd) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM res GROUP BY image), st AS (SELECT class, count(*) AS n, avg(cx) AS cx, avg(cy) AS cy, coalesce(stddev_samp(cx), 0) AS sigma_cx, coalesce(stddev_samp(cy), 0) AS sigma_cy, round_even(avg(cx - half), 0)::INT AS x1, round_even(avg(cx + half), 0)::INT AS x2 FROM det GROUP BY class) "
QUERIES = {f.__name__: f for f in (best_detection_per_class, position_results_single, unexpected_classes, position_verdict, position_status_counts, box_statistics, per_image_class_mode, auto_tolerance)}
ORACLE = {
    "best_detection_per_class": _D + "SELECT image, class, ord, conf FROM best",
    "position_results_single": _D + "SELECT * FROM res",
    "unexpected_classes": _D + "SELECT * FROM odd",
    "position_verdict": _D + "SELECT * FROM ver",
    "position_status_counts": _D + "SELECT s AS status, (SELECT count(*) FROM ver WHERE verdict = s) AS n FROM (VALUES ('PASS'), ('FAIL'), ('SKIPPED')) t(s)",
    "box_statistics": _D + "SELECT * FROM st",
    "per_image_class_mode": _D + "SELECT class, k AS mode FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, o) AS r FROM (SELECT class, k, count(*) AS n, min(o) AS o FROM (SELECT class, image, count(*) AS k, min(ord) AS o FROM det GROUP BY class, image) GROUP BY class, k)) WHERE r = 1",
    "auto_tolerance": _D + "SELECT greatest(max(greatest(sigma_cx, sigma_cy)) * 3, 5) / 640 * 100 AS tolerance FROM st",
}
