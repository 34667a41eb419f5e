"""Masks as rows of set pixels: morphology by offsets, connected components an image, and clusters of box centres."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators.reports import anomaly_zmask, normal_model
from boxwright.sources import bindings as B

SIDE, MIN_AREA, DIFFERENCE, FAINT, SIMPLE = 8, 3, 60, 10, 4


def ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel of odd size ``k``."""
    r = k // 2
    wide = lambda y: round(r * math.sqrt((r * r - y * y) / (r * r))) if r else 0
    return [(y, x) for y in range(-r, r + 1) for x in range(-wide(y), wide(y) + 1)]


def square(k: int) -> list[tuple[int, int]]:
    """Offsets of a square kernel of odd size ``k``."""
    return [(y, x) for y in range(-(k // 2), k // 2 + 1) for x in range(-(k // 2), k // 2 + 1)]


def _moved(mask: DataFrame, k: int, side: int, kernel=ellipse) -> DataFrame:
    """Each set pixel at each offset inside the image."""
    at = F.explode(F.array(*[F.struct((F.floor(F.col("pos") / side).cast("int") + y).alias("y"), (F.col("pos") % side + x).alias("x")) for y, x in kernel(k)]))
    return mask.select("image", at.alias("p")).filter(F.col("p.y").between(0, side - 1) & F.col("p.x").between(0, side - 1)).select("image", (F.col("p.y") * side + F.col("p.x")).cast("int").alias("pos"))


def dilate(mask: DataFrame, k: int, side: int = SIDE, kernel=ellipse) -> DataFrame:
    return _moved(mask, k, side, kernel).distinct()


def erode(mask: DataFrame, k: int, side: int = SIDE, kernel=ellipse) -> DataFrame:
    """Pixels whose neighbours inside the image are all set."""
    y, x = F.floor(F.col("pos") / side).cast("int"), F.col("pos") % side
    inside = sum((((y + dy).between(0, side - 1)) & ((x + dx).between(0, side - 1))).cast("int") for dy, dx in kernel(k))
    return _moved(mask, k, side, kernel).groupBy("image", "pos").agg(F.count("*").alias("n")).filter(F.col("n") == inside).select("image", "pos")


def components(mask: DataFrame, side: int = SIDE) -> DataFrame:
    """image, component (its least pixel), pos; pixels that touch at a side or corner are one component.

    An image is one group: its size bounds the task.
    """

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = set(rows["pos"].tolist()), []
        for first in sorted(left):
            if first not in left:
                continue
            left.discard(first)
            todo = [first]
            while todo:
                p = todo.pop()
                out.append((rows["image"].iat[0], first, p))
                y, x = divmod(p, side)
                near = {b * side + a for b in (y - 1, y, y + 1) for a in (x - 1, x, x + 1) if 0 <= a < side} & left
                left -= near
                todo += near
        return pd.DataFrame(out, columns=["image", "component", "pos"])

    return mask.groupBy("image").applyInPandas(label, "image long, component int, pos int")


def _differing(spark, sf, least: float):
    m = F.broadcast(normal_model(spark, sf).select("pos", "mean"))  # one row a pixel of an image
    return B.pixels(spark, sf).filter("image % 2 = 1").join(m, "pos").filter(F.abs(F.col("v") - F.col("mean")) >= least).select("image", "pos")


def difference_mask(spark, sf):
    """Pixels of the test images that differ from the reference mean by DIFFERENCE."""
    return _differing(spark, sf, DIFFERENCE)


def mask_closed(spark, sf):
    return erode(dilate(difference_mask(spark, sf), 3), 3)


def mask_opened(spark, sf):
    """Opening of the mask of a lower threshold, which has blocks to keep."""
    return dilate(erode(_differing(spark, sf, FAINT), 3), 3)


def anomaly_components(spark, sf):
    """Components of the closed mask of at least MIN_AREA pixels, with their areas."""
    return components(mask_closed(spark, sf)).groupBy("image", "component").agg(F.count("*").alias("area")).filter(F.col("area") >= MIN_AREA)


def cleaned(raw: DataFrame, min_area: int, open_size: int = 3, close_size: int = 5, dilate_size: int = 0, side: int = SIDE) -> DataFrame:
    """image, pos of a raw mask opened, closed, without components of under ``min_area`` pixels, and dilated; a size of 0 skips its step."""
    m = raw
    if open_size > 0:
        m = dilate(erode(m, open_size, side), open_size, side)
    if close_size > 0:
        m = erode(dilate(m, close_size, side), close_size, side)
    c = components(m, side)
    large = c.groupBy("image", "component").agg(F.count("*").alias("area")).filter(F.col("area") >= min_area)
    m = c.join(large, ["image", "component"], "left_semi").select("image", "pos")
    return dilate(m, dilate_size, side) if dilate_size > 0 else m


def anomaly_masks(spark, sf):
    """The test images' masks: far from the normal model, closed, of MIN_AREA pixels or more, dilated."""
    return cleaned(anomaly_zmask(spark, sf), MIN_AREA, 0, 3, 3)


def mean_image(pixels: DataFrame) -> DataFrame:
    """pos and the mean of each pixel, held in 0..255 and cut to whole numbers."""
    return pixels.groupBy("pos").agg(F.greatest(F.lit(0), F.least(F.lit(255), F.avg("v"))).cast("int").alias("mean"))


def simple_masks(spark, sf):
    """Pixels of the test images that differ from the mean image by more than SIMPLE, opened and closed by a square."""
    whole = F.greatest(F.lit(0), F.least(F.lit(255), F.col("v"))).cast("int")
    px = B.pixels(spark, sf)
    m = F.broadcast(mean_image(px.filter("image % 2 = 0")))  # one row a pixel of an image
    far = px.filter("image % 2 = 1").join(m, "pos").filter(F.abs(whole - F.col("mean")) > SIMPLE).select("image", "pos")
    opened = dilate(erode(far, 3, SIDE, square), 3, SIDE, square)
    return erode(dilate(opened, 3, SIDE, square), 3, SIDE, square)


def clusters(points: DataFrame, k: dict[str, int], rounds: int = 50) -> DataFrame:
    """class, cx, cy of the distinct points and key: k-means in each class from evenly chosen sorted points.

    Keys are name#i by the mean centres' order; a class with k of 1 or less keeps its name; with more clusters than
    points all are one. Centres lie on a pixel grid, so points are counted before anything else and a class has at most
    an image's pixels; centroids are classes times k.
    """
    spots = points.groupBy("class", "cx", "cy").agg(F.count("*").alias("n")).persist()
    totals = {r["class"]: r["n"] for r in spots.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    todo = {c: k.get(c, 1) for c, n in totals.items() if 1 < k.get(c, 1) <= n}
    ranks = spots.withColumn("hi", F.expr("sum(n) OVER (PARTITION BY class ORDER BY cx, cy)"))
    wanted = spots.sparkSession.createDataFrame([(c, i, min(i * max(1, totals[c] // m), totals[c] - 1)) for c, m in todo.items() for i in range(m)], "class string, c int, at long")
    found = ranks.join(F.broadcast(wanted), "class").filter("at < hi AND at >= hi - n").select("class", "c", "cx", "cy").collect()
    centre = {(r["class"], r.c): (r.cx, r.cy) for r in found}

    def assign() -> DataFrame:
        near = spots.sparkSession.createDataFrame([(c, i, x, y) for (c, i), (x, y) in centre.items()], "class string, c int, x double, y double")
        by = near.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("c", "x", "y"))).alias("cs"))
        best = F.array_min(F.transform("cs", lambda e: F.struct(((F.col("cx") - e["x"]) * (F.col("cx") - e["x"]) + (F.col("cy") - e["y"]) * (F.col("cy") - e["y"])).alias("d"), e["c"].alias("c"))))
        return spots.join(F.broadcast(by), "class", "left").withColumn("c", F.coalesce(best["c"], F.lit(0))).drop("cs")

    mean = lambda v: (F.sum(F.col(v) * F.col("n")) / F.sum("n")).alias(v)
    got = assign()
    for step in range(rounds):
        new = {(r["class"], r.c): (r.cx, r.cy) for r in got.groupBy("class", "c").agg(mean("cx"), mean("cy")).collect() if (r["class"], r.c) in centre}
        if all(centre[a] == b for a, b in new.items()) or step == rounds - 1:
            break
        centre |= new
        got = assign()
    order = got.groupBy("class", "c").agg(mean("cx"), mean("cy")).withColumn("i", F.expr("row_number() OVER (PARTITION BY class ORDER BY cx, cy) - 1"))
    plain = F.lit(False)
    for c in totals:
        if k.get(c, 1) <= 1:
            plain = plain | (F.col("class") == c)
    key = F.when(plain, F.col("class")).otherwise(F.concat_ws("#", "class", F.col("i").cast("string")))
    return got.join(F.broadcast(order.select("class", "c", "i")), ["class", "c"]).select("class", key.alias("key"), "cx", "cy", "n")


def cluster_boxes(spark, sf):
    """Three clusters of each class's detections: their keys, mean centres and counts."""
    d = B.detections(spark, sf)
    k = {r["class"]: 3 for r in d.select("class").distinct().collect()}  # classes are a fixed list
    got = clusters(d, k)
    return got.groupBy("class", "key").agg((F.sum(F.col("cx") * F.col("n")) / F.sum("n")).alias("cx"), (F.sum(F.col("cy") * F.col("n")) / F.sum("n")).alias("cy"), F.sum("n").alias("count"))


def _near_sql(cross: bool) -> str:
    reach = "abs(q.pos // 8 - {a}.pos // 8) + abs(q.pos % 8 - {a}.pos % 8) <= 1"
    return reach if cross else "greatest(abs(q.pos // 8 - {a}.pos // 8), abs(q.pos % 8 - {a}.pos % 8)) <= 1"


_PLUS = _near_sql(True)
_GRID = "grid AS (SELECT pos::INT AS pos, 1 + (pos // 8 > 0)::INT + (pos // 8 < 7)::INT + (pos % 8 > 0)::INT + (pos % 8 < 7)::INT AS n FROM range(0, 64) t(pos))"
_dilated = lambda m: f"SELECT DISTINCT image, q.pos FROM {m} JOIN grid q ON {_PLUS.format(a=m)}"
_eroded = lambda m: f"SELECT image, q.pos FROM {m} JOIN grid q ON {_PLUS.format(a=m)} GROUP BY image, q.pos, q.n HAVING count(*) = q.n"
_M = f"{B.PX_SQL}, nm AS (SELECT pos, avg(v) AS mean FROM px WHERE image % 2 = 0 GROUP BY pos), {_GRID}, m AS (SELECT image, px.pos FROM px JOIN nm ON px.pos = nm.pos WHERE image % 2 = 1 AND abs(v - mean) >= {DIFFERENCE}), md AS ({_dilated('m')}), mc AS ({_eroded('md')}), f AS (SELECT image, px.pos FROM px JOIN nm ON px.pos = nm.pos WHERE image % 2 = 1 AND abs(v - mean) >= {FAINT}), me AS ({_eroded('f')}), mo AS ({_dilated('me')})"
QUERIES = {f.__name__: f for f in (difference_mask, mask_closed, mask_opened, anomaly_components, anomaly_masks, simple_masks, cluster_boxes)}
_SQUARE = "greatest(abs(q.pos // 8 - {a}.pos // 8), abs(q.pos % 8 - {a}.pos % 8)) <= 1"
_GRID9 = "grid9 AS (SELECT pos::INT AS pos, (2 + (pos // 8 BETWEEN 1 AND 6)::INT) * (2 + (pos % 8 BETWEEN 1 AND 6)::INT) AS n FROM range(0, 64) t(pos))"
_dilated9 = lambda m: f"SELECT DISTINCT image, q.pos FROM {m} JOIN grid9 q ON {_SQUARE.format(a=m)}"
_eroded9 = lambda m: f"SELECT image, q.pos FROM {m} JOIN grid9 q ON {_SQUARE.format(a=m)} GROUP BY image, q.pos, q.n HAVING count(*) = q.n"
_Z = f"{B.PX_SQL}, nm AS (SELECT pos, avg(v) AS mean, sqrt(greatest(coalesce(var_samp(v), 0), 1)) AS std FROM px WHERE image % 2 = 0 GROUP BY pos), {_GRID}, m AS (SELECT image, px.pos FROM px JOIN nm ON px.pos = nm.pos WHERE image % 2 = 1 AND (abs(v - mean) / (std + 1e-6) >= 3 OR abs(v - mean) >= 70)), md AS ({_dilated('m')}), mc AS ({_eroded('md')})"
ORACLE = {
    "difference_mask": f"WITH {_M} SELECT * FROM m",
    "mask_closed": f"WITH {_M} SELECT * FROM mc",
    "mask_opened": f"WITH {_M} SELECT * FROM mo",
    "anomaly_components": f"WITH RECURSIVE {_M}, r AS (SELECT image, pos AS a, pos FROM mc UNION SELECT r.image, r.a, q.pos FROM r JOIN mc q ON q.image = r.image AND {_near_sql(False).format(a='r')}) SELECT image, component, count(*) AS area FROM (SELECT image, a, min(pos) AS component FROM r GROUP BY image, a) GROUP BY image, component HAVING count(*) >= {MIN_AREA}",
    "anomaly_masks": f"WITH RECURSIVE {_Z}, r AS (SELECT image, pos AS a, pos FROM mc UNION SELECT r.image, r.a, q.pos FROM r JOIN mc q ON q.image = r.image AND {_near_sql(False).format(a='r')}), big AS (SELECT image, a AS pos FROM r GROUP BY image, a HAVING count(*) >= {MIN_AREA}) {_dilated('big')}",
    "simple_masks": f"WITH {B.PX_SQL}, {_GRID9}, nm AS (SELECT pos, trunc(greatest(0, least(255, avg(v)))) AS mean FROM px WHERE image % 2 = 0 GROUP BY pos), m AS (SELECT image, px.pos FROM px JOIN nm ON px.pos = nm.pos WHERE image % 2 = 1 AND abs(trunc(greatest(0, least(255, v))) - mean) > {SIMPLE}), me AS ({_eroded9('m')}), mo AS ({_dilated9('me')}), md AS ({_dilated9('mo')}) {_eroded9('md')}",
}
