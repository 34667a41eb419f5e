"""Polygons, scores of prompted masks, and boxes of augmented images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.operators.geometry import HEIGHT, WIDTH
from boxwright.sources import bindings as B

#: Side of the masks, and parameters of the augmentation.
SIDE, VARIANTS, MAX_ANGLE, MIN_VISIBLE = 8, 3, 15, 0.3


def vertices(spark, sf) -> DataFrame:
    """image, vertex, x, y: each embedding as a polygon of 32 vertices on a grid of 10 pixels."""
    e = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("vertex"))
    at = lambda i: F.floor((0.5 + 2 * F.get("embedding", i).cast("double")) * 64) * 10.0
    return e.select("image", "vertex", at(F.col("vertex") * 2).alias("x"), at(F.col("vertex") * 2 + 1).alias("y"))


def bounds(polygons: DataFrame) -> DataFrame:
    """image and the box of its vertices: corners of at least 1 at the low side, cut to whole pixels."""
    low = lambda c: F.greatest(F.min(c), F.lit(1.0)).cast("int")
    return polygons.groupBy("image").agg(low("x").alias("x1"), low("y").alias("y1"), F.max("x").cast("int").alias("x2"), F.max("y").cast("int").alias("y2"))


def nearest(polygons: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """image, vertex and dist of the vertex nearest to a point within ``radius``, the last on ties."""
    d = polygons.withColumn("dist", F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))).filter(F.col("dist") <= radius)
    return d.groupBy("image").agg(F.max_by("vertex", F.struct(-F.col("dist"), "vertex")).alias("vertex"), F.min("dist").alias("dist"))


def polygon_boxes(spark, sf):
    return bounds(vertices(spark, sf))


def nearest_vertex(spark, sf):
    return nearest(vertices(spark, sf), 320.0, 320.0, 60.0)


def masks(spark, sf) -> DataFrame:
    """image, mask, score: four masks an image, with the scores that a model gave them."""
    return B.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("image"), (F.col("vec_id") % 4).cast("int").alias("mask"), (F.col("label") / 20).alias("score"))


def mask_pixels(spark, sf) -> DataFrame:
    """image, mask, row, col of the set pixels; every ninth mask has none."""
    e = B.table(spark, sf, "embeddings").filter("vec_id % 9 <> 4").select("vec_id", F.posexplode("embedding").alias("pos", "e")).filter("e > 0.05")
    return e.select(F.floor(F.col("vec_id") / 4).alias("image"), (F.col("vec_id") % 4).cast("int").alias("mask"), F.floor(F.col("pos") / SIDE).cast("int").alias("row"), (F.col("pos") % SIDE).alias("col"))


def prompts(masks_: DataFrame) -> DataFrame:
    """image, points (x, y, whether wanted) and the box of an image's prompt; every fifth image has no box."""
    point = lambda x, y, wanted: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(wanted).alias("wanted"))
    i = F.col("image")
    box = F.struct((i % 3).cast("int").alias("x0"), F.lit(1).alias("y0"), F.lit(6).alias("x1"), (5 + i % 6).cast("int").alias("y1"))
    return masks_.select("image").distinct().select("image", F.array(point(2.5 + i % 2, F.lit(3.5), True), point(F.lit(9), F.lit(1), True), point(i % 8, F.lit(6.5), False)).alias("points"), F.when(i % 5 != 0, box).alias("box"))


def mask_metrics(masks_: DataFrame, pixels: DataFrame, prompts_: DataFrame, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """image, mask, metric: the model's score, and what the points, the box and the area say.

    Coordinates are rounded (halves to even) and held inside the image. Masks without pixels count as well. The pixels
    of a mask are counted in one aggregate, before anything is gathered.
    """
    cell = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top - 1), F.rint(c).cast("int")))
    on = lambda p: (cell(p["x"], width) == F.col("col")) & (cell(p["y"], height) == F.col("row"))
    hits = lambda wanted: F.size(F.filter("points", lambda p: (p["wanted"] == F.lit(wanted)) & on(p)))
    b = {k: cell(F.col(f"box.{k}").cast("double"), width if k[0] == "x" else height) for k in ("x0", "y0", "x1", "y1")}
    inside = (F.col("row") >= b["y0"]) & (F.col("row") < b["y1"]) & (F.col("col") >= b["x0"]) & (F.col("col") < b["x1"])
    met = pixels.join(prompts_, "image").groupBy("image", "mask").agg(F.count("*").alias("area"), F.count_if(inside).alias("inside"), F.sum(hits(True)).alias("good"), F.sum(hits(False)).alias("bad"))
    all_ = masks_.join(prompts_, "image").join(met, ["image", "mask"], "left").na.fill(0, ["area", "inside", "good", "bad"])
    wanted = F.size(F.filter("points", lambda p: p["wanted"]))
    points = (F.col("good") - 0.8 * (wanted - F.col("good"))) * 0.35 - F.col("bad") * 0.45
    size = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    box = F.when((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), F.col("inside") / (F.col("area") + 1e-6) * 0.4 + F.least(F.col("inside") / size, F.lit(1.0)) * 0.25).otherwise(0.0)
    share = F.col("area") / F.lit(float(height * width))
    area = F.when(F.col("area") == 0, -1.0).otherwise(F.when(share > 0.4, (0.4 - share) * 2.5).otherwise(0.0) - F.when(share < 0.0005, 0.5).otherwise(0.0))
    return all_.select("image", "mask", (F.col("score") + points + box + area).alias("metric"))


def mask_scores(spark, sf):
    m = masks(spark, sf)
    return mask_metrics(m, mask_pixels(spark, sf), prompts(m))


def best_mask(spark, sf):
    """The mask of the greatest metric of each image, the first on ties."""
    return mask_scores(spark, sf).groupBy("image").agg(F.max_by("mask", F.struct("metric", -F.col("mask"))).alias("mask"))


def _draw(key: Column, first: int) -> Column:
    """A number from 0 to 65,535 from four digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), first, 4), 16, 10).cast("int")


def augmented(boxes: DataFrame, variants: int = VARIANTS, limit: float = MAX_ANGLE, visible: float = MIN_VISIBLE, seed: int = 0, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """stem, variant, line_no, class_id, x, y, w, h of the boxes after flipping and rotating their images.

    An image's variant is mirrored or not, and turned about its centre by up to ``limit`` degrees; both come from a
    hash of stem, variant and seed, so each rerun gives the same. A box becomes the upright box around its turned
    corners, is cut at the image's edge, and goes if less than ``visible`` of its area is left.
    """
    cut = lambda v, top: F.greatest(F.lit(0.0), F.least(v, F.lit(top)))
    edge = lambda m, s, sign, top: cut((F.col(m) + sign * F.col(s) / 2) * top, top)
    a = boxes.select("stem", "line_no", "class_id", edge("x", "w", -1, width).alias("x1"), edge("y", "h", -1, height).alias("y1"), edge("x", "w", 1, width).alias("x2"), edge("y", "h", 1, height).alias("y2")).filter("x2 > x1 AND y2 > y1")
    a = a.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    key = F.concat_ws(":", F.col("stem").cast("string"), F.col("variant").cast("string"), F.lit(str(seed)))
    turn = (_draw(key, 5) / 65535 * 2 - 1) * (limit * math.pi / 180)
    a = a.withColumns({"mirror": F.when(_draw(key, 1) % 2 == 1, -1.0).otherwise(1.0), "cos": F.cos(turn), "sin": F.sin(turn)})
    a = a.withColumns({"cx": F.col("mirror") * ((F.col("x1") + F.col("x2")) / 2 - width / 2), "cy": (F.col("y1") + F.col("y2")) / 2 - height / 2, "hw": (F.col("x2") - F.col("x1")) / 2, "hh": (F.col("y2") - F.col("y1")) / 2})
    a = a.withColumns({"tx": F.col("cx") * F.col("cos") - F.col("cy") * F.col("sin") + width / 2, "ty": F.col("cx") * F.col("sin") + F.col("cy") * F.col("cos") + height / 2, "tw": F.col("hw") * F.col("cos") + F.col("hh") * F.abs("sin"), "th": F.col("hw") * F.abs("sin") + F.col("hh") * F.col("cos")})
    side = lambda m, s, sign, top: cut(F.col(m) + sign * F.col(s), top)
    a = a.withColumns({"l": side("tx", "tw", -1, width), "r": side("tx", "tw", 1, width), "t": side("ty", "th", -1, height), "b": side("ty", "th", 1, height)})
    kept = a.filter((F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) >= visible * 4 * F.col("tw") * F.col("th"))
    return kept.select("stem", "variant", "line_no", "class_id", ((F.col("l") + F.col("r")) / 2 / width).alias("x"), ((F.col("t") + F.col("b")) / 2 / height).alias("y"), ((F.col("r") - F.col("l")) / width).alias("w"), ((F.col("b") - F.col("t")) / height).alias("h"))


def augmented_boxes(spark, sf):
    return augmented(B.annotations(spark, sf))


_V = "WITH v AS (SELECT vec_id AS image, i::INT AS vertex, floor((0.5 + 2 * embedding[2 * i + 1]::DOUBLE) * 64) * 10 AS x, floor((0.5 + 2 * embedding[2 * i + 2]::DOUBLE) * 64) * 10 AS y FROM embeddings, range(0, 32) t(i)) "
_K = """WITH k AS (SELECT vec_id // 4 AS image, (vec_id % 4)::INT AS mask, label / 20 AS score, list_transform(embedding, lambda e: (vec_id % 9 <> 4 AND e > 0.05)::INT) AS p FROM embeddings),
s AS (SELECT *, list_sum(p)::DOUBLE AS area, least(5 + image % 6, 7)::INT AS bottom FROM k),
n AS (SELECT image, mask, score, area, bottom, (SELECT coalesce(sum(p[r * 8 + c + 1]), 0) FROM range(1, 7) a(r), range(0, 6) b(c) WHERE r < bottom AND c >= image % 3)::DOUBLE AS inside,
  p[round_even(3.5, 0)::INT * 8 + round_even(2.5 + image % 2, 0)::INT + 1] + p[1 * 8 + 7 + 1] AS good, p[6 * 8 + image % 8 + 1] AS bad FROM s),
sc AS (SELECT image, mask, score + ((good - 0.8::DOUBLE * (2 - good)) * 0.35::DOUBLE - bad * 0.45::DOUBLE) + CASE WHEN image % 5 <> 0 THEN inside / (area + 1e-6) * 0.4::DOUBLE + least(inside / ((6 - image % 3) * (bottom - 1)), 1) * 0.25::DOUBLE ELSE 0 END
  + CASE WHEN area = 0 THEN -1 WHEN area / 64 > 0.4::DOUBLE THEN (0.4::DOUBLE - area / 64) * 2.5::DOUBLE ELSE 0 END AS metric FROM n) """
_A = f"""WITH {B.ANN_SQL}, c AS (SELECT stem, line_no, class_id, greatest(0, least((x - w / 2) * 1280, 1280)) AS x1, greatest(0, least((y - h / 2) * 720, 720)) AS y1, greatest(0, least((x + w / 2) * 1280, 1280)) AS x2, greatest(0, least((y + h / 2) * 720, 720)) AS y2 FROM ann),
k AS (SELECT *, md5(stem || ':' || i || ':0') AS m FROM c, range(1, {VARIANTS + 1}) t(i) WHERE x2 > x1 AND y2 > y1),
q AS (SELECT *, CASE WHEN ('0x' || substr(m, 1, 4))::INT % 2 = 1 THEN -1 ELSE 1 END AS f, (('0x' || substr(m, 5, 4))::INT / 65535 * 2 - 1) * {MAX_ANGLE} * pi() / 180 AS a FROM k),
z AS (SELECT *, f * (unnest([x1, x2, x1, x2]) - 640) AS dx, unnest([y1, y1, y2, y2]) - 360 AS dy FROM q),
r AS (SELECT stem, i, line_no, class_id, min(dx * cos(a) - dy * sin(a)) + 640 AS l, max(dx * cos(a) - dy * sin(a)) + 640 AS r, min(dx * sin(a) + dy * cos(a)) + 360 AS t, max(dx * sin(a) + dy * cos(a)) + 360 AS b FROM z GROUP BY ALL),
u AS (SELECT *, greatest(0, least(l, 1280)) AS l2, greatest(0, least(r, 1280)) AS r2, greatest(0, least(t, 720)) AS t2, greatest(0, least(b, 720)) AS b2 FROM r) """
QUERIES = {f.__name__: f for f in (polygon_boxes, nearest_vertex, mask_scores, best_mask, augmented_boxes)}
ORACLE = {
    "polygon_boxes": _V + "SELECT image, trunc(greatest(min(x), 1))::INT AS x1, trunc(greatest(min(y), 1))::INT AS y1, trunc(max(x))::INT AS x2, trunc(max(y))::INT AS y2 FROM v GROUP BY image",
    "nearest_vertex": _V + "SELECT image, vertex, dist FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY dist, vertex DESC) AS k FROM (SELECT *, sqrt((x - 320) ** 2 + (y - 320) ** 2) AS dist FROM v) WHERE dist <= 60) WHERE k = 1",
    "mask_scores": _K + "SELECT * FROM sc",
    "best_mask": _K + "SELECT image, mask FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY metric DESC, mask) AS k FROM sc) WHERE k = 1",
    "augmented_boxes": _A + f"SELECT stem, i::INT AS variant, line_no, class_id, (l2 + r2) / 2 / 1280 AS x, (t2 + b2) / 2 / 720 AS y, (r2 - l2) / 1280 AS w, (b2 - t2) / 720 AS h FROM u WHERE (r2 - l2) * (b2 - t2) >= {MIN_VISIBLE} * (r - l) * (b - t)",
}
