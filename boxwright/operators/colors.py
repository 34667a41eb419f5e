"""Colour rules over pixel rows: one aggregate an image, then column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwright.sources import bindings as B

# fixed values: margin of the centre, limits of black, yellow and green
MARGIN = int(8 * 0.15)
BLACK_S, BLACK_V, BLACK_COVERAGE, GREEN_SHARE, MIN_PIXELS = 50, 80, 0.6, 0.3, 20
_YELLOW = "(h BETWEEN 20 AND 35 AND s >= 80 AND v >= 150 OR h BETWEEN 18 AND 38 AND s >= 60 AND v >= 180)"
_ORANGE = "(h > 5 AND h < 20 AND s > 100)"
_COLORS = {0: "Black", 1: "Yellow", 4: "Green"}


def _centre(spark, sf):
    return B.hsv_pixels(spark, sf).filter(F.col("row").between(MARGIN, 7 - MARGIN) & F.col("col").between(MARGIN, 7 - MARGIN))


def _share(rule: str):
    return F.avg(F.expr(rule).cast("double"))


def color_fast_paths(spark, sf):
    """The first of black and yellow whose quick test fires on the centre of an image, and both tests."""
    a = _centre(spark, sf).groupBy("image", "color").agg(
        F.avg("s").alias("s"), F.avg("v").alias("v"), F.median("s").alias("ms"), F.median("v").alias("mv"), _share(f"s < {BLACK_S} AND v < {BLACK_V}").alias("dark"), _share(_YELLOW).alias("yellow_ratio"), _share(_ORANGE).alias("o")
    )
    black = ((F.col("s") < BLACK_S) & (F.col("v") < BLACK_V)) | ((F.col("ms") < BLACK_S * 0.8) & (F.col("mv") < BLACK_V * 0.8)) | (F.col("dark") > BLACK_COVERAGE)
    yellow = (F.col("yellow_ratio") > 0.25) & (F.col("yellow_ratio") > F.col("o") * 1.3)
    return a.select("image", "color", F.when(black, F.col("dark")).otherwise(0.0).alias("black_confidence"), "yellow_ratio", F.when(black, "Black").when(yellow, "Yellow").alias("fast"))


def color_green_share(spark, sf):
    """Share of green hues in the centre, and whether it overrides a prediction of red."""
    g = _centre(spark, sf).groupBy("image").agg(_share("h BETWEEN 70 AND 100").alias("green_ratio"))
    return g.select("image", "green_ratio", (F.col("green_ratio") > GREEN_SHARE).alias("green"))


def color_hue_similarity(spark, sf):
    """Similarity of an image's mean hue, over saturated pixels, to each palette hue: circular distance, scale 15."""
    m = B.hsv_pixels(spark, sf).filter("s >= 20").groupBy("image").agg(F.avg("h").alias("h"), F.count("*").alias("n")).filter(F.col("n") >= MIN_PIXELS)
    hues = F.explode(F.array(*[F.lit(x) for x in (5, 28, 85, 170)])).alias("hue")
    d = F.abs(F.col("h") - F.col("hue"))
    return m.select("image", "h", hues).select("image", "hue", F.exp(-F.least(d, 180 - d) / 15).alias("similarity"))


def color_summary(spark, sf):
    """Counts of images that match their expected colour, that don't, and without expectation; accuracy in percent."""
    p = color_fast_paths(spark, sf).join(color_green_share(spark, sf), "image")
    want = F.lit(None).cast("string")
    for i, c in _COLORS.items():
        want = F.when(F.col("color") == i, c).otherwise(want)
    p = p.select(want.alias("want"), F.coalesce("fast", F.when(F.col("green"), "Green"), F.lit("other")).alias("got"))
    c = p.agg(F.count("*").alias("total"), F.count_if(F.col("want") == F.col("got")).alias("matched"), F.count_if(F.col("want") != F.col("got")).alias("mismatched"), F.count_if(F.col("want").isNull()).alias("no_expectation"))
    n = F.col("matched") + F.col("mismatched")
    return c.withColumn("accuracy", F.when(n > 0, 100 * F.col("matched") / n))


_F = f"""WITH {B.HSV_SQL}, c AS (SELECT * FROM hsv WHERE row BETWEEN {MARGIN} AND {7 - MARGIN} AND col BETWEEN {MARGIN} AND {7 - MARGIN}),
a AS (SELECT image, color, avg(s) AS s, avg(v) AS v, median(s) AS ms, median(v) AS mv, avg((s < {BLACK_S} AND v < {BLACK_V})::INT) AS dark, avg({_YELLOW}::INT) AS y, avg({_ORANGE}::INT) AS o FROM c GROUP BY image, color),
b AS (SELECT *, s < {BLACK_S} AND v < {BLACK_V} OR ms < {BLACK_S * 0.8} AND mv < {BLACK_V * 0.8} OR dark > {BLACK_COVERAGE} AS black FROM a),
f AS (SELECT image, color, CASE WHEN black THEN dark ELSE 0 END AS black_confidence, y AS yellow_ratio, CASE WHEN black THEN 'Black' WHEN y > 0.25 AND y > o * 1.3 THEN 'Yellow' END AS fast FROM b),
g AS (SELECT image, avg((h BETWEEN 70 AND 100)::INT) AS green_ratio, green_ratio > {GREEN_SHARE} AS green FROM c GROUP BY image) """
QUERIES = {f.__name__: f for f in (color_fast_paths, color_green_share, color_hue_similarity, color_summary)}
ORACLE = {
    "color_fast_paths": _F + "SELECT * FROM f",
    "color_green_share": _F + "SELECT * FROM g",
    "color_hue_similarity": f"WITH {B.HSV_SQL}, m AS (SELECT image, avg(h) AS h FROM hsv WHERE s >= 20 GROUP BY image HAVING count(*) >= {MIN_PIXELS}) SELECT image, hue, exp(-least(abs(h - hue), 180 - abs(h - hue)) / 15) AS similarity FROM m, (VALUES (5), (28), (85), (170)) t(hue)",
    "color_summary": _F
    + "SELECT count(*) AS total, count(*) FILTER (want = got) AS matched, count(*) FILTER (want <> got) AS mismatched, count(*) FILTER (want IS NULL) AS no_expectation, 100 * matched / nullif(matched + mismatched, 0) AS accuracy FROM (SELECT CASE color "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in _COLORS.items())
    + " END AS want, coalesce(fast, CASE WHEN green THEN 'Green' END, 'other') AS got FROM f JOIN g USING (image))",
}
