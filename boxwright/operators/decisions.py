"""Colour scores and decisions of images: one aggregate an image over pixel rows, then column expressions.

The ranges are a configuration of a few colours; each adds three counts to the aggregate, so pixels are shuffled as
partial sums only, one row an image and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.operators.colors import _ORANGE, _YELLOW, BLACK_COVERAGE, BLACK_S, BLACK_V, GREEN_SHARE
from boxwright.sources import bindings as B
from boxwright.sources.bindings import ColorRange

# fixed values: margins, saturation, least pixels, scales of the likenesses, thresholds of the confidence
EDGE, CENTRE, SATURATION, FEW, HUE_SCALE, CHROMA_SCALE, TIE = 0.12, 0.15, 20, 50, 15, 20, 0.15
THRESHOLDS = {"Black": 0.45, "Yellow": 0.20, "Orange": 0.25, "Red": 0.25, "Green": 0.30}
#: Weights of hsv, lab, hue and chroma by strategy.
WEIGHTS = {"generic": (0.5, 0.3, 0.2, 0.0), "black": (0.5, 0.3, 0.2, 0.0), "yellow": (0.5, 0.2, 0.3, 0.0), "green": (0.6, 0.2, 0.2, 0.0), "red": (0.35, 0.25, 0.25, 0.15), "orange": (0.35, 0.25, 0.25, 0.15)}


def strategy(name: str) -> str:
    """The strategy of a colour: its own, else the first whose name it contains, else the generic one."""
    known = ("black", "green", "red", "orange", "yellow")
    low = name.lower()
    return low if low in known else next((k for k in known if k in low), "generic")


def _box(values: str, low, high) -> str:
    return " AND ".join(f"{c} BETWEEN {x} AND {y}" for c, x, y in zip(values, low, high))


def hsv_rule(r: ColorRange) -> str:
    """The HSV test of a colour's strategy. Only the colour named Red has red's hues; others of its strategy have orange's."""
    kind, s, v = strategy(r.name), r.low[1], r.low[2]
    if r.name == "Red":
        return f"(h <= 10 OR h >= 170) AND s >= {max(s, 130)} AND v >= {max(v, 80)}"
    fixed = {
        "black": f"s < {BLACK_S} AND v < {BLACK_V}",
        "yellow": "h BETWEEN 20 AND 35 AND s >= 80 AND v >= 150",
        "green": "h BETWEEN 70 AND 100 AND s >= 75 AND v BETWEEN 30 AND 100",
        "red": f"h BETWEEN 5 AND 20 AND s >= {max(s, 130)} AND v >= {max(v, 100)}",
    }
    fixed["orange"] = fixed["red"]
    return fixed.get(kind) or _box("hsv", r.low, r.high)


def measures(pixels: DataFrame, ranges: list[ColorRange], edge: float = EDGE) -> DataFrame:
    """One row an image: what the scores, quick tests, corrections and coverages need of its ``pixels``.

    ``pixels`` has image, row, col, h, s, v, l, a, b, and height and width where the sizes are known: pixels may lack
    then; else an image ends at its last row and column. An edge is cropped first where the image is larger than two.
    """
    if not {"height", "width"} <= set(pixels.columns):
        size = pixels.groupBy("image").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
        pixels = pixels.join(size, "image")
    m = F.floor(F.least("height", "width") * edge)
    p = pixels.withColumn("m", F.when((m > 0) & (F.col("height") > 2 * m) & (F.col("width") > 2 * m), m).otherwise(0))
    p = p.withColumns({"hh": F.col("height") - 2 * F.col("m"), "ww": F.col("width") - 2 * F.col("m"), "y": F.col("row") - F.col("m"), "x": F.col("col") - F.col("m")})
    p = p.filter("y >= 0 AND x >= 0 AND y < hh AND x < ww")
    inside = lambda my, mx: (F.col("y") >= my) & (F.col("y") < F.col("hh") - my) & (F.col("x") >= mx) & (F.col("x") < F.col("ww") - mx)
    both = F.floor(F.least("hh", "ww") * CENTRE)
    p = p.withColumns({"c": inside(F.floor(F.col("hh") * CENTRE), F.floor(F.col("ww") * CENTRE)), "k": inside(both, both), "sat": F.col("s") >= SATURATION})
    when = lambda cond, value=None: F.when(F.expr(cond), F.lit(1) if value is None else F.col(value))
    out = {
        "n": F.count("*"), "n_sat": F.count_if("sat"), "n_c": F.count_if("c"), "n_valid": F.count(when("c AND sat")),
        "mean_s": F.avg(when("c", "s")), "mean_v": F.avg(when("c", "v")), "median_s": F.median(when("c", "s")), "median_v": F.median(when("c", "v")),
        "n_dark": F.count(when(f"c AND s < {BLACK_S} AND v < {BLACK_V}")), "n_yellow": F.count(when(f"k AND {_YELLOW}")), "n_orange": F.count(when(f"k AND {_ORANGE}")), "n_k": F.count_if("k"),
        "mean_h": F.avg(when("c AND sat", "h")), "mean_a": F.avg(when("c AND sat", "a")), "mean_b": F.avg(when("c AND sat", "b")),
        "n_green": F.count(when("k AND h BETWEEN 70 AND 100")), "k_valid": F.count(when("k AND sat")), "k_orange": F.count(when("k AND sat AND h BETWEEN 8 AND 16")), "k_red": F.count(when("k AND sat AND (h <= 5 OR h >= 175)")),
        "k_a": F.avg(when("k AND sat", "a")), "k_b": F.avg(when("k AND sat", "b")),
    }
    for i, r in enumerate(ranges):
        lab = _box("lab", r.lab_low, r.lab_high)
        out |= {f"hsv{i}": F.count(when(f"c AND sat AND ({hsv_rule(r)})")), f"lab{i}": F.count(when(f"c AND sat AND {lab}")), f"mask{i}": F.count(when(f"sat AND {_box('hsv', r.low, r.high)} AND {lab}"))}
    return p.groupBy("image").agg(*[c.alias(name) for name, c in out.items()])


def _score(i: int, r: ColorRange) -> Column:
    kind = strategy(r.name)
    w = WEIGHTS[kind]
    hue, chroma = F.lit(1.0), F.lit(1.0)
    if r.hue is not None and kind != "black":
        d = F.abs(F.col("mean_h") - r.hue)
        hue = F.exp(-F.least(d, 180 - d) / HUE_SCALE)
    if r.chroma is not None:
        chroma = F.exp(-F.sqrt(F.pow(F.col("mean_a") - r.chroma[0], 2) + F.pow(F.col("mean_b") - r.chroma[1], 2)) / CHROMA_SCALE)
    return F.col(f"hsv{i}") / F.col("n_valid") * w[0] + F.col(f"lab{i}") / F.col("n_valid") * w[1] + hue * w[2] + chroma * w[3]


def scored(m: DataFrame, ranges: list[ColorRange]) -> DataFrame:
    """``m`` with fast (the first colour whose quick test fires) and scores, an array over the ranges."""
    dark = F.col("n_dark") / F.col("n_c")
    black = ((F.col("mean_s") < BLACK_S) & (F.col("mean_v") < BLACK_V)) | ((F.col("median_s") < BLACK_S * 0.8) & (F.col("median_v") < BLACK_V * 0.8)) | (dark > BLACK_COVERAGE)
    share = F.col("n_yellow") / F.col("n_k")
    yellow = (share > 0.25) & (share > F.col("n_orange") / F.col("n_k") * 1.3)
    quick = {"black": (black, dark), "yellow": (yellow, share)}
    fast = reduce(lambda rest, r: F.when(quick[strategy(r.name)][0], r.name).otherwise(rest) if strategy(r.name) in quick else rest, reversed(ranges), F.lit(None).cast("string"))
    few = F.col("n_valid") < FEW
    scores = []
    for i, r in enumerate(ranges):
        conf = quick[strategy(r.name)][1] if strategy(r.name) in quick else F.lit(0.0)
        scores.append(F.when(F.col("fast").isNotNull(), F.when(F.col("fast") == r.name, conf).otherwise(0.0)).when(few, 0.7 if r.name == "Black" else 0.0).otherwise(_score(i, r)))
    return m.withColumn("fast", fast).withColumn("scores", F.array(*scores))


def decide(pixels: DataFrame, ranges: list[ColorRange], threshold: float = 0.1, edge: float = EDGE) -> DataFrame:
    """image, predicted, corrected, confidence, coverage, low: the colour with the highest score (the first on ties), corrected.

    Red over much green becomes green; orange and red within a margin are parted by votes of the core hues and of the
    ratio of b to a. Coverage is the share of the colour's mask; without any the confidence is zero. ``low`` says that
    coverage or confidence are under their thresholds.
    """
    names = [r.name for r in ranges]
    d = scored(measures(pixels, ranges, edge), ranges)
    of = lambda name: F.get("scores", F.lit(names.index(name))) if name in names else F.lit(None).cast("double")
    name_at = lambda at: F.get(F.array(*map(F.lit, names)), at)
    d = d.withColumn("first", name_at((F.array_position("scores", F.array_max("scores")) - 1).cast("int"))).withColumn("best", F.array_max("scores"))
    green = F.col("n_green") / F.col("n_k")
    to_green = (F.col("first") == "Red") & (green > GREEN_SHARE)
    orange, red, votes = of("Orange"), of("Red"), F.col("k_b") / F.greatest(F.col("k_a"), F.lit(1.0))
    lab = F.when(votes > 1.05, "Orange").when(votes < 0.90, "Red")
    hue = F.when(F.col("k_orange") > F.col("k_red") * 1.2, "Orange").when(F.col("k_red") > F.col("k_orange") * 1.2, "Red")
    tie = F.coalesce(F.col("first").isin("Orange", "Red") & (F.abs(orange - red) < TIE) & (F.col("k_valid") > 0) & ~to_green, F.lit(False))
    d = d.withColumns({"tie": tie, "lab_vote": lab, "hue_vote": hue, "green": green})
    own = lambda vote: F.when(vote == "Orange", orange).otherwise(red)
    top = F.greatest(orange, red)
    h, l = F.col("hue_vote"), F.col("lab_vote")
    tied = F.coalesce(h, l, F.when(orange > red, "Orange").otherwise("Red"))
    sure = F.when(h == l, top * 1.3).when(h.isNotNull(), own(h) * 1.1).when(l.isNotNull(), own(l) * 1.1).otherwise(top * 0.9)
    d = d.withColumns({"predicted": F.when(to_green, "Green").when(F.col("tie"), tied).otherwise(F.col("first")), "sure": F.when(to_green, F.col("green")).when(F.col("tie"), sure).otherwise(F.col("best")), "corrected": to_green | F.col("tie")})
    mask = F.col("n_sat")  # a colour without a range, and the quick tests', cover all
    for i, name in enumerate(names):
        mask = F.when((F.col("predicted") == name) & ~(F.col("fast").eqNullSafe(F.lit(name))), F.when(F.col("fast").isNotNull() | (F.col("n_valid") < FEW), 0).otherwise(F.col(f"mask{i}"))).otherwise(mask)
    d = d.withColumn("coverage", mask / F.col("n")).withColumn("confidence", F.when(mask == 0, 0.0).otherwise(F.col("sure")))
    least = F.lit(threshold)
    for name, t in THRESHOLDS.items():
        least = F.when(F.col("predicted") == name, max(t, threshold)).otherwise(least)
    return d.select("image", "predicted", "corrected", "confidence", "coverage", ((F.col("coverage") < threshold) | (F.col("confidence") < least)).alias("low"))


def statuses(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """``decisions`` with expected (null for none) and status: match, mismatch or predicted_only, and low confidence."""
    plain = F.when(F.col("expected").isNull(), "predicted_only").when(F.col("expected") == F.col("predicted"), "match").otherwise("mismatch")
    both = decisions.join(expected, "image", "left").withColumn("plain", plain)
    status = F.when(~F.col("low"), F.col("plain")).when(F.col("plain") == "match", "low_confidence").otherwise(F.concat("plain", F.lit("_low_conf")))
    return both.select("image", "predicted", "expected", "corrected", "confidence", "coverage", status.alias("status"))


def color_scores(spark, sf):
    """The score of each colour for each image, and the quick test that decided it."""
    d = scored(measures(B.color_pixels(spark, sf), B.RANGES), B.RANGES)
    names = F.array(*[F.lit(r.name) for r in B.RANGES])
    return d.select("image", "fast", F.explode(F.arrays_zip(names.alias("color"), F.col("scores").alias("score"))).alias("r")).select("image", "fast", F.col("r.color").alias("color"), F.col("r.score").alias("score"))


def color_decisions(spark, sf):
    p = B.color_pixels(spark, sf)
    return statuses(decide(p, B.RANGES), p.select("image", "expected").distinct())


def color_decision_counts(spark, sf):
    """Images, images matched, mismatched, without expectation and of low confidence, and corrected ones."""
    s = F.col("status")
    return color_decisions(spark, sf).agg(F.count("*").alias("total"), F.count_if(s.isin("match", "low_confidence")).alias("matched"), F.count_if(s.startswith("mismatch")).alias("mismatched"), F.count_if(s.startswith("predicted_only")).alias("predicted_only"), F.count_if(s.contains("low_conf")).alias("low_confidence"), F.count_if("corrected").alias("corrected"))


def _sql() -> str:
    """The same in SQL: pixels of the 14 by 14 inside, centre of 10 by 10."""
    counts = []
    for i, r in enumerate(B.RANGES):
        own = {
            "Red": f"(h <= 10 OR h >= 170) AND s >= {max(130, r.low[1])} AND v >= {max(80, r.low[2])}", "Orange": f"h >= 5 AND h <= 20 AND s >= {max(130, r.low[1])} AND v >= {max(100, r.low[2])}", "DarkRed": f"h >= 5 AND h <= 20 AND s >= {max(130, r.low[1])} AND v >= {max(100, r.low[2])}",
            "Yellow": "h >= 20 AND h <= 35 AND s >= 80 AND v >= 150", "Green": "h >= 70 AND h <= 100 AND s >= 75 AND v >= 30 AND v <= 100", "Black": "s < 50 AND v < 80",
        }.get(r.name) or f"h >= {r.low[0]} AND h <= {r.high[0]} AND s >= {r.low[1]} AND s <= {r.high[1]} AND v >= {r.low[2]} AND v <= {r.high[2]}"
        lab = " AND ".join(f"{c} >= {r.lab_low[j]} AND {c} <= {r.lab_high[j]}" for j, c in enumerate("lab"))
        hsv = " AND ".join(f"{c} >= {r.low[j]} AND {c} <= {r.high[j]}" for j, c in enumerate("hsv"))
        counts.append(f"avg(({own})::INT) FILTER (c AND s >= 20) AS p{i}, avg(({lab})::INT) FILTER (c AND s >= 20) AS q{i}, count(*) FILTER (s >= 20 AND {hsv} AND {lab}) AS m{i}")
    weights = {"Red": (0.35, 0.25, 0.25, 0.15), "Orange": (0.35, 0.25, 0.25, 0.15), "DarkRed": (0.35, 0.25, 0.25, 0.15), "Yellow": (0.5, 0.2, 0.3, 0), "Green": (0.6, 0.2, 0.2, 0)}
    scores = []
    for i, r in enumerate(B.RANGES):
        w = weights.get(r.name, (0.5, 0.3, 0.2, 0))
        hue = f"exp(-least(abs(mh - {r.hue}), 180 - abs(mh - {r.hue})) / 15)" if r.hue is not None else "1"
        chroma = f"exp(-sqrt((ma - {r.chroma[0]}) ** 2 + (mb - {r.chroma[1]}) ** 2) / 20)" if r.chroma else "1"
        quick = {"Black": "dark", "Yellow": "yel"}.get(r.name, "0")
        scores.append(f"CASE WHEN fast IS NOT NULL THEN CASE WHEN fast = '{r.name}' THEN {quick} ELSE 0 END WHEN n_valid < 50 THEN {0.7 if r.name == 'Black' else 0} ELSE p{i} * {w[0]} + q{i} * {w[1]} + {hue} * {w[2]} + {chroma} * {w[3]} END AS s{i}")
    names = [r.name for r in B.RANGES]
    at = {n: f"s{i}" for i, n in enumerate(names)}
    first = "CASE " + " ".join(f"WHEN s{i} = best THEN '{n}'" for i, n in enumerate(names)) + " END"
    mask = "CASE " + " ".join(f"WHEN predicted = '{n}' THEN CASE WHEN fast = '{n}' THEN n_sat WHEN fast IS NOT NULL OR n_valid < 50 THEN 0 ELSE m{i} END" for i, n in enumerate(names)) + " END"
    least = "CASE predicted " + " ".join(f"WHEN '{n}' THEN {t}" for n, t in (("Black", 0.45), ("Yellow", 0.2), ("Orange", 0.25), ("Red", 0.25), ("Green", 0.3))) + " ELSE 0.1 END"
    o, r = at["Orange"], at["Red"]
    return f"""WITH {B.COLOR_SQL}, inner_ AS (SELECT *, row BETWEEN 3 AND 12 AND col BETWEEN 3 AND 12 AS c FROM cpx WHERE row BETWEEN 1 AND 14 AND col BETWEEN 1 AND 14),
ms AS (SELECT image, any_value(expected) AS expected, count(*) AS n, count(*) FILTER (s >= 20) AS n_sat, count(*) FILTER (c AND s >= 20) AS n_valid, avg(s) FILTER (c) AS ss, avg(v) FILTER (c) AS vv, median(s) FILTER (c) AS smed, median(v) FILTER (c) AS vmed,
  avg((s < 50 AND v < 80)::INT) FILTER (c) AS dark, avg({_YELLOW}::INT) FILTER (c) AS yel, avg({_ORANGE}::INT) FILTER (c) AS ora, avg((h >= 70 AND h <= 100)::INT) FILTER (c) AS grn, avg(h) FILTER (c AND s >= 20) AS mh, avg(a) FILTER (c AND s >= 20) AS ma, avg(b) FILTER (c AND s >= 20) AS mb,
  count(*) FILTER (c AND s >= 20 AND h >= 8 AND h <= 16) AS ko, count(*) FILTER (c AND s >= 20 AND (h <= 5 OR h >= 175)) AS kr, {", ".join(counts)} FROM inner_ GROUP BY image),
fa AS (SELECT *, CASE WHEN yel > 0.25 AND yel > ora * 1.3 THEN 'Yellow' WHEN ss < 50 AND vv < 80 OR smed < 40 AND vmed < 64 OR dark > 0.6 THEN 'Black' END AS fast FROM ms),
sc AS (SELECT *, {", ".join(scores)} FROM fa), be AS (SELECT *, greatest({", ".join(f"s{i}" for i in range(len(names)))}) AS best FROM sc), fi AS (SELECT *, {first} AS first FROM be),
vo AS (SELECT *, first = 'Red' AND grn > 0.3 AS togreen, CASE WHEN ko > kr * 1.2 THEN 'Orange' WHEN kr > ko * 1.2 THEN 'Red' END AS hv, CASE WHEN mb / greatest(ma, 1) > 1.05 THEN 'Orange' WHEN mb / greatest(ma, 1) < 0.9 THEN 'Red' END AS lv FROM fi),
ti AS (SELECT *, NOT togreen AND first IN ('Orange', 'Red') AND abs({o} - {r}) < 0.15 AND n_valid > 0 AS tie FROM vo),
pr AS (SELECT *, CASE WHEN togreen THEN 'Green' WHEN tie THEN coalesce(hv, lv, CASE WHEN {o} > {r} THEN 'Orange' ELSE 'Red' END) ELSE first END AS predicted, togreen OR tie AS corrected,
  CASE WHEN togreen THEN grn WHEN NOT tie THEN best WHEN hv = lv THEN greatest({o}, {r}) * 1.3 WHEN hv IS NOT NULL THEN CASE hv WHEN 'Orange' THEN {o} ELSE {r} END * 1.1 WHEN lv IS NOT NULL THEN CASE lv WHEN 'Orange' THEN {o} ELSE {r} END * 1.1 ELSE greatest({o}, {r}) * 0.9 END AS sure FROM ti),
ma AS (SELECT *, {mask} AS mk FROM pr), de AS (SELECT image, predicted, expected, corrected, CASE WHEN mk = 0 THEN 0 ELSE sure END AS confidence, mk / n AS coverage, CASE WHEN expected IS NULL THEN 'predicted_only' WHEN expected = predicted THEN 'match' ELSE 'mismatch' END AS plain, mk / n < 0.1 OR CASE WHEN mk = 0 THEN 0 ELSE sure END < {least} AS low FROM ma),
st AS (SELECT image, predicted, expected, corrected, confidence, coverage, CASE WHEN NOT low THEN plain WHEN plain = 'match' THEN 'low_confidence' ELSE plain || '_low_conf' END AS status FROM de) """


QUERIES = {f.__name__: f for f in (color_scores, color_decisions, color_decision_counts)}
ORACLE = {
    "color_scores": _sql() + " UNION ALL ".join(f"SELECT image, fast, '{r.name}' AS color, s{i} AS score FROM sc" for i, r in enumerate(B.RANGES)),
    "color_decisions": _sql() + "SELECT * FROM st",
    "color_decision_counts": _sql() + "SELECT count(*) AS total, count(*) FILTER (status IN ('match', 'low_confidence')) AS matched, count(*) FILTER (status LIKE 'mismatch%') AS mismatched, count(*) FILTER (status LIKE 'predicted_only%') AS predicted_only, count(*) FILTER (status LIKE '%low_conf%') AS low_confidence, count(*) FILTER (corrected) AS corrected FROM st",
}
