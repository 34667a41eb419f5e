"""Positions of several instances of a class: nearest assignment, statuses, verdicts; and queries over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions import names as N
from boxwright.operators.positions import best
from boxwright.sources import bindings as B
from boxwright.sources import configs

#: area, key, corners, given centre, tolerance in percent. Area C is disabled.
EXPECTED = [
    ("A", "click#0", 0.0, 0.0, 320.0, 640.0, None, None, None),
    ("A", "click#1", 320.0, 0.0, 640.0, 640.0, 500.0, None, 1.0),
    ("A", "view", 0.0, 0.0, 600.0, 500.0, None, None, 10.0),
    ("B", "view", 20.0, 20.0, 620.0, 620.0, None, None, None),
    ("B", "purchase#0", 10.0, 10.0, 500.0, 500.0, None, None, None),
    ("C", "view", 0.0, 0.0, 1.0, 1.0, None, None, None),
]
ENABLED = ("A", "B")


def expected(spark) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(EXPECTED)], "exp_ord int, area string, key string, x1 double, y1 double, x2 double, y2 double, ecx double, ecy double, tolerance double")


def detections(spark, sf) -> DataFrame:
    """The detections with an area, by image; every seventeenth has no centre."""
    d = B.detections(spark, sf)
    user = F.split("image", "/")[0].cast("long")
    none = F.col("ord") % 17 == 0
    return d.select("image", F.when(user % 3 == 0, "A").when(user % 3 == 1, "B").otherwise("C").alias("area"), "class", "conf", "ord", F.when(~none, F.col("cx")).alias("cx"), F.when(~none, F.col("cy")).alias("cy"))


def _inside(tolerance: float, size: float) -> Column:
    t = F.coalesce("tolerance", F.lit(tolerance)) / 100 * size
    between = lambda c, low, high: c.between(F.greatest(F.lit(0.0), low - t), F.least(F.lit(size), high + t))
    return between(F.col("cx"), F.col("x1"), F.col("x2")) & between(F.col("cy"), F.col("y1"), F.col("y2"))


def assigned(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (image, area, class, exp_ord, ord, dist and more) the nearest first, each side once, in an image and class.

    A fold over an image's sorted pairs; their number is that of its detections times the instances configured.
    """
    carried = [c for c in pairs.columns if c not in ("image", "area", "class")]
    order = [F.col(c) for c in ("dist", "exp_ord", "ord")] + [F.col(c) for c in carried if c not in ("dist", "exp_ord", "ord")]
    lists = pairs.groupBy("image", "area", "class").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("p"))
    none = F.slice("p", 1, 0)
    taken = lambda s, p: F.exists(s, lambda q: (q["exp_ord"] == p["exp_ord"]) | (q["ord"] == p["ord"]))
    kept = F.aggregate("p", none, lambda s, p: F.when(taken(s, p), s).otherwise(F.concat(s, F.array(p))))
    return lists.select("image", "area", "class", F.explode(kept).alias("m")).select("image", "area", "class", "m.*")


def validated(dets: DataFrame, exp: DataFrame, tolerance: float = B.TOLERANCE, size: float = B.IMGSZ) -> DataFrame:
    """image, key, ord and status of every expected box and every detection that isn't expected.

    A class with one box and no instance number takes its most confident detection; other classes assign theirs by
    distance, and what is left over is unexpected. A detection without centre is unknown where it is the one chosen.
    """
    w = Window.partitionBy("area", "class")
    exp = exp.withColumn("class", N.base_class(F.col("key")))
    exp = exp.withColumn("multi", (F.count("*").over(w) > 1) | (F.max(F.col("key").contains("#").cast("int")).over(w) == 1))
    exp = F.broadcast(exp.withColumns({"ecx": N.centre(F.col("ecx"), F.col("x1"), F.col("x2")), "ecy": N.centre(F.col("ecy"), F.col("y1"), F.col("y2"))}))  # a configuration
    inside = F.when(_inside(tolerance, size), "CORRECT").otherwise("WRONG")
    images = dets.select("image", "area").distinct()
    one = images.join(exp.filter(~F.col("multi")), "area").join(best(dets).drop("area"), ["image", "class"], "left")
    one = one.select("image", "key", "ord", F.when(F.col("ord").isNull(), "MISSING").when(F.col("cx").isNull() | F.col("cy").isNull(), "UNKNOWN").otherwise(inside).alias("status"))
    many = exp.filter("multi")
    pairs = dets.filter("cx IS NOT NULL AND cy IS NOT NULL").join(many, ["area", "class"])
    pairs = pairs.withColumn("dist", F.sqrt(F.pow(F.col("cx") - F.col("ecx"), 2) + F.pow(F.col("cy") - F.col("ecy"), 2)))
    met = assigned(pairs.select("image", "area", "class", "dist", "exp_ord", "ord", "key", inside.alias("status")))
    missing = images.join(many, "area").join(met.select("image", "exp_ord"), ["image", "exp_ord"], "left_anti").select("image", "key", F.lit(None).cast("long").alias("ord"), F.lit("MISSING").alias("status"))
    left = dets.join(many.select("area", "class").distinct(), ["area", "class"], "left_semi").join(met.select("image", "ord"), ["image", "ord"], "left_anti")
    odd = dets.join(exp.select("area", "class"), ["area", "class"], "left_anti")
    extra = left.select("image", "class", "ord").unionByName(odd.select("image", "class", "ord")).select("image", F.col("class").alias("key"), "ord", F.lit("UNEXPECTED").alias("status"))
    return one.unionByName(met.select("image", "key", "ord", "status")).unionByName(missing).unionByName(extra)


def verdicts(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """image and verdict: FAIL if anything is missing, wrong, unexpected or unknown; SKIPPED for the images of ``skipped``."""
    bad = results.groupBy("image").agg(F.when(F.max((F.col("status") != "CORRECT").cast("int")) == 1, "FAIL").otherwise("PASS").alias("verdict"))
    return bad.unionByName(skipped.select("image", F.lit("SKIPPED").alias("verdict")).distinct())


def _part_config(spark, sf) -> DataFrame:
    """The parts as expected boxes: brands are products, and their names give the keys."""
    p = B.table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("product"), F.concat(F.lit("A"), (F.col("p_size") % 3).cast("string")).alias("area"), F.col("p_partkey").alias("exp_ord"), F.concat(F.split("p_name", " ")[0], F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("#"), (F.col("p_partkey") % 4).cast("string"))).otherwise("")).alias("key"))


def position_results_multi(spark, sf):
    return validated(detections(spark, sf).filter(F.col("area").isin(*ENABLED)), expected(spark).filter(F.col("area").isin(*ENABLED)))


def position_verdict_multi(spark, sf):
    return verdicts(position_results_multi(spark, sf), detections(spark, sf).filter(~F.col("area").isin(*ENABLED)))


def position_class_summary(spark, sf):
    """Counts of each status by key, with the images that have it."""
    return position_results_multi(spark, sf).groupBy("key", "status").agg(F.count("*").alias("n"), F.countDistinct("image").alias("images"))


def greedy_match(spark, sf):
    """Expected and detected boxes of a class, nearest pairs first, each side once; each class is expected twice."""
    e = B.expected(spark).filter("class IN ('click', 'view')").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    e = e.select("class", F.concat_ws("#", "class", F.col("copy").cast("string")).alias("key"), (F.col("exp_ord") * 2 + F.col("copy")).alias("exp_ord"), ((F.col("x1") + F.col("x2")) / 2 + F.col("copy") * 100).alias("ex"), ((F.col("y1") + F.col("y2")) / 2).alias("ey"))
    pairs = B.detections(spark, sf).join(F.broadcast(e), "class").withColumn("dist", F.sqrt(F.pow(F.col("cx") - F.col("ex"), 2) + F.pow(F.col("cy") - F.col("ey"), 2)))
    return assigned(pairs.select("image", F.lit("").alias("area"), "class", "dist", "exp_ord", "ord", "key")).select("image", "key", "ord", "dist")


def expected_item_names(spark, sf):
    """Distinct base names of each product and area, in their order, as a configuration of the parts has them."""
    return configs.items(_part_config(spark, sf)).select("product", "area", F.array_join("items", ",").alias("items"), F.size("items").alias("n"))


def position_scope(spark, sf):
    """Boxes that count for an area that is configured, and for one that isn't, so that all do."""
    c = _part_config(spark, sf)
    one = lambda area: configs.scoped(c, "Brand#12", area).groupBy("product", "area").agg(F.count("*").alias("n")).withColumn("asked", F.lit(area))
    return one("A1").unionByName(one("none")).select("asked", "product", "area", "n")


def name_parts(spark, sf):
    """File name, stem, suffix and class keys of paths made of the parts' names."""
    p = B.table(spark, sf, "part").select("p_partkey", F.format_string("data/set%d/%s.%d%s", F.col("p_size") % 3, F.regexp_replace("p_name", " ", "_"), F.col("p_partkey") % 4, F.when(F.col("p_partkey") % 2 == 0, ".JPG").otherwise("#7")).alias("path"))
    key = F.concat(F.col("path"), F.when(F.col("p_partkey") % 3 == 0, "#12").otherwise("#x"))
    return p.select("p_partkey", N.file_name(F.col("path")).alias("file"), N.stem(F.col("path")).alias("stem"), N.suffix(F.col("path")).alias("suffix"), N.base_class(key).alias("base_class"), N.base_item(key).alias("base_item"))


def natural_order(spark, sf):
    """Rank of names in natural order within a brand; ties by key."""
    p = B.table(spark, sf, "part").select("p_brand", "p_partkey", F.concat(F.lit("img"), (F.col("p_size") * 7 % 120).cast("string"), F.lit("_v"), (F.col("p_partkey") % 13).cast("string")).alias("name"))
    w = Window.partitionBy("p_brand").orderBy(N.natural_key(F.col("name")), "p_partkey")
    return p.select("p_brand", "p_partkey", "name", F.row_number().over(w).alias("rank"))


def logged_metrics(spark, sf):
    """Metrics of the events' properties: sanitised keys and numeric values, the last of each user."""
    e = B.table(spark, sf, "events").select("user_id", "ts", "event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    e = e.select("user_id", "ts", "event_id", N.metric_key(F.concat(F.lit(" metrics/"), "k", F.lit("(B) "))).alias("metric"), N.metric_value(F.col("v")).alias("number")).filter("number IS NOT NULL")
    return e.groupBy("user_id", "metric").agg(F.max_by("number", F.struct("ts", "event_id")).alias("number"))


def newest_change(spark, sf):
    """Newest change under each source of a tree; zero where it has none."""
    n, o = B.table(spark, sf, "nation"), B.table(spark, sf, "customer").filter("c_custkey % 50 <> 0").join(B.table(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"))
    newest = o.groupBy("c_nationkey").agg(F.max(F.unix_timestamp("o_orderdate")).alias("m"))
    return n.filter("n_nationkey <= 30").join(newest, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.coalesce("m", F.lit(0)).cast("long").alias("newest"))


_E = ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r)]) + ")" for i, r in enumerate(EXPECTED) if r[0] in ENABLED)
_SQL = f"""WITH {B.DET_SQL}, dd AS (SELECT image, CASE split_part(image, '/', 1)::BIGINT % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS area, class, conf, ord, CASE WHEN ord % 17 <> 0 THEN cx END AS cx, CASE WHEN ord % 17 <> 0 THEN cy END AS cy FROM det),
d AS (SELECT * FROM dd WHERE area <> 'C'), e0 AS (SELECT *, regexp_replace(key, '(.)#[0-9]+$', '\\1') AS class FROM (VALUES {_E}) t(exp_ord, area, key, x1, y1, x2, y2, ecx, ecy, tolerance)),
e AS (SELECT * REPLACE (coalesce(ecx, (x1 + x2) / 2) AS ecx, coalesce(ecy, (y1 + y2) / 2) AS ecy), coalesce(tolerance, 5) / 100 * 640 AS t, key LIKE '%#%' AS multi FROM e0), im AS (SELECT DISTINCT image, area FROM d),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY conf DESC, ord) AS r FROM d) WHERE r = 1),
ones AS (SELECT im.image, e.key, b.ord, CASE WHEN b.ord IS NULL THEN 'MISSING' WHEN b.cx IS NULL THEN 'UNKNOWN' WHEN b.cx BETWEEN greatest(0, x1 - t) AND least(640, x2 + t) AND b.cy BETWEEN greatest(0, y1 - t) AND least(640, y2 + t) THEN 'CORRECT' ELSE 'WRONG' END AS status FROM im JOIN e ON im.area = e.area AND NOT multi LEFT JOIN bst b ON b.image = im.image AND b.class = e.class),
prs AS (SELECT d.image, d.area, d.class, exp_ord, ord, key, sqrt((cx - ecx) ** 2 + (cy - ecy) ** 2) AS dist, CASE WHEN cx BETWEEN greatest(0, x1 - t) AND least(640, x2 + t) AND cy BETWEEN greatest(0, y1 - t) AND least(640, y2 + t) THEN 'CORRECT' ELSE 'WRONG' END AS status FROM d JOIN e ON d.area = e.area AND d.class = e.class AND multi WHERE cx IS NOT NULL),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY dist, exp_ord, ord) AS r FROM prs) WHERE r = 1),
f2 AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.image, p.class ORDER BY p.dist, p.exp_ord, p.ord) AS r FROM prs p JOIN f1 ON p.image = f1.image AND p.class = f1.class AND p.exp_ord <> f1.exp_ord AND p.ord <> f1.ord) WHERE r = 1),
met AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
res AS (SELECT * FROM ones UNION ALL SELECT image, key, ord, status FROM met
  UNION ALL SELECT im.image, e.key, NULL, 'MISSING' FROM im JOIN e ON im.area = e.area AND multi WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.image = im.image AND met.exp_ord = e.exp_ord)
  UNION ALL SELECT d.image, d.class, d.ord, 'UNEXPECTED' FROM d WHERE EXISTS (SELECT 1 FROM e WHERE e.area = d.area AND e.class = d.class AND multi) AND NOT EXISTS (SELECT 1 FROM met WHERE met.image = d.image AND met.ord = d.ord)
  UNION ALL SELECT d.image, d.class, d.ord, 'UNEXPECTED' FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.area = d.area AND e.class = d.class)) """
_PATH = "SELECT p_partkey, printf('data/set%d/%s.%d%s', p_size % 3, replace(p_name, ' ', '_'), p_partkey % 4, CASE WHEN p_partkey % 2 = 0 THEN '.JPG' ELSE '#7' END) AS path FROM part"

_PC = "WITH pc AS (SELECT p_brand AS product, 'A' || p_size % 3 AS area, p_partkey AS o, split_part(p_name, ' ', 1) AS item FROM part) "
_G = f"""WITH {B.DET_SQL}, {B.EXP_SQL}, prs AS (SELECT image, d.class, ord, e.class || '#' || k AS key, exp_ord * 2 + k AS eo, sqrt((cx - (x1 + x2) / 2 - k * 100) ** 2 + (cy - (y1 + y2) / 2) ** 2) AS dist FROM det d JOIN ex e ON d.class = e.class, range(0, 2) t(k) WHERE d.class IN ('click', 'view')),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY dist, eo, ord) AS r FROM prs) WHERE r = 1),
f2 AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.image, p.class ORDER BY p.dist, p.eo, p.ord) AS r FROM prs p JOIN f1 ON p.image = f1.image AND p.class = f1.class AND p.eo <> f1.eo AND p.ord <> f1.ord) WHERE r = 1) """
QUERIES = {f.__name__: f for f in (greedy_match, expected_item_names, position_scope, position_results_multi, position_verdict_multi, position_class_summary, name_parts, natural_order, logged_metrics, newest_change)}
ORACLE = {
    "greedy_match": _G + "SELECT image, key, ord, dist FROM f1 UNION ALL SELECT image, key, ord, dist FROM f2",
    "expected_item_names": _PC + "SELECT product, area, string_agg(item, ',' ORDER BY o) AS items, count(*)::INT AS n FROM (SELECT product, area, item, min(o) AS o FROM pc GROUP BY ALL) GROUP BY product, area",
    "position_scope": _PC + "SELECT 'A1' AS asked, product, area, count(*) AS n FROM pc WHERE NOT EXISTS (SELECT 1 FROM pc WHERE product = 'Brand#12' AND area = 'A1') OR product = 'Brand#12' AND area = 'A1' GROUP BY product, area UNION ALL SELECT 'none', product, area, count(*) FROM pc GROUP BY product, area",
    "position_results_multi": _SQL + "SELECT * FROM res",
    "position_verdict_multi": _SQL + "SELECT image, CASE WHEN bool_or(status <> 'CORRECT') THEN 'FAIL' ELSE 'PASS' END AS verdict FROM res GROUP BY image UNION ALL SELECT DISTINCT image, 'SKIPPED' FROM dd WHERE area = 'C'",
    "position_class_summary": _SQL + "SELECT key, status, count(*) AS n, count(DISTINCT image) AS images FROM res GROUP BY key, status",
    "name_parts": f"WITH p AS ({_PATH}), f AS (SELECT p_partkey, split_part(path, '/', 3) AS file, path || CASE WHEN p_partkey % 3 = 0 THEN '#12' ELSE '#x' END AS key FROM p) SELECT p_partkey, file, regexp_replace(file, '\\.[^.]+$', '') AS stem, lower(regexp_extract(file, '\\.[^.]+$')) AS suffix, CASE WHEN p_partkey % 3 = 0 THEN substr(key, 1, length(key) - 3) ELSE key END AS base_class, split_part(key, '#', 1) AS base_item FROM f",
    "natural_order": "SELECT p_brand, p_partkey, 'img' || n || '_v' || v AS name, row_number() OVER (PARTITION BY p_brand ORDER BY n, v, p_partkey)::INT AS rank FROM (SELECT p_brand, p_partkey, p_size * 7 % 120 AS n, p_partkey % 13 AS v FROM part)",
    "logged_metrics": "SELECT user_id, 'metrics/' || k || '_B_' AS metric, arg_max(v, row(ts, event_id)) AS number FROM (SELECT user_id, ts, event_id, unnest(json_keys(props)) AS k, TRY_CAST(json_extract_string(props, unnest(json_keys(props))) AS DOUBLE) AS v FROM events) WHERE v IS NOT NULL GROUP BY user_id, k",
    "newest_change": "SELECT n_nationkey, coalesce(max(epoch(o_orderdate)), 0)::BIGINT AS newest FROM nation LEFT JOIN (customer JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND c_custkey % 50 <> 0) ON c_nationkey = n_nationkey GROUP BY n_nationkey",
}
