"""Normal models and anomalies, splits, samples, runs, fingerprints, logs, colour statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwright.functions.numbers import percentile_or, ratio_or
from boxwright.sources import bindings as B


def normal_model(spark, sf):
    """Mean and deviation of each pixel over the reference images; the variance is 1 at least."""
    p = B.pixels(spark, sf).filter("image % 2 = 0")
    return p.groupBy("pos").agg(F.avg("v").alias("mean"), F.sqrt(F.greatest(F.coalesce(F.var_samp("v"), F.lit(0.0)), F.lit(1.0))).alias("std"))


def anomaly_zmask(spark, sf):
    """Pixels of the test images that differ from the model by 3 deviations or by 70."""
    m = F.broadcast(normal_model(spark, sf))  # one row a pixel of an image
    diff = F.abs(F.col("v") - F.col("mean"))
    return B.pixels(spark, sf).filter("image % 2 = 1").join(m, "pos").filter((diff / (F.col("std") + 1e-6) >= 3) | (diff >= 70)).select("image", "pos")


def ranked(rows, strata, key, order):
    """``rows`` with k, the rank in its stratum by ``key`` (hexadecimal) and ``order``, and n, the size of the stratum.

    Ranks are counted in 256 ranges of the key and shifted by what lies before, so a stratum isn't one task. Strata may
    be null; there are few of them.
    """
    rows = rows.withColumns({"_h": key, "_b": F.substring(key, 1, 2)})
    counts = rows.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*strata)
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in strata], F.col("_b").alias("_at"), F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("n"))
    same = F.col("_b") == F.col("_at")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    k = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", order)) + F.col("_before")
    return rows.join(counts, same).withColumn("k", k).drop("_h", "_b", "_at", "_before", *[f"_{c}" for c in strata])


def stratified_split(spark, sf):
    """Train, val, test by rank in a stratum, ordered by a seeded hash; ratios .7, .15, .15."""
    at = ranked(B.table(spark, sf, "labels"), ["quality", "toxic"], F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id")
    return at.select("doc_id", F.when(F.col("k") <= F.rint(F.col("n") * 0.7), "train").when(F.col("k") <= F.rint(F.col("n") * 0.85), "val").otherwise("test").alias("split"))


def two_stage_split(spark, sf):
    """A hold-out by rank in a stratum of quality, then val and test by rank of the held-out ones, in another seeded order.

    Strata of fewer than two rows, or without a label, are one stratum: they can't be halved.
    """
    seeded = lambda seed: F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))
    at = ranked(B.table(spark, sf, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], seeded(1), "doc_id")
    at = at.withColumn("stratum", F.when(F.col("n") >= 2, F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")))).select("doc_id", "stratum")
    first = ranked(at, ["stratum"], seeded(2), "doc_id").withColumn("held", F.col("k") > F.rint(F.col("n") * 0.7)).drop("k", "n")
    second = ranked(first.filter("held"), ["stratum"], seeded(3), "doc_id")
    held = second.select("doc_id", F.when(F.col("k") <= F.rint(F.col("n") * 0.5), "val").otherwise("test").alias("split"))
    return first.filter("NOT held").select("doc_id", F.lit("train").alias("split")).unionByName(held)


def split_counts(spark, sf):
    return stratified_split(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


def seeded_sample(spark, sf):
    """The first 20 images in the order of a seeded hash."""
    i = B.images(spark, sf)
    return i.orderBy(F.md5(F.concat(F.col("stem").cast("string"), F.lit(":7"))), "stem").limit(20)


def last_metrics(spark, sf):
    """The last row of each user's series."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return B.table(spark, sf, "events").withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_id", "value")


def latest_run(spark, sf):
    """The newest order of each customer, the larger key on ties."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return B.table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_custkey", "o_orderkey")


def next_version(spark, sf):
    """Highest version of each brand's artefact names, and the next patch."""
    name = F.format_string("best_v%d.%d.%d_x", F.col("p_size") % 5, F.col("p_partkey") % 7, F.col("p_partkey") % 11)
    v = [F.regexp_extract(name, r"_v(\d+)\.(\d+)\.(\d+)_", i).cast("int") for i in (1, 2, 3)]
    top = B.table(spark, sf, "part").groupBy("p_brand").agg(F.max(F.struct(v[0].alias("a"), v[1].alias("b"), v[2].alias("c"))).alias("v"))
    return top.select("p_brand", F.concat_ws(".", F.col("v.a").cast("string"), F.col("v.b").cast("string"), (F.col("v.c") + 1).cast("string")).alias("version"))


def fingerprints(listing, by):
    """Digest of the files (path, length, modified in seconds) of each ``by``: the count, and sums of the digests of the files.

    Sums don't need the files of a folder in one row; a folder that has none isn't there, see ``dir_fingerprint``.
    """
    d = F.md5(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modified").cast("string")))
    part = lambda i: F.sum(F.conv(F.substring(d, i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return listing.groupBy(by).agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), part(1), part(17))).alias("digest"))


def dir_fingerprint(spark, sf):
    """Digest of the files of each source folder, empty for the folders that have none."""
    d = B.table(spark, sf, "documents").select("source", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("n_chars").alias("length"), (F.col("doc_id") * 60).alias("modified"))
    folders = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return folders.join(fingerprints(d, "source"), "source", "left").select("source", F.coalesce("digest", F.lit("empty")).alias("digest"))


def freshness(spark, sf):
    """Whether each customer's newest finished order is as new as the newest open one."""
    o = B.table(spark, sf, "orders")
    a, b = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")))
    return o.groupBy("o_custkey").agg(F.coalesce(a >= b, F.lit(False)).alias("fresh"))


def epochs(lines):
    """The ``lines`` (line and further columns) that are epoch records, with epoch, total_epochs, box_loss, cls_loss, dfl_loss."""
    p = r"(\d+)/(\d+)\s+[\d.]+\w*\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)"
    names = {"epoch": "int", "total_epochs": "int", "box_loss": "double", "cls_loss": "double", "dfl_loss": "double"}
    found = lines.filter(F.col("line").rlike(p)).withColumns({c: F.regexp_extract("line", p, i).try_cast(t) for i, (c, t) in enumerate(names.items(), 1)})
    return found.dropna(subset=list(names))  # "1.2.3" is no number


def epoch_log_parse(spark, sf):
    """Lines and box loss of each epoch over all of lineitem."""
    line = F.format_string("INFO %d/%d 1.2G %.3f %.3f %.3f", F.col("l_linenumber"), F.lit(9), F.abs("l_quantity"), F.abs("l_discount"), F.abs("l_tax"))
    rows = B.table(spark, sf, "lineitem").select(line.alias("line"))
    return epochs(rows).groupBy("epoch", "total_epochs").agg(F.count("*").alias("n"), F.sum("box_loss").alias("box_loss"))


def epoch_log_losses(spark, sf):
    """All three losses over all of lineitem; every third order's lines have no memory, every eleventh's are no epoch lines."""
    memory = F.when(F.col("l_orderkey") % 3 == 0, "0").otherwise("1.2G")
    line = F.format_string("INFO %d/%d %s %.3f %.3f %.3f", F.col("l_linenumber"), F.lit(9), memory, F.abs("l_quantity"), F.abs("l_discount"), F.abs("l_tax"))
    line = F.when(F.col("l_orderkey") % 11 == 0, "INFO results saved").otherwise(line)
    return epochs(B.table(spark, sf, "lineitem").select(line.alias("line"))).groupBy("epoch", "total_epochs").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("box_loss", "cls_loss", "dfl_loss")])


def log_severity(spark, sf):
    t = F.lower(F.col("text"))
    c = F.when(t.contains("error"), "error").when(t.contains("warning"), "warning").when(t.contains("success"), "success").when(t.contains("info"), "info").otherwise("plain")
    return B.table(spark, sf, "conversations").groupBy(c.alias("severity")).agg(F.count("*").alias("n"))


def color_channel_stats(spark, sf):
    p = B.pixels(spark, sf).filter("v >= 20")
    q = F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)))
    return p.groupBy("image").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), q[0].alias("p10"), q[1].alias("p90"))


def color_running_stats(spark, sf):
    """Per colour: mean of means and percentiles, least and greatest, images."""
    l = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.col("label").alias("color"))
    s = color_channel_stats(spark, sf).join(l, "image")
    return s.groupBy("color").agg(F.count("*").alias("count"), F.avg("mean").alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"), F.avg("p10").alias("p10"), F.avg("p90").alias("p90"))


def expected_color_lookup(spark, sf):
    """The first known colour, in order, that a part's name contains."""
    colors = ["red", "green", "blue", "yellow", "black", "white"]
    c = F.lit(None).cast("string")
    for x in reversed(colors):
        c = F.when(F.lower("p_name").contains(x), x).otherwise(c)
    return B.table(spark, sf, "part").select("p_partkey", c.alias("color"))


def log_issue_lines(spark, sf):
    """Lines that tell of errors or warnings, in any case."""
    low = F.lower("text")
    return B.table(spark, sf, "conversations").filter(low.contains("error") | low.contains("warning")).select("conv_id", "turn")


def label_text_check(spark, sf):
    """Whether a label's text may stand: two characters or more on its line, the first no blank or tab."""
    text = F.concat(F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(""), F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_name")))
    return B.table(spark, sf, "part").select("p_partkey", text.rlike(r"^[^ \t].+").alias("valid"))


def outcome_tally(spark, sf):
    """Orders done and not done of each priority."""
    done = F.col("o_orderstatus") == "F"
    return B.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(done).alias("succeeded"), F.count_if(~done).alias("failed"))


def user_ratios(spark, sf):
    """Each user's 90th percentile of purchases (-1 for none) and share of clicks that they are (-1 without clicks)."""
    e, is_ = B.table(spark, sf, "events"), lambda t: F.col("event_type") == t
    n = lambda t: F.count_if(is_(t)).cast("double")
    return e.groupBy("user_id").agg(percentile_or(F.when(is_("purchase"), F.col("value")), 90, -1.0).alias("p90"), ratio_or(n("purchase"), n("click"), -1.0).alias("ratio"))


def color_sample_totals(spark, sf):
    """Samples of all colours of a model, and its colours in order."""
    return color_running_stats(spark, sf).agg(F.sum("count").alias("total_samples"), F.array_join(F.sort_array(F.collect_set("color")), ",").alias("colors"))


_N = f"WITH {B.PX_SQL}, nm AS (SELECT pos, avg(v) AS mean, sqrt(greatest(coalesce(var_samp(v), 0), 1)) AS std FROM px WHERE image % 2 = 0 GROUP BY pos), cs AS (SELECT image, count(*) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM px WHERE v >= 20 GROUP BY image) "
_S = "WITH sp AS (SELECT doc_id, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.85, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(doc_id || ':42'), doc_id) AS k, (count(*) OVER (PARTITION BY quality, toxic))::DOUBLE AS n FROM labels)) "
QUERIES = {f.__name__: f for f in (normal_model, anomaly_zmask, stratified_split, two_stage_split, split_counts, seeded_sample, last_metrics, latest_run, next_version, dir_fingerprint, freshness, epoch_log_parse, epoch_log_losses, log_severity, color_channel_stats, color_running_stats, expected_color_lookup, log_issue_lines, label_text_check, outcome_tally, user_ratios, color_sample_totals)}
ORACLE = {
    "normal_model": _N + "SELECT * FROM nm",
    "anomaly_zmask": _N + "SELECT image, px.pos FROM px JOIN nm ON px.pos = nm.pos WHERE image % 2 = 1 AND (abs(v - mean) / (std + 1e-6) >= 3 OR abs(v - mean) >= 70)",
    "stratified_split": _S + "SELECT * FROM sp",
    "split_counts": _S + "SELECT split, count(*) AS n FROM sp GROUP BY split",
    "seeded_sample": f"WITH {B.ANN_SQL} SELECT stem FROM img ORDER BY md5(stem || ':7'), stem LIMIT 20",
    "last_metrics": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "latest_run": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "next_version": "SELECT p_brand, (m // 10000) || '.' || (m // 100 % 100) || '.' || (m % 100 + 1) AS version FROM (SELECT p_brand, max(p_size % 5 * 10000 + p_partkey % 7 * 100 + p_partkey % 11) AS m FROM part GROUP BY p_brand)",
    "dir_fingerprint": "WITH d AS (SELECT source, md5(source || '/' || doc_id || '.txt|' || n_chars || '|' || doc_id * 60) AS m FROM documents), g AS (SELECT source, md5(count(*) || ':' || sum(('0x' || substr(m, 1, 15))::BIGINT::HUGEINT) || ':' || sum(('0x' || substr(m, 17, 15))::BIGINT::HUGEINT)) AS digest FROM d GROUP BY source) SELECT f.source, coalesce(digest, 'empty') AS digest FROM (SELECT 'src' || i AS source FROM range(25) t(i)) f LEFT JOIN g ON g.source = f.source",
    "two_stage_split": "WITH a AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY quality, toxic) >= 2 THEN concat_ws('/', quality, toxic) END AS stratum FROM labels), f AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id || ':2'), doc_id) > round_even((count(*) OVER (PARTITION BY stratum))::DOUBLE * 0.7, 0) AS held FROM a), s AS (SELECT doc_id, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id || ':3'), doc_id) <= round_even((count(*) OVER (PARTITION BY stratum))::DOUBLE * 0.5, 0) AS val FROM f WHERE held) SELECT doc_id, 'train' AS split FROM f WHERE NOT held UNION ALL SELECT doc_id, CASE WHEN val THEN 'val' ELSE 'test' END FROM s",
    "freshness": "SELECT o_custkey, coalesce(max(o_orderdate) FILTER (o_orderstatus = 'F') >= max(o_orderdate) FILTER (o_orderstatus = 'O'), false) AS fresh FROM orders GROUP BY o_custkey",
    "epoch_log_parse": "SELECT l_linenumber AS epoch, 9 AS total_epochs, count(*) AS n, sum(round(abs(l_quantity), 3)) AS box_loss FROM lineitem GROUP BY 1",
    "epoch_log_losses": "SELECT l_linenumber AS epoch, 9 AS total_epochs, count(*) AS n, sum(round(abs(l_quantity), 3)) AS box_loss, sum(round(abs(l_discount), 3)) AS cls_loss, sum(round(abs(l_tax), 3)) AS dfl_loss FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1",
    "log_severity": "SELECT CASE WHEN lower(text) LIKE '%error%' THEN 'error' WHEN lower(text) LIKE '%warning%' THEN 'warning' WHEN lower(text) LIKE '%success%' THEN 'success' WHEN lower(text) LIKE '%info%' THEN 'info' ELSE 'plain' END AS severity, count(*) AS n FROM conversations GROUP BY 1",
    "color_channel_stats": _N + "SELECT * FROM cs",
    "color_running_stats": _N + "SELECT label AS color, count(*) AS count, avg(mean) AS mean, min(min) AS min, max(max) AS max, avg(p10) AS p10, avg(p90) AS p90 FROM cs JOIN embeddings ON image = vec_id GROUP BY label",
    "expected_color_lookup": "SELECT p_partkey, CASE " + " ".join(f"WHEN lower(p_name) LIKE '%{c}%' THEN '{c}'" for c in ("red", "green", "blue", "yellow", "black", "white")) + " END AS color FROM part",
    "log_issue_lines": "SELECT conv_id, turn FROM conversations WHERE text ILIKE '%error%' OR text ILIKE '%warning%'",
    "label_text_check": "SELECT p_partkey, regexp_matches(CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_name END, '^[^ \\t].+') AS valid FROM part",
    "outcome_tally": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1",
    "user_ratios": "SELECT user_id, coalesce(quantile_cont(value, 0.9) FILTER (event_type = 'purchase'), -1) AS p90, coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'click'), 0), -1) AS ratio FROM events GROUP BY user_id",
    "color_sample_totals": _N + "SELECT sum(n)::BIGINT AS total_samples, string_agg(label::VARCHAR, ',' ORDER BY label) AS colors FROM (SELECT label, count(*) AS n FROM cs JOIN embeddings ON image = vec_id GROUP BY label)",
}
