"""Dataset lint: pairing of images and labels, box rules, class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.sources import bindings as B


def pairing(images: DataFrame, labels: DataFrame) -> DataFrame:
    """stem with has_image, has_label over the union of stems."""
    a, b = images.select("stem", F.lit(True).alias("i")), labels.select("stem", F.lit(True).alias("l"))
    return a.join(b, "stem", "full_outer").select("stem", F.coalesce("i", F.lit(False)).alias("has_image"), F.coalesce("l", F.lit(False)).alias("has_label"))


def box_rules(n_classes: int | None) -> list[Column]:
    """One nullable issue text a rule; the rules are independent, and values are part of the text."""
    out = []
    if n_classes is not None:
        out.append(F.when((F.col("class_id") < 0) | (F.col("class_id") >= n_classes), F.concat(F.lit("class_out_of_range:"), F.col("class_id").cast("string"))))
    for c in "xywh":
        out.append(F.when((F.col(c) < 0) | (F.col(c) > 1), F.concat(F.lit(f"{c}_out_of_bounds:"), F.format_string("%.4f", c))))
    area = F.col("w") * F.col("h")
    out.append(F.when((F.col("w") <= 0) | (F.col("h") <= 0), F.lit("non_positive_area")))
    out.append(F.when(area < 1e-5, F.lit("tiny_box")))
    out.append(F.when(area > 0.8, F.lit("huge_box")))
    return out


def issues(images: DataFrame, labels: DataFrame, rows: DataFrame, n_classes: int | None) -> DataFrame:
    """stem, issue. A pairing issue ends the checks of its stem; a label file without rows is empty_labels once."""
    pairs = pairing(images, labels)
    gaps = pairs.filter("NOT (has_image AND has_label)").select("stem", F.when(~F.col("has_image"), F.lit("missing_image")).otherwise(F.lit("missing_label")).alias("issue"))
    good = pairs.filter("has_image AND has_label").select("stem")
    boxes = rows.join(good, "stem").select("stem", F.explode(F.array_compact(F.array(*box_rules(n_classes)))).alias("issue"))
    empty = good.join(rows.select("stem").distinct(), "stem", "left_anti").select("stem", F.lit("empty_labels").alias("issue"))
    return gaps.unionByName(boxes).unionByName(empty)


def _all(spark, sf):
    return B.images(spark, sf), B.label_files(spark, sf), B.label_rows(spark, sf)


def lint_issues(spark, sf):
    return issues(*_all(spark, sf), B.N_CLASSES)


def lint_issue_counts(spark, sf):
    return lint_issues(spark, sf).groupBy("issue").agg(F.count("*").alias("n"))


def class_histogram(spark, sf):
    i, l, r = _all(spark, sf)
    return r.join(i, "stem", "left_semi").groupBy("class_id").agg(F.count("*").alias("n"))


def pairing_gaps(spark, sf):
    return pairing(B.images(spark, sf), B.label_files(spark, sf)).filter("NOT (has_image AND has_label)")


def paired_stems(spark, sf):
    return B.images(spark, sf).join(B.label_files(spark, sf), "stem")


def class_distribution(spark, sf):
    """By name; ids outside the names are dropped."""
    names = F.array(*[F.lit(f"class{i}") for i in range(B.N_CLASSES)])
    return B.label_rows(spark, sf).filter(F.col("class_id").between(0, B.N_CLASSES - 1)).groupBy(F.get(names, F.col("class_id")).alias("name")).agg(F.count("*").alias("n"))


def label_indicator_matrix(spark, sf):
    out = B.label_rows(spark, sf).groupBy("stem").pivot("class_id", list(range(10))).agg(F.max(F.lit(1))).na.fill(0)
    return out.select("stem", *[F.col(str(i)).alias(f"c{i}") for i in range(10)])


def annotation_progress(spark, sf):
    p = pairing(B.images(spark, sf), B.label_files(spark, sf)).filter("has_image")
    n, done = F.count("*"), F.count_if("has_label")
    return p.agg(n.alias("total"), done.alias("annotated"), (n - done).alias("unannotated"), F.coalesce(F.try_divide(done * 100.0, n), F.lit(0.0)).alias("percent"))


def max_class_id(spark, sf):
    return B.label_rows(spark, sf).agg((F.max("class_id") + 1).alias("n_classes"))


_INT = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"


def _shown(v: Column) -> Column:
    """A double as Python writes it."""
    s = v.cast("string")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\.0E", "E"), r"E(\d)", "e+$1"), r"E-(\d)$", "e-0$1")
    return F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).when(s.contains("E") & F.abs(v).between(1e-4, 9.9e15), plain).otherwise(F.regexp_replace(power, "E-", "e-"))


def line_errors(lines: DataFrame, n_classes: int) -> DataFrame:
    """Messages of the ``lines`` (line and further columns, which are carried); a valid or blank line has none.

    Fewer than five values, or a first value that is no integer or one of the next four that is no number, are all that
    is said of a line; else there is a message for a class out of range and for each value outside 0 to 1.
    """
    carried = [c for c in lines.columns if c != "line"]
    v = F.regexp_extract_all("line", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = lines.select(*carried, v.alias("v")).withColumn("n", F.size("v")).filter("n > 0")
    at = lambda i: F.get("v", F.lit(i))
    bare = lambda i: F.regexp_replace(at(i), "_", "")
    good = at(0).rlike(_INT)
    for i in range(1, 5):
        good = good & at(i).rlike(_FLOAT)
    k = bare(0).try_cast("decimal(38,0)")  # null beyond 38 digits
    found = [F.when(F.coalesce((k < 0) | (k >= n_classes), F.lit(True)), F.concat(F.lit("invalid class_id "), F.coalesce(k.cast("string"), F.regexp_replace(bare(0), r"^\+", "")), F.lit(f" (must be 0-{n_classes - 1})")))]
    for i, c in enumerate("xywh", 1):
        x = F.coalesce(bare(i).try_cast("double"), F.lit(float("nan")))
        found.append(F.when(~x.between(0, 1), F.concat(F.lit(f"{c}="), _shown(x), F.lit(" out of range [0, 1]"))))
    messages = F.when(F.col("n") < 5, F.array(F.concat(F.lit("expected 5 values, got "), F.col("n").cast("string")))).when(~good, F.array(F.lit("cannot parse"))).otherwise(F.array_compact(F.array(*found)))
    return rows.select(*carried, F.explode(messages).alias("message"))


def annotation_line_errors(spark, sf):
    """Messages of the documents' lines, read as annotations."""
    lines = B.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return line_errors(lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line"), B.N_CLASSES)


def label_line_errors(spark, sf):
    """Messages of the lines built from the annotations."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "x", "y", "w", "h")
    return line_errors(B.annotations(spark, sf).select("stem", (F.col("line_no") + 1).cast("long").alias("line_no"), line.alias("line")), B.N_CLASSES)


_I = f"WITH {B.ANN_SQL}, good AS (SELECT stem FROM img JOIN lab USING (stem)), iss AS (SELECT stem, 'missing_label' AS issue FROM img WHERE stem NOT IN (SELECT stem FROM lab) UNION ALL SELECT stem, 'missing_image' FROM lab WHERE stem NOT IN (SELECT stem FROM img) UNION ALL SELECT stem, 'empty_labels' FROM good WHERE stem NOT IN (SELECT stem FROM rws) UNION ALL SELECT stem, unnest(list_filter([CASE WHEN class_id < 0 OR class_id >= 8 THEN 'class_out_of_range:' || class_id END, CASE WHEN x < 0 OR x > 1 THEN printf('x_out_of_bounds:%.4f', x) END, CASE WHEN y < 0 OR y > 1 THEN printf('y_out_of_bounds:%.4f', y) END, CASE WHEN w < 0 OR w > 1 THEN printf('w_out_of_bounds:%.4f', w) END, CASE WHEN h < 0 OR h > 1 THEN printf('h_out_of_bounds:%.4f', h) END, CASE WHEN w <= 0 OR h <= 0 THEN 'non_positive_area' END, CASE WHEN w * h < 1e-5 THEN 'tiny_box' END, CASE WHEN w * h > 0.8 THEN 'huge_box' END], lambda v: v IS NOT NULL)) FROM rws JOIN good USING (stem)) "

QUERIES = {f.__name__: f for f in (lint_issues, lint_issue_counts, class_histogram, pairing_gaps, paired_stems, class_distribution, label_indicator_matrix, annotation_progress, max_class_id, annotation_line_errors, label_line_errors)}
ORACLE = {
    "lint_issues": _I + "SELECT stem, issue FROM iss",
    "lint_issue_counts": _I + "SELECT issue, count(*) AS n FROM iss GROUP BY issue",
    "class_histogram": f"WITH {B.ANN_SQL} SELECT class_id, count(*) AS n FROM rws WHERE stem IN (SELECT stem FROM img) GROUP BY class_id",
    "pairing_gaps": f"WITH {B.ANN_SQL} SELECT coalesce(img.stem, lab.stem) AS stem, img.stem IS NOT NULL AS has_image, lab.stem IS NOT NULL AS has_label FROM img FULL JOIN lab ON img.stem = lab.stem WHERE img.stem IS NULL OR lab.stem IS NULL",
    "paired_stems": f"WITH {B.ANN_SQL} SELECT stem FROM img JOIN lab USING (stem)",
    "class_distribution": f"WITH {B.ANN_SQL} SELECT 'class' || class_id AS name, count(*) AS n FROM rws WHERE class_id BETWEEN 0 AND 7 GROUP BY 1",
    "label_indicator_matrix": f"WITH {B.ANN_SQL} SELECT stem, " + ", ".join(f"max(CASE WHEN class_id = {i} THEN 1 ELSE 0 END) AS c{i}" for i in range(10)) + " FROM rws GROUP BY stem",
    "annotation_progress": f"WITH {B.ANN_SQL} SELECT count(*) AS total, count(lab.stem) AS annotated, count(*) - count(lab.stem) AS unannotated, count(lab.stem) * 100.0 / count(*) AS percent FROM img LEFT JOIN lab ON img.stem = lab.stem",
    "max_class_id": f"WITH {B.ANN_SQL} SELECT max(class_id) + 1 AS n_classes FROM rws",
    "annotation_line_errors": r"WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line_no, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l) SELECT doc_id, line_no, CASE WHEN n < 5 THEN 'expected 5 values, got ' || n ELSE 'cannot parse' END AS message FROM c WHERE n > 0",
    "label_line_errors": f"WITH {B.ANN_SQL}, t AS (SELECT stem, line_no + 1 AS line_no, string_split(printf('%d %.6f %.6f %.6f %.6f', class_id, x, y, w, h), ' ') AS v FROM ann), p AS (SELECT stem, line_no, len(v) AS n, TRY_CAST(v[1] AS BIGINT) AS k, " + ", ".join(f"TRY_CAST(v[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xywh", 2)) + " FROM t) SELECT stem, line_no, unnest(CASE WHEN n < 5 THEN ['expected 5 values, got ' || n] WHEN k IS NULL OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN ['cannot parse'] ELSE list_filter([CASE WHEN k NOT BETWEEN 0 AND 7 THEN 'invalid class_id ' || k || ' (must be 0-7)' END, " + ", ".join(f"CASE WHEN NOT {c} BETWEEN 0 AND 1 THEN '{c}=' || {c} || ' out of range [0, 1]' END" for c in "xywh") + "], lambda m: m IS NOT NULL) END) AS message FROM p",
}
