"""Label documents of an image in XML and JSON, written and read back, and the quality roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import colors, positions
from boxwright.operators.colors import color_fast_paths
from boxwright.operators.geometry import yolo_to_corners
from boxwright.operators.positions import position_status_counts
from boxwright.sources import bindings as B

_VOC = "filename string, object array<struct<name: string, difficult: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
_CREATEML = "array<struct<image: string, annotations: array<struct<label: string, coordinates: struct<x: double, y: double, width: double, height: double>>>>>"


def _labelled(spark, sf) -> DataFrame:
    classes = B.annotations(spark, sf).select("stem", "line_no", F.concat(F.lit("class"), F.col("class_id").cast("string")).alias("label"))
    return yolo_to_corners(spark, sf).join(classes, ["stem", "line_no"])


def voc_documents(boxes: DataFrame) -> DataFrame:
    """stem and xml, objects in line order."""
    xml_text = F.replace(F.replace(F.replace("label", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    side = lambda tag, c: F.concat(F.lit(f"<{tag}>"), F.rint(c).cast("int").cast("string"), F.lit(f"</{tag}>"))
    one = F.concat(F.lit("<object><name>"), xml_text, F.lit("</name><difficult>0</difficult><bndbox>"), side("xmin", "x1"), side("ymin", "y1"), side("xmax", "x2"), side("ymax", "y2"), F.lit("</bndbox></object>"))
    rows = boxes.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("line_no", one.alias("x")))).alias("o"))
    return rows.select("stem", F.concat(F.lit("<annotation><filename>"), F.col("stem").cast("string"), F.lit(".jpg</filename>"), F.array_join("o.x", ""), F.lit("</annotation>")).alias("xml"))


def read_voc(docs: DataFrame) -> DataFrame:
    """filename, ord, label, difficult and whole corners (cut towards zero) of each object."""
    o = docs.select(F.from_xml("xml", _VOC).alias("d")).select("d.filename", F.posexplode("d.object").alias("ord", "o"))
    return o.select("filename", "ord", F.col("o.name").alias("label"), (F.coalesce(F.col("o.difficult"), F.lit(0)) != 0).alias("difficult"), *[F.col(f"o.bndbox.{c}").cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def createml_documents(boxes: DataFrame) -> DataFrame:
    """stem and json: a list with the image's record, annotations in line order."""
    xy = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    rows = boxes.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("line_no", F.struct("label", xy.alias("coordinates")).alias("a")))).alias("o"))
    return rows.select("stem", F.to_json(F.array(F.struct(F.concat(F.col("stem").cast("string"), F.lit(".jpg")).alias("image"), F.col("o.a").alias("annotations")))).alias("json"))


def read_createml(docs: DataFrame) -> DataFrame:
    """image, ord, label and corners of each annotation."""
    r = docs.select(F.explode(F.from_json("json", _CREATEML)).alias("r")).select("r.image", F.posexplode("r.annotations").alias("ord", "a"))
    c = F.col("a.coordinates")
    edge = lambda m, s, sign: c[m] + sign * c[s] / 2
    return r.select("image", "ord", F.col("a.label").alias("label"), edge("x", "width", -1).alias("x1"), edge("y", "height", -1).alias("y1"), edge("x", "width", 1).alias("x2"), edge("y", "height", 1).alias("y2"))


def voc_objects(spark, sf):
    return read_voc(voc_documents(_labelled(spark, sf)))


def createml_objects(spark, sf):
    return read_createml(createml_documents(_labelled(spark, sf)))


def summary(color: DataFrame | None = None, position: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
    """One row of what there is: records of the colour check, verdicts of positions, predictions.

    ``position`` has status and n. A source that isn't there has ``exists`` false and null counts.
    """
    at = lambda s: F.max(F.when(F.col("status") == s, F.col("n"))).alias(f"n_{s.lower()}")
    parts = {
        "color": color is not None and color.agg(F.count("*").alias("color_count")),
        "position": position is not None and position.agg(at("PASS"), at("FAIL"), at("SKIPPED"), F.sum("n").alias("samples")),
        "detection": detections is not None and detections.agg(F.count("*").alias("predictions")),
    }
    rows = None
    for one in parts.values():
        if one:
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    known = rows.columns if rows is not None else []
    value = lambda c: F.max(c) if c in known else F.lit(None).cast("long")
    rows = rows if rows is not None else SparkSession.active().range(0)
    return rows.agg(*[F.lit(bool(one)).alias(f"{name}_exists") for name, one in parts.items()], *[value(c).alias(c) for c in ("color_count", "n_pass", "n_fail", "n_skipped", "samples", "predictions")])


def qc_summary(spark, sf):
    """The summary of the colour check, the positions and the detections."""
    return summary(color_fast_paths(spark, sf), position_status_counts(spark, sf), B.detections(spark, sf))


_C = f"WITH {B.ANN_SQL}, cor AS (SELECT stem, line_no AS ord, 'class' || class_id AS label, greatest(0, least((x - w / 2) * 1280, 1280)) AS x1, greatest(0, least((y - h / 2) * 720, 720)) AS y1, greatest(0, least((x + w / 2) * 1280, 1280)) AS x2, greatest(0, least((y + h / 2) * 720, 720)) AS y2 FROM ann) "
QUERIES = {f.__name__: f for f in (voc_objects, createml_objects, qc_summary)}
ORACLE = {
    "voc_objects": _C + "SELECT stem || '.jpg' AS filename, ord, label, false AS difficult, round_even(x1, 0)::INT AS xmin, round_even(y1, 0)::INT AS ymin, round_even(x2, 0)::INT AS xmax, round_even(y2, 0)::INT AS ymax FROM cor",
    "createml_objects": _C + "SELECT stem || '.jpg' AS image, ord, label, x1, y1, x2, y2 FROM cor",
    "qc_summary": f"SELECT true AS color_exists, true AS position_exists, true AS detection_exists, (SELECT count(*) FROM ({colors.ORACLE['color_fast_paths']})) AS color_count, sum(n) FILTER (status = 'PASS')::BIGINT AS n_pass, sum(n) FILTER (status = 'FAIL')::BIGINT AS n_fail, sum(n) FILTER (status = 'SKIPPED')::BIGINT AS n_skipped, sum(n)::BIGINT AS samples, (SELECT count(*) FROM events) AS predictions FROM ({positions.ORACLE['position_status_counts']})",
}
