"""Writers of reports and label files through Spark's sinks: rows stay distributed, summaries are of aggregated size."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _text(df: DataFrame, text: str, path: str) -> None:
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_lint(issues: DataFrame, path: str) -> None:
    """issues.csv (stem, issue, detail; sorted by stem and issue) and summary.md with the counts of each kind."""
    split = F.split("issue", ":", 2)
    detail = F.col("detail") if "detail" in issues.columns else F.coalesce(F.get(split, F.lit(1)), F.lit(""))
    rows = issues.select("stem", F.get(split, F.lit(0)).alias("issue"), detail.alias("detail"))
    rows.orderBy("stem", "issue", "detail").write.mode("overwrite").option("header", True).csv(f"{path}/issues.csv")
    counts = rows.groupBy("issue").count().orderBy("issue").collect()
    lines = ["# Lint", "", f"Issues: {sum(r['count'] for r in counts)}", "", *[f"- {r.issue}: {r['count']}" for r in counts], ""]
    _text(issues, "\n".join(lines), f"{path}/summary.md")


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Colour decisions as CSV (confidence of four digits) and JSON rows, with a summary of their statuses."""
    shown = decisions.withColumns({"confidence": F.format_string("%.4f", "confidence"), "coverage": F.format_string("%.4f", "coverage")})
    shown.orderBy("image").write.mode("overwrite").option("header", True).csv(f"{path}/decisions.csv")
    decisions.write.mode("overwrite").json(f"{path}/items.json")
    s = F.col("status")
    one = decisions.agg(F.count("*").alias("total"), F.count_if(s.isin("match", "low_confidence")).alias("matched"), F.count_if(s.startswith("mismatch")).alias("mismatched"), F.count_if(s.startswith("predicted_only")).alias("predicted_only"), F.count_if(s.contains("low_conf")).alias("low_confidence"))
    one.coalesce(1).write.mode("overwrite").json(f"{path}/summary.json")


def write_positions(results: DataFrame, verdicts: DataFrame, path: str, source: str = "", tolerance: float | None = None) -> None:
    """records.json, one image with its verdict and results a line, and summary.json with the counts of the verdicts."""
    lists = results.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("key", "status", "ord"))).alias("results"))
    verdicts.join(lists, "image", "left").select("image", F.col("verdict").alias("status"), F.coalesce("results", F.array()).alias("results")).write.mode("overwrite").json(f"{path}/records.json")
    n = {r.verdict: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
    summary = {"summary": {"status_counts": {k: n.get(k, 0) for k in ("PASS", "FAIL", "SKIPPED")}, "samples": sum(n.values())}, "config_source": source, "tolerance_override": tolerance}
    _text(results, json.dumps(summary, ensure_ascii=False), f"{path}/summary.json")


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select("file", "class_id", "class_name", "conf", "x1", "y1", "x2", "y2").write.mode("overwrite").option("header", True).csv(path)


def write_summary(one: DataFrame, path: str) -> None:
    """A table of one row as JSON."""
    one.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_split(manifest: DataFrame, path: str) -> None:
    """A manifest with a column split, a folder for each."""
    manifest.write.mode("overwrite").partitionBy("split").json(path)


def write_labels(rows: DataFrame, path: str) -> None:
    """Label lines of stem, class_id, x, y, w, h (six decimals), a folder for each stem; lines keep the order of line_no."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "x", "y", "w", "h").alias("value")
    rows.repartition("stem").sortWithinPartitions("stem", "line_no").select("stem", line).write.mode("overwrite").partitionBy("stem").text(path)


def data_yaml(names: list[str], root: str = ".") -> str:
    """The text of a data.yaml."""
    return "".join([f"path: {json.dumps(root)}\n", "train: train/images\nval: val/images\ntest: test/images\n", f"nc: {len(names)}\n", "names:\n", *[f"  {i}: {json.dumps(n, ensure_ascii=False)}\n" for i, n in enumerate(names)]])


def write_documents(docs: DataFrame, column: str, path: str) -> None:
    """One text (XML or JSON) a stem, a folder for each; their line breaks become spaces."""
    docs.select("stem", F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").partitionBy("stem").text(path)


def createml_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """CreateML records (image, annotations): the new ones replace those of the same image, others stay."""
    return old.join(new.select("image"), "image", "left_anti").unionByName(new)


def report(name: str, run: str, dataset: str, images: dict[str, int], metrics: dict, pictures: list[str] = ()) -> str:
    """The Markdown text of a training report."""
    counts = ", ".join(f"{split}={images.get(split, 0)}" for split in ("train", "val", "test"))
    lines = [f"- {k}: {v}" for k, v in metrics.items()] or ["- (No metrics found in results.csv)"]
    return "\n".join([f"# YOLO Report: {name}", "", f"- Run dir: {run}", f"- Dataset: {dataset}", f"- Images: {counts}", "", "## Metrics", *lines, "", "## Artifacts", *[f"![{p}]({p})" for p in pictures]])


def write_report(spark, name: str, run: str, dataset: str, path: str, pictures: list[str] = ()) -> None:
    """A report of a run: images of each split, and the last metrics; both may be missing."""
    from boxwright.sources import files

    images = {s: files.files(spark, f"{dataset}/{s}/images", suffixes=None).count() for s in ("train", "val", "test")}
    there = [p for p in pictures if files.exists(spark, f"{run}/{p}")]
    text = report(name, run, dataset, images, files.last_row(spark, f"{run}/results.csv"), there)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def plain(value):
    """A value as JSON can hold it: keys are text, sequences lists, anything else its text."""
    if value is None or type(value) in (bool, int, float, str):
        return value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return str(value)


def append_experiment(spark, record: dict, path: str) -> None:
    """A record of an experiment as one more JSON line of the table at ``path``."""
    text = json.dumps(plain(record), ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)


def config_fingerprint(config) -> str:
    """MD5 of a configuration's JSON with sorted keys; "unknown" if it has none."""
    import hashlib

    try:
        return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()
    except (TypeError, ValueError):
        return "unknown"
