"""Configurations: mappings of YAML or JSON, positions as a table, class names of a run, colour models, presets.

They are small by nature, so a file is read whole on the driver, through Spark's file systems. YAML needs PyYAML; JSON
is read without it.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import names as N
from boxwright.plans.tasks import name_list
from boxwright.sources.files import exists

POSITIONS = "product string, area string, enabled boolean, mode string, area_tolerance double, exp_ord int, key string, x1 double, y1 double, x2 double, y2 double, ecx double, ecy double, sigma_cx double, sigma_cy double, count long, tolerance double"


def parsed(text: str, json_only: bool = False):
    """What a text of JSON or YAML holds; ValueError if it is neither."""
    try:
        return json.loads(text)
    except ValueError:
        if json_only:
            raise
    try:
        import yaml
    except ImportError as e:
        raise ValueError("this text isn't JSON, and YAML needs PyYAML") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def _text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row.value if row else ""


def load(spark: SparkSession, path: str, default: Mapping | None = None) -> dict:
    """The mapping of a file; that of ``default`` where there is no file, an error without one. An empty file is {}."""
    if not exists(spark, path):
        if default is None:
            raise FileNotFoundError(path)
        return dict(default)
    return parsed(_text(spark, path)) or {}


def mapping(spark: SparkSession, source) -> dict:
    """A mapping given, or read from a file; {} for whatever is none or can't be read."""
    if isinstance(source, Mapping):
        return {str(k): v for k, v in source.items()}
    try:
        got = load(spark, str(source), {}) if source else {}
    except ValueError:
        return {}
    return {str(k): v for k, v in got.items()} if isinstance(got, Mapping) else {}


@dataclass
class Watched:
    """A configuration that is read again when its file becomes newer."""

    path: str
    value: dict = field(default_factory=dict)
    seen: int | None = None

    def current(self, spark: SparkSession) -> dict:
        """The value held, until the file is newer than when it was first looked at."""
        if exists(spark, self.path):
            p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            changed = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
            if self.seen is not None and changed > self.seen:
                self.value = load(spark, self.path)
            self.seen = max(changed, self.seen or changed)
        return self.value


def position_rows(config: Mapping) -> list[tuple]:
    """Rows of POSITIONS of a mapping product → area → settings; what is no mapping or no number is left out."""
    if not isinstance(config, Mapping):
        raise TypeError("a position configuration is a mapping")
    number = lambda box, k: float(box[k]) if k in box else None
    rows = []
    for product, areas in config.items():
        for area, cfg in areas.items() if isinstance(areas, Mapping) else ():
            if not isinstance(cfg, Mapping):
                continue
            head = (str(product), str(area), bool(cfg.get("enabled", True)), str(cfg.get("mode", "center")), float(cfg.get("tolerance", 0.0)))
            boxes = cfg.get("expected_boxes", {})
            for key, box in boxes.items() if isinstance(boxes, Mapping) else ():
                try:
                    corners = [float(box.get(k, 0.0)) for k in ("x1", "y1", "x2", "y2")]
                    rest = [number(box, k) for k in ("cx", "cy", "sigma_cx", "sigma_cy")]
                    rows.append((*head, len(rows), str(key), *corners, *rest, int(box["count"]) if "count" in box else None, number(box, "tolerance")))
                except (AttributeError, TypeError, ValueError):
                    continue
    return rows


def positions(spark: SparkSession, source) -> DataFrame:
    """Expected boxes of a configuration, given as a mapping or a file, in their order."""
    config = source if source is None or isinstance(source, Mapping) else load(spark, str(source))
    return spark.createDataFrame(position_rows(config or {}), POSITIONS)


def scoped(config: DataFrame, product: str | None = None, area: str | None = None) -> DataFrame:
    """The rows of a product's area; all rows where either isn't given or nothing matches."""
    if product is None or area is None:
        return config
    hit = config.filter((F.col("product") == product) & (F.col("area") == area))
    return config if hit.isEmpty() else hit


def overridden(config: DataFrame, tolerance=None, unit: str | None = None) -> DataFrame:
    """Areas with a tolerance (ignored if it is no number) and a unit set from outside."""
    try:
        config = config if tolerance is None else config.withColumn("area_tolerance", F.lit(float(tolerance)))
    except (TypeError, ValueError):
        pass
    return config.withColumn("tolerance_unit", F.lit(unit)) if unit else config


def items(config: DataFrame) -> DataFrame:
    """product, area and the distinct names of its boxes without instance numbers, in the order in which they appear."""
    first = config.groupBy("product", "area", N.base_item(F.col("key")).alias("item")).agg(F.min("exp_ord").alias("at"))
    return first.groupBy("product", "area").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda r: r["item"]).alias("items"))


def expected_items(spark: SparkSession, explicit: Mapping | None = None, config: DataFrame | None = None, product: str | None = None, area: str | None = None, names: Iterable | None = None) -> dict:
    """product → area → names: those given, else those of the positions, else the class names for one product's area."""
    if explicit:
        return dict(explicit)
    found: dict = {}
    if config is not None:
        rows = config if not (product and area) else config.filter((F.col("product") == str(product)) & (F.col("area") == str(area)))
        for r in items(rows).collect():  # a configuration
            found.setdefault(r.product, {})[r.area] = list(r["items"])
    if not found and product and area and names is not None and not isinstance(names, (str, bytes)):
        found = {str(product): {str(area): [str(n) for n in names if n is not None]}}
    return found


def detection_config(payload: Mapping, extra: Mapping, reserved: Iterable[str], product=None, area=None, wanted: Mapping | None = None) -> dict:
    """The settings of a detector: ``payload``, what it is for, and further keys that neither set nor reserve."""
    out = dict(payload)
    out |= {k: v for k, v in (("current_product", product and str(product)), ("current_area", area and str(area)), ("expected_items", wanted)) if v}
    kept = set(reserved) | set(out)
    return out | {k: v for k, v in extra.items() if k not in kept}


def run_class_names(spark: SparkSession, run: str, fallback=None) -> list[str]:
    """Class names of a run's args.yaml, else of the dataset file that this names, else ``fallback``."""
    args = mapping(spark, f"{run}/args.yaml")
    names = name_list(args.get("names"))
    if not names and args.get("data"):
        data = str(args["data"])
        names = name_list(mapping(spark, data if data.startswith("/") or "://" in data else posixpath.join(run, data)).get("names"))
    return names or name_list(fallback)


def color_model(spark: SparkSession, path: str) -> dict:
    """version, config, colors, creation_time and total_samples of a reference model; the samples default to their sum."""
    got = parsed(_text(spark, path), json_only=True) or {}
    colors = {k: v for k, v in (got.get("colors") or {}).items() if isinstance(v, Mapping)}
    total = got.get("total_samples")
    return {"version": int(got.get("version", 1)), "config": got.get("config", {}), "colors": colors, "creation_time": got.get("creation_time", ""), "total_samples": int(sum(v["samples"] for v in colors.values()) if total is None else total)}


def presets(spark: SparkSession, candidates: Iterable[str], default: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """Lists of tasks by name, from the first file that holds any, else ``default``."""
    for path in candidates:
        raw = mapping(spark, path).get("presets")
        got = {k: [str(t) for t in v] for k, v in raw.items() if isinstance(v, list)} if isinstance(raw, Mapping) else {}
        if got:
            return got
    return dict(default)


def existing_weights(spark: SparkSession, project: str, prefix: str = "train", given: Iterable[str | None] = ()) -> str | None:
    """The first file of ``given`` that is there, else the newest best.pt or last.pt of a run whose name has the prefix."""
    for path in given:
        if path and exists(spark, path):
            return path
    try:
        found = spark.read.format("binaryFile").load(f"{project}/{prefix}*/weights/{{best,last}}.pt")
    except AnalysisException:  # no such file
        return None
    return found.agg(F.max_by("path", F.struct("modificationTime", F.col("path").endswith("/best.pt"), "path")).alias("path")).first().path
