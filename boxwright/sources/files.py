"""Readers of a dataset's files through Spark's sources, so that they may lie in any store that Spark reads.

Listings and labels stay distributed. Configurations (colour statistics, class names) are small by nature and come to
the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import names as N
from boxwright.sources.bindings import ColorRange

IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
_FILES = "path string, name string, stem string, suffix string, modified timestamp, length long"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _empty_files(spark: SparkSession, folder: str, listed: DataFrame, found: DataFrame) -> DataFrame:
    """The files without a byte, which Spark's scans leave out; the driver, which lists the folder, asks for their times."""
    names = [(p,) for p in listed.inputFiles()]
    if len(names) == found.count():
        return found.limit(0)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, rows = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), []
    full = found.select(F.explode(F.array("path", F.regexp_replace("path", "^file:/+", "file:///"))).alias("p"))
    for (p,) in spark.createDataFrame(names, "p string").join(full, "p", "left_anti").collect():
        status = fs.getFileStatus(path(spark._jvm.java.net.URI(p)))
        if not status.getLen():  # escaped names aren't met in ``full``
            rows.append((status.getPath().toString(), status.getModificationTime()))
    empty = spark.createDataFrame(rows, "path string, millis long")
    return empty.select("path", F.timestamp_millis("millis").alias("modificationTime"), F.lit(0).cast("long").alias("length"))


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = IMAGES, recursive: bool = False, required: bool = False) -> DataFrame:
    """path, name, stem, suffix, modified, length of the files with one of the suffixes, in any case; contents aren't read.

    A folder that isn't there is empty, or an error if the files are ``required``. Sort by name where order matters.
    """
    if not exists(spark, folder):
        if required:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], _FILES)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    path = F.col("path")
    found = listed.select("path", "modificationTime", "length")
    found = found.unionByName(_empty_files(spark, folder, listed, found))
    found = found.select(path, N.file_name(path).alias("name"), N.stem(path).alias("stem"), N.suffix(path).alias("suffix"), F.col("modificationTime").alias("modified"), "length")
    if suffixes is not None:
        found = found.filter(F.col("suffix").isin(*[s.lower() for s in suffixes]))
    if required and found.isEmpty():
        raise FileNotFoundError(f"no files in {folder}")
    return found


def by_stem(listing: DataFrame) -> DataFrame:
    """One path a stem, the last by name where suffixes differ."""
    return listing.groupBy("stem").agg(F.max_by("path", "name").alias("path"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """stem, line_no and the blank-separated values of each line that has any."""
    if not exists(spark, folder) or files(spark, folder, (".txt",)).isEmpty():
        return spark.createDataFrame([], "stem string, line_no int, v array<string>")
    text = spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True).select(N.stem(F.col("_metadata.file_path")).alias("stem"), "value")
    lines = text.select("stem", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))
    return lines.select("stem", "line_no", F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0)).alias("v")).filter(F.size("v") > 0)


def labels(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """stem, line_no, class_id, x, y, w, h of the label files' lines of five values or more; further values are ignored.

    A value that is no number fails the query, or is null if not ``strict``.
    """
    rows = _lines(spark, folder).filter(F.size("v") >= 5)

    def number(i: int, kind: str) -> Column:
        got = F.get("v", F.lit(i)).try_cast("double")
        if strict:
            got = F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.col("stem"), F.lit(": no number: "), F.get("v", F.lit(i)))).cast("double"))
        return got.cast(kind)

    return rows.select("stem", "line_no", number(0, "int").alias("class_id"), *[number(i, "double").alias(c) for i, c in enumerate("xywh", 1)])


def label_classes(spark: SparkSession, folder: str) -> DataFrame:
    """stem and its distinct class ids in the order in which they appear; lines without an integer in front are skipped."""
    ids = _lines(spark, folder).select("stem", "line_no", F.get("v", F.lit(0)).try_cast("int").alias("c")).filter("c IS NOT NULL")
    first = ids.groupBy("stem", "c").agg(F.min("line_no").alias("at"))
    return first.groupBy("stem").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "c"))), lambda r: r["c"]).alias("classes"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels and bytes (blue, green, red) of the images that can be read."""
    i = spark.read.format("image").option("dropInvalid", True).load(folder)
    return i.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def image_pixels(images_: DataFrame) -> DataFrame:
    """path, row, col, b, g, r of images with three channels."""
    px = images_.filter("channels = 3").select("path", "width", F.hex("data").alias("x"), F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("pos"))
    byte = lambda k: F.conv(F.substr(F.col("x"), F.col("pos") * 6 + F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")
    return px.select("path", F.floor(F.col("pos") / F.col("width")).cast("int").alias("row"), (F.col("pos") % F.col("width")).alias("col"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))


def class_names(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """``names``, or the lines of classes.txt where they are none or the placeholder "object"."""
    path = f"{folder}/classes.txt"
    if (not names or names == ["object"]) and exists(spark, path):
        names = [x for (text,) in spark.read.text(path, wholetext=True).collect() for x in map(str.strip, text.splitlines()) if x]
    if not names or not isinstance(names, list):
        raise ValueError("class names are a list that isn't empty")
    return names


def color_ranges(spark: SparkSession, path: str, hsv_margin=(0.0,), lab_margin=(0.0,)) -> list[ColorRange]:
    """Ranges of a file of colour statistics, widened by margins of one value or of one for each channel."""
    import json

    (text,) = spark.read.text(path, wholetext=True).first()
    data = json.loads(text)
    three = lambda m: list(m) * 3 if len(m) == 1 else list(m)
    out = []
    for name, s in data.get("summary", data).items():
        low, high = ([x + sign * m for x, m in zip(s[f"hsv_{end}"], three(hsv_margin))] for end, sign in (("min", -1), ("max", 1)))
        lab_low, lab_high = ([x + sign * m for x, m in zip(s[f"lab_{end}"], three(lab_margin))] for end, sign in (("min", -1), ("max", 1)))
        hsv, lab = s.get("hsv_mean"), s.get("lab_mean")
        out.append(ColorRange(name, tuple(low), tuple(high), tuple(lab_low), tuple(lab_high), hsv and hsv[0], lab and (lab[1], lab[2])))
    return out


def expected_colors(spark: SparkSession, path: str) -> DataFrame:
    """image (lower-cased base name) and color of a CSV, or of JSON that is a list or has ``items``.

    The image is named image, file or path, the colour color or label; rows without either are skipped. Of rows of one
    image the last counts.
    """
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    else:
        rows = spark.read.option("multiLine", True).json(path)
        if "items" in rows.columns:
            rows = rows.select(F.explode("items").alias("i")).select("i.*")
    some = lambda *known: F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in known if c in rows.columns], F.lit(None).cast("string"))
    rows = rows.select(F.monotonically_increasing_id().alias("at"), F.lower(N.file_name(some("image", "file", "path"))).alias("image"), some("color", "label").alias("color"))
    return rows.dropna(subset=["image", "color"]).groupBy("image").agg(F.max_by("color", "at").alias("color"))


def last_row(spark: SparkSession, path: str, columns: list[str] | None = None) -> dict:
    """The last row of a CSV, or those of its ``columns`` that it has; empty if it can't be read."""
    try:
        rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    except AnalysisException:
        return {}
    kept = [c for c in (columns or rows.columns) if c in rows.columns]
    numbered = rows.select(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("r")) if kept else None
    got = numbered.agg(F.max_by("r", "at").alias("r")).first().r if kept else None
    return got.asDict() if got else {}


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV after its header; 0 if it can't be read."""
    try:
        return max(0, spark.read.option("header", False).option("multiLine", True).csv(path).count() - 1)
    except AnalysisException:
        return 0


def json_or_none(spark: SparkSession, path: str):
    import json

    try:
        (text,) = spark.read.text(path, wholetext=True).first()
        return json.loads(text)
    except (AnalysisException, ValueError, TypeError):
        return None


def _documents(spark: SparkSession, folder: str, ending: str, column: str) -> DataFrame:
    if not exists(spark, folder):
        return spark.createDataFrame([], f"stem string, {column} string")
    text = spark.read.option("pathGlobFilter", ending).text(folder, wholetext=True)
    return text.select(N.stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias(column))


def voc(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of a folder's Pascal VOC files; a file that is no such XML has none."""
    from boxwright.operators.labels import read_voc

    return read_voc(_documents(spark, folder, "*.[xX][mM][lL]", "xml"))


def createml(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of a folder's CreateML files; a file that is no such JSON has none."""
    from boxwright.operators.labels import read_createml

    return read_createml(_documents(spark, folder, "*.[jJ][sS][oO][nN]", "json"))
