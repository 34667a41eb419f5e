r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of 10 words. A window is contained in a text only if its rarest shingle is, so that one
shingle is the window's necessary prefix (for containment of a whole set of n tokens a prefix of one is enough). The
rarity of all benchmark shingles is counted over all documents. Documents join the prefixes at each of their
positions; the offset of the shingle in its window gives the start (positional bound), the window must end in the
text (length bound), and the words are compared one by one.

Prefixes are broadcast while their measured size is at most ``broadcast_bytes``; beyond it positions, without texts,
are shuffled to them, and texts only meet their candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm._spark import cut

WINDOW, SHINGLE, BROADCAST_BYTES = 10, 3, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, once A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z in lower case, runs of digits, letters and other characters from \\x80 on; null for null.

    Splitting at the breaks takes about a sixth of the time of extracting every word by a pattern.
    """
    return F.array_remove(F.split(F.translate(text.cast("string"), UPPER, LOWER), BREAK), "")


def _key(at: Column, list_: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(list_, at + F.lit(i)) for i in range(n)))


def windows(benchmark: DataFrame) -> DataFrame:
    """t, window and items: each distinct window of each distinct text of words, with the item_ids of that text as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0).withColumn("t", F.md5(F.array_join("w", " ")))
    texts = items.groupBy("t").agg(F.first("w").alias("w"), F.sort_array(F.collect_set("item")).alias("items"))
    n = F.size("w")
    cuts = F.when(n <= WINDOW, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.slice("w", i, WINDOW)))
    return texts.select("t", F.explode(F.array_distinct(cuts)).alias("window"), "items")


def _positions(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Each position of each row with the key of its shingle (of each size); an empty row has one of null."""
    out = rows.select("*", F.posexplode_outer("w").alias("pos", "x"))
    keys = [_key(F.col("pos"), F.col("w"), n) for n in sizes]
    return out.withColumn("key", keys[0]) if len(keys) == 1 else out.withColumn("key", F.explode(F.array(*keys)))


def mark(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: its columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is 10 consecutive words of an item; a shorter item is one window; an item without words, and null, has
    none. A word inside any occurrence is hit. Items are those with a window that occurs; one without item_id marks
    words but has no name. Null and empty texts, an empty benchmark and empty tables give no hits; other columns are
    ignored.
    """
    cuts = cut(windows(benchmark))
    held = F.length(F.array_join("window", " ")) + F.length(F.array_join("items", ",")) + 24 * F.size("items") + 128
    size = cuts.agg(F.sum(held).alias("b"), F.collect_set(F.least(F.size("window"), F.lit(SHINGLE))).alias("s")).first()
    small = (size.b or 0) <= broadcast_bytes
    sizes = sorted(size.s, reverse=True) or [SHINGLE]
    # a row's number is made once, in the one pass that uses it, or lies in the shared folder
    rows = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    if not small:
        rows = cut(rows)
    n = F.least(F.size("window"), F.lit(SHINGLE))
    spread = cuts.select("t", "window", "items", F.explode(F.sequence(F.lit(0), F.size("window") - n)).alias("offset"))
    key = F.lit(None).cast("long")
    for s in sizes:
        key = F.when(F.least(F.size("window"), F.lit(SHINGLE)) == s, _key(F.col("offset"), F.col("window"), s)).otherwise(key)
    spread = spread.withColumn("key", key)
    keys, every = spread.select("key").distinct(), _positions(rows.select("w"), sizes).select("key")
    if small:
        often = every.join(F.broadcast(keys), "key").groupBy("key").agg(F.count("*").alias("n"))
    else:  # counted before they meet the keys, so that a frequent shingle is a row a task
        often = every.groupBy("key").agg(F.count("*").alias("n")).join(keys, "key")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("p")
    rarest = spread.join(often, "key", "left").groupBy("t", "window", "items").agg(first)
    prefix = cut(rarest.select("window", "items", F.col("p.offset").alias("offset"), F.col("p.key").alias("key")), light=True)
    start, length = F.col("pos") - F.col("offset"), F.size("window")
    fits = (start >= 0) & (start + length <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("window")
    hit = F.when(F.col("window").isNotNull(), F.struct(start.alias("a"), (start + length).alias("b"))).alias("hit")
    n_words = F.greatest(F.size("w"), F.lit(0)).alias("n")
    if small:
        p = F.broadcast(prefix.withColumnRenamed("key", "k"))
        met = _positions(rows, sizes).join(p, (F.col("key") == F.col("k")) & fits & same, "left")
        met = met.filter(F.col("window").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0)).select("doc_id", "row", n_words, hit, "items")
    else:
        near = _positions(rows.select("row", "w"), sizes).select("row", "pos", "key").join(prefix, "key").filter(start >= 0)
        met = rows.join(near.select("row", "pos", "window", "items", "offset"), "row").filter(fits & same).select("doc_id", "row", n_words, hit, "items")
        none = F.lit(None).cast("struct<a:int,b:int>").alias("hit"), F.lit(None).cast("array<string>").alias("items")
        met = met.unionByName(rows.select("doc_id", "row", n_words, *none))
    one = met.groupBy("doc_id", "row").agg(F.max("n").cast("long").alias("n_words"), F.sort_array(F.collect_set("hit")).alias("hits"), F.collect_set("items").alias("items"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, h: F.struct((s["n"] + F.greatest(h["b"] - F.greatest(h["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], h["b"]).alias("end")),
        lambda s: s["n"].cast("long"),
    )
    one = one.select("doc_id", "n_words", covered.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))
    return one.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any window of a benchmark item, each judged by its own text; columns as they are."""
    # doc_id may be null or repeat with other texts, and a text may repeat with other ids: both make the key
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha1(text.cast("binary")))
    gone = mark(docs.select(key.alias("doc_id"), "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    names = docs.columns
    marked = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return marked.join(gone, "_key", "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in names])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k
), h AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
