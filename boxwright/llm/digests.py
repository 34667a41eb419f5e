"""Document fingerprints: quartile bucket digests.

Byte triplets, taken at fixed distances so that they span words, are hashed into 256 buckets and counted; each
bucket's digit says in which quartile of the counts it lies, and one more byte holds the length on a log scale. Two
digests differ by the sum of their digits' differences (a difference of three counts as six) and of their lengths,
bounded: likeness is 1 for equal digests, and 0 from the difference that these digits would have in any other order.
So short texts, whose few triplets leave most buckets empty, are measured by the buckets that they have. Long texts of
one language share its letters: 1,000 random words each from the same few letters are at 0.5.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import _text as T
from boxwright.llm._spark import shuffle_partitions

BUCKETS = 256
#: Distances of a triplet's second and third byte from its first.
GAPS = ((3, 7), (5, 12), (9, 20))
#: Cost of a difference of digits.
COST = np.array([0, 1, 2, 6])
U64 = np.uint64


def digest(data: bytes) -> str:
    """130 hexadecimal digits: the length's byte, then two bits for each bucket."""
    n = np.zeros(BUCKETS, np.int64)
    for k, (x, y) in enumerate(GAPS if data else ()):
        # zeros after the end: the shortest text has as many triplets as bytes
        b = np.frombuffer(data + bytes(y), np.uint8).astype(np.uint32)
        h = b[: len(b) - y] * np.uint32(0x9E3779B1) + b[x : len(b) - y + x] * np.uint32(0x85EBCA77) + b[y:] * np.uint32(0xC2B2AE3D) + np.uint32(k * 0x27D4EB2F)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        n += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    # equal counts have equal digits: the number of quartiles below
    bound = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    q = (n[:, None] > bound[None, :]).sum(1).astype(np.uint8).reshape(-1, 4)
    length = min(255, round(8 * np.log2(len(data) + 1)))
    return f"{length:02x}" + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).tobytes().hex()


def _digits(fingerprint: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], 1).ravel().astype(np.int8)


def likeness(a: str, b: str) -> float:
    """0 to 1. A length three times as long costs as much as a fifth of all digits, and no more."""
    if a == b:
        return 1.0
    x, y = _digits(a), _digits(b)
    unrelated = np.bincount(x, minlength=4) @ COST[np.abs(np.arange(4)[:, None] - np.arange(4))] @ np.bincount(y, minlength=4) / BUCKETS
    cost = COST[np.abs(x - y)].sum() / unrelated if unrelated else 0.0
    cost += min(0.2, abs(int(a[:2], 16) - int(b[:2], 16)) / 64)
    return float(max(0.0, 1.0 - cost))


def _edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


_BOUNDS = "array<struct<k:int,i:bigint,x:bigint>>"


def _bounds(rows: DataFrame, n: int, total: int, known: int) -> list[tuple[int, int, int]]:
    """Bounds of about n even runs of rows in the order of (doc_id is there, doc_id, hash of text), the first left out.

    Rows without doc_id, and those of one that fills several runs, are parted by the hash.
    """
    cuts = rows.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if known and n > 1 else []
    often = Counter(int(c) for c in cuts)
    span = lambda m: [-(1 << 63) + (1 << 64) * j // m for j in range(m)]
    none = round(n * (total - known) / total) if total else 0
    return sorted([(0, 0, x) for x in span(max(1, none))[1:]] + [(1, c, x) for c, m in often.items() for x in span(m)])


def with_next(docs: DataFrame):
    """doc_id, text and bucket, dealt so that each bucket holds a run of doc_ids and, last, the row after the run.

    Returns the DataFrame, sorted in its partitions; ``extra`` marks that last row. Only bounds of the buckets come to
    the driver. The row after the last is the first.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("k"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("x"))
    counts = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    bounds = _bounds(rows, 4 * parts, counts.n, counts.known)
    # found in two steps: the block of bounds, and the place in it
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    as_json = lambda rows_: [dict(zip("kix", r)) for r in rows_]
    firsts = F.from_json(F.lit(json.dumps(as_json(b[0] for b in blocks))), _BOUNDS)
    all_ = F.from_json(F.lit(json.dumps([as_json(b) for b in blocks])), f"array<{_BOUNDS}>")
    block = F.size(F.filter(firsts, lambda c: c <= key))
    within = F.size(F.filter(F.get(all_, block - 1), lambda c: c <= key))
    bucket = F.when(block == 0, 0).otherwise((block - 1) * step + within).cast("int")
    rows = rows.withColumn("bucket", bucket)
    # the first row of each bucket: least doc_id (null first), then least text's hash
    heads = sorted((r.bucket, r.h.null == 1, r.h.doc_id, r.h.x) for r in rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().cast("int").alias("null"), "doc_id", F.xxhash64("text").alias("x"))).alias("h")).collect())
    if not heads:
        return rows.withColumn("extra", F.lit(False))
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    lead = spark.createDataFrame([(b, i, x, before[b]) for b, _, i, x in heads], "bucket int, head long, x long, back int")
    first = rows.join(F.broadcast(lead), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("head")) & (F.xxhash64("text") == F.col("x")))
    first = first.groupBy("bucket", "back", "doc_id").agg(F.first("text").alias("text"))
    extra = first.select("doc_id", "text", F.col("back").alias("bucket"), F.lit(True).alias("extra"))
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    return both.withColumn("x", F.xxhash64("text")).repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "x").drop("x")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (rounded down) replaced by as much of the next row's head. Rows are in the
    order of doc_id, null first, and, of one doc_id, of a hash of the text; after the last comes the first. Null reads
    as empty; an empty text has all digits zero; a single row is its own next; no rows give none.
    """

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "extra"))):
                doc_id, text, bucket, extra = row
                raw = text.encode()
                mark = digest(raw)
                if held is not None and held[2] == bucket:
                    was, old, _, old_mark = held
                    edited = _edited(old, text).encode()
                    new = digest(edited)
                    out.append((was, len(old), hashlib.sha256(edited).hexdigest(), old_mark, new, likeness(old_mark, new), likeness(old_mark, mark)))
                held = None if extra else (doc_id, text, bucket, mark)
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=list(names))

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return fingerprint(table(spark, sf_dir, "documents"))
