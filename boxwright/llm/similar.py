"""Near copies by similarity: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A MinHash sketch of each text is cut into bands; texts that share a band are candidates, and a candidate pair is linked
only if its shingle sets, compared in full, are similar enough. A pair at 0.8 shares none of the bands with a
probability of 0.0006; one above it, with less.

In the list of a shared band each text is first compared with the one before it, which makes large groups of near
copies one. Texts of a list that then still is of several groups are compared by an exact join on the rarest shingles of
each, so a large group isn't compared in pairs and no pair of a long list is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm import _text as T
from boxwright.llm import simhash
from boxwright.llm._spark import cut

WORDS, BANDS, ROWS = 5, 14, 4
BROADCAST_BYTES = 64 << 20
#: Sets with one shingle that a task compares a set with.
PARTNERS = 1024
U64 = np.uint64
_SEEDS = T.mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * T.BASE_2)


def _sets(column):
    """(first row, row after the last, row of each shingle counted from the first, shingle) of runs of rows.

    The shingles of a row are distinct and in order. A-Z is lower-cased; fewer words than five are one shingle.
    """
    for lo, hi, buf, offsets in T.slices(column):
        buf = T.LOWER[buf]
        starts, ends, first = T.words(buf, offsets)
        (h,) = T.word_hashes(buf, starts, ends, T.BASE_1)
        at = np.flatnonzero(T.whole(first, len(starts), WORDS))
        value, row = [T.windows(h, WORDS, T.STEP_1)[at]], [np.searchsorted(first, at, "right") - 1]
        for k in range(1, WORDS):
            some = np.flatnonzero(np.diff(first) == k)
            if len(some):
                value.append(T.windows(h, k, T.STEP_1, first[some]) ^ U64(k))
                row.append(some)
        value, row = np.concatenate(value), np.concatenate(row)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, row[new], value[new]


def sketches(docs: DataFrame) -> DataFrame:
    """id, size (shingles), whole (a hash of the set) and bands of each text with words."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for lo, _, row, value in _sets(batch.column("text")):
                if not len(row):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                least = [np.minimum.reduceat((value ^ s) * (s | U64(1)), begin) for s in _SEEDS]
                bands = np.empty((len(begin), BANDS), U64)
                for b in range(BANDS):
                    key = np.full(len(begin), b, U64)
                    for x in least[b * ROWS : (b + 1) * ROWS]:
                        key = T.mix(key * T.STEP_2 + x)
                    bands[:, b] = key
                size = np.diff(np.concatenate([begin, [len(row)]]))
                whole = np.add.reduceat(T.mix(value ^ T.BASE_2), begin)
                yield pa.record_batch([ids.take(pa.array(lo + row[begin])), pa.array(size, pa.int32()), pa.array(whole.view(np.int64)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))], names=["id", "size", "whole", "bands"])

    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, size int, whole long, bands array<long>")


def shingles(docs: DataFrame) -> DataFrame:
    """id and the set of its shingles, for texts with words."""

    def run(batches):
        for batch in batches:
            for lo, _, row, value in _sets(batch.column("text")):
                if len(row):
                    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    offsets = pa.array(np.concatenate([begin, [len(row)]]), pa.int32())
                    yield pa.record_batch([batch.column("id").take(pa.array(lo + row[begin])), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64)))], names=["id", "set"])

    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, set array<long>")


def candidates(sets: DataFrame, width: int = 1) -> DataFrame:
    """Pairs of ``sets`` (id, label, size, bands) of different labels and fitting sizes that share a band: a, b, la, lb."""
    rows = sets.select("id", "label", "size", "bands", F.posexplode("bands").alias("band", "key"))
    rows = rows.select("key", F.get("bands", (F.col("band") + 1) % BANDS).alias("next"), F.struct("id", "label", "size").alias("x"))
    w = Window.partitionBy("key").orderBy("next", "x").rowsBetween(-width, -1)
    lists = rows.select(F.col("x").alias("y"), F.collect_list("x").over(w).alias("before"))
    # most texts of a long list are in one group by then: their pairs are never made
    fit = lists.select("y", F.expr("filter(before, x -> x.label <> y.label AND 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size))").alias("fit"))
    fit = fit.select("y", F.explode("fit").alias("x"))
    return fit.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).selectExpr("x.id AS a", "y.id AS b", "x.label AS la", "y.label AS lb").distinct()


def crowded(sets: DataFrame, width: int = 1) -> DataFrame:
    """id, label and size of those of ``sets`` in a band of several labels that ``candidates`` doesn't compare in full."""
    rows = sets.select("id", "label", "size", F.explode("bands").alias("key"))
    lists = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return rows.join(lists.filter((F.col("n") > width + 1) & (F.col("lo") < F.col("hi"))), "key", "left_semi").select("id", "label", "size").distinct()


def rare_pairs(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """Pairs of ``rest`` (id, label, size) of different labels that can have a similarity of 0.8: a, b, la, lb; none is left out.

    Shingles are ordered by rarity among ``rest``. Of two sets that similar, the first size - ceil(0.8 size) + 1 have one in
    common, and after the first that they share enough must follow in both. A frequent one is dealt to several tasks.
    """
    rows = cut(shingles(docs.join(rest.select("id"), "id", "left_semi")).select("id", F.explode("set").alias("token")))
    often = rows.groupBy("token").count().filter("count > 1")  # one that no other set has makes no pair, but has its place
    rows = rows.join(often, "token", "left").join(rest, "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("count", F.lit(1)), "token"))
    rows = rows.withColumn("place", place).filter("place <= size - ceil(0.8BD * size) + 1 AND count IS NOT NULL")
    parts = F.ceil(F.col("count") / PARTNERS).cast("int")
    x = F.struct("id", "label", "size", "place")
    left = rows.select("token", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), x.alias("x"))
    right = rows.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), x.alias("y"))
    fit = left.join(right, ["token", "part"]).filter("x.id < y.id AND x.label <> y.label AND 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)")
    fit = fit.filter("9 * (1 + least(x.size - x.place, y.size - y.place)) >= 4 * (x.size + y.size)")
    return fit.selectExpr("x.id AS a", "y.id AS b", "x.label AS la", "y.label AS lb").distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` whose sets have a similarity of 0.8 or more: 9 times the common ones are 4 times the sum of the sizes."""
    used = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), light=True)
    if 16 * used.count() <= BROADCAST_BYTES:
        used = F.broadcast(used)  # texts stay where they are
    sets = cut(shingles(docs.join(used, "id", "left_semi")))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("la", "lb")


def groups(docs: DataFrame) -> DataFrame:
    """id and group (its smallest id) of every row of ``docs`` (id, text; id distinct): what SimHash or similarity links, directly or over others."""
    near = cut(simhash.near_duplicates(docs.select(F.col("id").alias("doc_id"), "text")).select(F.col("doc_id").alias("id"), F.col("component_id").alias("label")), light=True)
    sets = cut(sketches(docs).join(near, "id"), light=True)
    # equal sets are one, and go with each other's groups
    one = cut(sets.groupBy("whole", "size").agg(F.min(F.struct("id", "label", "bands")).alias("r")).select("whole", "size", "r.*"), light=True)
    twins = sets.select("whole", "size", F.col("label").alias("a")).distinct().join(one.select("whole", "size", F.col("label").alias("b")), ["whole", "size"])
    links = cut(twins.filter("a <> b").select("a", "b").distinct(), light=True)
    label = cut(simhash.components(links), light=True)
    for exact in (False, True):
        now = one.join(label.select(F.col("id").alias("label"), "component"), "label", "left")
        now = now.select("id", F.coalesce("component", "label").alias("label"), "size", "bands")
        if exact:
            rest = cut(crowded(now), light=True)
            pairs = cut(rare_pairs(docs, rest), light=True)
        else:
            pairs = cut(candidates(now), light=True)
        links = cut(links.union(verified(docs, pairs)).distinct(), light=True)
        label = cut(simhash.components(links), light=True)
    return near.join(label.select(F.col("id").alias("label"), "component"), "label", "left").select("id", F.coalesce("component", "label").alias("group"))


def keep_first(docs: DataFrame, stable: bool = False) -> DataFrame:
    """One row of each group of ``docs``, that of the smallest doc_id (null last, then in the order of the rows); columns as they are.

    Rows are numbered by their place, so null and repeated doc_ids are told apart. ``stable`` says that docs gives the
    same rows in the same partitions whenever it is read, as files do; else it is written to the shared folder first.
    Should a row not be the one that was judged, the job fails. Texts without words are one group; no rows give none.
    """
    if not stable:
        docs = cut(docs)
    row, seen = F.monotonically_increasing_id(), F.xxhash64("text")
    ids = cut(docs.select(row.alias("id"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("d"), seen.alias("x")))
    named = cut(groups(docs.select(row.alias("id"), "text")).join(ids, "id"), light=True)
    first = named.groupBy("group").agg(F.min(F.struct("d", "id"))["id"].alias("first"))
    gone = cut(named.join(first, "group").filter("id <> first").select(F.col("id").alias("_id"), F.col("x").alias("_was")), light=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"), row.alias("_id"), seen.alias("_x"))
    # gone rows are broadcast while their measured size allows
    both = rows.join(F.broadcast(gone) if 48 * gone.count() <= BROADCAST_BYTES else gone, "_id", "left")
    changed = F.raise_error(F.lit("the rows of docs changed between two readings")).cast("boolean")
    stays = F.when(F.col("_was").isNull(), True).when(F.col("_was") == F.col("_x"), False).otherwise(changed)
    return both.filter(stays).select(*[F.col("_r").getField(c).alias(c) for c in docs.columns])
