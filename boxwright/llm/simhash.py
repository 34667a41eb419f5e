"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints at most 4 bits apart share a value at most 2 bits from each. So every distinct fingerprint emits all
values within 2 bits of it (2081), values are grouped, and fingerprints that share one are verified and linked.

The emission is factored: a value's bucket is its k lowest bits, so a fingerprint goes once to each bucket that its
values reach (1 + k + k(k-1)/2 of them), and the values are made there. k follows the number of distinct fingerprints,
so that a bucket's values fit memory; a larger bucket is worked through in parts by further bits of the value. Equal
fingerprints are one before that, and a bucket links the fingerprints of a shared value in a chain, never in pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import _text as T
from boxwright.llm._spark import cut

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Values that a bucket holds at once.
VALUES = 4 << 20
#: Links that one task may finish.
FEW = 2_000_000
U64 = np.uint64


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the 64-bit SimHash of the text's 4-word shingles as a signed long.

    A-Z is lower-cased; words are runs of other characters than \\x20 and \\x09-\\x0D; repeats count. Fewer words than
    four: the whole sequence is the one shingle. No words, or null: zero.
    """

    def run(batches):
        digest = xxhash.xxh64_digest
        for batch in batches:
            out = np.zeros(batch.num_rows, U64)
            for lo, hi, buf, offsets in T.slices(batch.column("text")):
                starts, ends, first = T.words(buf, offsets)
                joined, begin = T.joined(T.LOWER[buf], starts, ends)
                raw, lens = joined.tobytes(), ends - starts
                stop = begin + lens
                ok = T.whole(first, len(starts), SHINGLE)
                at = np.flatnonzero(ok)
                n = np.diff(first)
                short = np.flatnonzero((n > 0) & (n < SHINGLE))
                a = np.concatenate([begin[at], begin[first[short]]]) if len(short) else begin[at]
                b = np.concatenate([stop[at + SHINGLE - 1], stop[first[short + 1] - 1]]) if len(short) else stop[at + SHINGLE - 1]
                hashed = b"".join([digest(raw[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())])
                bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
                edge = np.searchsorted(at, first)
                for k in np.flatnonzero(n >= SHINGLE):
                    x, y = edge[k], edge[k + 1]
                    out[lo + k] = np.packbits(2 * bits[x:y].sum(0, dtype=np.int64) > y - x).view(">u8")[0]
                for i, k in enumerate(short):
                    out[lo + k] = np.packbits(bits[len(at) + i]).view(">u8")[0]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: list[int], flips: int) -> np.ndarray:
    one = [1 << b for b in bits]
    out = [0]
    if flips > 0:
        out += one
    if flips > 1:
        out += [x | y for i, x in enumerate(one) for y in one[:i]]
    return np.array(out, U64)


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable of each of n nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        x, y = label[a], label[b]
        for to, least in ((x, y), (y, x), (a, y), (b, x)):
            np.minimum.at(new, to, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(points: DataFrame, n_points: int) -> DataFrame:
    """Pairs (a, b) of ids that connect all of ``points`` (id, fp; fp distinct) at most RADIUS bits apart.

    Every pair is within a group of such links; the pairs are a chain of each group a bucket sees, not all links.
    """
    k = min(24, max(4, math.ceil(math.log2(max(1, n_points) * 2081 / VALUES))))
    half = RADIUS // 2
    mask = (1 << k) - 1

    def emit(batches):
        m = _masks(list(range(k)), half)
        used = np.bitwise_count(m).astype(np.int8)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(U64)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                bucket = ((part & U64(mask))[:, None] ^ m[None, :]).ravel().astype(np.int64)
                yield pa.record_batch([pa.array(bucket), pa.array(np.repeat(ids[lo : lo + 20_000], len(m))), pa.array(np.repeat(part, len(m)).view(np.int64)), pa.array(np.tile(used, len(part)))], names=["bucket", "id", "fp", "used"])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, fp, used = (table[c].to_numpy() for c in ("id", "fp", "used"))
        high = fp.view(U64) & ~U64(mask)
        total = sum(int((used == u).sum()) * len(_masks(list(range(k, 64)), half - u)) for u in range(half + 1))
        more = max(0, math.ceil(math.log2(max(1, total / VALUES))))
        sub = U64(((1 << more) - 1) << k)  # parts by these bits of the value
        rest = list(range(k + more, 64))
        label = np.arange(len(ids))
        for part in range(1 << more):
            want = U64(part << k)
            away = np.bitwise_count((high ^ want) & sub).astype(np.int64) + used
            value, who = [], []
            for u in range(half + 1):
                at = np.flatnonzero(away == u)
                if len(at):
                    m = _masks(rest, half - u)
                    value.append(((high[at] & ~sub)[:, None] ^ m[None, :]).ravel())
                    who.append(np.repeat(at, len(m)))
            if not value:
                continue
            value, who = np.concatenate(value), np.concatenate(who)
            order = np.argsort(value)
            value, who = value[order], who[order]
            same = np.flatnonzero(value[1:] == value[:-1])
            a, b = who[same], who[same + 1]
            near = np.bitwise_count(fp[a].view(U64) ^ fp[b].view(U64)) <= RADIUS
            a, b = label[a[near]], label[b[near]]
            pair = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
            found = _components(pair // len(ids), pair % len(ids), len(ids))
            label = found[label]
        order = np.lexsort((ids, label))
        l, i = label[order], ids[order]
        chain = np.flatnonzero(l[1:] == l[:-1])
        return pa.table({"a": pa.array(i[chain], pa.int64()), "b": pa.array(i[chain + 1], pa.int64())})

    sent = points.select("id", "fp").mapInArrow(emit, "bucket long, id long, fp long, used byte")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _finish(table: pa.Table) -> pa.Table:
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return pa.table({"id": ids, "component": ids[_components(at[: len(a)], at[len(a) :], len(ids))]})


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """id and component (its smallest id) of every id in the links (a, b).

    While there are more than ``few`` links, a round contracts them: every node takes the first of itself and its
    neighbours in an order that is random anew each round, and the links between those remain; their nodes are a
    fraction of those before, whatever the shape. At most ``few`` links (32 MB)
    are finished in one task. Each round's results lie in the shared folder.
    """
    edges = cut(edges.filter("a <> b"), light=True)
    maps = []
    while edges.count() > few:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        to = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least(rank("a"), "m")["id"].alias("to")), light=True)
        maps.append(to)
        left = to.select(F.col("id").alias("a"), F.col("to").alias("x"))
        right = to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), light=True)
    last = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_finish, "id long, component long")
    if not maps:
        return last
    last = cut(last, light=True)
    out = maps[0].select("id", F.col("to").alias("component"))
    for to in [*maps[1:], last.withColumnRenamed("component", "to")]:
        at = to.select(F.col("id").alias("component"), "to")
        out = out.join(at, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    out = cut(out, light=True)
    least = out.groupBy("component").agg(F.min("id").alias("least"))
    return out.join(least, "component").select("id", F.col("least").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable over links.

    One row per row of ``docs``. A null doc_id takes the group of its fingerprint, where a row with a doc_id has the same, and
    else null. Empty tables give empty results; other columns are ignored.
    """
    marks = cut(fingerprints(docs))
    points = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("id")), light=True)
    named = points.filter("id IS NOT NULL")
    label = components(links(named, named.count()))
    # rows without any doc_id have no name to give: their fingerprint links to nothing
    group = points.join(label, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marks.join(group, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return near_duplicates(table(spark, sf_dir, "documents"))
