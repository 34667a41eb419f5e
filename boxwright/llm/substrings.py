"""Exact substring deduplication with fixed-block anchors.

Every window of 20 words holds a whole block of 10 words that starts at a multiple of 10, in its own document and in
any other that repeats it. So: (1) index the non-overlapping blocks and probe them with every rolling window of 10
words; (2) extend each hit to the windows of 20 words around it and find the earliest start of each by content; (3)
cover the words of all later windows, which joins them to maximal exact repeats.

Documents are dealt once, by a hash of doc_id, into groups of bounded text; Spark reuses that exchange. What crosses
the other shuffles are packed arrays, one entry for each distinct hash of a group: a passage that a third of all rows
hold counts once a group, no pair is ever made, and answers go back to groups, not to rows. Probes are filtered by
about 32 bits above the bucket's; windows are compared by 96 bits of two hashes of their words' bytes, under keys drawn
for each run, so that no text can be written to deceive them.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import _text as T
from boxwright.llm._spark import shuffle_partitions, text_bytes

WINDOW, BLOCK, GROUP_BYTES = 20, 10, 16 << 20
U64 = np.uint64
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def _ordered(table: pa.Table) -> pa.Table:
    """By doc_id, null first, then text: the order in which repeats count as earlier."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table["doc_id"].null_count == 0 else pa.concat_tables([table.filter(table["doc_id"].is_null()), table.filter(table["doc_id"].is_valid()).sort_by([("doc_id", "ascending"), ("text", "ascending")])])


def _runs(table: pa.Table, keys: tuple):
    """(first row, offsets, bytes, starts, ends, first words, hashes) for each slice of the table."""
    for lo, hi, buf, offsets in T.slices(table["text"]):
        starts, ends, first = T.words(buf, offsets)
        yield lo, hi, buf, starts, ends, first, T.word_hashes(buf, starts, ends, *keys)


def _packed(key, bucket: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row for each bucket, arrays as bytes; bucket must be ascending."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    ends = np.r_[at[1:], len(bucket)] if len(bucket) else at
    data = {"bucket": pa.array(bucket[at].astype(np.int64)), "g": pa.array(np.full(len(at), key, np.int64))}
    for i, c in enumerate(columns):
        data[f"c{i}"] = pa.array([c[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
    return pa.table(data)


def _cat(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def remove_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Removes every word covered by a 20-word window whose sequence also starts earlier (by doc_id, then position).

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space) and spans, the maximal
    removed runs as [first word, word after the last]. Null and empty texts have no words and the digest of the empty
    text. A null doc_id counts as earliest; rows of equal doc_id are ordered by a hash of their text, then by text, and
    each gets a row; they are dealt by both, so that many rows of one doc_id, or of none, aren't one group. An empty
    table gives an empty one; other columns are ignored.
    """
    one_key, two_key = (U64(secrets.randbits(64)) for _ in range(2))
    spark = docs.sparkSession
    size = text_bytes(docs)
    parts = shuffle_partitions(spark)
    groups = max(parts, -(-size // group_bytes))
    bits = max(3, int(np.ceil(np.log2(groups))))
    low = U64(32 - min(bits, 31))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g")).repartition(groups, "g")

    def probe(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Distinct 10-word windows of the group; flags: 1 occurs twice, 2 is a block."""
        hashes, blocks = [], []
        for *_, starts, _, first, (h,) in _runs(table, (one_key,)):
            ok = T.whole(first, len(h), BLOCK)
            if ok.any():
                own = np.repeat(first[:-1], np.diff(first))
                at = np.flatnonzero(ok)
                hashes.append(T.windows(h, BLOCK, T.STEP_1)[at])
                blocks.append((at - own[at]) % BLOCK == 0)
        if not hashes:
            return _packed(0, np.empty(0, np.int64), *(np.empty(0, t) for t in ("<u4", "u1")))
        v = (np.concatenate(hashes) >> low << U64(1)) | np.concatenate(blocks).astype(U64)
        del hashes, blocks
        v.sort()
        block, v = (v & U64(1)).astype(np.uint8), v >> U64(1)
        at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        n = np.diff(np.r_[at, len(v)])
        flags = (n > 1).astype(np.uint8) | np.maximum.reduceat(block, at) << 1
        v = v[at]
        return _packed(key[0].as_py(), v >> U64(32), (v & U64(0xFFFFFFFF)).astype("<u4"), flags.astype("u1"))

    def hits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The hashes of each group that meet a block elsewhere."""
        v, flags = _cat(table, "c0", "<u4"), _cat(table, "c1", "u1")
        sizes = np.array([len(x) // 4 for x in table["c0"].to_pylist()], np.int64)
        order = np.argsort(v, kind="stable")
        s = v[order]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        n, f = np.diff(np.r_[at, len(s)]), flags[order]
        good = ((n > 1) | (np.maximum.reduceat(f & 1, at) > 0)) & (np.maximum.reduceat(f & 2, at) > 0)
        hit = np.empty(len(v), bool)
        hit[order] = np.repeat(good, n)
        ends = np.cumsum(sizes)
        out = [v[b - m : b][hit[b - m : b]].tobytes() for b, m in zip(ends, sizes)]
        return pa.table({"bucket": table["bucket"], "g": table["g"], "c0": pa.array(out, pa.binary())}).filter(pa.array([len(x) > 0 for x in out], pa.bool_()))

    def candidates(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        """Distinct 20-word windows around the hits, with the first document that has each."""
        known = []
        for b, c in zip(answer["bucket"].to_pylist(), answer["c0"].to_pylist()):
            known.append(np.frombuffer(c, "<u4").astype(U64) | U64(b) << U64(32))
        known = np.sort(np.concatenate(known)) if known else np.empty(0, U64)
        one, two, doc = [], [], []
        table = _ordered(table)
        ids = table["doc_id"].fill_null(-(1 << 63)).to_numpy()
        for lo, *_, first, (h, h2) in _runs(table, (one_key, two_key)) if len(known) else ():
            ok = T.whole(first, len(h), WINDOW)
            if ok.any():
                mark = _found(known, T.windows(h, BLOCK, T.STEP_1) >> low)
                before = np.r_[0, np.cumsum(mark)]
                n = len(ok)
                at = np.flatnonzero(ok & (before[BLOCK + 1 : BLOCK + 1 + n] > before[:n]))
                one.append(T.windows(h, WINDOW, T.STEP_1, at))
                two.append(T.windows(h2, WINDOW, T.STEP_2, at).astype("<u4"))
                doc.append(ids[lo + np.searchsorted(first, at, "right") - 1])
        if not one:
            return _packed(0, np.empty(0, np.int64), *(np.empty(0, t) for t in ("<u8", "<u4", "<i8", "u1")))
        one, two, doc = np.concatenate(one), np.concatenate(two), np.concatenate(doc)
        order = np.lexsort((two, one))  # stable: the first document stays first
        one, two, doc = one[order], two[order], doc[order]
        at = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.empty(0, np.int64)
        n = np.diff(np.r_[at, len(one)])
        one, two, doc = one[at], two[at], doc[at]
        return _packed(key[0].as_py(), one >> U64(64 - bits), one, two, doc, (n > 1).astype("u1"))

    def earliest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """For each group its windows that occur earlier in another (1), or first but again in itself (2)."""
        one, two, doc, again = (_cat(table, f"c{i}", k) for i, k in enumerate(("<u8", "<u4", "<i8", "u1")))
        sizes = np.array([len(x) // 8 for x in table["c0"].to_pylist()], np.int64)
        # of one doc_id, the group decides
        dealt = np.repeat(table["g"].to_numpy(), sizes)
        order = np.lexsort((dealt, doc, two, one))
        a, b = one[order], two[order]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        head = np.zeros(len(one), bool)
        head[order[at]] = True
        code = np.where(head, 2 * again, 1).astype(np.uint8)
        ends, out = np.cumsum(sizes), []
        for e, m in zip(ends, sizes):
            k = code[e - m : e] > 0
            out.append([x[e - m : e][k].tobytes() for x in (one, two, code)])
        full = pa.array([len(x[0]) > 0 for x in out], pa.bool_())
        return pa.table({"bucket": table["bucket"], "g": table["g"], **{f"c{i}": pa.array([x[i] for x in out], pa.binary()) for i in range(3)}}).filter(full)

    def kept(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        one, two, code = (_cat(answer, f"c{i}", k) for i, k in enumerate(("<u8", "<u4", "u1")))
        order = np.lexsort((two, one))
        one, two, code = one[order], two[order], code[order]
        # where two windows share the first hash, the second tells them apart
        clash = {} if not len(one) else {(int(one[i]), int(two[i])): i for j in np.flatnonzero(one[1:] == one[:-1]) for i in (j, j + 1)}
        seen = np.zeros(len(one), bool)
        table = _ordered(table)
        ids, n_words, n_removed, digests, spans = table["doc_id"], [], [], [], []
        for lo, hi, buf, starts, ends, first, (h, h2) in _runs(table, (one_key, two_key)):
            gone = np.zeros(len(h), bool)
            ok = T.whole(first, len(h), WINDOW)
            if ok.any() and len(one):
                w = T.windows(h, WINDOW, T.STEP_1)
                at = np.flatnonzero(ok & _found(one, w))
                w2 = T.windows(h2, WINDOW, T.STEP_2, at).astype("<u4")
                i = np.searchsorted(one, w[at])
                for j in np.flatnonzero(np.isin(w[at], [k[0] for k in clash])) if clash else ():
                    i[j] = clash.get((int(w[at[j]]), int(w2[j])), i[j])
                good = two[i] == w2
                at, i = at[good], i[good]
                again = seen[i]
                _, head = np.unique(i, return_index=True)
                new = np.zeros(len(i), bool)
                new[head] = True
                drop = (code[i] == 1) | again | ~new
                seen[i] = True
                edge = np.zeros(len(h) + 1, np.int32)
                edge[at[drop]] += 1
                edge[at[drop] + WINDOW] -= 1
                gone = np.cumsum(edge[:-1]) > 0
            stay = ~gone
            out, begin = T.joined(buf, starts[stay], ends[stay])
            rank = np.r_[0, np.cumsum(stay)]
            begin = np.r_[begin, len(out)]
            raw = out.tobytes()
            for k in range(hi - lo):
                a, b = first[k], first[k + 1]
                x, y = rank[a], rank[b]
                n_words.append(b - a)
                n_removed.append((b - a) - (y - x))
                digests.append(hashlib.sha256(raw[begin[x] : begin[y] - 1] if y > x else b"").hexdigest())
                if y - x < b - a:
                    e = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False].astype(np.int8)))
                    spans.append(e.reshape(-1, 2).tolist())
                else:
                    spans.append([])
        return pa.Table.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, _OUT.field("spans").type)], schema=_OUT)

    packed = "bucket long, g long, "
    probes = rows.groupBy("g").applyInArrow(probe, packed + "c0 binary, c1 binary")
    answers = probes.groupBy("bucket").applyInArrow(hits, packed + "c0 binary")
    found = rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(candidates, packed + "c0 binary, c1 binary, c2 binary, c3 binary")
    first = found.groupBy("bucket").applyInArrow(earliest, packed + "c0 binary, c1 binary, c2 binary")
    return rows.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


#: A plain form of the same result: all windows by content, those after the first cover their words.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents
), v AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM v) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r
), g AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
