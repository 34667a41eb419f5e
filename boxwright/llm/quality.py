"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-proximal).

Tokens are runs of letters, of digits or of other visible characters; features are their hashed unigrams and bigrams
with the share of the text's tokens as value, so that long and short texts score alike. All pairs of a token with itself are one
feature, whatever the token. Weights are one vector of
2^18 floats (1 MB whatever the corpus), sent to every task, and a score is a sparse dot product.

The fit reads at most about ``sample`` labelled rows, chosen by a hash of doc_id; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm import _text as T

BITS, SAMPLE, EPOCHS = 18, 10_000, 4
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 1e-4, 1e-4, 24.0
U64 = np.uint64
#: 0 white space and controls, 1 letters and bytes from \x80 on, 2 digits, 3 the rest.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
_CLASS[128:] = 1
for _a, _b in ((65, 91), (97, 123)):
    _CLASS[_a:_b] = 1
_CLASS[48:58] = 2


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = _CLASS[buf]
    begin = np.empty(len(c), bool)
    begin[:1] = True
    begin[1:] = c[1:] != c[:-1]
    begin[offsets[:-1][offsets[:-1] < len(c)]] = True
    at = np.flatnonzero(begin)
    ends = np.r_[at[1:], len(c)]
    on = c[at] > 0 if len(at) else np.empty(0, bool)
    starts, ends = at[on], ends[on]
    return starts, ends, np.searchsorted(starts, offsets)


def features(column: pa.Array):
    """(first row, row after the last, offsets, feature of each token and pair, its share of the text) for each slice."""
    for lo, hi, buf, offsets in T.slices(column):
        starts, ends, first = _tokens(buf, offsets)
        (h,) = T.word_hashes(T.LOWER[buf], starts, ends, T.BASE_1)
        pair = T.whole(first, len(h), 2)
        two = np.where(h[1:] == h[:-1], U64(0), T.windows(h, 2, T.STEP_1))[pair] if len(h) > 1 else np.empty(0, U64)
        own = np.repeat(np.arange(hi - lo), np.diff(first))
        doc = np.concatenate([own, own[:-1][pair] if len(h) > 1 else own[:0]])
        index = (np.concatenate([h, two]) >> U64(64 - BITS)).astype(np.int32)
        n = np.bincount(doc, minlength=hi - lo)
        yield lo, hi, doc, index, (SCALE / np.maximum(n, 1))[doc]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights and, last, the bias, from labelled rows that aren't held out; zeros if there are none.

    ``labels`` may repeat a doc_id (its largest quality counts) and have nulls (ignored).
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("y"))
    n = known.count()
    span = 1 << 30
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * sample / n))
    # at most about `sample` rows of 12 bytes
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "text")

    def sparse(batches):
        for batch in batches:
            index, value = [], []
            for lo, hi, doc, i, v in features(batch.column("text")):
                order = np.lexsort((i, doc))
                d, i, v = doc[order], i[order], v[order]
                at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1])]) if len(d) else np.empty(0, np.int64)
                s = np.add.reduceat(v, at) if len(at) else np.empty(0)
                edge = np.searchsorted(d[at], np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    index.append(i[at[edge[k] : edge[k + 1]]].astype("<i4").tobytes())
                    value.append(s[edge[k] : edge[k + 1]].astype("<f4").tobytes())
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "y", "i", "v"])

    def learn(table: pa.Table) -> pa.Table:
        size = (1 << BITS) + 1
        z, n2, w = (np.zeros(size) for _ in range(3))
        rows = sorted(zip(table["doc_id"].to_pylist(), table["y"].to_pylist(), table["i"].to_pylist(), table["v"].to_pylist()), key=lambda r: ((r[0] * 0x9E3779B1) & 0xFFFFFFFF, r[2]))
        for _ in range(EPOCHS):
            for _, y, i, v in rows:
                i = np.r_[np.frombuffer(i, "<i4"), size - 1]
                v = np.r_[np.frombuffer(v, "<f4"), 1.0]
                l1 = np.full(len(i), L1)
                l1[-1] = 0
                w[i] = np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n2[i])) / ALPHA + L2))
                g = (1 / (1 + np.exp(-np.clip(w[i] @ v, -35, 35))) - (y > 0)) * v
                s = (np.sqrt(n2[i] + g * g) - np.sqrt(n2[i])) / ALPHA
                z[i] += g - s * w[i]
                n2[i] += g * g
        l1 = np.full(size, L1)
        l1[-1] = 0
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n2)) / ALPHA + L2))
        return pa.table({"w": [w.astype("<f4").tobytes()]})

    got = rows.mapInArrow(sparse, "doc_id long, y int, i binary, v binary").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "w binary").collect()
    return np.frombuffer(got[0].w, "<f4") if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; empty and null texts score by the bias alone.

    A null doc_id isn't held out; repeated rows each get their row; other columns are ignored; no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights, np.float32))

    def run(batches):
        w = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, float(w[-1]))
            for lo, hi, doc, index, value in features(batch.column("text")):
                out[lo:hi] += np.bincount(doc, w[index] * value, hi - lo)
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
