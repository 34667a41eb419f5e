"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies the likelihood of the text (hashed byte 4-grams), of the language that the row
declares (markup or metadata), of its address (country suffix, or first path segment), and a prior of its host that is
smoothed towards its domain's, and that towards the corpus's; the priors are grouped sums over all rows of what their
texts say. An undetermined class has every 4-gram equally likely: it wins for texts in no known language.

Declared codes count by their primary subtag of two or three letters in lower case ("fr-FR" is fr). Every code that a
row with text declares is a class. The likelihoods are fitted on about ``sample`` rows with a declared language, chosen
by a hash of distinct texts, and on more where a language would have under RARE of them; a language with fewer rows is fitted on all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm import _text as T
from boxwright.llm._spark import cut

BITS, SAMPLE, N = 14, 8_000, 4
#: Share of independent evidence in overlapping 4-grams.
TEMPER = 0.25
DECLARED, ADDRESS, STRENGTH, CONFIDENT, UNDETERMINED = 0.9, 0.8, 20.0, 0.5, 0.005
BROADCAST_BYTES, RARE = 64 << 20, 200
#: Parts that a host's rows are dealt to where the priors are too large to broadcast.
SALTS = 32
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SIZE = 1 << BITS


def _grams(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A feature for each byte; _SIZE where no 4-gram with letters starts."""
    b = _FOLD[buf]
    out = np.full(len(b), _SIZE, np.int32)
    n = len(b) - N + 1
    if n > 0:
        x = b.astype(np.uint32)
        h = x[:n] * np.uint32(0x9E3779B1) ^ x[1 : n + 1] * np.uint32(0x85EBCA77) ^ x[2 : n + 2] * np.uint32(0xC2B2AE3D) ^ x[3 : n + 3] * np.uint32(0x27D4EB2F)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x2C1B3C6D)
        blank = b == 32
        many = blank[:n].astype(np.int8) + blank[1 : n + 1] + blank[2 : n + 2] + blank[3 : n + 3]
        out[:n] = np.where(many < 3, (h >> np.uint32(32 - BITS)).astype(np.int32), _SIZE)
        for k in range(1, N):
            at = offsets[1:] - k
            out[at[at >= 0]] = _SIZE
    return out


def code(declared: Column) -> Column:
    """The primary subtag of a declared language, in lower case; null for other strings."""
    found = F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    return F.when(found != "", found)


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each feature (and of none) for each, last the undetermined class.

    ``rows`` has text and declared. Codes are of three letters at most, so what the driver gets is bounded: a count for
    each code, and then compressed counts of its features.
    """
    known = rows.filter("text IS NOT NULL").select(code(F.col("declared")).alias("declared"), "text").filter("declared IS NOT NULL")
    n = {r.declared: r["count"] for r in known.groupBy("declared").count().collect()}
    if not n:
        return [], np.full((1, _SIZE + 1), -np.log(_SIZE) - 0.2, np.float32)
    share = sample / sum(n.values())
    span = 1 << 30
    # by language, so that the rare are fitted too
    bound = known.sparkSession.createDataFrame([(k, int(span * min(1.0, max(share, RARE / x)))) for k, x in n.items()], "declared string, bound long")
    known = known.join(F.broadcast(bound), "declared").filter(F.pmod(F.xxhash64("text"), F.lit(span)) < F.col("bound")).select("declared", "text").distinct()

    def packed(x: np.ndarray) -> bytes:
        return zstandard.compress(x.astype("<f4").tobytes(), 1)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("declared").to_pylist()
            for lo, hi, buf, offsets in T.slices(batch.column("text")):
                g = _grams(buf, offsets)
                for k in range(hi - lo):
                    x = np.bincount(g[offsets[k] : offsets[k + 1]], minlength=_SIZE + 1)
                    # a root of the count: one text's repeats don't rule
                    total[names[lo + k]] = total.get(names[lo + k], 0) + np.sqrt(x)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([packed(x) for x in total.values()], pa.binary())], names=["lang", "n"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # in a fixed order, so that sums of floats don't depend on who came first
        return pa.table({"lang": [key[0].as_py()], "n": [packed(sum(np.frombuffer(zstandard.decompress(x), "<f4").astype(np.float64) for x in sorted(table["n"].to_pylist())))]})

    got = sorted((r.lang, np.frombuffer(zstandard.decompress(r.n), "<f4").astype(np.float64)) for r in known.mapInArrow(count, "lang string, n binary").groupBy("lang").applyInArrow(add, "lang string, n binary").collect())
    got = [(k, x) for k, x in got if x[:-1].sum() > 0]
    w = np.zeros((len(got) + 1, _SIZE + 1), np.float32)
    for i, (_, x) in enumerate(got):
        w[i, :-1] = np.log(0.8 * x[:-1] / x[:-1].sum() + 0.2 / _SIZE)  # a fifth of a text may be anything
    w[-1, :-1] = -np.log(_SIZE) - 0.2
    return [k for k, _ in got], w


def evidence(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` with ``ll``: the tempered log-likelihood of the text in each language and, last, undetermined; null without letters."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = sent.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(w)))
            letters = np.zeros(batch.num_rows, bool)
            for lo, hi, buf, offsets in T.slices(batch.column("text")):
                if not len(buf):
                    continue
                g = _grams(buf, offsets)
                full = np.flatnonzero(offsets[1:] > offsets[:-1])
                at = offsets[:-1][full]
                letters[lo + full] = np.maximum.reduceat(_FOLD[buf] != 32, at)
                for k in range(len(w)):
                    out[lo + full, k] = np.add.reduceat(w[k][g].astype(np.float64), at)
            ll = pa.array([x.tolist() if m else None for x, m in zip(TEMPER * out, letters)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ll], names=[*batch.schema.names, "ll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ll array<double>"
    return rows.mapInArrow(run, schema)


def _domain(host: Column) -> Column:
    """The last two labels of a host name; other names are their own."""
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)


def priors(rows: DataFrame, langs: list[str], strength: float = STRENGTH) -> DataFrame:
    """host and prior (array over langs): grouped sums of what texts say, smoothed host to domain to corpus.

    The counts of a host are summed before they are shuffled, however many rows it has. ``rows`` has host and ll.
    """
    k = len(langs)
    best = F.array_position(F.slice("ll", 1, k), F.array_max(F.slice("ll", 1, k)))
    counts = rows.filter("host IS NOT NULL AND ll IS NOT NULL").withColumn("b", best).groupBy("host").agg(*[F.sum((F.col("b") == i + 1).cast("double")).alias(f"n{i}") for i in range(k)])
    # one row a host: texts are read once for it, whatever follows
    counts = cut(counts, light=True).withColumn("domain", _domain(F.col("host")))
    by = counts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(k)])
    total = by.agg(*[F.sum(f"d{i}").alias(f"t{i}") for i in range(k)]).first()
    t = [float(x or 0) for x in total] if total else [0.0] * k
    g = [(x + 1) / (sum(t) + k) for x in t]
    d = sum((F.col(f"d{i}") for i in range(k)), F.lit(0.0))
    n = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
    domain = [(F.col(f"d{i}") + strength * g[i]) / (d + strength) for i in range(k)]
    host = [(F.col(f"n{i}") + strength * domain[i]) / (n + strength) for i in range(k)]
    return counts.join(by, "domain").select("host", F.array(*host).alias("prior"))


def identify(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``rows`` with lang_id, confidence and rejected.

    ``rows`` has text, declared, host and address (a language code found in the address), any of them null. A row is
    rejected if it has no letters to judge, if undetermined is likeliest, or if no language has a posterior of
    CONFIDENT; lang_id is then null. Ties go to the first code. No rows give none; repeated rows are alike; further
    columns are carried. Texts are read three times: for the fit's sample, for the priors, and for the result.
    """
    langs, weights = fit(rows, sample)
    k = len(langs)
    if not k:
        return rows.withColumns({"lang_id": F.lit(None).cast("string"), "confidence": F.lit(0.0), "rejected": F.lit(True)})
    prior = priors(evidence(rows.select("text", "host"), weights).select("host", "ll"), langs)
    size = prior.agg(F.sum(F.octet_length("host") + 8 * k + 64)).first()[0] or 0
    scored = evidence(rows, weights)
    if size <= BROADCAST_BYTES:
        scored = scored.join(F.broadcast(prior), "host", "left")
    else:  # a host's rows are dealt to several tasks
        prior = prior.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        scored = scored.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(prior, ["host", "_salt"], "left")

    def told(name: str, lang: str, sure: float) -> Column:
        c = code(F.col(name))
        return F.when(c.isNull() | ~c.isin(langs), 0.0).when(c == lang, float(np.log(sure))).otherwise(float(np.log((1 - sure) / max(1, k - 1))))

    logs = [F.col("ll")[i] + F.log(F.coalesce(F.col("prior")[i], F.lit(1.0 / k))) + told("declared", x, DECLARED) + told("address", x, ADDRESS) for i, x in enumerate(langs)]
    logs.append(F.col("ll")[k] + float(np.log(UNDETERMINED)))
    top = F.array_max("logs")
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    at = F.array_position("logs", top)
    out = scored.withColumn("logs", F.when(F.col("ll").isNotNull(), F.array(*logs))).withColumn("at", at).withColumn("confidence", F.coalesce(1 / total, F.lit(0.0)))
    out = out.withColumn("rejected", F.coalesce((F.col("at") > k) | (F.col("confidence") < CONFIDENT), F.lit(True)))
    out = out.withColumn("lang_id", F.when(~F.col("rejected"), F.get(F.array(*map(F.lit, langs)), (F.col("at") - 1).cast("int"))))
    return out.select(*rows.columns, "lang_id", "confidence", "rejected")


def document_rows(docs: DataFrame, *carry: str) -> DataFrame:
    """Evidence of a document: its text, lang as declared, source as host, and the country suffix where that has one."""
    host = F.col("source").cast("string")
    suffix = F.regexp_extract(F.lower(host), r"\.([a-z]{2})$", 1)
    return docs.select(*carry, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), host.alias("host"), F.when(suffix != "", suffix).alias("address"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of a page: visible text, html's lang attribute, host name, and country suffix or first path segment."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/?#:]+)", 1))
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z_-]{2,})", 1)
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", "url", bare.alias("text"), blank(declared).alias("declared"), blank(host).alias("host"), F.coalesce(blank(path), blank(suffix)).alias("address"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with its columns."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    carried = docs.select(*[F.col(c).alias(x) for c, x in names.items()], "text", "lang", "source")
    return identify(document_rows(carried, *names.values())).filter(~F.col("rejected")).select(*[F.col(x).alias(c) for c, x in names.items()])


def op5_language(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    docs = table(spark, sf_dir, "documents")
    return identify(document_rows(docs, "doc_id")).select("doc_id", "lang_id", "confidence", "rejected")


def pages_language(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return identify(page_rows(table(spark, sf_dir, "pages"))).select("page_id", "url", "lang_id", "confidence", "rejected")
