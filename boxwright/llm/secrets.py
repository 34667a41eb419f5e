r"""Secret scans: fixed patterns, and a token-efficiency test for other random strings.

A string of 20 or more characters from a secret's alphabet is random if a public byte-level vocabulary needs a token
for fewer than ``ratio`` characters: words and names compress, keys don't. Digests of known lengths, UUIDs and labelled
digests ("sha256-...=") are cut out of a run first, numbers and identifiers made of words excluded. Where a whole run isn't random, its parts between / = + _ - are
tested, adjacent random ones as one, so that a key behind a path is found.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "dense")
RATIO, LEAST = 1.9, 20
MASK = "[secret]"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24}")
_DENSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
#: A UUID (1), or a part between the separators of a run.
_PART = re.compile(r"((?<![0-9A-Za-z])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Za-z]))|[A-Za-z0-9]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\Z")
#: Lengths in hexadecimal digits of CRC-64 doubled, MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_SIZES = frozenset((32, 40, 56, 64, 96, 128))
#: What is known for no secret, wherever it stands in a run: labelled digests in base 64, UUIDs, digests in hexadecimal.
_KNOWN = re.compile(
    r"(?<![0-9A-Za-z])(?:"
    r"(?:md5-[A-Za-z0-9+/_-]{22}|sha1-[A-Za-z0-9+/_-]{27}|sha256-[A-Za-z0-9+/_-]{43}|sha384-[A-Za-z0-9+/_-]{64}|sha512-[A-Za-z0-9+/_-]{86})={0,2}"
    r"|[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
    r"|(?:[0-9a-f]{128}|[0-9a-f]{96}|[0-9a-f]{64}|[0-9a-f]{56}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{128}|[0-9A-F]{96}|[0-9A-F]{64}|[0-9A-F]{56}|[0-9A-F]{40}|[0-9A-F]{32})"
    r")(?![0-9A-Za-z])"
)
#: Characters that are encoded at once: the time of an encoding may grow with the square of a run's length.
PIECE = 2048
_NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|\d{1,4})(?:[_/-]+(?:[A-Z]?[a-z]+|[A-Z]+|\d{1,4}))*\Z")


def encoding(vocabulary: bytes):
    """The tiktoken encoding of a file of base64 tokens and ranks."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _dense(s: str, encode, ratio: float) -> bool:
    return len(s) < ratio * sum(len(encode(s[a : a + PIECE])) for a in range(0, len(s), PIECE))


def excluded(s: str, encode, ratio: float = RATIO) -> bool:
    """Digests of known sizes, UUIDs, numbers, and identifiers whose parts are words.

    Parts of up to three letters count as words; longer ones are words if together they compress, in lower case where
    they are capitals.
    """
    if _UUID.match(s) or not re.search(r"[A-Za-z]", s):
        return True
    if _DIGEST.match(s) and len(s) in _DIGEST_SIZES:
        return True
    if not _NAME.match(s):
        return False
    long = [w.lower() if w.isupper() else w for w in re.findall(r"[A-Za-z]{4,}", s)]
    tokens = sum(len(encode(w[a : a + PIECE])) for w in long for a in range(0, len(w), PIECE))
    return sum(map(len, long)) >= ratio * tokens


def _random(s: str, encode, ratio: float) -> Iterator[tuple[int, int]]:
    """(start, end) of the random strings in a run: all of it, or else the longest rows of random parts between its separators."""
    if len(s) < LEAST or excluded(s, encode, ratio):
        return
    if _dense(s, encode, ratio):
        yield 0, len(s)
        return
    rows, open_ = [], False
    for m in _PART.finditer(s):
        p = m[0]
        if not m[1] and _dense(p, encode, ratio) and not (len(p) >= LEAST and excluded(p, encode, ratio)):
            if open_:
                rows[-1] = (rows[-1][0], m.end())
            else:
                rows.append(m.span())
            open_ = True
        else:
            open_ = False
    for a, b in rows:
        if b - a >= LEAST and not excluded(s[a:b], encode, ratio) and _dense(s[a:b], encode, ratio):
            yield a, b


def scan(text: str, encode, ratio: float = RATIO) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of each secret in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_LONG.search(text):
        found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    base = sorted(found)
    reach = list(accumulate((e for _, e, _ in base), max))
    for m in _DENSE.finditer(text):
        edge = [0, *(x for k in _KNOWN.finditer(m[0]) for x in k.span()), len(m[0])]
        for x, y in zip(edge[::2], edge[1::2]):
            s = m[0][x:y].strip("-=_/+")
            at = m.start() + m[0].index(s, x)
            for a, b in _random(s, encode, ratio):
                i = bisect.bisect_left(base, (at + b,))  # those before it begin before the end
                if not i or reach[i - 1] <= at + a:
                    found.append((at + a, at + b, 3))
    return sorted(found)


def _vocabulary(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_dense.

    An assignment's span is its whole match. Base patterns are leftmost and non-overlapping per kind; dense spans are
    added where no base span is. Null reads as empty; empty texts and tables, repeated rows and further columns have
    their plain results. ``vocabulary`` is a tiktoken file on the driver, sent once (0.8 MB).
    """
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches):
        encode = encoding(sent.value).encode_ordinary
        for batch in batches:
            n, digest, all_, dense = ([], [], []), [], [], []
            for text in batch.column("text").to_pylist():
                spans = scan(text or "", encode, ratio)
                base = [s for s in spans if s[2] < 3]
                for k in range(3):
                    n[k].append(sum(s[2] == k for s in base))
                digest.append(hashlib.sha256(_text(base).encode()).hexdigest())
                all_.append(_text(spans))
                dense.append(len(spans) - len(base))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(all_, pa.string()), pa.array(dense, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_dense"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_dense long")


def redact(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """The same rows and columns, secrets replaced by a mark and n_chars, where it is an integer, counted anew where text changed."""
    counted = dict(docs.dtypes).get("n_chars") in ("int", "bigint")
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches):
        encode = encoding(sent.value).encode_ordinary
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if counted else None
            for i, text in enumerate(texts):
                spans = scan(text or "", encode, ratio)
                if spans:
                    out, end = [], 0
                    for a, b, _ in spans:
                        if a >= end:
                            out += [text[end:a], MASK]
                        end = max(end, b)
                    texts[i] = "".join(out) + text[end:]
                    if sizes:
                        sizes[i] = len(texts[i])
            for name, values in (("text", texts), ("n_chars", sizes)):
                if values is not None:
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return secrets(table(spark, sf_dir, "documents"))
