"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut at places that no piece spans. The distinct cuts ("words") of the corpus form a lattice: their
substrings of at most a piece's length are exploded, equi-joined to the piece table, and grouped by word. A fold of
Spark's higher-order functions then picks the path: Viterbi over the scores for unigram models, and for BPE models
the replay of merges (best score first, leftmost on ties), as Viterbi doesn't give a BPE model's segmentation.

A BPE word of over WIDE characters goes through the lattice in overlapping windows, joined where two of them share a
token. That is exact: merges inside one token don't depend on what lies beyond its neighbours, so a row of tokens is
the encoding of its text if each two neighbours are the encoding of theirs. Windows without a shared token (long runs
of one letter) are encoded by a merge heap.

Documents aren't shuffled as rows of words: a group of documents becomes compressed codes and, by bucket, packed
requests for its distinct words, both rows of one exchange that the three later steps read; answers are packed as
well. A frequent word counts once a group.
"""

from __future__ import annotations

import bisect
import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm._spark import shuffle_partitions, text_bytes

SPACE = "▁"
#: Text of a group, text of a shuffle partition, and the longest BPE word (and the distance of windows) of the fold.
GROUP_BYTES, PART_BYTES, WIDE, STRIDE = 12 << 20, 32 << 20, 48, 24


class Model:
    """Pieces, scores and specials of a .model file."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = sp.get_piece_size()
        self.bpe = spec.trainer_spec.model_type == 2
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        if spec.normalizer_spec.name != "identity" or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without normalisation are supported")
        self.unknown = sp.unk_id()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = [(x, i, float(sp.get_score(i))) for i, x in enumerate(self.names) if not special[i]]
        self.longest = max((len(x) for x, _, _ in self.pieces), default=1)
        self.ids = {x: i for x, i, _ in self.pieces}
        self.score = {x: s for x, _, s in self.pieces}
        #: Score of a character without a piece, in unigram models.
        self.low = min(self.score.values(), default=0.0) - 10.0
        self.silent = frozenset(i for i in range(n) if sp.is_control(i))
        self.late = frozenset(i for _, i in _late(self.pieces)) if self.bpe else frozenset()
        # a cut is safe between two characters unless the first has a follower, and the second a leader, in some piece
        after = {x[k] for x, _, _ in self.pieces for k in range(1, len(x))} - {SPACE}
        before = {x[k] for x, _, _ in self.pieces for k in range(len(x) - 1)} - {SPACE}
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x, _, _ in self.pieces):
            raise ValueError("a piece goes on after a word")
        kind = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"
        both, last, first = kind(after & before), kind(after - before), kind(before - after)
        self.cut = re.compile(f"(?:{SPACE}+|{first}){both}*{last}?|{both}+{last}?|{last}|.", re.S)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        s = text.replace(" ", SPACE)
        return self.cut.findall(SPACE + s if self.prefix else s)


def _late(pieces: list[tuple[str, int, float]]) -> list[tuple[str, int]]:
    """Pieces whose own better merges don't leave exactly two parts.

    What is inside two cuts evolves alone until one of them goes. So any other piece, when its turn comes in the order
    of scores, can be merged then or never, and one pass in that order replays a word without late pieces.
    """
    cost = {x: -s for x, _, s in pieces}
    found = []
    for x, i, s in pieces:
        n = len(x)
        spans = ((cost.get(x[a:b]), a, b) for a in range(n) for b in range(a + 2, n + 1))
        better = sorted(e for e in spans if e[0] is not None and e[0] < -s)
        cuts, on = (1 << (n + 1)) - 1, n > 1
        while on:
            for _, a, b in better:
                ends, inner = (1 << a) | (1 << b), (1 << b) - (1 << (a + 1))
                if cuts & ends == ends and (cuts & inner).bit_count() == 1:
                    cuts &= ~inner
                    break
            else:
                on = False
        if n > 1 and (cuts & ((1 << n) - 2)).bit_count() != 1:
            found.append((x, i))
    return found


def merged(model: Model, word: str) -> list[int]:
    """Ends of the tokens of a BPE word, by a heap of merges."""
    n, score = len(word), model.score
    after, before, alive, end = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, list(range(1, n + 1))
    heap: list = []

    def offer(a):
        b = after[a]
        if b < n and (got := score.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (-got, a, end[b], b))

    for a in range(n):
        offer(a)
    while heap:
        _, a, e, b = heapq.heappop(heap)
        if not alive[a] or after[a] != b or b >= n or not alive[b] or end[b] != e:
            continue
        alive[b], end[a], after[a] = False, e, after[b]
        if after[b] < n:
            before[after[b]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [e for e, on in zip(end, alive) if on]


def viterbi(model: Model, word: str) -> list[int]:
    """Ends of the tokens of a unigram word, in the library's single precision; of equal paths the longest last token."""
    best: list = [(np.float32(0), 0)]
    for e in range(1, len(word) + 1):
        ways = []
        for b in range(max(0, e - model.longest), e):
            s = model.score.get(word[b:e], model.low if e - b == 1 else None)
            if s is not None:
                ways.append((best[b][0] + np.float32(s), -b))
        top = max(ways)
        best.append((top[0], -top[1]))
    out, e = [], len(word)
    while e:
        out.append(e)
        e = best[e][1]
    return out[::-1]


def windows(word: str) -> list[str]:
    """The windows of a word that is too wide for the fold; the last one is shorter."""
    return [word[a : a + WIDE] for a in range(0, len(word) - WIDE + STRIDE, STRIDE)]


def spliced(parts: list[list[int]]) -> list[int] | None:
    """Ends of a word's tokens from those of its windows; None where two windows share no token."""
    out = list(parts[0])
    for k in range(1, len(parts)):
        at = k * STRIDE
        tail = bisect.bisect_left(out, at)
        known = {t: i for i, t in enumerate(zip(out[tail:], out[tail + 1 :]), tail + 1)}
        here = [0, *parts[k]]
        shared = next((i for i in range(1, len(here)) if (here[i - 1] + at, here[i] + at) in known), None)
        if shared is None:
            return None
        del out[known[here[shared - 1] + at, here[shared] + at] + 1 :]
        out += [e + at for e in here[shared + 1 :]]
    return out


def _ends(cuts: int, n: int) -> list[int]:
    """Places of the bits above the lowest, up to n."""
    return [i for i, c in enumerate(bin(cuts & ((2 << n) - 1))[:1:-1]) if c == "1"][1:]


def _tokens(model: Model, word: str, ends: list[int]) -> list[int]:
    get, out, a = model.ids.get, [], 0
    for b in ends:
        i = get(word[a:b])
        if i is not None:
            out.append(i)
        elif model.byte:
            out += [model.byte[x] for x in word[a:b].encode()]
        else:
            out.append(model.unknown)
        a = b
    return out


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftleft", x, k)


def encode_words(words: DataFrame, model: Model, partitions: int) -> DataFrame:
    """key and path of the ``words`` (key, word; keys distinct, words not empty) by lattice and fold.

    A path of a BPE model is a long whose bits are the tokens' bounds (words are at most WIDE long; one without any
    edge has no row, and is cut everywhere); of a unigram model it is the array of the tokens' ends.
    """
    spark, n, least = words.sparkSession, F.length("word"), 2 if model.bpe else 1
    rows = words.repartition(partitions, "key").filter(n >= least)
    starts = rows.select("key", "word", F.explode(F.sequence(F.lit(0), n - least)).alias("a"))
    spans = starts.select("key", "word", "a", F.explode(F.sequence(F.col("a") + least, F.least(n, F.col("a") + model.longest))).alias("b"))
    spans = spans.select("key", "a", "b", F.substring(F.col("word"), F.col("a") + 1, F.col("b") - F.col("a")).alias("piece"))
    # the vocabulary is a file of fixed size
    if not model.bpe:
        pieces = spark.createDataFrame([(x, s) for x, _, s in model.pieces], "piece string, score float")
        edges = spans.join(F.broadcast(pieces), "piece", "left").filter("score IS NOT NULL OR b = a + 1")
        return _viterbi(edges.withColumn("score", F.coalesce("score", F.lit(model.low).cast("float"))))
    rank = {s: i for i, s in enumerate(sorted({s for _, _, s in model.pieces}, reverse=True))}
    pieces = spark.createDataFrame([(x, (rank[s] << 13) | (i in model.late)) for x, i, s in model.pieces], "piece string, cost long")
    # rank, start and end of an edge and whether its word needs all passes, in one long that sorts by them
    edge = F.col("cost") + _shift(F.col("a").cast("long"), F.lit(7)) + _shift(F.col("b").cast("long"), F.lit(1))
    lattice = spans.join(F.broadcast(pieces), "piece").select("key", edge.alias("e")).groupBy("key").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    return _replay(lattice)


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _replay(lattice: DataFrame) -> DataFrame:
    """Path of a BPE model: a cut between all characters, then the best merge of two neighbours, step by step.

    The cuts are the bits of a long. An edge is such a merge while its ends are cuts and one cut is inside. Words
    without late pieces take one pass over the edges by score, which does the same merges.
    """
    one, full = F.lit(1).cast("long"), F.lit((1 << 62) - 1)

    def inner(e: Column) -> Column:
        a, b = (F.shiftright(e, k).bitwiseAND(63).cast("int") for k in (7, 1))
        return _shift(one, b) - _shift(one, a + 1)

    def fit(cuts: Column, e: Column) -> Column:
        a, b = (F.shiftright(e, k).bitwiseAND(63).cast("int") for k in (7, 1))
        return (F.bit_count(cuts.bitwiseAND(_shift(one, b + 1) - _shift(one, a))) == 3) & (F.bit_count(cuts.bitwiseAND(inner(e))) == 1)

    def once(cuts: Column, e: Column) -> Column:
        return F.when(fit(cuts, e), cuts.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(cuts)

    def merge(cuts: Column, _: Column) -> Column:
        first = F.get(F.filter("edges", lambda e: fit(cuts, e)), F.lit(0))
        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(inner(first), F.lit(0).cast("long"))))

    late = F.exists("edges", lambda e: e.bitwiseAND(1) == 1)
    # no word of at most WIDE characters takes as many merges
    steps = F.sequence(F.lit(1), F.least(F.size("edges"), F.lit(WIDE)))
    return lattice.select("key", F.when(late, F.aggregate(steps, full, merge)).otherwise(F.aggregate("edges", full, once)).alias("path"))


def _viterbi(edges: DataFrame) -> DataFrame:
    """Path of a unigram model: the best score of the edges; of equal ones the longest last edge."""
    by_end = edges.groupBy("key", "b").agg(F.collect_list(F.struct("a", "score")).alias("ways"))
    lattice = by_end.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("b", "ways"))).alias("ends"))

    def step(s: Column, e: Column) -> Column:
        ways = F.transform(e["ways"], lambda w: F.struct((F.get(s["best"], w["a"]) + w["score"]).alias("score"), (-w["a"]).alias("a")))
        grow = lambda top: F.struct(F.concat(s["best"], F.array(top["score"])).alias("best"), F.concat(s["back"], F.array(-top["a"])).alias("back"))
        return _bound(F.array_max(ways), grow)

    start = F.struct(F.array(F.lit(0.0).cast("float")).alias("best"), F.array(F.lit(0)).alias("back"))
    done = lattice.select("key", F.aggregate("ends", start, step, lambda s: s["back"]).alias("back"))
    n = F.size("back") - 1

    def step_back(s: Column, _: Column) -> Column:
        return F.when(s["at"] == 0, s).otherwise(F.struct(F.get("back", s["at"]).alias("at"), F.concat(F.array(s["at"]), s["path"]).alias("path")))

    none = F.struct(n.alias("at"), F.array().cast("array<int>").alias("path"))
    return done.select("key", F.aggregate(F.sequence(F.lit(1), n), none, step_back, lambda s: s["path"]).alias("path"))


def _planes(x: np.ndarray) -> bytes:
    """The four bytes of each number, all lowest first."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.compress(np.array([len(words)], "<u4").tobytes() + _planes(sizes) + "".join(words).encode(), 3)


def _unpack_words(data: bytes) -> list[str]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(_numbers(raw, n, 4), dtype=np.int64).tolist()
    text = raw[4 + 4 * n :].decode()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _decoded(ids: list[int], names: list[str], byte: dict[int, int], silent: frozenset) -> str:
    out, raw = [], bytearray()
    for i in ids:
        if i in byte:
            raw.append(byte[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        if i not in silent:
            out.append(names[i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    return "".join(out)


class _Codes(dict):
    """Numbers words by their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def encode(docs: DataFrame, model: Model | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array of int), round_trip (decoding gives the normalised text back).

    Null and empty texts have no ids. Rows of equal or null doc_id each get theirs; no rows give none; other columns
    are ignored. Groups are told apart by partition, number and content: should a lost executor's partition come again
    with other rows, the job fails rather than mix them up.
    """
    spark: SparkSession = docs.sparkSession
    model = model or Model()
    size = text_bytes(docs)
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    buckets = max(parts, -(-size // group_bytes))
    sent = spark.sparkContext.broadcast(model)
    windowed = model.bpe and model.longest <= STRIDE
    fold = WIDE if model.bpe else 1 << 31
    kinds = {"to": pa.int64(), "check": pa.int64(), "g": pa.int64(), "blob": pa.binary(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "order": pa.binary()}

    def group(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of one group: its documents' codes (to is below zero), and the words it asks of each bucket."""
        cut, code = sent.value.words, _Codes()
        each = []
        for text in texts:
            w = cut(text)
            each.append(np.fromiter(map(code.__getitem__, w), np.int32, len(w)))
        names = list(code)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        blob = zstandard.compress(_planes(np.concatenate(each)), 3)
        order = zstandard.compress(_planes(bucket), 3)
        check = xxhash.xxh64_intdigest(order, xxhash.xxh64_intdigest(blob) & 0xFFFFFFFF) >> 1
        by = np.argsort(bucket, kind="stable")
        to = bucket[by]
        at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
        asked = [_pack_words([names[i] for i in by[x:y].tolist()]) for x, y in zip(at, [*at[1:], len(to)])]
        g, n = -1 - ((TaskContext.get().partitionId() << 32) | number), len(asked)
        rows = {"to": [g, *to[at].tolist()], "check": [check] * (n + 1), "g": [g] * (n + 1), "blob": [blob, *asked], "ids": [ids] + [None] * n, "sizes": [[len(x) for x in each]] + [None] * n, "order": [order] + [None] * n}
        return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))

    def pack(batches):
        ids, texts, held, number = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= group_bytes:
                    yield group(number, ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield group(number, ids, texts)

    def lattice_words(blobs: list[bytes]) -> tuple[list[list[str]], list[str]]:
        """The words of each request, and what the lattice has to know for them, in order."""
        each = [_unpack_words(x) for x in blobs]
        all_ = set().union(*each)
        wide = {w for w in all_ if len(w) > fold}
        all_ -= wide
        if windowed:
            for w in wide:
                all_.update(windows(w))
        return each, sorted(all_)

    def distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        words = lattice_words(table["blob"].to_pylist())[1] if bucket >= 0 else []
        return pa.table({"key": pa.array((max(bucket, 0) << 32) + np.arange(len(words), dtype=np.int64)), "word": pa.array(words, pa.string())})

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if key[0].as_py() >= 0:
            m = sent.value
            byte = {i: b for b, i in m.byte.items()}
            each, words = lattice_words(asked["blob"].to_pylist())
            path: list = [-1] * len(words)
            for i, p in zip((known["key"].to_numpy() & 0xFFFFFFFF).tolist(), known["path"].to_pylist()):
                path[i] = p
            ends = {w: _ends(p, len(w)) if m.bpe else p for w, p in zip(words, path)}
            del words, path
            wide = {w for x in each for w in x if len(w) > fold}
            for w in wide:
                got = spliced([ends[x] for x in windows(w)]) if windowed else None
                ends[w] = merged(m, w) if got is None else got
            place, sizes, good, flat = _Codes(), [], [], []
            for w, e in ends.items():
                ids = _tokens(m, w, e)
                place[w]
                sizes.append(len(ids))
                good.append(_decoded(ids, m.names, byte, m.silent) == w)
                flat += ids
            del ends
            n, good, flat = np.array(sizes, np.int64), np.array(good, np.uint8), np.array(flat, np.int64)
            begin = np.cumsum(n) - n
            for w in each:
                i = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
                k = n[i]
                take = np.arange(int(k.sum())) + np.repeat(begin[i] - (np.cumsum(k) - k), k)
                out.append(zstandard.compress(_planes(k) + good[i].tobytes() + _planes(flat[take]), 3))
        else:
            asked = asked.slice(0, 0)
        return pa.table({"g": asked["g"], "bucket": asked["to"], "check": asked["check"], "words": pa.array([len(w) for w in each] if out else [], pa.int64()), "blob": pa.array(out, pa.binary())})

    def assemble(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
        if key[0].as_py() >= 0:
            return schema.empty_table()
        m, mine = sent.value, table["check"].to_pylist()
        if len(mine) != 1 or set(answers["check"].to_pylist()) - set(mine):
            raise RuntimeError("a group's rows changed between two readings of its partition")
        sizes, good, flat = [np.empty(0, np.int64)], [np.empty(0, np.uint8)], [np.empty(0, np.uint32)]
        for _, n, blob in sorted(zip(answers["bucket"].to_pylist(), answers["words"].to_pylist(), answers["blob"].to_pylist())):
            raw = zstandard.decompress(blob)
            sizes.append(_numbers(raw, n).astype(np.int64))
            good.append(np.frombuffer(raw, np.uint8, n, 4 * n))
            flat.append(_numbers(raw, (len(raw) - 5 * n) // 4, 5 * n))
        del answers
        n, good, flat = np.concatenate(sizes), np.concatenate(good) > 0, np.concatenate(flat)
        bucket = zstandard.decompress(table["order"][0].as_py())
        bucket = _numbers(bucket, len(bucket) // 4)
        if len(bucket) != len(n):
            raise RuntimeError("a group lacks answers")
        place = np.empty(len(n), np.int64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(n))
        begin = (np.cumsum(n) - n)[place]
        n, good = n[place], good[place]
        raw = zstandard.decompress(table["blob"][0].as_py())
        codes = _numbers(raw, len(raw) // 4)
        edge = np.r_[0, np.cumsum(table["sizes"][0].as_py())].astype(np.int64)
        ids = table["ids"][0].as_py()
        out = []
        for lo in range(0, len(ids), 256):
            hi = min(len(ids), lo + 256)
            c = codes[edge[lo] : edge[hi]]
            k = n[c]
            ends = np.cumsum(k)
            tokens = flat[np.arange(int(k.sum())) + np.repeat(begin[c] - (ends - k), k)].astype(np.int32)
            cum = np.r_[0, ends][edge[lo : hi + 1] - edge[lo]]
            bad = np.r_[0, np.cumsum(~good[c])][edge[lo : hi + 1] - edge[lo]]
            if not m.byte and len(tokens):  # the library makes a run of unknown characters one
                head = np.zeros(len(tokens), bool)
                head[cum[:-1][cum[:-1] < len(tokens)]] = True
                keep = np.r_[True, (tokens[1:] != m.unknown) | (tokens[:-1] != m.unknown)] | head
                tokens, cum = tokens[keep], np.r_[0, np.cumsum(keep)][cum]
            lists = pa.ListArray.from_arrays(pa.array(cum, pa.int32()), pa.array(tokens))
            out.append(pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(np.diff(cum)), lists, pa.array(np.diff(bad) == 0)], schema=schema))
        return pa.Table.from_batches(out, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = rows.mapInArrow(pack, "to long, check long, g long, blob binary, ids array<long>, sizes array<int>, order binary").repartition(parts, "to")
    words = both.groupBy("to").applyInArrow(distinct, "key long, word string")
    known = encode_words(words, model, parts).withColumn("bucket", F.shiftright("key", 32))
    kind = "long" if model.bpe else "array<int>"
    known = known.select("bucket", "key", F.col("path").cast(kind).alias("path"))
    answers = both.groupBy("to").cogroup(known.groupBy("bucket")).applyInArrow(answer, "g long, bucket long, check long, words long, blob binary")
    return both.groupBy("to").cogroup(answers.groupBy("g")).applyInArrow(assemble, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``tokens`` (doc_id, ids): doc_id and text. Null and empty ids give an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(model or Model())

    def run(batches):
        m = sent.value
        byte = {i: b for b, i in m.byte.items()}
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                text = _decoded(ids or [], m.names, byte, m.silent)
                out.append((text[1:] if m.prefix and text.startswith(SPACE) else text).replace(SPACE, " "))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return encode(table(spark, sf_dir, "documents"))
