"""The corpus operators against brute force, on small fixtures with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from boxwright.llm import decontaminate, digests, html, language, pieces, quality, secrets, simhash, substrings, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g int, bucket int, fp int"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2, 3) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    out = [(i, " ".join(random.choices(vocabulary, k=random.randrange(90)))) for i in range(25)]
    long = " ".join(random.choices(vocabulary, k=70))
    out += [(30, long), (31, "x y " + long), (32, long + " " + long), (33, None), (34, ""), (35, " \n\t"), (36, "é Ä " * 30), (37, long.upper())]
    return out


def test_substrings(spark, texts):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, texts), group_bytes=500).collect()}
    seen = set()
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert sum(b - a for a, b in got[i].spans) == len(gone)


def test_substrings_compares_words_not_polynomials(spark):
    """Words of 1,024 letters in the order of Thue and Morse: equal under any polynomial hash modulo 2**64."""
    one = "".join("ab"[n.bit_count() & 1] for n in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = [f"v{i}" for i in range(24)]
    rows = [(1, " ".join([*rest[:12], one, *rest[12:]])), (2, " ".join([*rest[:12], two, *rest[12:]])), (3, " ".join([*rest[:12], one, *rest[12:]]))]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 25}


def test_substrings_of_equal_and_null_ids(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(50)}" for _ in range(30))
    rows = [(None, f"{i} {passage} {i}") for i in range(40)] + [(7, f"{passage} tail{i}") for i in range(20)] + [(7, "short"), (None, None)]
    got = substrings.remove_repeats(docs(spark, rows).repartition(5), group_bytes=100).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    # one row without an id has the first occurrence; all others lose the passage
    assert sorted(r.n_removed for r in got) == [0, 0, 0] + [30] * 59
    assert [r.n_removed for r in got if r.doc_id == 7 and r.n_words > 1] == [30] * 20


def test_simhash(spark, texts):
    import numpy as np
    import xxhash

    more = [*texts, (None, texts[0][1]), (40, texts[0][1])]
    fp = {}
    for i, t in more:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, more)).collect()}
    ids = sorted(i for i in fp if i is not None)
    part = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if np.bitwise_count(np.uint64(fp[a] ^ fp[b])) <= 4:
                    part[a] = part[b] = min(part[a], part[b])
    for i in ids:
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp[i]:016x}", part[i])
    assert got[None].component_id == 0


def test_components_by_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    for few in (10**6, 20):
        got = {r.id: r.component for r in simhash.components(edges, few).collect()}
        assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, "!!"), (5, item.upper()), (6, "solo")], "item_id long, text string")
    rows = [(0, f"x {item.lower()}, y"), (1, "x one... TWO x"), (2, None), (3, ""), (4, "beta gamma delta epsilon zeta eta theta iota kappa lambda nu"), (5, "solo one solo"), (6, "alpha beta gamma")]
    for limit in (1 << 26, -1):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in decontaminate.mark(docs(spark, rows), bench, limit).collect()}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[0] == (14, 12, 2, True, sha("1,5"))
        assert got[1] == (4, 2, 1, True, sha("2"))
        assert got[2] == got[3] == (0, 0, 0, False, sha(""))
        assert got[4] == (11, 10, 2, True, sha("1,5"))
        assert got[5] == (3, 2, 1, True, sha("6"))
        assert got[6] == (3, 0, 0, False, sha(""))


def test_decontamination_by_brute_force(spark):
    """Random texts over few words against items of all lengths; null and repeated ids, ties and one very long text."""
    rng = random.Random(8)
    word = lambda n: [rng.choice("abc") + rng.choice("xy") for _ in range(n)]
    items = [(i, " ".join(word(n))) for i, n in enumerate([1, 2, 5, 9, 10, 11, 14, 25, 14])] + [(20, None), (21, "--"), (None, " ".join(word(4)))]
    items += [(30, items[4][1]), (31, "Zz " + items[4][1].upper())]
    rows = [(i, " ".join(word(rng.randrange(40)))) for i in range(30)] + [(40 + k, f"aq, {t}!") for k, (_, t) in enumerate(items) if t]
    rows += [(None, items[6][1]), (None, "nothing"), (7, items[7][1]), (7, "clean"), (90, " ".join(word(30000))), (91, None), (92, "")]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expect = []
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for i, t in rows:
        w, hit, ids = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[x]
        names = sorted(str(x) for x in ids if x is not None)
        expect.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), docs(spark, rows)
    for limit in (1 << 26, -1):
        got = decontaminate.mark(df, bench, limit).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(expect)
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(i), t or "") for (i, t), e in zip(rows, expect) if not e[-1])


def test_secrets(spark):
    key = "Zx9Qw3Rt7Yu1Op5As8Df2Gh6Jk4"
    rows = [(0, f'a token = "{key}" b'), (1, "AKIA" + "A1" * 10), (2, "0123456789abcdef" * 2), (3, f"see {key} there"), (4, "a perfectly_ordinary_identifier_name and words"), (5, None), (6, ""), (7, "password: abc")]
    got = {r.doc_id: r for r in secrets.secrets(docs(spark, rows)).collect()}
    assert [got[i].n_assign for i in range(8)] == [1, 0, 0, 0, 0, 0, 0, 0]
    assert got[1].n_access == 1 and got[2].n_hex == 1 and got[3].n_dense == 1 and got[3].spans == f"dense:4:{4 + len(key)}"
    assert got[4].spans == got[5].spans == got[6].spans == ""
    assert key not in "".join(r.text or "" for r in secrets.redact(docs(spark, rows)).collect())


def test_digests(spark, texts):
    got = {r.doc_id: r for r in digests.fingerprint(docs(spark, texts)).collect()}
    for k, (i, t) in enumerate(texts):
        t, n = t or "", texts[(k + 1) % len(texts)][1] or ""
        m = len(t) // 4
        e = t[: len(t) - m] + n[:m]
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), digests.digest(t.encode()))
        assert got[i].near_edited == digests.likeness(got[i].fingerprint, digests.digest(e.encode()))
        assert got[i].near_next == digests.likeness(got[i].fingerprint, digests.digest(n.encode()))
    assert digests.likeness(digests.digest(b"abc"), digests.digest(b"abc")) == 1.0


def test_digest_by_brute_force():
    for text in (b"", b"a", b"abc", b"the quick brown fox" * 9):
        n = [0] * 256
        for k, (x, y) in enumerate(digests.GAPS):
            padded = text + bytes(y)
            for i in range(len(text)):
                h = (padded[i] * 0x9E3779B1 + padded[i + x] * 0x85EBCA77 + padded[i + y] * 0xC2B2AE3D + k * 0x27D4EB2F) & 0xFFFFFFFF
                n[(h ^ h >> 15) * 0x2C1B3C6D >> 24 & 255] += 1
        bounds = [sorted(n)[i] for i in (63, 127, 191)]
        assert digests._digits(digests.digest(text)).tolist() == [sum(c > b for b in bounds) for c in n]


def test_likeness_at_all_lengths():
    """Averages over random texts: unrelated ones, and ones with a tenth of the words replaced."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randrange(2, 10)))
    for n, apart, near in ((1, 0.15, 0.0), (2, 0.2, 0.0), (5, 0.3, 0.2), (20, 0.35, 0.5), (100, 0.4, 0.6), (1000, 0.6, 0.7)):
        a, b = [], []
        for _ in range(30):
            x, y = ([word() for _ in range(n)] for _ in range(2))
            z = [word() if i % 10 == 0 else w for i, w in enumerate(x)]
            of = lambda p, q: digests.likeness(digests.digest(" ".join(p).encode()), digests.digest(" ".join(q).encode()))
            a.append(of(x, y))
            b.append(of(x, z))
        assert sum(a) / 30 <= apart and sum(b) / 30 >= near, (n, sum(a) / 30, sum(b) / 30)
    assert digests.likeness(digests.digest(b"abc"), digests.digest(b"xyz")) < 0.2


def test_digests_of_null_and_equal_ids(spark):
    rng = random.Random(2)
    rows = [(None, f"null {rng.random()}") for _ in range(60)] + [(5, f"five {rng.random()}") for _ in range(60)] + [(i, f"other {i}") for i in range(40)] + [(90, None), (91, "long " * 200_000)]
    df = docs(spark, rows).repartition(4)
    got = digests.fingerprint(df).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    # each text is followed once: as many next ones as rows, by the order that the docstring gives
    order = [t or "" for _, _, t in sorted((i is not None, (i or 0, x), t) for i, t, x in [(r.doc_id, r.text, r.x) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).collect()])]
    follow = {a: b for a, b in zip(order, order[1:] + order[:1])}
    text = {digests.digest(t.encode()): t for t in order}
    for r in got:
        t = text[r.fingerprint]
        m = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - m] + follow[t][:m]).encode()).hexdigest()


def test_html(spark):
    page = '<html><body><div class="site-menu"><a href=x>menu</a></div><article class="p12"><h1>A &amp; B</h1><p>One\n two<br>three<script>no</script><p>four<div class="comments"><p>bad</div></article><footer>f</footer></body>'
    rows = spark.createDataFrame([(1, "http://h.example/1", page), (2, None, None), (3, "http://h.example/2", ""), (4, "http://h.example/3", "<article class=p7><p>x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(rows).collect()}
    assert got[1].text == "A & B\nOne two three\nfour" and got[2].text == got[3].text == "" and got[4].text == "x" and got[4].n_chars == 1


def test_html_keeps_text_that_names_or_damage_would_hide(spark):
    pages = {
        1: ("<p class=it's>three</p><p>four <b title='>x", "three\nfour x"),
        2: ("<article><header class='article-header'><h1>T</h1></header><div class='related-work'>a</div><div class='notice-of-motion'>b</div><div class=social-science>c</div><div class='comments'><p>no</div><div id=cookieNotice>no</div></article>", "T\na\nb\nc"),
        3: ("<body><div class=main><h1>Head</h1><div class=c1>one text here</div><div class=c2>two text here</div></div>", "Head\none text here\ntwo text here"),
        4: ("<!DOCTYPE html><title>t</title><h1>A</h1><p>text", "A\ntext"),
        5: ("<body><div class=wrap><div class=intro>" + "i" * 100 + "</div><div class=body>" + "b" * 900 + "</div></div>", "i" * 100 + "\n" + "b" * 900),
        6: ("<div>" * 100_000 + "deep", "deep"),
        7: ("<p class=\"x>" * 3001 + "quoted", "quoted"),
        8: ("<p>" + "long " * 400_000, ("long " * 400_000).strip()),
        9: ("<nav>a</nav><aside>b</aside><form>c</form><script>d</script><style>e</style><footer>f</footer><header>g</header>", ""),
    }
    rows = [(i, f"http://h{i}.example/", h, "clash") for i, (h, _) in pages.items()] + [(9, None, None, None), (1, "http://h1.example/", pages[1][0], "clash")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(i, t) for i, (_, t) in pages.items()] + [(9, ""), (1, pages[1][1])])


def test_html_by_brute_force(spark):
    """Random pages as trees: shares, votes of hosts and texts computed on the trees, without parsing."""
    rng = random.Random(9)

    def tree(depth=0):
        kids = [("p", "", [(rng.choice("abcdef") + " ") * rng.randrange(1, 60)]) if depth > 2 or rng.random() < 0.4 else tree(depth + 1) for _ in range(rng.randrange(1, 4))]
        return (rng.choice(["div", "div", "section", "article"]), rng.choice(["", "", "ca", "cb", "menu", "site-comments"]), kids)

    def dump(x):
        return x if isinstance(x, str) else f'<{x[0]}{f" class={x[1]}" if x[1] else ""}>' + "".join(map(dump, x[2])) + f"</{x[0]}>"

    def walk(x, path="", named=None, landmark=False):
        """(path, suspect path or None, in a landmark, text) of each block; the containers too."""
        if x[0] == "p":
            return [(path, named, landmark, x[2][0].strip())], []
        path += f">{x[0]}.{x[1]}"
        landmark = landmark or x[0] == "article"
        if named is None and x[1] in ("menu", "site-comments") and x[0] != "article":
            named = path
        out, all_ = [], [(path, named, landmark)]
        for c in x[2]:
            b, k = walk(c, path, named, landmark)
            out, all_ = out + b, all_ + k
        return out, all_

    pages = [("h%d" % rng.randrange(4), tree()) for _ in range(60)]
    votes, count = {}, {}
    inside = lambda path, of: path == of or path.startswith(of + ">")
    shares = []
    for h, x in pages:
        blocks, paths = walk(x)
        plain, total = (sum(len(b[3]) for b in blocks if every or b[1] is None) for every in (False, True))
        own = {}
        for path, named, landmark in set(paths):
            if named is None and plain:
                own[path] = (sum(len(b[3]) for b in blocks if b[1] is None and inside(b[0], path)) / plain, landmark, False)
            elif named == path:
                own[path] = (sum(len(b[3]) for b in blocks if inside(b[0], path)) / total, False, True)
        shares.append(own)
        count[h] = count.get(h, 0) + 1
        for path, v in own.items():
            votes.setdefault((h, path), []).append(v)
    good = {k: v[0] for k, v in votes.items() if len(v) >= html.SUPPORT * count[k[0]] and sum(x[0] for x in v) / len(v) >= (html.RESCUE if v[0][2] else html.LANDMARK if v[0][1] else html.SHARE)}
    expect = []
    for (h, x), own in zip(pages, shares):
        blocks, paths = walk(x)
        rescued = {p for (g, p), v in good.items() if g == h and v[2]}
        here = [k for k in paths if k[1] is None and (h, k[0]) in good] or [k for k in paths if k[1] is None and k[0] in own and own[k[0]][0] >= (html.LANDMARK if k[2] else html.SHARE)]
        here = sorted(here, key=lambda k: (not k[2], k[0].count(">") * (1 if k[2] else -1)))
        top = here[0][0] if here else ""
        expect.append("\n".join(b[3] for b in blocks if (not top or inside(b[0], top)) and b[1] is None or any(inside(b[0], r) for r in rescued)))
    rows = [(i, f"https://{h}/", dump(x)) for i, (h, x) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (html.BROADCAST_BYTES, -1):
        got = {r.page_id: r.text for r in html.extract(df, limit).collect()}
        assert [got[i] for i in range(len(expect))] == expect


def test_warc(spark, tmp_path):
    big = "é" * 700
    rows = spark.createDataFrame([(1, "http://a/ b", big), (2, "http://b", big), (3, None, None), (4, "u", "short"), (5, "u", "short"), (-6, "u", big)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(rows, path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {1: ("revisit", 2, 1400), 2: ("response", None, 1400), 3: ("response", None, 0), 4: ("response", None, 5), 5: ("response", None, 5), -6: ("revisit", 2, 1400)}
    assert all(got[i].payload_digest == hashlib.sha1(big.encode()).hexdigest() for i in (1, 2, -6))


def test_warc_salvage():
    import gzip

    one, two, three = (warc.record(i, "u", b"p" * i, i, hashlib.sha1(b"p" * i).hexdigest(), None, False) for i in (1, 2, 3))
    for pack in (gzip.compress, lambda x: x):
        parts = [pack(x) for x in (one, two, three)]
        broken = parts[1][:-9] + b"?" + parts[1][-8:] if pack is gzip.compress else parts[1].replace(b"\r\npp", b"\r\npq")
        data = parts[0] + broken + b"junk" + parts[2]
        found = list(warc.salvage(data))
        assert [x[0] for x in found] == ["record", "gap", "record"]
        assert found[1][1:3] == (len(parts[0]), len(data) - len(parts[2]))


def test_warc_salvage_keeps_valid_foreign_records():
    import base64

    body = b"payload"
    sha = hashlib.sha1
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body

    def foreign(version, kind, block, *headers, content="application/http; msgtype=response"):
        return b"\r\n".join([version, f"WARC-Type: {kind}".encode(), *(h.encode() for h in headers), f"Content-Type: {content}".encode(), f"Content-Length: {len(block)}".encode(), b"", block, b"", b""])

    hexed, b32 = sha(http).hexdigest(), base64.b32encode(sha(http).digest()).decode()
    good = [
        foreign(b"WARC/1.0", "response", http, f"WARC-Block-Digest: sha1:{hexed}"),
        foreign(b"WARC/1.1", "response", http, f"WARC-Block-Digest: SHA1:{b32.lower()}", f"WARC-Payload-Digest: sha1:{sha(body).hexdigest().upper()}"),
        foreign(b"WARC/0.18", "resource", http, f"WARC-Payload-Digest: sha1:{b32}", content="text/plain"),
        foreign(b"WARC/1.0", "response", http, "X-Folded: a", "\tb", " c", "WARC-Block-Digest: sha256:" + hashlib.sha256(http).hexdigest()),
        foreign(b"WARC/1.0", "response", http, f"X-Long: {'h' * 200_000}"),
        foreign(b"WARC/1.0", "response", http, "WARC-Payload-Digest: crc32:12345678"),
    ]
    found = list(warc.salvage(b"".join(good)))
    assert [x[0] for x in found] == ["record"] * len(good) and found[3][3]["x-folded"] == "a b c"
    bad = foreign(b"WARC/1.0", "response", http, f"WARC-Block-Digest: sha1:{sha(b'other').hexdigest()}")
    found = list(warc.salvage(good[0] + bad + b"WARC/1.0\r\nno colon\r\n" * 1000 + good[1]))
    assert [x[0] for x in found] == ["record", "gap", "record"]


def test_warc_bombs_are_gaps(monkeypatch):
    import gzip

    one = warc.record(1, "u", b"p", 1, hashlib.sha1(b"p").hexdigest(), None, False)
    monkeypatch.setattr(warc, "MOST", 1 << 21)
    found = list(warc.salvage(gzip.compress(b"\0" * (1 << 24)) + gzip.compress(one)))
    assert [x[0] for x in found] == ["gap", "record"]


def test_warc_of_null_and_repeated_ids_and_long_addresses(spark, tmp_path):
    big = "x" * 2000
    rows = [(None, "u", big, 1), (7, "u", big, 2), (7, "u", big, 3), (3, "u", big, 4), (4, "data:" + "\x01" * 30_000, "y", 5), (5, None, "z" * 3_000_000, 6), (6, "", "", 7)]
    for k, limit in enumerate((warc.BROADCAST_BYTES, -1)):
        path = f"file://{tmp_path}/w{k}"
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3), path, broadcast_bytes=limit)
        got = warc.read(spark, path).collect()
        assert {r.kind for r in got} == {"record"}
        assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [(0, "response", 0, 2000), (3, "revisit", 7, 2000), (4, "response", 0, 1), (5, "response", 0, 3_000_000), (6, "response", 0, 0), (7, "response", 0, 2000), (7, "response", 0, 2000)]
    path = f"file://{tmp_path}/none"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_language(spark):
    en, fr = "the cat and the dog were in the house with the other one ", "le chat et le chien sont dans la maison avec les autres "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr", "s") for i in range(20)] + [(20, en * 3, None, None), (21, "12345 --- !!", "en", "s"), (22, None, "en", "s"), (23, "", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(language.document_rows(df, "doc_id")).collect()}
    assert all(got[i].lang_id == ("en" if i % 2 else "fr") for i in range(20)) and got[20].lang_id == "en"
    assert all(got[i].rejected for i in (21, 22, 23))
    assert language.keep_identified(df).count() == 21


def test_language_keeps_rare_ones(spark):
    en, other = "the cat and the dog were in the house with the other one ", "kissa ja koira olivat talossa toisen kanssa "
    rows = [(i, f"{i} {en * 60}", "en", "s") for i in range(3000)] + [(i, f"{i} {other}", "fi", "t") for i in range(3000, 3002)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for sample in (8000, 50):
        got = {r.doc_id: r.lang_id for r in language.identify(language.document_rows(df, "doc_id"), sample).collect()}
        assert all(got[i] == ("en" if i < 3000 else "fi") for i in range(3002))


def test_language_codes_are_one_in_any_spelling(spark):
    en, fr = "the cat and the dog were in the house with the other one ", "le chat et le chien sont dans la maison avec les autres "
    rows = [(i, f"{i} {en if i % 2 else fr}", (" EN", "en", "en_GB")[i % 3] if i % 2 else ("fr-FR", "fr", "FR")[i % 3], "s") for i in range(30)] + [(30, en, "(unknown language)", "s"), (31, fr, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang_id for r in language.identify(language.document_rows(df, "doc_id")).collect()}
    assert all(got[i] == ("en" if i % 2 else "fr") for i in range(30)) and (got[30], got[31]) == ("en", "fr")


def test_language_fusion_by_brute_force(spark, monkeypatch):
    """The posterior as a plain product, with counts of hosts and domains by hand; both ways of the join."""
    import math

    rng = random.Random(4)
    kinds = {"aa": "abcde ", "bb": "bcdef ", "cc": "cdefg "}
    rows = [(i, "".join(rng.choices(kinds[k], k=rng.randrange(4, 80))), rng.choice([k, k, k.upper(), "aa-XX", None]), rng.choice(["x.one.aa", "y.one.aa", "z.two.bb", "three", None])) for i, k in enumerate(rng.choices(list(kinds), k=80))]
    rows += [(80, None, "aa", "three"), (81, "", None, None), (82, "12 34", "bb", "three"), (83, "ab" * 40000, None, None), (7, "bcd bcd", "bb", "three"), (7, "bcd bcd", "bb", "three")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, ll int, prior string")
    langs, w = language.fit(language.document_rows(df))
    ll = []
    for _, t, _, _ in rows:
        raw = bytes(b if b >= 128 else (ord(chr(b).lower()) if chr(b).isalpha() else 32) for b in (t or "").encode())
        if not raw.strip():
            ll.append(None)
            continue
        total = [0.0] * (len(langs) + 1)
        for k in range(len(raw) - 3):
            if raw[k : k + 4].count(32) < 3:
                m = (1 << 32) - 1
                h = (raw[k] * 0x9E3779B1 & m) ^ (raw[k + 1] * 0x85EBCA77 & m) ^ (raw[k + 2] * 0xC2B2AE3D & m) ^ (raw[k + 3] * 0x27D4EB2F & m)
                h = (h ^ h >> 16) * 0x2C1B3C6D & m
                for i in range(len(total)):
                    total[i] += language.TEMPER * float(w[i][h >> 32 - language.BITS])
        ll.append(total)
    count = {}
    for (_, _, _, host), x in zip(rows, ll):
        if host and x:
            best = x.index(max(x[:-1]))
            for key in (host, "domain " + ".".join(host.split(".")[-2:]), ""):
                count.setdefault(key, [0] * len(langs))[best] += 1
    smooth = lambda key, up: [(a + language.STRENGTH * b) / (sum(count[key]) + language.STRENGTH) for a, b in zip(count[key], up)]
    top = [(a + 1) / (sum(count[""]) + len(langs)) for a in count[""]]
    expect = []
    for (i, _, declared, host), x in zip(rows, ll):
        if x is None:
            expect.append((i, None, 0.0, True))
            continue
        prior = smooth(host, smooth("domain " + ".".join(host.split(".")[-2:]), top)) if host in count else [1 / len(langs)] * len(langs)
        logs = [a + math.log(p) for a, p in zip(x, prior)] + [x[-1] + math.log(language.UNDETERMINED)]
        suffix = re.search(r"\.([a-z]{2})$", host or "")
        for c, sure in ((declared and declared[:2].lower(), language.DECLARED), (suffix and suffix[1], language.ADDRESS)):
            if c in langs:
                for n, name in enumerate(langs):
                    logs[n] += math.log(sure if name == c else (1 - sure) / (len(langs) - 1))
        best = max(logs)
        sure = 1 / sum(math.exp(a - best) for a in logs)
        out = logs.index(best) == len(langs) or sure < language.CONFIDENT
        expect.append((i, None if out else langs[logs.index(best)], sure, out))
    for limit in (language.BROADCAST_BYTES, -1):
        monkeypatch.setattr(language, "BROADCAST_BYTES", limit)
        got = [(r.doc_id, r.lang_id, r.confidence, r.rejected) for r in language.identify(language.document_rows(df, "doc_id")).select("doc_id", "lang_id", "confidence", "rejected").collect()]
        key = lambda r: (r[0], str(r[1]), r[2])
        for a, b in zip(sorted(got, key=key), sorted(expect, key=key), strict=True):
            assert a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 1e-4, (a, b)
        kept = language.keep_identified(df)
        assert kept.columns == df.columns and kept.count() == sum(not r[3] for r in expect)


def test_quality(spark):
    good, bad = "a plain sentence of words that goes on ", "$$ %% buy buy buy ## !! "
    df = docs(spark, [(i, (good if i % 3 else bad) * 4) for i in range(90)] + [(90, None), (91, "")])
    labels = df.filter("doc_id < 90").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    got = quality.score(df, quality.fit(df, labels)).filter("held_out AND doc_id < 90").collect()
    assert len(got) > 5 and all(r.predicted == int(r.doc_id % 3 > 0) for r in got)


def test_pieces(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a  b", " lead", "tab\t nl\n", "é ñ 漢字 😀", "", None, "x" * 300, "<s> <0x0A>", "The quick brown fox."]
    model = pieces.Model()
    got = pieces.encode(docs(spark, list(enumerate(texts))), model)
    for r in got.collect():
        assert r.ids == sp.encode(texts[r.doc_id] or "") and r.round_trip and r.n_tokens == len(r.ids)
    assert {r.doc_id: r.text for r in pieces.decode(got, model).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (substrings.remove_repeats(none), simhash.near_duplicates(none), decontaminate.mark(none, bench), secrets.secrets(none), digests.fingerprint(none), html.extract(pages), language.identify(language.document_rows(none, "doc_id")), quality.score(none, quality.fit(none, labels)), pieces.encode(none)):
        assert df.count() == 0


def test_fold_matches_the_heap_on_words_with_and_without_late_pieces(spark):
    m = pieces.Model()
    names = {m.names[i] for i in m.late}
    words = sorted({"▁" * n + w for n in range(18) for w in ("", "x", "the", "aaaaaaa", "banana", "ééé", "internationalisation", "zqxjk")} - {""})
    assert names and any(x in w for x in names for w in words) and any(all(x not in w for x in names) for w in words)
    got = pieces.encode_words(spark.createDataFrame(list(enumerate(words)), "key long, word string"), m, 4).collect()
    path = {words[r.key]: pieces._ends(r.path, len(words[r.key])) for r in got}
    assert {w: path.get(w, list(range(1, len(w) + 1))) for w in words} == {w: pieces.merged(m, w) for w in words}


def test_wide_words_by_windows(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    m, rng = pieces.Model(), random.Random(2)
    words = ["".join(rng.choices(kind, k=n)) for kind in ("etaoinshr", "abcdefghijklmnopqrstuvwxyz", "0aZ漢é/=") for n in (49, 72, 73, 200, 1500)]
    for w in ["▁" + w for w in words] + ["".join(words)]:
        parts = [pieces.merged(m, x) for x in pieces.windows(w)]
        assert pieces.spliced(parts) == pieces.merged(m, w)
    heap = []
    monkeypatch.setattr(pieces, "merged", lambda m, w: heap.append(w))
    assert pieces.spliced([[8, 16, 24, 32, 40, 48], [3, 11, 19, 27]]) is None and not heap
    monkeypatch.undo()
    words += ["a" * 777, "ab" * 400, "x" * 48, "x" * 49, "the" * 40000]
    for r in pieces.encode(docs(spark, list(enumerate(words))), m).collect():
        assert r.ids == sp.encode(words[r.doc_id]) and r.round_trip


def test_pieces_of_null_equal_and_repeated_ids(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(None, "alpha beta"), (None, "white green"), (7, "alpha beta"), (7, "red blue"), (7, "red blue"), (None, None), (7, ""), (None, "one two"), (7, "three four")]
    df = docs(spark, rows).repartition(6)
    for size in (1, 1 << 20):
        got = sorted((str(r.doc_id), list(r.ids)) for r in pieces.encode(df, group_bytes=size).collect())
        assert got == sorted((str(i), sp.encode(t or "")) for i, t in rows)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A small unigram model, written by hand: no training."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.trainer_spec.model_type = 1
    spec.trainer_spec.unk_id = 0
    spec.trainer_spec.bos_id = spec.trainer_spec.eos_id = spec.trainer_spec.pad_id = -1
    spec.normalizer_spec.name = "identity"
    spec.normalizer_spec.add_dummy_prefix = True
    spec.normalizer_spec.remove_extra_whitespaces = False
    spec.normalizer_spec.escape_whitespaces = True
    spec.pieces.add(piece="<unk>", score=0, type=2)
    for i, x in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "aa", "aaa", "bb", "▁▁"]):
        spec.pieces.add(piece=x, score=-1.0 - [2, 2, 2, 2, 1, 1, 3, 1, 2.5, 1, 2, 1, 2, 1, 1][i], type=1)
    path = str(tmp_path_factory.mktemp("u") / "u.model")
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    return path


def test_unigram_viterbi_with_unknowns_and_ties(spark, unigram):
    import sentencepiece

    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=unigram), pieces.Model(unigram), random.Random(1)
    assert not m.bpe
    texts = ["".join(rng.choices("aabbc  x漢", k=n)) for n in range(1, 30) for _ in range(4)] + ["abcabcaaa" * 40, "x" * 70, "", "  "]
    for r in pieces.encode(docs(spark, list(enumerate(texts))), m).collect():
        assert r.ids == sp.encode(texts[r.doc_id]), texts[r.doc_id]
    words = sorted({w for t in texts for w in m.words(t)})
    got = {words[r.key]: r.path for r in pieces.encode_words(spark.createDataFrame(list(enumerate(words)), "key long, word string"), m, 2).collect()}
    assert got == {w: pieces.viterbi(m, w) for w in words}


def test_secrets_without_digits_and_behind_paths(spark):
    letters, key = "qZxWvKjPfGtRbYhNmDcLsXoB", "Zx9Qw3Rt7Yu1Op5As8Df2Gh6"
    paths = [f"config/production/keys/{key}", f"https/api/configuration/production/key={key}"]
    plain = ["a/configuration_production_settings/directory-listing", "CONFIGURATION_PRODUCTION_SETTINGS", "internationalisation", "550e8400-e29b-41d4-a716-446655440000", "2024-01-02/12345678901234567890"]
    found = [letters, letters.lower(), *paths]
    got = {r.doc_id: r for r in secrets.secrets(docs(spark, list(enumerate(found + plain)))).collect()}
    for i, t in enumerate(found):
        start, end = map(int, got[i].spans.removeprefix("dense:").split(":"))
        assert start <= max(t.find(key), 0) and end == len(t)
    assert all(got[len(found) + i].n_dense == 0 for i in range(len(plain)))


def test_secrets_recall_and_known_strings(spark):
    """Shares of random strings found, and known digests and identifiers that are no secrets, inside longer runs too."""
    import base64

    rng = random.Random(7)
    kinds = {"letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "alphanumeric": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"}
    keys = [(k, n, "".join(rng.choices(a, k=n))) for k, a in kinds.items() for n in (20, 24, 32, 40) for _ in range(100)]
    rows = [(i, f"the value is {k} today") for i, (_, _, k) in enumerate(keys)]
    got = {r.doc_id: r.n_dense for r in secrets.secrets(docs(spark, rows)).collect()}
    for k in kinds:
        for n in (20, 24, 32, 40):
            at = [i for i, x in enumerate(keys) if x[:2] == (k, n)]
            assert sum(got[i] > 0 for i in at) >= 0.95 * len(at), (k, n)
    sri = lambda name: f"{name}-{base64.b64encode(hashlib.new(name, b'x').digest()).decode()}"
    uuid = "550e8400-e29b-41d4-a716-446655440000"
    known = [f"{uuid}-suffix", f"prefix/{uuid}", *map(sri, ("sha256", "sha384", "sha512")), f"assets/{hashlib.md5(b'x').hexdigest().upper()}/index", "x" * 5000, "the_long_name_of_a_function_in_a_module", "a" * 200_000]
    words = [f"see {x} there" for x in known]
    got = {r.doc_id: r for r in secrets.secrets(docs(spark, list(enumerate(words)))).collect()}
    assert [i for i in range(len(words) - 1) if got[i].n_dense] == []
    odd = spark.createDataFrame([(1, f"key {keys[150][2]}", "many"), (2, None, None)], "doc_id int, text string, n_chars string")
    assert {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(odd).collect()} == {1: ("key [secret]", "many"), 2: (None, None)}


def test_near_copies_of_similarity_are_dropped(spark):
    import corpus_pipeline

    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    edits = lambda at: " ".join("new" if i in at else w for i, w in enumerate(base))
    near, far = edits({10, 50}), edits({5, 25, 45, 65, 85, 105})  # 106 of 126 shared shingles: 0.84; 86 of 146: 0.59
    rows = [(7, " ".join(base)), (8, near), (9, far), (3, far.upper()), (10, "a b c"), (11, "A  b c"), (12, "a b d")]
    df = docs(spark, rows)
    fp = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(df).collect()}
    assert (fp[7] ^ fp[8]).bit_count() > 4
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [3, 7, 10, 12]


def test_one_row_of_each_group_by_brute_force(spark, tmp_path):
    """Groups by all pairs of 5-word shingle sets and all pairs of fingerprints; null, equal and repeated rows; from files and not."""
    from boxwright.llm import similar

    rng = random.Random(12)
    base = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (60, 80, 100, 120)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((rng.choice([i, 7, None]), " ".join(w)))
    rows += [rows[0], rows[1], (None, None), (3, ""), (4, "a b"), (5, "A b"), (6, "a c"), (None, "alone"), (99, "long " * 50_000)]
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := cut(t)) else set() for _, t in rows]
    df = docs(spark, rows)
    marks = simhash.fingerprints(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    fp = {r.doc_id: r.fp & (1 << 64) - 1 for r in marks}
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (fp[a] ^ fp[b]).bit_count() <= 4 or (sets[a] and both / len(sets[a] | sets[b]) >= 0.8):
                part = [part[b] if p == part[a] else p for p in part]
    expect = []
    for g in set(part):
        ids = [rows[k][0] for k in range(len(rows)) if part[k] == g]
        known = [i for i in ids if i is not None]
        expect.append(str(min(known) if known else None))
    path = f"file://{tmp_path}/d"
    df.repartition(3).write.parquet(path)
    for d, stable in ((df, False), (spark.read.parquet(path), True)):
        got = similar.keep_first(d, stable)
        assert got.columns == d.columns and sorted(str(r.doc_id) for r in got.collect()) == sorted(expect)


def test_crowded_bands_lose_no_pair(spark, monkeypatch):
    """The join on rare shingles against all pairs, frequent shingles dealt to several tasks; and what counts as crowded."""
    from boxwright.llm import similar

    rng = random.Random(21)
    parts = [[f"p{k}x{i}" for i in range(12)] for k in range(9)]
    texts = [" ".join(["a b c d", *(w for p in sorted(rng.sample(range(9), rng.randrange(1, 9))) for w in parts[p])]) for _ in range(90)]
    texts = sorted(set(texts)) + ["a b c d e", "a b c d", "one"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    expect = {(a, b) for b in range(len(sets)) for a in range(b) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert len(expect) > 5
    monkeypatch.setattr(similar, "PARTNERS", 3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    rest = spark.createDataFrame([(k, k, len(s)) for k, s in enumerate(sets)], "id long, label long, size int")
    got = {(r.la, r.lb) for r in similar.verified(df, similar.rare_pairs(df, rest)).collect()}
    assert got == expect
    same = rest.withColumn("label", F.lit(1).cast("long"))
    assert similar.rare_pairs(df, same).isEmpty()
    lists = spark.createDataFrame([(k, min(k, 2), 5, [7, k]) for k in range(4)] + [(9, 9, 5, [8, 5]), (10, 9, 5, [8, 6])], "id long, label long, size int, bands array<long>")
    assert {r.id for r in similar.crowded(lists, 2).collect()} == {0, 1, 2, 3} and similar.crowded(lists, 3).isEmpty()
    assert similar.crowded(lists.filter("id > 8"), 0).isEmpty()


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows on its own input, and run() as the last one's: nulls, empty texts, ties, repeated rows, an empty table."""
    import sys
    from pathlib import Path

    import sentencepiece

    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline
    import public_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    en = "the of and to in that is was for with as his on be at by which have from this".split()
    fr = "le de un et que dans pour ce qui ne sur se pas plus par je avec tout faire son".split()
    text = lambda kind, n=80: " ".join(rng.choices(kind, k=n)) + f" {rng.random()}"
    rows = [(i, text(en if i % 3 else fr), "en" if i % 3 else "fr", f"s{i % 4}", 5) for i in range(60)]
    rows += [(60, rows[1][1], "en", "s0", 5), (60, rows[2][1] + " x", "en", "s0", 5), (61, "1234 5678", "en", "s1", 5), (62, None, "en", None, None), (None, text(en), None, None, 5), (63, "", None, "s1", 0)]
    item = " ".join(f"item{k}" for k in range(12))
    rows += [(64, f"{text(en)} {item}", "en", "s1", 5), (64, text(en), "en", "s1", 5), (65, f"{text(en)} token = Zx9Qw3Rt7Yu1", "en", "s1", 5)]
    top = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    docs_, kept = spark.read.parquet(f"{top}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, top)
        if name != "sentencepiece":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{top}/{name}")
        docs_ = spark.read.parquet(f"{top}/{name}")
        kept[name] = sorted((str(r.doc_id), r.text) for r in docs_.collect()) if name != "sentencepiece" else docs_.collect()
    of = lambda rs: sorted((str(r[0]), r[1]) for r in rs)
    assert kept["language_id"] == of(r for r in rows if r[0] not in (61, 62, 63))
    near = {("60", rows[60][1]), ("60", rows[61][1])}
    assert kept["simhash_near_dedup"] == [r for r in kept["language_id"] if r not in near]
    assert kept["benchmark_decontamination"] == [r for r in kept["simhash_near_dedup"] if item not in r[1]]
    assert kept["secret_scans"] == sorted((i, t.replace("token = Zx9Qw3Rt7Yu1", "[secret]")) for i, t in kept["benchmark_decontamination"])
    assert sorted((str(r.doc_id), list(r.ids)) for r in kept["sentencepiece"]) == sorted((i, sp.encode(t)) for i, t in kept["secret_scans"])
    assert sorted((str(r.doc_id), list(r.ids)) for r in corpus_pipeline.run(spark, top).collect()) == sorted((str(r.doc_id), list(r.ids)) for r in kept["sentencepiece"])
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, id int, label int, _id int").write.parquet(f"{top}/none/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{top}/none").count() == 0


def test_light_results_go_to_few_files(spark):
    from pathlib import Path

    from boxwright.llm import _spark, simhash

    n, held = 120, {"spark.sql.shuffle.partitions": "120", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame([(i, f"a b c d {i // 2}") for i in range(40)], "doc_id long, text string")
    _spark.shared_dir(spark)
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    seen = set(top.glob("rdd-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(got[i] <= i and got[i] == got[i - i % 2] for i in range(40))
    files = [len(list(p.glob("part-*"))) for p in set(top.glob("rdd-*")) - seen]
    assert files and max(files) <= max(n // 8, 4 * spark.sparkContext.defaultParallelism) < n
