"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the share of the page's text (less links) that they hold. Shares are averaged by
host and generalised tag-class path, a page counting as much as any other; a path that holds nearly all text of the
pages that have it is the host's consensus, and each page's text is taken again from the innermost such path. A page
that has none falls back to its own shares; its root holds everything, so no text is lost for want of a container.

Containers named as menus, notices, adverts or comments are left out, but for those that hold nearly all text of their
host's pages: there the host's votes say that the name deceives.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm._spark import cut

BROADCAST_BYTES, SALTS = 64 << 20, 32
#: Average share of a consensus path, the same for article and main, a named container's share that saves it, and the
#: part of a host's pages that has to have a path.
SHARE, LANDMARK, RESCUE, SUPPORT = 0.95, 0.5, 0.9, 0.1
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTR = re.compile(r"""(?:\s|^)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINER = frozenset("html body main article section div td center".split())
_LANDMARK = frozenset(["article", "main"])
_OFF = frozenset("nav footer aside form script style textarea title noscript template iframe button select svg head dialog menu".split())
_OFF_ROLE = frozenset("navigation banner contentinfo complementary search".split())
#: A name is suspect if all its parts are of these two kinds, and one at least is of the first.
_BOILER = frozenset("nav navbar navigation menu menus masthead header footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent notice notices gdpr comment comments disqus reply replies respond share sharing social related recommended recommendations subscribe newsletter popup modal breadcrumb breadcrumbs pagination skip".split())
_NEUTRAL = frozenset("site page main top bottom left right primary secondary global reader readers user box wrap wrapper container section area list item items widget block links link inner outer bar btn button buttons form small large sticky fixed media group row col column panel side the and".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\dA-Za-z_]+")
_CLOSES = {"p": frozenset("p".split()), "li": frozenset("li p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split()), "tr": frozenset("tr td th p".split()), "dt": frozenset("dt dd p".split()), "dd": frozenset("dt dd p".split()), "option": frozenset(["option"])}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_P = frozenset(["p"])


def suspect(name: str) -> bool:
    """Whether a class or id names boilerplate and nothing else: "cookie-notice", not "notice-of-motion"."""
    parts = [x.lower() for x in _WORD.findall(name)]
    return any(x in _BOILER for x in parts) and all(x in _BOILER or x in _NEUTRAL for x in parts)


class Page:
    """Containers and blocks of a page, read in time linear in its length.

    A container is a number: ``parent``, ``path`` (a hash of the generalised tags and classes from the root), ``depth``,
    ``landmark`` (article, main or in one) and ``named`` (suspect, or in one: the number of the outermost). Number 0 is
    the root. ``blocks`` has (container, text, characters of it in links, whether it is an h1).
    """

    def __init__(self, page: str):
        self.parent, self.path, self.depth, self.landmark, self.named = [0], [0], [0], [False], [-1]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._read(page)

    def _container(self, up: int, tag: str, names: dict, named: bool) -> int:
        at = len(self.parent)
        kind = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in names.get("class", "").lower().split()})])
        self.parent.append(up)
        self.path.append(xxhash.xxh64_intdigest(kind, self.path[up] & 0xFFFFFFFFFFFFFFFF) >> 1)
        self.depth.append(self.depth[up] + 1)
        self.landmark.append(self.landmark[up] or tag in _LANDMARK)
        self.named.append(self.named[up] if self.named[up] >= 0 or not named else at)
        return at

    def _read(self, page: str) -> None:
        # tag, off, container, place of the nearest element at or below it that isn't inline
        stack: list[tuple[str, bool, int, int]] = []
        open_: dict[str, int] = {}
        text: list[str] = []
        unclosed: set[str] = set()
        pos, n, linked = 0, len(page), 0

        def flush():
            nonlocal linked
            if text:
                s = " ".join(_html.unescape("".join(text)).split())
                if s:
                    self.blocks.append((stack[-1][2] if stack else 0, s, linked, open_.get("h1", 0) > 0))
                text.clear()
            linked = 0

        def pop():
            open_[stack.pop()[0]] -= 1

        def end_of_tag(at: int) -> int:
            """Place of the > that ends a tag. A quote opens a value only after =, and only if it is closed."""
            while m := _STOP.search(page, at):
                if not m[1]:
                    return m.start()
                close = page.find(m[1], m.end()) if m[1] not in unclosed else -1
                if close < 0:
                    unclosed.add(m[1])
                at = m.end() if close < 0 else close + 1
            return n

        while pos < n:
            m = _MARK.search(page, pos)
            a = m.start() if m else n
            off = bool(stack) and stack[-1][1]
            if a > pos and not off:
                text.append(page[pos:a])
                if open_.get("a"):
                    linked += a - pos
            if not m or not m[2]:
                pos = m.end() if m else n
                continue
            rest = end_of_tag(m.end())
            tag, attributes, pos = m[2].lower(), page[m.end() : rest], rest + 1
            if tag not in _INLINE:
                flush()
            elif tag == "br" and not off:
                text.append(" ")
            if m[1]:
                if open_.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            close = _CLOSES.get(tag, frozenset()) | (_P if tag in _ENDS_P else frozenset())
            if any(open_.get(x) for x in close):
                at, last = len(stack) - 1, len(stack)
                while at >= 0 and (at := stack[at][3]) >= 0 and stack[at][0] in close:
                    last, at = at, at - 1
                while len(stack) > last:
                    pop()
            if tag in _VOID:
                continue
            names = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attributes)} if attributes else {}
            up, off = (stack[-1][2], stack[-1][1]) if stack else (0, False)
            off = off or tag in _OFF or names.get("role", "") in _OFF_ROLE or (tag == "header" and not self.landmark[up])
            container = up
            if not off:
                named = bool(names) and tag not in _INLINE and tag not in ("html", "body", "article", "main") and any(map(suspect, [*names.get("class", "").split(), names.get("id", "")]))
                if named or tag in _CONTAINER:
                    container = self._container(up, tag, names, named)
            if attributes.endswith("/"):
                continue
            below = len(stack) if tag not in _INLINE else (stack[-1][3] if stack else -1)
            stack.append((tag, off, container, below))
            open_[tag] = open_.get(tag, 0) + 1
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, pos)
                pos = end.start() if end else n
        flush()

    def shares(self) -> tuple[dict[int, float], dict[int, float]]:
        """Shares of the page's text by path: of containers outside suspect ones, and of outermost suspect ones.

        The first are shares of what isn't suspect, halved without the page's first h1; the second of all.
        """
        mass, first = [0.0] * len(self.parent), None
        for at, s, links, h1 in self.blocks:
            mass[at] += max(0, len(s) - 2 * links)
            if h1 and first is None and self.named[at] < 0:
                first = at
        total = sum(mass)
        plain = sum(x for x, named in zip(mass, self.named) if named < 0)
        title = set()
        while first:
            title.add(first)
            first = self.parent[first]
        for at in range(len(mass) - 1, 0, -1):
            up = self.parent[at]
            if self.named[at] < 0 or self.named[up] >= 0:
                mass[up] += mass[at]
        own, other = {0: 1.0} if plain else {}, {}
        halved = {0}
        for at in range(1, len(mass)):
            if self.named[at] < 0 and plain:
                own[self.path[at]] = own.get(self.path[at], 0.0) + mass[at] / plain
                if at in title:
                    halved.add(self.path[at])
            elif self.named[at] == at and total:
                other[self.path[at]] = other.get(self.path[at], 0.0) + mass[at] / total
        if title:
            own = {k: x if k in halved else x / 2 for k, x in own.items()}
        return own, other

    def votes(self) -> list[tuple[int, float, bool, bool]]:
        """(path, share, in a landmark, suspect) of each path; the root's is there if the page has any text."""
        own, other = self.shares()
        mark = {p for p, m in zip(self.path, self.landmark) if m}
        return [(0, 1.0, False, False)] * (bool(other) and not own) + [(p, x, p in mark, False) for p, x in own.items()] + [(p, x, False, True) for p, x in other.items()]

    def text(self, good: set[int], rescued: set[int]) -> str:
        """The blocks in the outermost landmark among the ``good`` paths, or else in the innermost good one, or, if the
        page has none, on its own best path; suspect containers only where ``rescued``. One block a line, in page order.
        """
        here = [i for i in range(1, len(self.path)) if self.path[i] in good and self.named[i] < 0]
        if not here:
            own = self.shares()[0]
            here = [i for i in range(1, len(self.path)) if self.named[i] < 0 and own.get(self.path[i], 0.0) >= (LANDMARK if self.landmark[i] else SHARE)]
        best = min(here, key=lambda i: (not self.landmark[i], self.depth[i] if self.landmark[i] else -self.depth[i], i), default=0)
        inside = [False] * len(self.path)
        for i, p in enumerate(self.path):
            inside[i] = (i == 0 and best == 0) or (i > 0 and (inside[self.parent[i]] or p == self.path[best]))
            if self.named[i] == i and p in rescued:
                inside[i] = True
            elif self.named[i] == i:
                inside[i] = False
        return "\n".join(s for at, s, _, _ in self.blocks if inside[at])


def host(url):
    """Host name of an address, in lower case; empty for none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Character references are decoded, white space in a block is one space, blocks are joined by line feeds. Null or
    empty html, and pages without any text, give an empty text; pages without a host share one consensus. Repeated
    rows each get theirs; no rows give none; other columns are ignored. Ties between paths go to the first in the page.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))

    def vote(batches):
        for batch in batches:
            out = []
            for h, page in zip(batch.column("host"), batch.column("html")):
                if page.is_valid:
                    out += [(h.as_py(), *v) for v in Page(page.as_py()).votes()]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()))], names=["host", "path", "share", "landmark", "suspect"])

    def text(batches):
        for batch in batches:
            out = []
            for page, good, rescued in zip(batch.column("html"), batch.column("good"), batch.column("rescued")):
                out.append(Page(page.as_py() or "").text(set(good.as_py() or ()), set(rescued.as_py() or ())))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path long, share double, landmark boolean, suspect boolean")
    # decimals: sums don't depend on the order of the rows
    share = F.sum(F.round("share", 6).cast("decimal(28,6)")).cast("double")
    paths = cut(votes.groupBy("host", "path", "landmark", "suspect").agg(F.count("*").alias("n"), share.alias("share")))
    pages_ = paths.filter("path = 0").groupBy("host").agg(F.sum("n").alias("pages"))
    mean, least = F.col("share") / F.col("n"), F.when(F.col("suspect"), RESCUE).when(F.col("landmark"), LANDMARK).otherwise(SHARE)
    good = paths.filter(F.col("path") != 0).join(pages_, "host").filter((F.col("n") >= SUPPORT * F.col("pages")) & (mean >= least))
    best = cut(good.groupBy("host").agg(F.collect_set(F.when(~F.col("suspect"), F.col("path"))).alias("good"), F.collect_set(F.when(F.col("suspect"), F.col("path"))).alias("rescued")))
    size = best.agg(F.sum(F.octet_length("host") + 8 * F.size("good") + 8 * F.size("rescued") + 64)).first()[0] or 0
    kinds = dict(rows.dtypes)
    if size <= broadcast_bytes:
        met = rows.join(F.broadcast(best), "host", "left")
    else:  # a host's pages are dealt to several tasks
        best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).join(best, ["host", "salt"], "left")
    return met.select("page_id", "url", "html", "good", "rescued").mapInArrow(text, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    return extract(table(spark, sf_dir, "pages"))
