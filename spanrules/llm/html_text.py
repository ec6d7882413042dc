"""Main text of web pages by a site style tree.

The pages of a host are merged to a tree of styles: an element counts as the same node on all pages
where the path of tags, classes and ids above it is the same. A node of the tree is important if
it varies: content importance is the entropy of the texts below it over the pages that have it,
presentation importance that of the sequences of its children, both divided by the largest
entropy that so many pages allow. What is composed of a node is as important as its own
presentation and its branches: ``(1 - G^l) presentation + G^l mean of the l branches``. Branches
that many pages of the host repeat are noise and leave each page.

Pages of a host with the same text outside of the elements that are noise by what they are count once:
copies of a page say nothing about what its site repeats. A page without ``article`` or ``main`` never
loses the branch with the largest share of its text, at any level of the tree.

Some elements are noise by what they are (navigation, headers and footers of pages, asides, scripts, by tag
or role): these go whatever their entropy, since a host of a few pages has none to measure. A class or
id only raises a suspicion, and so does a form: wrappers of whole pages carry such names too. A suspect
that holds half of the text of the page, or half of that of its articles, is a wrapper and stays; others go. Names of
comments and cookie notices always count, ``related`` and the like do unless half of the text is theirs. A name with a word
such as ``no``, ``with`` or ``free`` states what the element has, not what it is. An ``article`` or ``main`` element
is never pruned by entropy: a host may well repeat an article.

The pages are parsed twice, first for the style nodes of each distinct page and their counts, which both
combine map-side, so that a host with a third of all pages is no hot key, then for the texts. The importances of a
host, one row, come to its pages by a join on the host (a broadcast if they are few), which AQE can
split where a host is hot.

Defined cases: null html is an empty page with empty text; a null or odd URL belongs to the host
"" and is treated like any other host; markup that is cut off or badly nested is read as far as it
goes; pages that repeat an id get a row each; other columns of the table are not read.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrules.llm.common import broadcast_if_small, slices
from spanrules.session import cut_lineage

MIN_PAGES = 8      # of a host, for entropy to tell anything
THRESHOLD = 0.25
GAMMA = 0.9

# Elements of the HTML standard by how they are treated.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup
option p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
NOISE = set("""nav aside footer option dialog menu head fieldset search""".split())
SKIPPED = set("button select object audio video canvas datalist".split())  # within a line of text
NOISE_ROLES = set("""navigation banner contentinfo complementary search alert alertdialog dialog menu menubar
toolbar tablist""".split())
READER_NAMES = set("""comment comments commentlist consent cookie cookies disqus gdpr replies reply respond""".split())
TEASER_NAMES = set("""ad ads advert adverts advertisement advertising promo promotion related sponsor sponsored widget
widgets""".split())
FRAME_NAMES = set("""banner breadcrumb breadcrumbs copyright footer header masthead menu modal nav navbar navigation
newsletter notice notices pagination pager popup share sharing sidebar signup skip social subscribe subscription toolbar
topbar""".split())
STATES = set("closed disabled enabled free has have hide no non not off on open show with without".split())
# what a name makes of an element, from the weakest suspicion to none that text could lift
PLAIN, FORM, FRAME, TEASER, READER = range(5)
HEADINGS = set("h1 h2 h3 h4 h5 h6 p".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
LISTS = {"ul", "ol", "menu", "dl", "table", "select"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"""
                   r"""|[^<]+|<""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")
BASE, MODULUS = 0x9E3779B97F4A7C15, (1 << 61) - 1


def suspicion(names: str, article: bool = False, inside: bool = False) -> int:
    """What the class and id ``names`` of an element make of it, an ``article`` or ``main`` itself or one ``inside``."""
    found = PLAIN
    for name in names.split():
        words = set(NAME.findall(name))
        if words & STATES:
            continue
        if words & READER_NAMES:
            return READER
        if words & TEASER_NAMES:
            found = TEASER
        elif not article and words & FRAME_NAMES and not (inside and "header" in words):
            found = max(found, FRAME)
    return found


class Page:
    """A page as style nodes (parent, key, kind) and blocks of text (node, text), in page order."""

    def __init__(self, source: str):
        self.parent, self.key, self.first = [-1], [1], [0]
        self.inside, self.article, self.fixed, self.suspect, self.heading = [False], [False], [False], [PLAIN], [False]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)
        self.noise, self.main = self._settled()

    def _node(self, above: int, tag: str, attrs: str) -> int:
        marks = {m[1].lower(): m[2].strip("\"'").lower() for m in ATTR.finditer(attrs)} if "=" in attrs else {}
        named = f"{marks.get('class', '')} {marks.get('id', '')}"
        label = f"{tag} {re.sub(r'[0-9]+', '0', named)}"
        article = tag in ("article", "main") or marks.get("role") == "main"
        self.parent.append(above)
        self.key.append(xxhash.xxh3_64_intdigest(label, seed=self.key[above]) >> 1)
        self.first.append(len(self.blocks))
        self.fixed.append(tag in NOISE or tag == "header" and not self.inside[above] or marks.get("role") in NOISE_ROLES)
        self.suspect.append(PLAIN if tag in ("html", "body") else
                            max(suspicion(named, article, self.inside[above]), FORM if tag == "form" else PLAIN))
        self.article.append(article)
        self.inside.append(self.inside[above] or article)
        self.heading.append(tag in HEADINGS)
        return len(self.parent) - 1

    def _settled(self) -> tuple[list[bool], list[bool]]:
        """By node: whether it is noise by what it is or by its name, and whether it belongs to an article."""
        n = len(self.parent)
        # noise whatever the shares, and text that no suspicion of comments can count for
        out, articles = [False] * n, [False] * n
        for node in range(1, n):
            up = self.parent[node]
            out[node] = out[up] or self.fixed[node] or self.suspect[node] == READER
            articles[node] = articles[up] or self.article[node] and self.suspect[node] < TEASER
        chars, own, heading = [0] * n, [0] * n, self.heading[:]
        for node, text in self.blocks:
            if not out[node]:
                chars[node] += len(text)
                own[node] += len(text) if articles[node] else 0
        for node in range(n - 1, 0, -1):
            up = self.parent[node]
            chars[up] += chars[node]
            own[up] += own[node]
            heading[up] = heading[up] or heading[node]
        noise, main = out, [False] * n
        for node in range(1, n):
            up, kind = self.parent[node], self.suspect[node]
            wraps = 0 < chars[0] <= 2 * chars[node] and (kind != FORM or heading[node])
            wraps = wraps or kind < TEASER and 0 < own[0] <= 2 * own[node]
            noise[node] = noise[up] or noise[node] or kind != PLAIN and not wraps
            main[node] = main[up] or self.article[node] and not noise[node]
        return noise, main

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]   # open block elements and their nodes
        places: dict[str, list[int]] = {}          # by tag, where in the stack it is open
        hold: list[str] = []                       # text of the open block
        endless: set[str] = set()                  # tags that are not closed any more

        def flush() -> None:
            if hold:
                text = " ".join(html_entities.unescape("".join(hold)).split())
                if text:
                    self.blocks.append((stack[-1][1], text))
                hold.clear()

        def innermost(tags: set[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close(tags: set[str], fence: set[str]) -> None:
            at = innermost(tags)
            if at and at >= innermost(fence):
                flush()
                for tag, _ in stack[at:]:
                    places[tag].pop()
                del stack[at:]

        def after(tag: str, pos: int) -> int:
            """Where the element ends that began before ``pos``, or -1."""
            if tag in endless:
                return -1
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, pos)
            if end is None:
                endless.add(tag)
            return end.end() if end else -1

        pos, n = 0, len(source)
        while pos < n:
            m = TOKEN.match(source, pos)
            pos = m.end()
            tag = m[2]
            if tag is None:
                if m[0][0] != "<":
                    hold.append(m[0])
                elif m[0] == "<":
                    hold.append("&lt;")
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "br":
                    hold.append(" ")
                elif tag in BLOCKS or tag == "head":
                    close({tag}, set() if tag in ("article", "main", "body", "html", *LISTS) else {"article", "main"})
                continue
            if tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = after(tag, pos)
                    pos = end if end >= 0 else n
                hold.append(" " if tag in ("svg", "math") else "")
                continue
            if tag == "br":
                hold.append(" ")
                continue
            if tag in SKIPPED:  # one that is never closed is read on
                pos = max(pos, after(tag, pos))
                continue
            if tag not in BLOCKS and tag not in NOISE:
                continue
            flush()
            if tag in VOID:
                continue
            if tag in SIBLINGS:
                close(SIBLINGS[tag], LISTS | {"article", "main"})
            elif tag in CLOSES_P and stack[-1][0] == "p":
                close({"p"}, set())
            if tag in ("article", "main"):  # these do not stand in a menu that was left open
                close({"nav", "head"}, {"article", "main"})
            if tag == "body":
                close({"head"}, set())
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, self._node(stack[-1][1], tag, m[3])))
        flush()

    def style(self) -> dict[int, tuple[int, int]]:
        """By style key: hashes of the text below it and of the sequence of its children."""
        # the blocks below a node lie one after the other: their hash comes from those of two prefixes
        prefix, power = [0], [1]
        for _, block in self.blocks:
            prefix.append((prefix[-1] * BASE + xxhash.xxh3_64_intdigest(block) + 1) % MODULUS)
            power.append(power[-1] * BASE % MODULUS)
        count = [0] * len(self.parent)
        for node, _ in self.blocks:
            count[node] += 1
        for node in range(len(self.parent) - 1, 0, -1):
            count[self.parent[node]] += count[node]
        text: dict[int, int] = {}
        for node, (key, a, c) in enumerate(zip(self.key, self.first, count)):
            part = prefix[a + c] - prefix[a] * power[c]
            text[key] = (text.get(key, 0) * power[c] + part) % MODULUS
        below: dict[int, list[int]] = {}
        for node in range(1, len(self.parent)):
            below.setdefault(self.key[self.parent[node]], []).append(self.key[node])
        return {k: (text[k], xxhash.xxh3_64_intdigest(repr(below.get(k, ()))) >> 1) for k in set(self.key)}

    def own_text(self) -> str:
        """The blocks that no noise element holds."""
        return "\n".join(text for node, text in self.blocks if not self.noise[node])

    def _largest(self) -> set[int]:
        """The nodes with the largest share of the page's text at each level, those of one style together."""
        n = len(self.parent)
        chars = [0] * n
        for node, text in self.blocks:
            if not self.noise[node]:
                chars[node] += len(text)
        below: list[list[int]] = [[] for _ in range(n)]
        for node in range(n - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
            below[self.parent[node]].append(node)
        level, kept = [0], set()
        while level:
            kept.update(level)
            share: dict[int, int] = {}
            for node in level:
                for child in below[node]:
                    share[self.key[child]] = share.get(self.key[child], 0) + chars[child]
            top = max(share.values(), default=0)
            keys = {k for k, x in share.items() if x == top and top}
            level = [child for node in level for child in below[node] if self.key[child] in keys]
        return kept

    def main_text(self, content: dict[int, float], presentation: dict[int, float], threshold: float) -> str:
        """The blocks that no noise element and no branch of low importance holds."""
        n = len(self.parent)
        branches: list[list[float]] = [[] for _ in range(n)]
        low = [False] * n
        for node in range(n - 1, 0, -1):  # children come after their parents
            k = self.key[node]
            parts = branches[node]
            if parts:
                g = GAMMA ** len(parts)
                own = (1 - g) * presentation.get(k, 1.0) + g * sum(parts) / len(parts)
            else:
                own = content.get(k, 1.0)
            branches[self.parent[node]].append(own)
            low[node] = own < threshold and not self.main[node]
        kept_main = set()
        for node in range(n):
            if self.main[node]:
                up = node
                while up >= 0 and up not in kept_main:  # a branch that holds the article stays
                    kept_main.add(up)
                    up = self.parent[up]
        if not kept_main and any(low):
            kept_main = self._largest()
        gone = [False] * n
        for node in range(1, n):
            gone[node] = gone[self.parent[node]] or self.noise[node] or (low[node] and node not in kept_main)
        return "\n".join(text for node, text in self.blocks if not gone[node])


# ------------------------------------------------------------------ Spark jobs


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _distinct_counts(rows: DataFrame) -> DataFrame:
    """``host, key, kind, value, n`` over the distinct pages of ``host, text``; of pages with the same text of
    their own the one with the least style counts."""
    def styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 8 << 20):
                seen: dict[tuple[str, bytes], list[int]] = {}
                for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
                    page = Page(text or "")
                    own = xxhash.xxh3_128_digest(page.own_text())
                    flat = [x for key, (content, order) in sorted(page.style().items()) for x in (key, content, order)]
                    seen[host, own] = min(flat, seen.get((host, own), flat))
                yield pa.record_batch([
                    pa.array([h for h, _ in seen], pa.string()), pa.array([d for _, d in seen], pa.binary()),
                    pa.array(list(seen.values()), pa.list_(pa.int64()))], names=["host", "own", "style"])

    once = (rows.mapInArrow(styles, "host string, own binary, style array<long>")
            .groupBy("host", "own").agg(F.min("style").alias("style")))
    parts = F.expr("transform(sequence(0, size(style) - 3, 3), i -> struct(style[i] AS key, style[i + 1] AS content, "
                   "style[i + 2] AS nodes))")
    nodes = once.select("host", F.explode(parts).alias("s"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("s.content").alias("value")),
                              F.struct(F.lit(1).alias("kind"), F.col("s.nodes").alias("value"))))
    return (nodes.select("host", "s.key", kinds.alias("v")).groupBy("host", "key", "v.kind", "v.value")
            .agg(F.count(F.lit(1)).alias("n")))


def site_styles(pages: DataFrame, url_col: str = "url", html_col: str = "html", distinct: bool = False) -> DataFrame:
    """``host, keys, content, presentation``: the importances of the style nodes of every host, over all
    ``pages`` or the ``distinct`` ones of a host."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 8 << 20):
                seen: Counter = Counter()
                for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
                    for key, (content, order) in Page(text or "").style().items():
                        seen[host, key, 0, content] += 1
                        seen[host, key, 1, order] += 1
                cols = list(zip(*seen)) or [(), (), (), ()]
                yield pa.record_batch([
                    pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                    pa.array(cols[3], pa.int64()), pa.array(list(seen.values()), pa.int64())],
                    names=["host", "key", "kind", "value", "n"])

    rows = pages.select(_host(url_col).alias("host"), F.col(html_col).cast("string").alias("text"))
    counts = _distinct_counts(rows) if distinct else (
        rows.mapInArrow(count, "host string, key long, kind int, value long, n long")
        .groupBy("host", "key", "kind", "value").agg(F.sum("n").alias("n")))
    nodes = (counts.groupBy("host", "key", "kind")
             .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
             .where(F.col("m") >= MIN_PAGES)
             .select("host", "key", "kind", (1 - F.col("s") / F.col("m") / F.log("m")).alias("importance")))
    both = nodes.groupBy("host", "key").agg(
        F.max(F.when(F.col("kind") == 0, F.col("importance"))).alias("content"),
        F.max(F.when(F.col("kind") == 1, F.col("importance"))).alias("presentation"))
    return cut_lineage(both.groupBy("host").agg(F.collect_list(F.struct("key", "content", "presentation")).alias("s"))
                       .select("host", F.col("s.key").alias("keys"), F.col("s.content").alias("content"),
                               F.col("s.presentation").alias("presentation")))


def extract(pages: DataFrame, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars``."""
    styles = site_styles(pages, url_col, html_col, distinct=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, known = None, ({}, {})
        for whole in batches:
            for batch in slices(whole, 8 << 20):
                texts = []
                rows = zip(*(batch.column(c) for c in ("host", "keys", "content", "presentation")),
                           batch.column("text").to_pylist())
                for h, keys, content, order, text in rows:
                    if h.as_py() != host:
                        host, keys = h.as_py(), keys.as_py() or []
                        known = (dict(zip(keys, content.as_py() or [])), dict(zip(keys, order.as_py() or [])))
                    texts.append(Page(text or "").main_text(*known, threshold))
                yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())],
                                      names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _host(url_col).alias("host"),
                        F.col(html_col).cast("string").alias("text"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return (rows.join(broadcast_if_small(styles, 4096), "host", "left")
            .mapInArrow(read, f"id {kinds[0]}, url {kinds[1]}, text string")
            .select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                    F.length("text").cast("long").alias("n_chars")))
