"""Main text of web pages by a site style tree.

Pages of one host are merged into a style tree.  An element's node is its place: the node above, that one's style (the
sequence of its child elements) and the place in it, so pages that look alike share nodes and others do not.  A node's
presentation importance is the normalised entropy of its styles over the host's pages: a frame looks the same on every
page, content does not.  A branch that holds half of the text or more and whose style varies is the host's main branch.
Beside it a branch counts by its presentation and its share of the page's text, less what is link text; inside it a
line counts by its content: on n of N pages its importance is 1 - n / N, so a line that comes back on most pages among
lines that differ is told from them.  Branches and lines of low importance are removed from each page.

What a page declares (article, main; menus, headers, footers, sidebars, adverts, forms, comments) is one more feature: a
prior that weighs as much as PRIOR_PAGES pages, so few pages say little and many decide, and a factor on branches that
declare themselves to be no article.  Pages of one host with the same text are one page, or copies would look like
boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, spread_join

#: pages that the prior weighs
PRIOR_PAGES = 3
#: states of an element: undeclared, in a declared main element, declared to be no article, beside a declared main element
PLAIN, MAIN_PART, CHROME_PART, BESIDE = 0, 1, 2, 3
#: prior importance by state, and the factor on what the tree says of branches declared to be no article
PRIOR = (0.7, 1.0, 0.2, 0.3)
CHROME_FACTOR = 0.3
#: share of the text and presentation importance from which a branch is its host's main one
MAIN_SHARE, MAIN_PRESENTATION = 0.5, 0.5
#: composite importance below which a branch or line goes
MIN_IMPORTANCE = 0.35

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas".split())
CHROME = set("nav header footer aside form button select option dialog menu head".split())
MAIN = {"article", "main"}
BLOCK = set(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_WORDS = set(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond "
    "pagination pager skip toolbar copyright legal".split()
)
#: the elements whose end tag may be left out, and the open elements that the start of one closes
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _declared(tag: str, attrs: str) -> tuple[str, bool]:
    """(label of the element in the tree, whether it declares itself to be no article)."""
    label, chrome = tag, tag in CHROME
    if attrs and "=" in attrs:
        for name, *values in _ATTR.findall(attrs):
            value = "".join(values).lower()
            name = name.lower()
            if name in ("class", "id"):
                label += ("." if name == "class" else "#") + "-".join(value.split())
                chrome = chrome or not CHROME_WORDS.isdisjoint(_SPLIT.split(value))
            elif name == "role":
                chrome = chrome or value.strip() in CHROME_ROLES
            else:
                chrome = chrome or value in ("true", "hidden", "")
    return label, chrome


class Page:
    """A parsed page.

    ``blocks`` are [element, state, text, link characters] in page order; ``elements`` are [parent, label, digest of the
    path of labels, state, labels of the children, place among them], the page itself first.
    """

    def __init__(self, page: str):
        self.blocks: list[list] = []
        self.elements: list[list] = [[-1, "", 0, PLAIN, [], 0]]
        stack = [(0, "")]  # element, tag
        opened: Counter = Counter()
        text: list[str] = []
        linked, in_link = 0, False

        def leave() -> None:
            opened[stack.pop()[1]] -= 1

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if joined:
                    at = next(e for e, tag in reversed(stack) if tag in BLOCK or not tag)
                    self.blocks.append([at, self.elements[stack[-1][0]][3], joined, min(linked, len(joined))])
                linked = 0

        at = 0
        while found := _TOKEN.search(page, at):
            start, stop = found.span()
            if start > at:
                text.append(page[at:start])
                if in_link:
                    linked += start - at
            at = stop
            end, tag, attrs = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                text.append(" ")
            elif tag in BLOCK:
                flush()
            if tag == "a":
                in_link = not end
            if end:
                if opened[tag]:
                    if tag in BLOCK:
                        while stack[-1][1] != tag:
                            leave()
                        leave()
                    elif stack[-1][1] == tag:
                        flush()
                        leave()
                continue
            if tag in RAW:
                last = _END[tag].search(page, at)
                at = last.end() if last else len(page)
                continue
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                continue
            label, chrome = _declared(tag, attrs)
            if tag not in BLOCK and not chrome and stack[-1][1] != tag:
                continue  # inline: no element of its own
            closes = CLOSES.get(tag)
            if closes and stack[-1][1] in closes:
                leave()
            above = self.elements[stack[-1][0]]
            flush()
            state = CHROME_PART if chrome or above[3] == CHROME_PART else MAIN_PART if tag in MAIN or above[3] == MAIN_PART else PLAIN
            self.elements.append([stack[-1][0], label, _digest(f"{above[2]}/{label}"), state, [], len(above[4])])
            above[4].append(label)
            stack.append((len(self.elements) - 1, tag))
            opened[tag] += 1
        text.append(page[at:])
        flush()
        self._beside()

    def _beside(self) -> None:
        """Elements outside the declared main ones, and not around them, are beside these."""
        mains = [k for k, e in enumerate(self.elements) if e[3] == MAIN_PART]
        if any(b[1] == MAIN_PART for b in self.blocks):
            around = set()
            for k in mains:
                while k >= 0 and k not in around:
                    around.add(k)
                    k = self.elements[k][0]
            for k, e in enumerate(self.elements):
                if e[3] == PLAIN and k not in around:
                    e[3] = BESIDE
            for b in self.blocks:
                b[1] = BESIDE if b[1] == PLAIN else b[1]

    def keys(self) -> list[int]:
        """The node of the style tree that each element is."""
        out, styles = [], [_digest(" ".join(e[4])) for e in self.elements]
        for parent, _, _, _, _, place in self.elements:
            out.append(_digest(f"{out[parent]} {styles[parent]} {place}") if parent >= 0 else 0)
        return out

    def sizes(self) -> tuple[list[int], list[int]]:
        """(characters of text, characters of link text) of every element's branch."""
        chars, links = [0] * len(self.elements), [0] * len(self.elements)
        for at, _, text, linked in self.blocks:
            chars[at] += len(text)
            links[at] += linked
        for k in range(len(self.elements) - 1, 0, -1):
            chars[self.elements[k][0]] += chars[k]
            links[self.elements[k][0]] += links[k]
        return chars, links

    def features(self) -> list[tuple]:
        """(what, key, value, prior, share, linked): branches with their style (0), paths that hold lines (1), lines (2)."""
        chars, links = self.sizes()
        out = []
        for key, e, n, linked in zip(self.keys(), self.elements, chars, links, strict=True):
            if n:
                out.append((0, key, _digest(" ".join(e[4])), PRIOR[e[3]], n / chars[0], linked / n))
        lines = {}
        for at, state, text, _ in self.blocks:
            if state in (PLAIN, MAIN_PART):
                path = self.elements[at][2]
                lines[path, 0] = lines[path, _digest(text)] = state
        out += [(2 if value else 1, path, value, PRIOR[state], 0.0, 0.0) for (path, value), state in lines.items()]
        return out

    def own_text(self) -> int:
        """Digest of the text that the page declares to be its own, or else does not declare to be no article."""
        own = [b for b in self.blocks if b[1] == MAIN_PART] or [b for b in self.blocks if b[1] == PLAIN]
        return _digest("\n".join(b[2] for b in own))

    def main_text(self, low: set, main: set, lines: set) -> tuple[str, int, int]:
        """(text, blocks removed that declarations alone would keep, blocks of low importance).

        ``low`` are nodes of low importance beside a main branch, ``main`` main branches, ``lines`` (path, line) of low importance.
        """
        keys, n = self.keys(), len(self.elements)
        inner = [keys[k] in main and self.elements[k][3] != CHROME_PART for k in range(n)]
        holds = [False] * n
        for k in range(n - 1, 0, -1):  # the deepest main branch counts
            if inner[k] or holds[k]:
                holds[self.elements[k][0]] = True
        inner = [a and not b for a, b in zip(inner, holds, strict=True)]
        inside, under = [False] * n, [False] * n
        for k, (parent, _, _, state, _, _) in enumerate(self.elements):
            inside[k] = inner[k] or state == MAIN_PART or parent >= 0 and inside[parent]
            under[k] = keys[k] in low and not inside[k] or parent >= 0 and under[parent]
        told = any(inside)
        kept, removed, unimportant = [], 0, 0
        for at, state, text, _ in self.blocks:
            weak = state != CHROME_PART and (self.elements[at][2], _digest(text)) in lines or under[at] and (told or state == CHROME_PART)
            declared = PRIOR[state] < MIN_IMPORTANCE
            unimportant += weak
            removed += weak and not declared
            # a branch that is unknown to the tree has its prior alone
            if not weak and not declared:
                kept.append(text)
        return " ".join(kept), removed, unimportant


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - 2**63


_FEATURE = "struct<what:int,key:long,value:long,prior:double,share:double,linked:double>"


def _counted(pages: DataFrame) -> DataFrame:
    """(host, what, key, value, n, prior, share, linked): on how many pages of different text a node has a style, and lines stand; with sums over them."""

    def run(batches):
        import pyarrow as pa

        names = ("what", "key", "value", "prior", "share", "linked")
        kind = pa.list_(pa.struct([("what", pa.int32()), ("key", pa.int64()), ("value", pa.int64()), *[(n, pa.float64()) for n in names[3:]]]))
        for batch in slices(batches, 200):
            digests, rows = [], []
            for page in batch.column(1).to_pylist():
                parsed = Page(page or "")
                digests.append(parsed.own_text())
                rows.append([dict(zip(names, f, strict=True)) for f in sorted(parsed.features())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), pa.array(rows, kind)], names=["host", "page", "found"])

    found = pages.mapInArrow(run, f"host string, page long, found array<{_FEATURE}>")
    once = found.groupBy("host", "page").agg(F.min("found").alias("found"))
    sums = [F.sum(c).alias(c) for c in ("prior", "share", "linked")]
    return once.select("host", F.inline("found")).groupBy("host", "what", "key", "value").agg(F.count(F.lit(1)).alias("n"), *sums)


def _weighed(importance, pages, prior):
    """``importance`` as ``pages`` pages show it, drawn to the prior."""
    return (pages * importance + PRIOR_PAGES * prior) / (pages + PRIOR_PAGES)


def style_tree(counts: DataFrame) -> DataFrame:
    """(host, key, n_pages, presentation, share, linked, importance, main) of every node of the style tree.

    ``counts`` is as in :func:`_counted`.  The entropy is over the node's pages with the logarithm to base n_pages, so it
    lies between 0 and 1 (1 for a node of one page only, which is like no other).
    """
    # -sum(p log p) = log N - sum(n log n) / N, so no window over a hot host is needed
    nodes = counts.where("what = 0").groupBy("host", "key").agg(
        F.sum("n").alias("n_pages"), F.sum(F.col("n") * F.log("n")).alias("s"), *[(F.sum(c) / F.sum("n")).alias(c) for c in ("prior", "share", "linked")]
    )
    entropy = (F.log("n_pages") - F.col("s") / F.col("n_pages")) / F.log("n_pages")
    nodes = nodes.withColumn("presentation", F.when(F.col("n_pages") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), entropy)))
    seen = (1 - F.col("linked")) * (F.col("presentation") + (1 - F.col("presentation")) * F.col("share"))
    chrome = F.col("prior") < (PRIOR[CHROME_PART] + PRIOR[BESIDE]) / 2
    importance = _weighed(F.when(chrome, CHROME_FACTOR).otherwise(1.0) * seen, F.col("n_pages"), F.col("prior"))
    main = (F.col("n_pages") > 1) & (F.col("share") >= MAIN_SHARE) & (F.col("presentation") >= MAIN_PRESENTATION) & (F.col("linked") < 0.5) & ~chrome
    return nodes.select("host", "key", "n_pages", "presentation", "share", "linked", importance.alias("importance"), main.alias("main"))


def common_lines(counts: DataFrame) -> DataFrame:
    """(host, path, value, n, n_pages, importance) of lines that more than one page of a host has at one path."""
    pages = counts.where("what = 1").select("host", "key", F.col("n").alias("n_pages"))
    lines = counts.where("what = 2 and n > 1").withColumn("prior", F.col("prior") / F.col("n")).join(pages, ["host", "key"])
    importance = 1 - F.col("n") / F.col("n_pages")
    return lines.select("host", F.col("key").alias("path"), "value", "n", "n_pages", _weighed(importance, F.col("n_pages"), F.col("prior")).alias("importance"))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """Main text per row of ``pages``: key, url, text, n_chars, n_removed, n_low.

    A null or empty page has an empty text; a page with a null url is its own host of one page, so only its
    declarations count.  Blocks keep page order and are joined by one space; character references are decoded and
    white space inside a block becomes one space.  ``n_low`` counts the blocks that the tree scores low, by their branch
    or as a line, ``n_removed`` those of them that the page's declarations alone would keep.
    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))
    base = pages.select(host.alias("host"), F.col(page)).where("host <> ''")
    counts = scratch.put(_counted(base), "counts")
    nodes = style_tree(counts).where((F.col("n_pages") > 1) & (F.col("main") | (F.col("importance") < min_importance)))
    lines = common_lines(counts).where(F.col("importance") < min_importance)
    told = nodes.select("host", F.when(F.col("main"), 1).otherwise(0).alias("what"), "key", F.lit(None).cast("long").alias("value"))
    told = told.unionByName(lines.select("host", F.lit(2).alias("what"), F.col("path").alias("key"), "value"))
    pick = lambda what, c: F.collect_list(F.when(F.col("what") == what, F.col(c)))
    # the template of a host: what its pages have in common, which does not grow with their number
    told = told.groupBy("host").agg(pick(0, "key").alias("low"), pick(1, "key").alias("main"), pick(2, "key").alias("paths"), pick(2, "value").alias("lines"))
    told = scratch.put(told, "told")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"), host.alias("host"))
    joined = spread_join(rows, told, "host", F.xxhash64("key", "url"), "left").select("key", "url", "page", "host", "low", "main", "paths", "lines")

    def run(batches):
        import pyarrow as pa

        last, sets = None, (set(), set(), set())
        for batch in slices(batches, 200):
            out = []
            for k, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host != last:
                    low, main, paths, values = (batch.column(c)[k].as_py() or [] for c in range(4, 8))
                    last, sets = host, (set(low), set(main), set(zip(paths, values, strict=True)))
                out.append(Page(page or "").main_text(*sets))
            text, removed, unimportant = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(removed, pa.int32()), pa.array(unimportant, pa.int32())],
                names=["key", "url", "text", "n_removed", "n_low"],
            )

    kind = joined.schema["key"].dataType.simpleString()
    found = joined.mapInArrow(run, f"key {kind}, url string, text string, n_removed int, n_low int")
    return found.select(F.col("key").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed", "n_low")
