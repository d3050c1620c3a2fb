"""Main text of web pages by site style trees.

A first pass parses each page into elements and merges the trees of a host: an element's place is its path of tags, classes
and ids from the root. For each place of a host, and of all hosts together, the entropies of its contents and of its child
sequences over the pages are computed by aggregation; divided by the logarithm of the number of pages they are its importance
(1: differs on every page, 0: always the same). Equal pages of a host count once, and so do equal main contents for the places
inside them: a text that many pages copy is still their text. Hosts with fewer than ``PAGES`` pages at a place take that of
all hosts. A second pass drops, from each page, branches whose place is unimportant, and those whose tag or class names menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments. ``article`` and ``main`` elements are a prior:
inside them a place is dropped under ``INSIDE`` only, and inline elements stay with their block; beside them, a text is read
if its place is known to be important on enough pages. In a page without such elements all that isn't dropped is read.

Null or empty html gives an empty text; a page without a host joins the group of pages without one. Null or repeated ids and
extra columns pass, as pages are joined only to a table with one row per host; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import arrow, cut, lookup

#: A host's own importance of a place counts from so many pages on; places under LEAST are dropped, and under INSIDE in main content.
PAGES, LEAST, INSIDE = 20, 0.5, 0.1

# Fixed word lists: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav header footer aside form button select option datalist dialog menu object audio video canvas map head".split())
MAIN_TAGS = frozenset(["article", "main"])
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar "
    "footer colophon copyright sidebar aside widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login search form comment comments commentlist disqus reply replies respond pagination pager skip toolbar".split()
)
#: Elements that a start tag ends when they are open, up to the nearest element that holds them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|[!?/][^>]*(?:>|$))", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLANK = re.compile(r"\s+")
_PART = re.compile(r"[a-zA-Z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|$)", re.I) for t in RAW}
_MASK = (1 << 63) - 1


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Node:
    """An open element: its place, whether it gives no text by its names or by its importance, whether it is in main content or holds some."""

    __slots__ = ("dropped", "holds", "main", "noise", "parts", "place", "tag")

    def __init__(self, tag: str, place: int, noise: bool, dropped: bool, main: bool):
        self.tag, self.place, self.noise, self.dropped, self.main, self.holds = tag, place, noise, dropped, main, False
        self.parts: list[str] = []  # texts, and digests of inner elements


_places: dict[tuple, tuple[int, bool]] = {}


def _place(parent: int, tag: str, attributes: str) -> tuple[int, bool]:
    """The key of a place, and whether its element's names say noise."""
    key = (parent, tag, attributes)
    if (known := _places.get(key)) is None:
        names = sorted({m[1].lower() + "=" + (m[2] or m[3] or m[4] or "").lower() for m in _NAMED.finditer(attributes)}) if attributes else []
        noise = tag in NOISE_TAGS or any(p.lower() in NOISE_NAMES for n in names for p in _PART.findall(n.split("=", 1)[1]))
        if len(_places) > 50_000:
            _places.clear()
        known = _places[key] = (xxhash.xxh3_64_intdigest(f"{parent} {tag} {' '.join(names)}") & _MASK, noise)
    return known


def walk(html: str, dropped: frozenset[int] = frozenset(), overruled: frozenset[int] = frozenset()) -> tuple[list[tuple[str, bool]], dict[int, tuple[list[str], list[str], bool]], list[str]]:
    """Blocks of text as (text, main text by tag or importance); for each place its elements' digests and child tags, and whether
    it is in main content; digests of the main contents.

    Branches that are noise by name, or at a dropped place outside main content, give no blocks. Main content within a dropped
    place isn't dropped with it, and html and body never are. At ``overruled`` places importance overrules the tag: in main
    content they give no blocks, beside it theirs count as main text. Places that names or the tags html and body decide aren't
    listed, nor inline ones in main content."""
    root = Node("", 0, False, False, False)
    stack, blocks, line = [root], [], []
    seen: dict[int, tuple[list[str], list[str], bool]] = {}
    mains: list[str] = []
    at, n = 0, len(html)

    def put(raw: str) -> None:
        if not raw:
            return
        top = stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        top.parts.append(text)
        if not (top.noise or top.dropped):
            line.append(text)

    def flush() -> None:
        if line:
            if text := _BLANK.sub(" ", "".join(line)).strip():
                blocks.append((text, next((x for x in reversed(stack) if x.tag not in INLINE), root)))
            line.clear()

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1].tag not in INLINE:
                flush()
            node = stack.pop()
            digest = xxhash.xxh3_64_hexdigest(_BLANK.sub(" ", " ".join(node.parts)).strip())
            stack[-1].parts.append(digest)
            if node.place in seen:
                seen[node.place][0].append(digest)
            if node.main and not stack[-1].main:
                mains.append(digest)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            put(html[at:])
            break
        m = _TAG.match(html, lt)
        if m is None:  # a lone less-than sign
            put(html[at : lt + 1])
            at = lt + 1
            continue
        put(html[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in MAIN_TAGS and tag in INLINE:
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:  # its content isn't markup, and never main text
            end = _END_OF[tag].search(html, at)
            at = end.end() if end else n
            continue
        if tag not in INLINE:  # ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
            if tag in _ENDS:
                ends, holders = _ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in holders:
                        break
                    if stack[k].tag in ends:
                        close(k)
            flush()
        elif tag in ("br", "wbr", "img"):
            if tag == "br":
                put(" ")
            continue
        place, named = _place(stack[-1].place, tag, m[3].strip())
        parent = stack[-1]
        if parent.place in seen:
            seen[parent.place][1].append(tag)
        if tag in VOID:
            continue
        if tag in ("html", "body"):
            named = False
        if tag == "header" and parent.main:  # an article's own head holds its title
            named = False
        main = parent.main or tag in MAIN_TAGS and not named
        if main and not parent.main:
            for x in stack:
                x.holds = True
        noise = parent.noise or named
        judged = not noise and tag not in ("html", "body") and not (main and tag in INLINE)
        if judged:
            seen.setdefault(place, ([], [], main))
        stack.append(Node(tag, place, noise, judged and place in (overruled if main else dropped) or parent.dropped and main == parent.main, main))
    close(1)
    flush()
    tagged = any(x.main for _, x in blocks)
    return [(text, tagged and (x.main or x.place in overruled and not x.holds)) for text, x in blocks], seen, mains


def main_text(html: str | None, dropped: frozenset[int] = frozenset(), overruled: frozenset[int] = frozenset()) -> str:
    """Main text of a page: its blocks in order, one to a line."""
    blocks, _, _ = walk(html or "", dropped, overruled)
    main = [t for t, inside in blocks if inside]
    return "\n".join(main if main else [t for t, _ in blocks])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, place, kind, value, page): kind 0 is a place's text, 1 its child tags, and 2 more outside main content. Equal pages have the same
    key, or equal main contents for places inside."""
    for batch in batches:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, seen, mains = walk(page or "")
            own, keys = host(url), [xxhash.xxh3_64_intdigest(x) & _MASK for x in (page or "", " ".join(mains))]
            for place, (text, tags, main) in seen.items():
                key = keys[main]
                for kind, value in enumerate((" ".join(text), " ".join(tags)), 0 if main else 2):
                    for column, x in zip(out, (own, place, kind, xxhash.xxh3_64_intdigest(value) & _MASK, key), strict=True):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["host", "place", "kind", "value", "page"])


def _importance(counted: DataFrame, *keys: str) -> DataFrame:
    """Entropy of the values over the pages of a place, as a share of its greatest possible value. The greater of the two kinds counts."""
    c = F.col("n").cast("double")
    each = counted.groupBy(*keys, "kind").agg(F.sum("n").alias("pages"), F.sum(c * F.log(c)).alias("s"))
    entropy = F.log(F.col("pages").cast("double")) - F.col("s") / F.col("pages")
    each = each.withColumn("importance", F.when(F.col("pages") > 1, entropy / F.log(F.col("pages").cast("double"))).otherwise(1.0))
    return each.groupBy(*keys).agg(F.max("pages").alias("pages"), F.max("importance").alias("importance"), F.max(F.col("kind") > 1).alias("outside"))


def style_trees(pages: DataFrame) -> DataFrame:
    """Importance of every listed place of every host: host, place, pages, importance, whether it is outside main content, and whether enough pages say so."""
    rows = arrow(pages.select("url", "html"), _features, "host string, place long, kind long, value long, page long").distinct()  # copies count once
    counted = cut(rows.groupBy("host", "place", "kind", "value").agg(F.count("*").alias("n")))
    by_host = _importance(counted, "host", "place")
    by_all = _importance(counted.groupBy("place", "kind", "value").agg(F.sum("n").alias("n")), "place").select("place", F.col("pages").alias("all_pages"), F.col("importance").alias("all_importance"))
    enough, enough_in_all = F.col("pages") >= PAGES, F.col("all_pages") >= PAGES
    importance = F.when(enough, F.col("importance")).when(enough_in_all, F.col("all_importance")).otherwise(1.0)
    return by_host.join(by_all, "place").select("host", "place", "pages", importance.alias("importance"), "outside", (enough | enough_in_all).alias("sure"))


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    low = F.col("importance") < F.when(F.col("outside"), least).otherwise(min(least, INSIDE))
    places = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("place"))))
    outside = F.col("outside")
    hosts = style_trees(pages).groupBy("host").agg(places(outside & low).alias("dropped"), places(F.when(outside, F.col("sure") & ~low).otherwise(low)).alias("overruled"), F.max(~outside).alias("tagged"))
    overruled = F.when(F.col("tagged"), F.col("overruled"))  # without main content there's no tag to overrule
    dropped = cut(hosts.select("host", "dropped", overruled.alias("overruled")).where((F.size("dropped") > 0) | (F.size("overruled") > 0)))
    own = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = lookup(pages.select("page_id", "url", "html", own.alias("host")), dropped, "host").select("page_id", "url", "html", "dropped", "overruled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, frozenset(d or ()), frozenset(o or ())) for h, d, o in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow(joined, run, f"page_id {kind}, url string, text string, n_chars long")
