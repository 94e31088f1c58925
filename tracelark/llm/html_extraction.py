"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf path of block tags (inline tags, such as b or a, are
no part of it). For each path the text length (without links) and the punctuation are summed and divided by the number of its
nodes; the logs of both ratios are smoothed along the page (a path takes from its neighbours) and fused into one value. Where a
page has <article> or <main> with content, paths outside count OUTSIDE of their value: the tag is evidence, not a switch.

A path is selected if its value is SHARE of the page's mean or more (the mean over the blocks, weighed by the log of their
length). Short lines, lists and tables that stand beside a selected path in the same area of the page go with it, and so
do headings, but for those of areas with nothing selected. Left out before all that are blocks that are marked as navigation,
header, footer, sidebar, notice, advert, form or comments, controls, and paths that consist of links.

Work and memory grow with the page's length only: a path is a number with a parent, the scanner never looks back, and what is
not found once (the end of a quote or of an element) is not looked for again.

Defined results: a null or empty html, or one without main text, gives an empty string. Unclosed and crossed
tags are tolerated; a tag that the page's end cuts short holds no text. Repeated rows give the same; an empty table gives an empty one.
Columns of the input named text and n_chars are replaced, all others are kept.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The tags of HTML by their part in the layout.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw up to their end tag, and elements whose whole content is no text of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
MUTE = frozenset("noscript template svg math object canvas audio video select button datalist map label option optgroup output progress meter".split())
APART = frozenset("nav footer aside form fieldset legend menu dialog head".split())
CONTAINER = frozenset("article main".split())
#: Tags that lay out text within an area of the page, and are no area of their own.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption center".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A path needs this share of the page's mean value; outside of articles its value counts this much.
SHARE, OUTSIDE = 0.5, 0.6
#: What a path takes from the path before, itself and the path after.
KERNEL = (0.1, 0.8, 0.1)
#: Words of class, id and role names that mark what is not the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promoted|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|rail|widget|footer|masthead|topbar|toolbar|"
    r"header|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|form|share|sharing|social|follow|related|recommended|recommendations|more|trending|popular|tags|pagination|pager|"
    r"comment|comments|commentlist|disqus|respond|replies|reply|discussion|feedback|reactions|copyright|legal|disclaimer|skip|contentinfo|complementary|alertdialog|hidden|sr-only)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|main|body|text)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCT = re.compile(r"[.,;:!?…。，！？、¿¡\"'()]")
_NAME = re.compile(r"/?[a-zA-Z][^\s>/]*")
_STOP = re.compile(r"[\"'>]")
#: What a start tag closes if it is open below it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tr", "td", "th")}
_LISTS = ("ul", "ol", "dl", "table", "menu", "body")
_FLOWING = ("p", "li", "td", "tr")


class Paths:
    """The page's root-to-leaf paths by number; 0 is the root."""

    def __init__(self):
        self.parent, self.tag, self.apart, self.within, self.area, self.header = [0], [""], [False], [False], [0], [False]
        self.known: dict[tuple[int, str, bool], int] = {}

    def below(self, path: int, tag: str, label: str, apart: bool) -> int:
        key = (path, label, apart)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = len(self.parent)
            self.parent.append(path)
            self.tag.append(tag)
            self.apart.append(apart or self.apart[path])
            self.within.append(tag in CONTAINER or self.within[path])
            self.area.append(self.area[path] if tag in FLOW else got)
            self.header.append(self.header[path] or tag == "header" and self.within[path])
        return got


def _tag_end(page: str, at: int, missing: dict[str, int]) -> int:
    """Where the tag that goes on at `at` ends (its >), or -1. A quote opens a value only after =."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        i = m.start()
        q = page[i]
        if q == ">":
            return i
        at = i + 1
        if page[max(0, i - 8):i].rstrip()[-1:] == "=" and i < missing.get(q, len(page)):
            j = page.find(q, at)
            if j < 0:
                missing[q] = i
            else:
                at = j + 1


def blocks(page: str) -> tuple[list[tuple[int, str, int]], Paths]:
    """(path, text, characters within links) of each block with text, in page order, and the paths."""
    paths = Paths()
    out: list[list] = []  # path, parts, link
    stack: list[tuple[str, int, bool]] = []  # tag, path, whether its content is no text
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
    ends: dict[str, list[int]] = {}  # places of end tags, of elements that need one
    missing: dict[str, int] = {}
    path = link = muted = 0
    current: list | None = None

    def cut(k: int) -> None:
        nonlocal muted
        while len(stack) > k:
            tag, _, mute = stack.pop()
            places[tag].pop()
            muted -= mute

    def end_tag(tag: str, after: int) -> int:
        """The first end tag after a place, or -1; the list is used up as the scan goes on."""
        if tag not in ends:
            ends[tag] = [m.start() for m in re.finditer(rf"</{tag}(?=[\s>/])", page, re.I)][::-1]
        left = ends[tag]
        while left and left[-1] < after:
            left.pop()
        return left[-1] if left else -1

    def add(s: str) -> None:
        nonlocal current
        if muted or not s or current is None and s.isspace():
            return
        if current is None:
            current = [path, [], 0]
            out.append(current)
        current[1].append(s)
        if link:
            current[2] += len(s.strip())

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            add(page[at:])
            break
        if i > at:
            add(page[at:i])
        c = page[i + 1:i + 2]
        if c in ("!", "?"):
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                at = n if j < 0 else j + 3
            else:
                j = page.find(">", i)
                at = n if j < 0 else j + 1
            continue
        m = _NAME.match(page, i + 1)
        if m is None:
            add("<")
            at = i + 1
            continue
        name = m[0].lower()
        closing = name[0] == "/"
        tag = name[1:] if closing else name
        j = page.find(">", m.end()) if closing else _tag_end(page, m.end(), missing)
        if j < 0:
            break
        attrs, at = page[m.end():j], j + 1
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                e = end_tag(tag, at)
                if e >= 0:
                    at = page.find(">", e) + 1 or n
                elif tag in ("script", "style"):
                    at = n
            add(" ")
        elif tag in MUTE:
            add(" ")
            if closing:
                if places[tag]:
                    cut(places[tag][-1])
            elif not attrs.endswith("/") and end_tag(tag, at) >= 0:
                places[tag].append(len(stack))
                stack.append((tag, path, True))
                muted += 1
        elif tag in BLOCK:
            if closing:
                if places[tag] and not (tag in _FLOWING and places[tag][-1] < max((places[x][-1] for x in CONTAINER if places[x]), default=-1)):
                    cut(places[tag][-1])
            else:
                if stack and stack[-1][0] == "p":
                    cut(len(stack) - 1)
                if tag in _CLOSES:
                    least = max((places[x][-1] for x in _LISTS if places[x]), default=-1)
                    open_ = [places[x][-1] for x in _CLOSES[tag] if places[x] and places[x][-1] > least]
                    if open_:
                        cut(min(open_))
                if tag == "body" and places["head"]:
                    cut(places["head"][-1])
                label, apart = _entry(tag, attrs, bool(places["article"] or places["main"]))
                places[tag].append(len(stack))
                stack.append((tag, paths.below(stack[-1][1] if stack else 0, tag, label, apart), False))
            path, current, link = stack[-1][1] if stack else 0, None, 0
        elif tag == "a":
            link = max(0, link + (-1 if closing else 1))
        elif tag == "br":
            add(" ")
    got = []
    for p, parts, links in out:
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            got.append((p, text, min(links, len(text))))
    return got, paths


def _entry(tag: str, attrs: str, within: bool) -> tuple[str, bool]:
    """The tag's label in a path, and whether it is marked as no part of the article."""
    names, label = "", tag
    if attrs and not attrs.isspace():
        a = {k.lower(): v or w or x or "" for k, v, w, x in _ATTR.findall(attrs)}
        names = " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label")).strip()
        if a.get("class"):
            label = f"{tag}.{'.'.join(a['class'].split())}"
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            return label, True
    apart = tag in APART or tag == "header" and not within
    if not apart and names and tag not in ("html", "body") and MARKED.search(names):
        rest = re.sub(r"header", "", names, flags=re.I) if _GOOD.search(names) else names  # post-header is no page header
        apart = bool(MARKED.search(rest)) and tag not in CONTAINER
    return label, apart


def ratios(found: list[tuple[int, str, int]]) -> dict[int, float]:
    """The fused ratio of each path: logs of its text and punctuation ratios, smoothed along the page, links taken off."""
    order = list(dict.fromkeys(b[0] for b in found))
    size, punct, links, nodes = (defaultdict(float) for _ in range(4))
    for path, text, link in found:
        size[path] += len(text)
        punct[path] += len(_PUNCT.findall(text))
        links[path] += link
        nodes[path] += 1
    raw = np.log1p(np.array([[(size[p] - links[p]) / nodes[p], punct[p] / nodes[p] * (1 - links[p] / size[p])] for p in order]).reshape(-1, 2))
    smooth = np.stack([np.convolve(np.pad(raw[:, k], 1, mode="edge"), KERNEL, "valid") for k in (0, 1)], 1) if len(order) > 1 else raw
    return {p: math.sqrt(max(0.0, a * b)) for p, (a, b) in zip(order, smooth)}


def selected(able: list[tuple[int, str, int]], value: dict[int, float], paths: Paths) -> set[int]:
    """The paths that are content, by value; able are the blocks that no mark leaves out."""
    if any(paths.within[p] and value[p] > 0 for p, _, _ in able):
        value = {p: v if paths.within[p] else OUTSIDE * v for p, v in value.items()}
    weight = [math.log1p(len(t)) for _, t, _ in able]
    floor = SHARE * sum(w * value[b[0]] for w, b in zip(weight, able)) / sum(weight)
    own = {b[0] for b in able}
    chosen = {p for p in own if value[p] >= floor}
    heading = lambda p: paths.tag[p] in HEADING
    areas = {paths.area[p] for p in chosen if not heading(p)} or {paths.area[p] for p in chosen}
    got = {p for p in own if not heading(p) and (p in chosen or paths.area[p] in areas)}
    # areas, with those around them, that hold text besides headings, and those that hold content
    holds, keeps = set(), set()
    for into, some in ((holds, (p for p in own if not heading(p))), (keeps, got)):
        for p in some:
            while p not in into:
                into.add(p)
                p = paths.parent[p]
    whole = {p for p in own if heading(p) and (paths.tag[p] == "h1" or paths.area[p] in keeps or paths.area[p] not in holds)}
    return got | whole


def extract(page: str | None) -> str:
    found, paths = blocks(page or "")
    size, links = defaultdict(int), defaultdict(int)
    for p, text, link in found:
        size[p] += len(text)
        links[p] += link
    able = [b for b in found if not paths.apart[b[0]] and links[b[0]] <= 0.6 * size[b[0]]]
    # the lines of an article's own header besides headings: author, date
    able = [b for b in able if not (paths.header[b[0]] and paths.tag[b[0]] not in HEADING)]
    if not able:
        return ""
    chosen = selected(able, ratios(found), paths)
    return "\n".join(text for p, text, _ in able if p in chosen)


def _map(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            texts = [extract(x) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*(c for i, c in enumerate(part.schema.names) if i != at), "text", "n_chars"])


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars (code points); columns of these names are replaced."""
    from pyspark.sql import types as T

    src = pages.drop(*[c for c in ("text", "n_chars") if c in pages.columns and c != column])
    at = src.columns.index(column)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema if f.name != column] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return src.mapInArrow(lambda it: _map(it, at), schema)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
