"""Main text of web pages by tag-path ratios.

Each text node has the path of block tags, with their class and id names, from the
root to it. For each path, text length, punctuation marks and link text are summed and
divided by the path's nodes. The ratios are smoothed along the page, most among nodes
of the same container, and fused into one score with a prior from what the page says
of the path: names of adverts, comments, notices and so on make it small, an article
that holds most of the text makes it larger, and elements that are by definition
menus, footers, forms or controls make it 0.

Paths with a share of the best score are strong: they hold the content. A block of a
weak path is content if it stands in a container that holds strong text itself (or
between strong blocks), unless its names speak against it more than the container's
do, or its path or list is mostly link text. So lists, tables and code of the article stay,
and all that depends on what the ratios found.

Defined cases
    null or empty html     empty text
    no content found       empty text
    broken markup          unclosed tags end with what surrounds them; a tag or
                           comment that never ends is text, a script or style that
                           never ends swallows the rest
    deep nesting           elements below DEPTH count for the element at that depth
    null page_id or url    passed on
    repeated rows          each gives its own row
    very long pages        read whole, in one pass forward
    ties                   paths with the needed share exactly are strong
    extra columns          not read
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from resonant.session import ship


@dataclass(frozen=True)
class ExtractConfig:
    smoothing: float = 0.7  # standard deviation of the Gaussian, in text nodes
    across: float = 0.05  # weight in it of a node of another list or container
    most_length: float = 400.0  # characters a node beyond which a path gains nothing
    most_marks: float = 8.0  # punctuation marks a node beyond which a path gains nothing
    cut: float = 0.2  # share of the best score that makes a path strong
    least_share: float = 0.05  # share of the text that the best path must have
    article: float = 2.0  # prior of an article with most of the text
    card: float = 0.25  # prior of other articles
    most_links: float = 0.6  # share of link text beyond which a weak path is a menu
    against: float = 0.2  # prior of a weak block, against its container's, below which it is left out


# HTML's element kinds, and words by which pages name regions that are not content.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section"
    " select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body center details div html main section".split())
CELLS = frozenset(["td", "th"])
LISTS = frozenset("dl ol table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas textarea noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
SCOPES = frozenset("ul ol dl table select body html div section article".split())
OTHER_TAGS = frozenset("head nav footer aside form button select menu dialog fieldset search title".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
OTHER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs byline cart"
    " comment comments commentlist consent cookie cookies copyright discussion disqus feedback footer gdpr header login masthead menu modal nav"
    " navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion"
    " recommended related replies reply respond responses search share sharing shoutbox sidebar sidenav signup skip social"
    " sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
WRAPPER_WORDS = frozenset("article body container content enabled entry has layout main no page post story text with without wrapper".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
DEPTH = 512

#: What an element's names make of it: a whole name, a part of one, a part that also names headings of sections.
WHOLE, PART, HEADER_PART = 0.05, 0.1, 0.5

_NEXT = re.compile(r"<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)|(?P<comment>!--)|[!?])")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    parent: int
    path: int  # number of its path of block elements
    prior: float  # product over the path, without articles and doubts
    doubt: int  # the nearest element of which part of a name speaks against it, itself included
    container: int  # the nearest container or table cell, itself included
    group: int  # the nearest list, table or container, itself included
    article: int  # the outermost article around, itself included; -1 without
    heading: bool = False
    link: bool = False
    lent: bool = False  # in the header of an article, of which headings count


@dataclass
class Node:
    """A run of text."""

    element: int
    block: int
    text: str
    size: int  # without white space around


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", 0, 0, 1.0, 0, 0, 0, -1)])
    nodes: list[Node] = field(default_factory=list)
    doubts: dict[int, tuple[float, bool]] = field(default_factory=dict)  # by element: prior, and whether comments are named


def prior_of(tag: str, attrs: str, in_article: bool) -> tuple[float, tuple[float, bool] | None, str, str]:
    """What tag, names and attributes say of an element, what parts of its names say, its names, and its role."""
    names, role, prior, doubt = "", "", 1.0, None
    if attrs and not attrs.isspace():
        exempt = tag in ("html", "body", "article", "main") or tag in HEADINGS
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class" or key == "id":
                names += "." + value
                for name in value.split() if not exempt else ():
                    parts = set(_PARTS.split(name))
                    found = OTHER_WORDS & parts
                    if name in OTHER_WORDS:
                        prior = min(prior, WHOLE)
                    elif found and WRAPPER_WORDS.isdisjoint(parts):
                        doubt = (HEADER_PART if found == {"header"} and (not doubt or doubt[0] > PART) else PART, bool(found & COMMENT_WORDS) or bool(doubt and doubt[1]))
            elif key == "role":
                role = value
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
                prior = 0.0
    if tag in OTHER_TAGS or role in OTHER_ROLES or (tag == "header" and not in_article):
        prior = 0.0
    return prior, doubt, names, role


def parse(page: str) -> Page:
    """Elements and text nodes in page order; one pass, forward only."""
    out = Page()
    elements, nodes = out.elements, out.nodes
    paths: dict[tuple[int, str], int] = {}
    stack, open_tags = [0], {"": 1}
    block, at, start, size = 0, 0, 0, len(page)
    quotes = comments = True  # whether a quoted attribute, or a comment, may still end

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            raw = page[lo:hi]
            raw = html.unescape(raw) if "&" in raw else raw
            nodes.append(Node(stack[-1], block, raw, len(raw.strip())))

    def cut(k: int) -> None:
        for e in stack[k:]:
            open_tags[elements[e].tag] -= 1
        del stack[k:]

    while at < size:
        m = _NEXT.search(page, at)
        if m is None:
            break
        found = m.start()
        if m["comment"]:
            end = page.find("-->", found + 4) if comments else -1
            comments = end >= 0
            if not comments:
                at = found + 4  # text
                continue
            text(start, found)
            at = start = end + 3
            continue
        name = m["name"]
        end = -1
        if name and quotes:
            q = _QUOTED.match(page, m.end())
            quotes = q is not None
            end = q.end() if q else -1
        if end < 0:
            end = page.find(">", m.end()) + 1
            if not end:
                break  # no tag ends any more
        text(start, found)
        at = start = end
        if not name:
            continue
        tag, attrs = name.lower(), page[m.end() : end - 1]
        if m["close"]:
            if open_tags.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    e = elements[stack[k]].tag
                    if e == tag:
                        cut(k)
                        break
                    if tag not in BLOCKS and e in BLOCKS:
                        break  # an inline end tag closes nothing outside its block
            block += tag in BLOCKS
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = start = size if stop is None else page.find(">", stop.start()) + 1 or size
                block += tag not in ("svg", "object", "canvas")
            continue
        if tag in BLOCKS:
            block += 1
            for k in range(len(stack) - 1, 0, -1):
                e = elements[stack[k]].tag
                if e == "p":
                    cut(k)
                    break
                if e in BLOCKS:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                e = elements[stack[k]].tag
                if e in CLOSES[tag]:
                    cut(k)
                    break
                if e in SCOPES:
                    break
        if tag == "br":
            nodes.append(Node(stack[-1], block, " ", 0))
        if tag in VOID or attrs.endswith("/") or len(stack) > DEPTH:
            continue
        top = elements[stack[-1]]
        prior, doubt, names, role = prior_of(tag, attrs, top.article >= 0)
        path = top.path
        if tag in BLOCKS:
            path = paths.setdefault((path, tag + names), len(paths) + 1)
        own = len(elements)
        if doubt:
            out.doubts[own] = doubt
        article = own if top.article < 0 and (tag in ("article", "main") or role in ("main", "article")) else top.article
        elements.append(
            Element(
                tag, stack[-1], path, top.prior * prior, own if doubt else top.doubt, own if tag in CONTAINERS or tag in CELLS else top.container,
                own if tag in CONTAINERS or tag in LISTS else top.group, article,
                top.heading or tag in HEADINGS, top.link or tag == "a", top.lent or (tag == "header" and top.article >= 0),
            )
        )
        stack.append(own)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    text(start, size)
    return out


def smooth(values: list[float], groups: list[int], config: ExtractConfig) -> list[float]:
    """Gaussian smoothing along the page, in which nodes of other lists and containers weigh little."""
    sigma = config.smoothing
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i, c in enumerate(groups):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[abs(j - i)]
            if groups[j] != c:
                w *= config.across
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def settle_doubts(page: Page, nodes: list[Node]) -> None:
    """Priors of the elements whose names are in doubt: a region that holds most of the text is none of a page's sides.

    One named after comments must also have no article beside it.
    """
    if not page.doubts:
        return
    e, held, articles, total, all_articles = page.elements, {}, {}, 0.0, 0
    for n in nodes:
        of = e[n.element]
        weight = 0.0 if of.link else n.size * of.prior
        total += weight
        all_articles += of.article >= 0
        d = of.doubt
        while d:
            held[d] = held.get(d, 0.0) + weight
            articles[d] = articles.get(d, 0) + (of.article >= 0)
            d = e[e[d].parent].doubt
    factors = {0: 1.0}
    for d, (prior, comments) in page.doubts.items():  # in page order, outer ones first
        wrapper = 2 * held.get(d, 0.0) > total and not (comments and articles.get(d, 0) < all_articles)
        factors[d] = factors[e[e[d].parent].doubt] * (1.0 if wrapper else prior)
    for of in e:
        of.prior *= factors[of.doubt]


@dataclass
class Path:
    length: int = 0
    marks: int = 0
    linked: int = 0
    count: int = 0
    by_length: float = 0.0  # smoothed, summed over the nodes
    by_marks: float = 0.0
    prior: float = 0.0

    @property
    def links(self) -> float:
        return self.linked / self.length if self.length else 0.0


def path_ratios(page: Page, nodes: list[Node], config: ExtractConfig) -> dict[int, Path]:
    """Sums, smoothed ratios and prior of each path."""
    e = page.elements
    paths: dict[int, Path] = {}
    articles: dict[int, float] = {}
    total = 0.0
    for n in nodes:
        of = e[n.element]
        p = paths.setdefault(of.path, Path())
        p.length += n.size
        p.linked += n.size * of.link
        p.marks += len(PUNCTUATION.findall(n.text))
        p.count += 1
        p.prior = max(p.prior, of.prior)
        if not of.link and of.prior > 0:
            total += n.size * of.prior
            articles[of.article] = articles.get(of.article, 0.0) + n.size * of.prior
    per = [paths[e[n.element].path] for n in nodes]
    homes = [e[n.element].group for n in nodes]
    by_length = smooth([p.length / p.count for p in per], homes, config)
    by_marks = smooth([p.marks / p.count for p in per], homes, config)
    of_article: dict[int, int] = {}
    for n, p, a, b in zip(nodes, per, by_length, by_marks):
        p.by_length += a
        p.by_marks += b
        of_article[e[n.element].path] = e[n.element].article
    for path, article in of_article.items():
        if article >= 0:
            paths[path].prior *= config.article if 2 * articles.get(article, 0) >= total else config.card
    return paths


def path_scores(paths: dict[int, Path], config: ExtractConfig) -> dict[int, float]:
    """Length, punctuation, links and prior, fused."""
    out = {}
    for path, p in paths.items():
        length, marks = min(p.by_length / p.count, config.most_length), min(p.by_marks / p.count, config.most_marks)
        out[path] = math.sqrt(length * (1 + marks)) * (1 - 0.9 * p.links) * p.prior
    return out


def strong_paths(paths: dict[int, Path], scores: dict[int, float], config: ExtractConfig) -> set[int]:
    """The paths with a share of the score of the best one that holds some of the text."""
    weight = {k: p.length * p.prior for k, p in paths.items()}
    least = config.least_share * sum(weight.values())
    best = max((scores[k] for k in paths if weight[k] >= least), default=0.0)
    return {k for k, s in scores.items() if s > 0 and s >= config.cut * best}


def content_blocks(page: Page, nodes: list[Node], config: ExtractConfig) -> set[int]:
    """The numbers of the blocks that are content."""
    e = page.elements
    paths = path_ratios(page, nodes, config)
    scores = path_scores(paths, config)
    strong = strong_paths(paths, scores, config)
    blocks = {n.block for n in nodes if e[n.element].path in strong}
    if not blocks:
        return blocks
    # the containers of strong text, and an article around it, with the prior of their text
    homes: dict[int, float] = {}
    for n in nodes:
        of = e[n.element]
        if of.path in strong:
            for home in {of.container, of.article if of.article >= 0 else of.container}:
                homes[home] = max(homes.get(home, 0.0), of.prior)
    first, last = min(blocks), max(blocks)
    most = max(homes.values())
    known: dict[int, float] = {}

    def home_prior(element: int) -> float:
        chain = []
        while element and element not in known and element not in homes:
            chain.append(element)
            element = e[element].parent
        found = homes[element] if element in homes else known.get(element, 0.0)
        known.update(dict.fromkeys(chain, found))
        return found

    grouped: dict[int, list[int]] = {}
    for n in nodes:
        sums = grouped.setdefault(e[n.element].group, [0, 0])
        sums[0] += n.size
        sums[1] += n.size * e[n.element].link
    kept = set(blocks)
    titles = []
    for n in nodes:
        of = e[n.element]
        if n.block in blocks:
            continue
        around = home_prior(of.container)
        if not around and first < n.block < last:
            around = most
        size, linked = grouped[of.group]
        menu = paths[of.path].links > config.most_links or linked > config.most_links * size
        if around and of.prior >= config.against * around and not menu:
            kept.add(n.block)
        elif of.heading and of.prior >= 1 and n.block < first and not of.link:
            titles.append(n)
    # the headline may stand before the text, outside its container
    if titles and e[titles[-1].element].tag == "h1" and not any(e[n.element].heading for n in nodes if n.block in kept and n.block <= first):
        kept.add(titles[-1].block)
    return kept


def main_text(page: str | None, config: ExtractConfig = ExtractConfig()) -> str:
    """The blocks of the content, white space inside one turned into a space, joined by newlines."""
    if not page:
        return ""
    parsed = parse(page)
    e = parsed.elements
    shown = [n for n in parsed.nodes if e[n.element].prior > 0 and (e[n.element].heading or not e[n.element].lent)]
    solid = [n for n in shown if n.size]
    if not solid:
        return ""
    settle_doubts(parsed, solid)
    held = content_blocks(parsed, solid, config)
    blocks: dict[int, list[str]] = {}
    for n in shown:
        if n.block in held:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


SCHEMA = "page_id long, url string, text string, n_chars long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Pages are read one at a time, nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(p.as_py(), config) for p in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), sizes], schema=_ARROW)

    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
