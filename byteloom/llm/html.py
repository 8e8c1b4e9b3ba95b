"""Main-text extraction by tag-path ratios.

A page becomes a list of blocks, each with the path of block-level tags (with class and id names) from the root down to
it. All blocks of one path are judged together, as a template gives its parts paths of their own:

* text ratio: characters of a path's blocks, links not counted, per block;
* punctuation ratio: sentence marks of a path's blocks per block;
* both are smoothed over the path's neighbours in page order, weighted by a Gaussian, so that a heading or a short
  paragraph amid the article keeps the article's level;
* they are fused as text ratio x log(1 + punctuation ratio), times the weight of the path, and paths below THRESHOLD of
  the page's mean fused ratio, weighted by text, are dropped.

A path's weight is 1 unless tags, roles or names along it say what they hold. Those that can hold nothing to read
(``script``, ``select``, ``hidden``, ...) make it zero. ``nav``, ``footer``, ``ad``, ``cookie``, ``comments`` and the like
make it NAMED of what it was; such a word beside others that tell nothing of a page's parts (``social-science``), or one
that has other meanings (``popular``), make it DOUBTED or UNSURE of that. So names alone drop no long passage that they
don't clearly name, and a name on a wrapper of most of the page's text counts for nothing (``settle``). All such words are
fixed values below.

Content also has to lie in the region that holds most of the content paths' text: the deepest section that holds SHARE of
it (or ``article`` and ``main``, if together they hold SHARE). Within the region, a path of a tag of PARTS (a heading, a
paragraph, an item, ...) stays whatever its ratio, if no name in the region lowers it; other paths (``div``, ``section``,
loose text) stay only if their ratio passes before smoothing too, as an advert or a copyright line amid paragraphs is
lifted by them.

Paths are numbers, given to (number of the parent's path, own name), and each step walks nodes or blocks once, so time
and memory grow with the page's length, however deep tags are nested.

Nulls and edge cases: null or empty html, and pages with no content, give an empty text; tags that are cut off or
never closed end with the page or with the tag around them; text outside any tag is a block; repeated rows give equal
texts; an empty table gives no rows. ``extract`` passes on the columns asked for and replaces any named ``text``.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from byteloom.llm.common import batch_input

# Names of HTML elements, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math canvas object select".split())
HIDDEN = RAW | frozenset("head form button nav footer aside header menu dialog fieldset datalist label option audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Open tags that a tag closes, unless one of the others was opened since.
SAME_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
SECTIONS = frozenset("article main section div body td".split())
#: Headings and what belongs to running text whatever its ratio: paragraphs, items, cells, code, quotes.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption pre blockquote".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner billboard sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation menu menus submenu topbar toolbar breadcrumb breadcrumbs pagination pager toc
    header masthead footer foot copyright colophon legal disclaimer
    sidebar aside rail widget widgets related recommended recommendations teaser teasers trending popular more
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox paywall
    comment comments commentlist discussion disqus replies reply respond reader readers feedback
    share sharing social follow subscribe subscription newsletter signup login search form tags tagcloud byline meta skip""".split()
)
#: Words that wrappers of whole pages hold too (``with-sidebar``). By any other word, more is asked of a wrapper.
LAYOUT_WORDS = frozenset("sidebar aside rail header masthead nav navbar navigation menu menus topbar toolbar toc breadcrumb breadcrumbs widget widgets search form login more meta skip tags".split())
#: Words of BOILER_WORDS that articles use of themselves, too.
DOUBTFUL_WORDS = frozenset("reader readers popular more legal rail feedback skip meta tags trending aside discussion respond reply replies alert follow banner social".split())
#: Words that say nothing about what a part holds.
NEUTRAL_WORDS = frozenset("list box wrap wrapper container section block area item items inner outer site page pages top bottom left right bar links link post posts article articles news primary secondary global user content body text main entry col column row group panel unit title slot div id by the of for in on and view btn button form policy us entries card cards".split())
READER_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond reader readers feedback".split())
#: Tags that hide what they hold, whatever its size; those left of HIDDEN only speak against it.
UNSEEN = RAW | frozenset("head button datalist option audio video map".split())
MARKS = re.compile(r"[.,;:!?…、。，！？¿¡]")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

THRESHOLD, SHARE, SPREAD = 0.3, 0.85, 1.0
NAMED, DOUBTED, UNSURE = 0.01, 0.35, 0.5


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    path: int
    depth: int
    unseen: bool  # hidden, with all it holds
    named: bool  # its own tag, role or name speaks against it
    added: bool  # by more than LAYOUT_WORDS or a form
    lowered: float = 1.0  # by names that may mean something else
    in_article: bool = False
    weight: float = 1.0  # set by ``settle``
    plain: int = 0  # characters outside links that it holds
    held: int = 0  # characters of chosen blocks that it holds
    mark: bool = False


@dataclass
class Block:
    node: Node
    text: str
    linked: int  # characters inside links
    fused: float = 0.0
    own: float = 0.0  # the path's ratio before smoothing


def speaks_against(value: str, words: frozenset[str] = BOILER_WORDS) -> tuple[set[str], float]:
    """The words of a class or id that clearly name boilerplate, and how far the others lower it."""
    clear, lowered = set(), 1.0
    for name in value.split():
        own = {w.lower() for w in WORD.findall(name)}
        bad = own & words
        if not bad:
            continue
        if bad <= DOUBTFUL_WORDS:
            lowered = min(lowered, UNSURE)
        elif own - words - NEUTRAL_WORDS:
            lowered = min(lowered, DOUBTED)
        else:
            clear |= bad - DOUBTFUL_WORDS
    return clear, lowered


@dataclass
class _Reader:
    """Turns tags and text into blocks."""

    blocks: list[Block] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    node: Node = field(default_factory=lambda: Node("", None, 0, 0, False, False, False))
    nodes: list[Node] = field(default_factory=list)  # each after its parent
    opened: dict[str, list[Node]] = field(default_factory=dict)  # by tag, outermost first
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", html.unescape("".join(self.text))).strip()
            if text:
                self.blocks.append(Block(self.node, text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.links:
            self.linked += len(text.strip())

    def innermost(self, tags: str) -> Node | None:
        found = [self.opened[t][-1] for t in tags.split() if self.opened.get(t)]
        return max(found, key=lambda n: n.depth, default=None)

    def leave(self, node: Node) -> None:
        """Closes a node and all that are open in it."""
        self.flush()
        self.links = 0
        while self.node is not node.parent:
            self.opened[self.node.tag].pop()
            self.node = self.node.parent

    def open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = 1
            return
        self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            while self.node.tag == "p":
                self.leave(self.node)
        if tag in SAME_CLOSES:
            closed, within = SAME_CLOSES[tag]
            limit = self.innermost(within)
            while (at := self.innermost(closed)) and (limit is None or at.depth > limit.depth):
                self.leave(at)
        self.node = self._made(tag, attributes)
        self.nodes.append(self.node)
        self.opened.setdefault(tag, []).append(self.node)

    def _made(self, tag: str, attributes: str) -> Node:
        name, unseen, within = tag, self.node.unseen or tag in UNSEEN, bool(self.opened.get("article"))
        named, lowered = tag in HIDDEN, 1.0
        added = named and tag != "form"
        # The page's own header may hold the article's title; only one inside the article is content.
        words = BOILER_WORDS - {"header"} if within else BOILER_WORDS if tag != "article" else READER_WORDS
        for m in ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                name += ("." if key == "class" else "#") + value
                if tag not in ("body", "html", "main"):  # an article of its own may be named in any way; a comment is none
                    clear, less = speaks_against(value, words)
                    named, added, lowered = named or bool(clear), added or bool(clear - LAYOUT_WORDS), min(lowered, less)
            elif key == "role":
                named |= value.lower() in BOILER_ROLES
                added |= value.lower() in BOILER_ROLES - {"form", "search"}
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                unseen = True
            elif key == "style":
                unseen |= "display:none" in value.replace(" ", "").lower()
        if tag == "header" and within:
            named, lowered = False, 1.0
        path = self.paths.setdefault((self.node.path, name), len(self.paths) + 1)
        return Node(tag, self.node, path, self.node.depth + 1, unseen, named, added, lowered, self.node.in_article or tag in ("article", "main"))

    def close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = 0
            return
        if self.opened.get(tag):
            self.leave(self.opened[tag][-1])
        else:
            self.flush()


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The nodes, each after its parent, the root first; and the blocks in page order."""
    reader, at = _Reader(), 0
    reader.nodes.append(reader.node)
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            reader.add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                reader.add(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            reader.close(tag)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            if tag not in ("svg", "math"):
                reader.flush()
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else len(page)
        else:
            reader.open(tag, m[3])
    reader.add(page[at:])
    reader.flush()
    settle(reader.nodes, reader.blocks)
    return reader.nodes, reader.blocks


def settle(nodes: list[Node], blocks: list[Block]) -> None:
    """Sets the nodes' weights.

    A name that speaks against a node counts for all that it holds, unless the node is a wrapper: it holds ``main``, or
    most of the page's plain text with next to nothing left outside such names (no sentence at all, if its tag, role or
    name is more than one of layout). Nodes with most of the text lie within one another, so they are tried from the
    outermost inwards, until one isn't a wrapper.
    """
    for b in blocks:
        if not b.node.unseen:
            b.node.plain += len(b.text) - b.linked
    for n in reversed(nodes):
        n.mark |= n.tag == "main" and not (n.unseen or n.named)
        if n.parent is not None:
            n.parent.plain += n.plain
            n.parent.mark |= n.mark
    for n in nodes:
        n.named &= not n.mark
    total = nodes[0].plain
    wrappers = [n for n in nodes if n.named and not n.unseen and 2 * n.plain > total]
    chain = {id(n) for n in wrappers}
    around: dict[int, int] = {}  # how many of the wrappers hold a node
    against: dict[int, bool] = {}  # whether another name does
    for n in nodes:
        up = id(n.parent)
        around[id(n)] = around.get(up, 0) + (id(n) in chain)
        against[id(n)] = against.get(up, False) or n.unseen or n.named and id(n) not in chain
    sizes, marks = [0] * (len(wrappers) + 1), [False] * (len(wrappers) + 1)
    for b in blocks:
        if not against[id(b.node)] and b.linked < len(b.text):
            k = around[id(b.node)]
            sizes[k] += len(b.text) - b.linked
            marks[k] = marks[k] or MARKS.search(b.text) is not None
    left, sentence = 0, False
    for n, size, mark in zip(wrappers, sizes, marks):
        left, sentence = left + size, sentence or mark
        if sentence if n.added else left > (1 - SHARE) * total:
            break
        n.named = False
    for n in nodes:
        above = n.parent.weight if n.parent is not None else 1.0
        n.weight = 0.0 if n.unseen else above * (NAMED if n.named else n.lowered if 2 * n.plain <= total else 1.0)


def rate(blocks: list[Block]) -> None:
    """Sets each block's ratios: those of its path, fused, before and after smoothing."""
    paths: dict[int, list] = {}
    for b in blocks:
        stats = paths.setdefault(b.node.path, [0, 0, 0])
        if b.node.weight:
            stats[0] += len(b.text) - b.linked
            stats[1] += len(MARKS.findall(b.text))
        stats[2] += 1
    reach = math.ceil(2 * SPREAD)
    kernel = [math.exp(-(d * d) / (2 * SPREAD * SPREAD)) for d in range(reach + 1)]
    # Each path is smoothed over the blocks around its own; a path's level is the mean over its blocks.
    levels: dict[int, list] = {p: [0.0, 0.0] for p in paths}
    for k, b in enumerate(blocks):
        text = marks = weight = 0.0
        for j in range(max(0, k - reach), min(len(blocks), k + reach + 1)):
            w = kernel[abs(j - k)]
            s = paths[blocks[j].node.path]
            text, marks, weight = text + w * s[0] / s[2], marks + w * s[1] / s[2], weight + w
        levels[b.node.path][0] += text / weight
        levels[b.node.path][1] += marks / weight
    for b in blocks:
        text, marks, n = paths[b.node.path]
        smooth_text, smooth_marks = (x / n for x in levels[b.node.path])
        b.fused = b.node.weight * smooth_text * math.log1p(smooth_marks)
        b.own = b.node.weight * text / n * math.log1p(marks / n)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    rate(blocks)
    size = sum(len(b.text) * b.node.weight for b in blocks if b.fused > 0)
    mean = sum(b.fused * len(b.text) * b.node.weight for b in blocks) / size if size else 0.0
    own = sum(b.own * len(b.text) * b.node.weight for b in blocks if b.fused > 0) / size if size else 0.0
    chosen = [b for b in blocks if b.fused > 0 and b.fused >= THRESHOLD * mean]
    if not chosen:  # no sentence anywhere: whatever names speak least against
        best = max(b.node.weight for b in blocks)
        chosen = [b for b in blocks if b.node.weight == best > NAMED and b.linked < len(b.text)]
    total = sum(len(b.text) for b in chosen)
    if not total:
        return ""
    for b in chosen:
        b.node.held += len(b.text)
    for n in reversed(nodes[1:]):
        n.parent.held += n.held
    # The deepest section that holds most of the content; articles side by side are content together.
    region = max((n for n in nodes if n.held >= SHARE * total and (n.tag in SECTIONS or n.parent is None)), key=lambda n: n.depth)
    # Cards and comments are articles too: the tags count if they hold as much as a region has to.
    articles = sum(len(b.text) for b in chosen if b.node.in_article) >= SHARE * total
    least: dict[int, float] = {}  # the weight that nodes of the region have unless a name in it lowers them
    for n in nodes:
        start = n.held > 0 and n.tag in ("article", "main") if articles else n is region
        above = least.get(id(n.parent))
        if above is not None or start:
            least[id(n)] = n.weight if above is None else above
    out = []
    for b in blocks:
        level = least.get(id(b.node))
        if level is None and not articles and b.node.tag == "h1":  # a page's one title may stand before the region
            level = region.weight
        if level is None or not b.node.weight:
            continue
        part = b.node.tag in PARTS and b.linked < len(b.text) and b.node.weight >= level
        content = b.fused >= THRESHOLD * mean and b.own >= THRESHOLD * own if own else b.linked < len(b.text) and b.node.weight >= level
        if content or part:
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the main text of ``html_col``, to the columns kept."""
    names = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    rows, at = batch_input(pages, names, html_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*names, "text"])

    schema = StructType([*pages.select(*names).schema, StructField("text", StringType())])
    return rows.mapInArrow(run, schema)
