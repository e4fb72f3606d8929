"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is read once into a flat list of text blocks. Each block knows its
word count and link density, those of the blocks before and after it, and
what its containers are called. A decision tree, grown from the small table of
labelled blocks below, tells article text from the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

# Element names and words of class, id and role attributes (fixed values).
RAW = "script style noscript template title textarea select option iframe object svg math canvas audio video head-only".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("html body main article section div nav header footer aside form ul ol dl table tbody thead tr td th figure details dialog fieldset menu blockquote center button address".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BAD_ELEMENTS = set("nav footer aside form dialog menu button fieldset".split())
GOOD_ELEMENTS = {"article", "main"}
BAD_WORDS = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion
banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets related recommended recommendations
trending popular share sharing social cookie cookies consent gdpr notice notices notification alert popup modal overlay
newsletter subscribe subscription signup signin login paywall form search comment comments disqus reply replies respond
discussion footer masthead topbar copyright legal disclaimer pager pagination toolbar skip complementary contentinfo""".split())
GOOD_WORDS = set("article content main post entry story maincontent articlebody".split())


@dataclass
class Block:
    """One run of text between block-level tags."""

    heading: bool = False
    bad: bool = False
    good: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0


def _flags(name: str, attributes: str, inside_article: bool, attribute) -> tuple[bool, bool]:
    """(bad, good) by an element's name and the words of its attributes."""
    words = {w for _, a, b, c in attribute.findall(attributes) for w in "".join(ch if ch.isalpha() else " " for ch in (a or b or c).lower()).split()} if attributes else set()
    bad = name in BAD_ELEMENTS or (name == "header" and not inside_article) or bool(words & BAD_WORDS) or (bool(words & {"header", "top"}) and not inside_article)
    return bad, not bad and (name in GOOD_ELEMENTS or bool(words & GOOD_WORDS))


def scanner():
    """A function from html to the list of its blocks, in page order."""
    import html as entities
    import re

    raw = "|".join(RAW)
    token = re.compile(
        rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
        rf"|<(?P<raw>{raw})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
        r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S | re.I)
    attribute = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

    def unclosed(m) -> bool:
        """Whether a comment, raw element or CDATA goes on to the page's end."""
        end = "-->" if m[0].startswith("<!--") else "]]>" if m[0][:9].upper() == "<![CDATA[" else ""
        if m["raw"]:
            return not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I)
        return bool(end) and not m[0].endswith(end)

    def scan(page: str | None) -> list[Block]:
        blocks: list[Block] = []
        open_: list[tuple[str, bool, bool]] = []  # (element, bad, good), inherited
        depth: dict[str, int] = {}  # how many of each element are open
        now, link = Block(), None  # link: depth at which <a> was opened

        def close(start: Block) -> Block:
            if now.parts:
                now.text = " ".join("".join(now.parts).split())
                now.words = len(now.text.split())
                if now.text:
                    blocks.append(now)
                now.parts = []
            return start

        def fresh(heading=False, bad=False, good=False) -> Block:
            _, b, g = open_[-1] if open_ else ("", False, False)
            return Block(heading=heading, bad=b or bad, good=g or good)

        def text(piece: str) -> None:
            piece = entities.unescape(piece)
            now.parts.append(piece)
            if link is not None:
                now.linked += len(piece.split())

        page = page or ""
        at = 0
        # Every tag ends by the last ">", so what is open after it is not looked for.
        markup = page.rfind(">") + 1
        for m in token.finditer(page, 0, markup):
            if m.start() > at:
                text(page[at:m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                if at == markup and unclosed(m):
                    at = len(page)
                if m[0][:9].upper() == "<![CDATA[":
                    text(page[m.start() + 9:at].removesuffix("]]>"))
                continue
            if name == "a":
                link = None if m["end"] else len(open_)
            elif name == "br":
                now.parts.append(" ")
            elif name in INLINE:
                pass
            elif m["end"]:
                now = close(now)
                if name in CONTAINERS and depth.get(name):
                    while True:
                        closed = open_.pop()[0]
                        depth[closed] -= 1
                        if closed == name:
                            break
                    if link is not None and len(open_) < link:
                        link = None
                now = fresh()
            else:
                now = close(now)
                bad, good = _flags(name, m["attrs"], bool(depth.get("article")), attribute)
                if name in CONTAINERS and not m["attrs"].endswith("/"):
                    _, b, g = open_[-1] if open_ else ("", False, False)
                    open_.append((name, b or bad, g or good))
                    depth[name] = depth.get(name, 0) + 1
                    now = fresh()
                elif name in VOID:
                    now = fresh()
                else:
                    now = fresh(name in HEADINGS, bad, good)
        if at < len(page):
            # A tag that is never closed is markup, not text.
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!]", rest)
            text(rest[:cut.start()] if cut else rest)
        close(now)
        return blocks

    return scan


FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "heading", "bad", "good", "page_has_good")


def features(blocks: list[Block]) -> list[list[float]]:
    density = [b.linked / b.words if b.words else 0.0 for b in blocks]
    marked = float(any(b.good and not b.bad for b in blocks))
    rows = []
    for i, b in enumerate(blocks):
        before = (blocks[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (blocks[i + 1].words, density[i + 1]) if i + 1 < len(blocks) else (0, 0.0)
        rows.append([float(b.words), density[i], float(before[0]), before[1], float(after[0]), after[1],
                     float(b.heading), float(b.bad), float(b.good), marked])
    return rows


def grow(rows: list[list[float]], labels: list[int], least: int = 1, depth: int = 8):
    """Binary decision tree by Gini impurity: (feature, cut, low, high) or a label."""
    ones = sum(labels)
    if depth == 0 or ones in (0, len(labels)) or len(labels) < 2 * least:
        return int(2 * ones > len(labels))
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda i: rows[i][f])  # noqa: B023
        left = 0
        for k in range(1, len(order)):
            left += labels[order[k - 1]]
            a, b = rows[order[k - 1]][f], rows[order[k]][f]
            if a < b and least <= k <= len(order) - least:
                right = ones - left
                impurity = left * (k - left) / k + right * (len(order) - k - right) / (len(order) - k)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, (a + b) / 2
    if best is None:
        return int(2 * ones > len(labels))
    _, f, cut = best
    low = [i for i in range(len(rows)) if rows[i][f] < cut]
    high = [i for i in range(len(rows)) if rows[i][f] >= cut]
    part = lambda side: grow([rows[i] for i in side], [labels[i] for i in side], least, depth - 1)
    return f, cut, part(low), part(high)


def classify(tree, row: list[float]) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] < cut else high
    return tree


# The labelled table: (blocks as (words, link words, heading, bad, good), labels).
# Page kinds: marked article; marked article with asides inside; plain
# paragraphs without any marked container; link lists; short articles.
LABELLED = [
    ([(1, 1, 0, 1, 0), (1, 1, 0, 1, 0), (2, 2, 0, 1, 0), (12, 0, 0, 1, 0), (10, 0, 1, 0, 1), (60, 0, 0, 0, 1), (4, 0, 0, 0, 1), (35, 2, 0, 0, 1), (14, 0, 0, 1, 0)],
     [0, 0, 0, 0, 1, 1, 1, 1, 0]),
    ([(3, 0, 1, 0, 1), (1, 0, 0, 0, 1), (2, 2, 0, 0, 1), (80, 0, 0, 0, 1), (25, 0, 0, 1, 1), (9, 9, 0, 1, 1), (40, 3, 0, 0, 1), (30, 0, 0, 1, 0)],
     [1, 1, 1, 1, 0, 0, 1, 0]),
    ([(5, 5, 0, 0, 0), (6, 0, 1, 0, 0), (70, 1, 0, 0, 0), (45, 0, 0, 0, 0), (8, 0, 0, 0, 0), (55, 2, 0, 0, 0), (3, 3, 0, 0, 0), (2, 2, 0, 0, 0), (7, 1, 0, 1, 0)],
     [0, 1, 1, 1, 1, 1, 0, 0, 0]),
    ([(2, 2, 0, 0, 0), (2, 2, 0, 0, 0), (3, 3, 0, 0, 0), (4, 0, 0, 0, 0), (30, 0, 0, 0, 0), (28, 0, 0, 0, 0), (2, 2, 0, 0, 0), (3, 0, 0, 0, 0), (2, 2, 0, 0, 0)],
     [0, 0, 0, 0, 1, 1, 0, 0, 0]),
    ([(15, 0, 0, 0, 0), (20, 0, 0, 0, 0), (6, 0, 1, 0, 1), (16, 0, 0, 0, 1), (5, 5, 0, 0, 1), (9, 0, 0, 0, 1), (18, 0, 0, 0, 0), (40, 0, 0, 1, 0)],
     [0, 0, 1, 1, 1, 1, 0, 0]),
    ([(1, 0, 0, 0, 1), (90, 0, 0, 1, 0), (120, 0, 0, 1, 0), (22, 0, 0, 0, 0), (4, 0, 0, 0, 0)],
     [1, 0, 0, 0, 0]),
    ([(3, 0, 1, 0, 0), (12, 0, 0, 0, 0), (1, 1, 0, 0, 0), (65, 0, 0, 1, 0), (33, 30, 0, 0, 0), (14, 12, 0, 0, 0)],
     [1, 1, 0, 0, 0, 0]),
    ([(50, 0, 0, 0, 0), (5, 0, 1, 0, 0), (48, 0, 0, 0, 0), (20, 0, 0, 0, 0), (2, 2, 0, 1, 0), (11, 0, 0, 1, 0)],
     [1, 1, 1, 1, 0, 0]),
]


def train(table=None):
    """The tree grown from a table of labelled blocks."""
    rows, labels = [], []
    for blocks, marks in LABELLED if table is None else table:
        rows += features([Block(words=w, linked=n, heading=bool(h), bad=bool(b), good=bool(g)) for w, n, h, b, g in blocks])
        labels += marks
    return grow(rows, labels)


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Text of article blocks: character references decoded, white space inside
    a block one space, blocks in page order joined by one space. Null and
    empty pages, and pages without article text, give an empty text. Null ids
    and urls pass through; repeated rows come out as often as they go in.
    Tags that are never closed, unclosed scripts and comments end with the
    page. An empty table gives no rows.
    """
    tree = train() if tree is None else tree
    state: dict = {}

    def run(htmls):
        scan = state.get("scan") or state.setdefault("scan", scanner())
        texts = []
        for page in htmls:
            blocks = scan(page)
            texts.append(" ".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if classify(tree, row)))
        return [texts, [len(t) for t in texts]]

    got, (text, n) = add_columns(pages.select("page_id", "url", "html"), "html", run, ["text string", "n_chars long"])
    return got.select("page_id", "url", F.col(text).alias("text"), F.col(n).alias("n_chars"))
