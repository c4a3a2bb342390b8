"""Main text of web pages by minimum cut.

A page is read as a sequence of text blocks, each with the elements it lies in. A classifier gives a block a cost for
being kept and one for being dropped: the log odds of what its text looks like (length, link share, how it ends), and of
what the elements around it say; these are the capacities to and from the terminals. Neighbouring blocks and blocks with
a near common ancestor are joined by edges whose capacity is the price of telling them apart. The minimum cut, found by
augmenting paths, separates the article from the rest.

The classifier's weights for texts and the edges' capacities are fitted, in each run, to ``sample`` pages of the table
(in the order of a hash): there, blocks that an article or main element holds are taken for content, blocks in
elements like nav or footer for the rest, and how often related blocks agree gives the capacities. Both are drawn to
fixed starting values, which alone count where a table has no such elements. What an element around a block says
against it counts for less the more of the page's text the element holds. Neither side is so sure that the cut could
not overrule it: a short line between paragraphs follows them, whatever it looks like.

Pages are independent, so the rest is one pass with no shuffle. Null html is an empty page; a page without blocks has
an empty text; rows that repeat a page are read each; other columns are ignored. Pages of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import pieces

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long, n_moved long"

# fixed values: element names of HTML
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
#: an open element that the start of another ends, up to the element that bounds the search
IMPLIED_END = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}
IMPLIED_END = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED_END.items()}
#: elements, and words in class, id and role, that speak for or against the article
AGAINST_TAG = frozenset("nav header footer aside form menu dialog fieldset button".split())
#: of these, what may hold articles that are not the page's; what others say ends at an article, and all of it at main
FIRM_TAG = AGAINST_TAG - {"form", "fieldset", "header"}
FIRM_WORD = frozenset("ad ads advert adverts advertisement advertising comment comments disqus discussion promo promoted promotion related reply replies respond sponsor sponsored".split())
READER_WORD = frozenset("comment comments disqus discussion reply replies respond related".split())
FOR_TAG = frozenset("article main".split())
WORD = re.compile(r"[a-z]+")
AGAINST_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "discussion footer foot header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager "
    "popup promo promoted promotion related reply replies respond search share sharing shares sidebar sidenav social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets overlay login signup gdpr copyright legal disclaimer alert complementary contentinfo dialog".split()
)
FOR_WORD = frozenset("article content post entry story main body text blog prose maintext".split())

#: the last but two: a tag whose quotes don't close
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*(?:>|\Z)|<(?=[^a-zA-Z/!?])|<", re.S)
NEGATED = re.compile(r"(?:no|not|non|has|with|without|hide)[-_]", re.I)
NAMES = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ATTR = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
END_OF = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
SPACES = re.compile(r"\s+")
#: how a line about rights begins
RIGHTS = re.compile(r"©|\(c\)\s|copyright\s*(?:©|\(c\)|[0-9]{4}|by\b)", re.I)

ARTICLE_LEAST = 25  #: code points in an article or main element, links aside, that make a page's own text
SAMPLE = 2000  #: pages that weights and capacities are fitted to, at most
#: starting values of the text's log odds, more for the rest: by length in code points up to each bound, by share of linked
#: text up to each bound, whether the last character ends a sentence, a heading, a list item, a line about rights
LENGTHS, LINKS = (24, 59, 119, 299), (0.0, 0.25, 0.5)
START = np.array([0.6, 0.1, -0.3, -0.8, -1.0, -0.3, 0.0, 0.5, 1.6, 0.2, -0.5, -0.5, 0.3, 1.5])
DRAWN = 40.0  #: how many blocks the starting values count as much as
SEEN = 2000.0  #: blocks that the sample counts as, at most
TEXT_MOST = 2.0  #: the text's log odds are cut to this
FOR, AGAINST = -2.5, 3.0  #: log odds of lying in an article, of lying in something that isn't one
EDGE_MOST = 1.5  #: capacity of an edge, at most
#: how often related blocks agree and differ before any is counted: with the same elements for or against around them; with others
AGREE = ((20.0, 1.0), (1.0, 2.0))


class Block:
    __slots__ = ("parts", "path", "linked", "size", "around", "against", "inside", "heading", "item", "article")

    def __init__(self, path, against, inside, heading, item, article):
        self.article = article
        self.parts, self.linked, self.size, self.around = [], 0, 0, (against, inside)
        self.path, self.against, self.inside, self.heading, self.item = path, against, inside, heading, item


def is_hidden(attrs: str) -> bool:
    """Whether a tag has the attribute hidden, or a style with display: none."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, a, b, c in NAMES.findall(low):
        if name == "hidden" or name == "style" and any(x.replace(" ", "").removesuffix("!important") == "display:none" for x in SPACES.sub(" ", a or b or c).split(";")):
            return True
    return False


def graded(blocks: list[Block], readers: set[int]) -> list[Block]:
    """``blocks`` with the elements in against and inside as grades: 1 if they hold up to 2/5 of the text, 0 from 3/5.

    Elements of readers' comments and of related pages (``readers``) keep 1 whatever they hold, if outside of them some
    text, ``ARTICLE_LEAST`` characters at least, lies in an article or main element: comments may well be longer than the
    article they are on.
    """
    held: dict[int, int] = {}
    article, within = 0, {e: 0 for e in readers}
    for b in blocks:
        own = b.size - b.linked
        for e in b.against:
            held[e] = held.get(e, 0) + own
        if b.article:
            article += own
            for e in b.against:
                if e in readers:
                    within[e] += own
    total = max(sum(b.size - b.linked for b in blocks), 1)
    grade = {e: 1.0 if e in readers and article - within[e] >= ARTICLE_LEAST else min(max(3 - 5 * n / total, 0.0), 1.0) for e, n in held.items()}
    for b in blocks:
        b.against = max((grade[e] for e in b.against), default=0.0)
        b.inside = any(all(grade.get(e, 1.0) < 0.5 for e in around) for around in b.inside)
    return blocks


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order. Unclosed, misplaced and unknown tags are taken as browsers take them, roughly."""
    out: list[Block] = []
    # an open element: name, number, skipped depth, the elements up to it that speak against the article, those around each
    # one that speaks for it, in a link, heading
    stack: list[tuple] = [("", 0, False, (), (), False, False)]
    firm, readers = set(), set()
    number, current, at, n = 0, None, 0, len(html)

    def add(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if top[2] or not text:
            return
        text = unescape(text) if "&" in text else text
        if current is None:
            if not text.strip():
                return
            current = Block(tuple(e[1] for e in stack if e[0] in BLOCK), top[3], top[4], top[6], any(e[0] == "li" for e in stack), any(e[0] in FOR_TAG for e in stack))
            out.append(current)
        current.parts.append(text)
        size = len(text)
        current.size += size
        if top[5]:
            current.linked += size

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group() == "<":
                add("<")
            continue
        name = name.lower()
        if m.group(1):  # an end
            if name in BLOCK:
                current = None
            if name == "br" or name == "p" and all(e[0] != "p" for e in stack):
                current = None
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    # an inline end does not reach across a block
                    if name in BLOCK or all(e[0] not in BLOCK for e in stack[k + 1 :]):
                        del stack[k:]
                    elif name not in BLOCK:
                        top = stack.pop(k)
                        if top[5]:  # the end of a link that holds blocks
                            stack[k:] = [(*e[:5], False, e[6]) for e in stack[k:]]
                    break
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            current = None
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        # formatting elements that the paragraph left open go on without their block
                        del stack[k:]
                        break
                    if stack[k][0] in ("button", "table", "td", "th"):
                        break
            if name in IMPLIED_END:
                ends, bounds = IMPLIED_END[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        if name != "tr" or stack[-1][0] not in ends:
                            break
                    elif stack[k][0] in bounds:
                        break
        if name in VOID:
            continue
        if name in RAW:
            end = END_OF[name].search(html, at)
            if end is None:
                break
            close = html.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        attrs = m.group(3)
        if attrs and attrs.endswith("/") and name in ("svg", "math"):
            continue
        words = set()
        if attrs and ("=" in attrs):
            for a in ATTR.finditer(attrs):
                for x in (a.group(1) or a.group(2) or a.group(3) or "").split():
                    if not NEGATED.match(x):
                        words.update(WORD.findall(x.lower()))
        top = stack[-1]
        number += 1
        hidden = bool(attrs) and is_hidden(attrs)
        article = name in FOR_TAG
        main = article or bool(words & FOR_WORD)
        # a header inside an article is the article's own; an article inside an aside or a comment list is not the page's
        against = top[3]
        if article:
            against = () if name == "main" else tuple(e for e in against if e in firm)
            if name != "main" and words & READER_WORD:  # a comment marked up as an article
                against = (*against, number)
                firm.add(number)
                readers.add(number)
        elif name not in ("html", "body") and (words & AGAINST_WORD or name in AGAINST_TAG and not (name == "header" and top[4])):
            against = (*against, number)
            if name in FIRM_TAG or words & FIRM_WORD:
                firm.add(number)
            if words & READER_WORD:
                readers.add(number)
        inside = top[4] if not main or against in top[4] else (*top[4], against)
        stack.append((name, number, top[2] or name in SKIPPED or hidden, against, inside, top[5] or name == "a", top[6] or len(name) == 2 and name[0] == "h" and name[1] in "123456"))
    return graded(out, readers)


def features(text: str, block: Block) -> tuple[int, ...]:
    """The places in START of what the text looks like."""
    share = block.linked / max(block.size, 1)
    ends = 9 + (text[-1] in ".!?:;\"'”’)")
    return (
        sum(len(text) > x for x in LENGTHS), 5 + sum(share > x for x in LINKS), ends,
        *[11] * block.heading, *[12] * block.item, *[13] * bool(RIGHTS.match(text)),
    )


def said(block: Block, any_main: bool) -> float:
    """Log odds of what the elements around a block say, more for the rest."""
    base = FOR if block.inside else -FOR if any_main else 0.0
    return AGAINST * block.against + base * (1 - block.against)


def seed_label(block: Block) -> int | None:
    """1 where the elements around a block tell that it is not the article's, 0 where that it is, else None."""
    return 1 if block.against >= 1 else 0 if block.inside and not block.against else None


def relations(blocks: list[Block]) -> list[tuple[int, int, tuple[int, int, int]]]:
    """Related blocks i < j and how: next to each other (0) or children or grandchildren of one element (1), whether the
    elements for or against the article around them differ, and steps from one to the other (5 at most), or to the element."""
    out = []
    last: dict[tuple[int, int], int] = {}
    for i, block in enumerate(blocks):
        path = block.path
        if i:
            near = blocks[i - 1]
            common = 0
            for x, y in zip(path, near.path):
                if x != y:
                    break
                common += 1
            steps = len(path) + len(near.path) - 2 * common
            out.append((i - 1, i, (0, int(block.around != near.around), min(steps, 5))))
        for up in (2, 3):  # the block before among the children, and the grandchildren, of one element
            if len(path) >= up:
                j = last.get((up, path[-up]))
                if j is not None and j != i - 1:
                    out.append((j, i, (1, int(block.around != blocks[j].around), up)))
                last[up, path[-up]] = i
    return out


def fit_weights(counts: dict[tuple[tuple[int, ...], int], float]) -> np.ndarray:
    """Weights of the text's features by logistic regression on (features, label) counts, drawn to START."""
    w = START.copy()
    if not counts:
        return w
    x = np.zeros((len(counts), len(w)))
    for i, (f, _) in enumerate(counts):
        x[i, list(f)] = 1
    y = np.array([label for _, label in counts], float)
    n = np.array(list(counts.values()))
    for c in (0, 1):  # both labels count the same
        if n[y == c].sum():
            n[y == c] *= min(n.sum(), SEEN) / 2 / n[y == c].sum()
    if y.min() == y.max():
        return w
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (n * (p - y)) + DRAWN * (w - START)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + DRAWN * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def capacity(relation: tuple[int, int, int], agreed: dict[tuple[int, int, int], tuple[float, float]]) -> float:
    """Half the log odds that blocks so related agree, times 1 / (1 + steps) below a common ancestor."""
    kind, other, steps = relation
    same, differ = agreed.get(relation, (0.0, 0.0))
    same, differ = same + AGREE[other][0], differ + AGREE[other][1]
    return min(max(0.5 * float(np.log(same / differ)), 0.0), EDGE_MOST) / (1 + steps if kind else 1)


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side (kept) of a minimum cut.

    A node with a negative cost is tied to the source by that much, one with a positive cost to the sink; edges have
    their capacity both ways. Paths are sought back from one node with a demand at a time. Where none with a supply is
    found, nothing can flow into the nodes seen any more, so they are left alone from then on.
    """
    n = len(cost)
    to: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, c in edges:
        to[a].append(len(head))
        head.append(b)
        room.append(c)
        to[b].append(len(head))
        head.append(a)
        room.append(c)
    supply = [max(-c, 0.0) for c in cost]
    eps = 1e-9
    dead = [False] * n
    for goal in range(n):
        demand = max(cost[goal], 0.0)
        while demand > eps and not dead[goal]:
            via = {goal: -1}  # the edge that leads from a node towards the goal
            queue = [goal]
            start = -1
            for u in queue:
                if supply[u] > eps:
                    start = u
                    break
                for e in to[u]:
                    v = head[e]
                    if room[e ^ 1] > eps and v not in via and not dead[v]:
                        via[v] = e ^ 1
                        queue.append(v)
            if start < 0:
                for u in queue:
                    dead[u] = True
                break
            flow, u = min(demand, supply[start]), start
            while via[u] >= 0:
                flow = min(flow, room[via[u]])
                u = head[via[u]]
            supply[start] -= flow
            demand -= flow
            u = start
            while via[u] >= 0:
                e = via[u]
                room[e] -= flow
                room[e ^ 1] += flow
                u = head[e]
    # what a supply still reaches is kept
    kept = [s > eps for s in supply]
    queue = [i for i in range(n) if kept[i]]
    for u in queue:
        for e in to[u]:
            if room[e] > eps and not kept[head[e]]:
                kept[head[e]] = True
                queue.append(head[e])
    return kept


def texts_of(html: str) -> tuple[list[str], list[Block]]:
    """Blocks that hold text, white space squashed."""
    found = []
    for b in blocks_of(html):
        text = SPACES.sub(" ", "".join(b.parts)).strip()
        if text:
            found.append((text, b))
    return [t for t, _ in found], [b for _, b in found]


Model = tuple[np.ndarray, dict[tuple[int, int, int], tuple[float, float]]]  #: weights of the text, agreement of related blocks


def costs(texts: list[str], blocks: list[Block], model: Model = (START, {})) -> list[float]:
    """Cost of keeping each block less that of dropping it."""
    any_main = any(b.inside for b in blocks)
    weights = model[0]
    return [min(max(sum(weights[i] for i in features(t, b)), -TEXT_MOST), TEXT_MOST) + said(b, any_main) for t, b in zip(texts, blocks)]


def extract(html: str, model: Model = (START, {})) -> tuple[str, int, int, int]:
    """(main text, number of blocks, of kept ones, of those that the cut and the sign of their cost tell apart)."""
    texts, blocks = texts_of(html)
    if not texts:
        return "", 0, 0, 0
    cost = costs(texts, blocks, model)
    known: dict[tuple[int, int, int], float] = {}
    edges = [(i, j, known.setdefault(r, capacity(r, model[1])) if r not in known else known[r]) for i, j, r in relations(blocks)]
    kept = min_cut(cost, edges)
    return "\n".join(t for t, k in zip(texts, kept) if k), len(texts), sum(kept), sum(k != (c < 0) for k, c in zip(kept, cost))


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, key, label) counts of a batch's blocks and related blocks whose surroundings tell what they are."""
    for pdf in pieces(batches, "html"):
        found: dict[tuple[str, str, int], int] = {}
        for html in pdf["html"]:
            texts, blocks = texts_of(html)
            labels = [seed_label(b) for b in blocks]
            for t, b, y in zip(texts, blocks, labels):
                if y is not None:
                    key = ("text", ",".join(map(str, features(t, b))), y)
                    found[key] = found.get(key, 0) + 1
            for i, j, r in relations(blocks):
                if labels[i] is not None and labels[j] is not None:
                    key = ("edge", ",".join(map(str, r)), int(labels[i] == labels[j]))
                    found[key] = found.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "key", "label", "n"])


def learn(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The text's weights and how often related blocks agree, from ``sample`` pages (page_id, url, html)."""
    key = F.xxhash64("page_id", "url").alias("key")
    drawn = pages.select(key).distinct().orderBy("key").limit(sample)  # hashes only
    seeds = pages.select(key, "html").join(F.broadcast(drawn), "key").dropDuplicates(["key"]).select("html").mapInPandas(_seeds, "kind string, key string, label int, n long")
    rows = seeds.groupBy("kind", "key", "label").agg(F.sum("n").alias("n")).orderBy("kind", "key", "label").collect()  # as many as there are kinds of blocks
    parse = lambda k: tuple(int(x) for x in k.split(","))
    weights = fit_weights({(parse(r["key"]), r["label"]): float(r["n"]) for r in rows if r["kind"] == "text"})
    agreed: dict[tuple[int, int, int], tuple[float, float]] = {}
    for r in rows:
        if r["kind"] == "edge":
            k = parse(r["key"])
            same, differ = agreed.get(k, (0.0, 0.0))
            agreed[k] = (same + r["n"], differ) if r["label"] else (same, differ + r["n"])
    return weights, agreed


def _extract_all(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "html"):
            out = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                text, n, k, moved = extract(html, model)
                out.append((None if pd.isna(page_id) else int(page_id), url, text, len(text), n, k, moved))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"page_id": "Int64"})

    return run


def html_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per page with its main text; see the module."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    return pages.mapInPandas(_extract_all(learn(pages, sample)), SCHEMA)
