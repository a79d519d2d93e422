"""HTML extraction by minimum-cut labelling of text blocks and their containers.

A page is read into blocks of text in a tree of elements. A classifier looks at
a block's own text, links and tag, and gives it a cost of being called content
and one of being called boilerplate; these are the capacities of its edges to
the two terminals of a graph. Containers whose tag or name says what they hold
(an article, a menu) are nodes as well. What a tag or name is worth is a finite
capacity: one that can only mean boilerplate (``comments``, ``nav``) outweighs
the text that the container holds, one that often does not (``more``,
``related-work``) is worth as much as a paragraph or two, so longer text
outweighs it. Smoothness edges join every block to the nearest container, a
container to the one around it, and blocks to those before and behind them, the
more strongly the nearer they stand in the tree. The minimum cut is the labelling
with the least total cost: a short line is content between the paragraphs of an
article, a list of links in it is not. Nodes whose terminal edges outweigh all
their smoothness edges are settled first (which loses nothing); the rest is
solved by Dinic's algorithm.

Pages are read once from start to end. Where the open elements of a name stand is
kept by name, so no end tag searches for its start, and time and memory grow with
the length of a page, however it is nested or broken.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that start and end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
#: Tags without an end.
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Tags whose content is no text, or is text that no page shows in its body.
HIDDEN_TAGS = frozenset("script style template noscript iframe object svg math head title canvas audio video textarea select option datalist".split())
_RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
#: Tags that a new one of theirs closes, and where the search for it ends.
_CLOSES = {
    "p": ({"p"}, None),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDS = frozenset(BLOCK_TAGS - {"option", "optgroup", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "head", "title"})

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPACE = re.compile(r"\s*")
#: One attribute: its name, and its value in double, single or no quotes. Every
#: character but space and ``/`` belongs to one, so matches never start in a value.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: What containers of boilerplate and of content are called. These tags say so for sure, those may hold an article's text.
SURE_TAGS = frozenset("nav header footer form menu button dialog label input".split())
WEAK_TAGS = frozenset("aside fieldset legend".split())
_TAIL = r"(?:[-_]?(?:area|section|list|item|items|wrap|wrapper|box|container|content|inner|outer|banner|bar|block|unit|slot|notice|form|thread|panel|left|right|top|bottom|main|primary|secondary|\d+))*"
_LEAD = r"(?:(?:site|page|global|post|article|user|reader|the|js|google)[-_])?"
_ANYWHERE = r"ads?|adverts?|advertisements?|advertising|adsense|sponsored|cookies?|consent|gdpr|newsletter|comments?|commentlist|replies|disqus|copyright"
_OUTSIDE = r"nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|foot|sidebar|pagination|pager|contentinfo|complementary|banner|social|subscribe|signup|login|popup|modal|overlay"
#: Whole names that are sure anywhere, and outside of articles.
SURE_ANYWHERE = re.compile(rf"{_LEAD}(?:{_ANYWHERE}){_TAIL}", re.I)
SURE_OUTSIDE = re.compile(rf"{_LEAD}(?:{_ANYWHERE}|{_OUTSIDE}){_TAIL}", re.I)
#: Names of which a part speaks for boilerplate.
WEAK_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|foot|sidebar\w*|aside|side|rail|widget\w*|related|recommend\w*|more|popular|trending|share|sharing|social|"
    r"cookies?|consent|gdpr|notice\w*|alert\w*|popup|pop|modal|overlay|newsletter|subscri\w*|signup|login|register|search\w*|form|comments?|comment\w*|respon[ds]\w*|replies|reply|disqus|discussion|"
    r"copyright|legal|disclaimer|pagination|pager|tags?|toolbar|skip|hidden|author-bio|byline-box|contentinfo|navigation|complementary|dialog)(?:$|[\s_\-0-9])",
    re.I,
)
BAD_ARTICLES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|replies|reply|related|recommend\w*)(?:$|[\s_\-0-9])", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|entry|post|story|body|text|page-content|articlebody|maincontent)(?:$|[\s_\-0-9])", re.I)
#: Names of a head: of an article it holds the title.
HEADS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_\-0-9])", re.I)
#: Tags of lines of text; in an article their names say little.
LINE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figure figcaption table tbody thead tr td th caption a b i em strong span small code sub sup u s q cite abbr time mark br img".split())
#: Lines that ask a reader for something, and words of notices.
_REQUEST = re.compile(r"^\W*(?:please )?(?:subscribe|sign (?:up|in)\b|log in\b|follow us|share (?:this|on)\b|read more|click here|advertisement\b|we use cookies|this (?:web)?site uses cookies|accept (?:all )?cookies)", re.I)
_NOTICE = re.compile(r"\b(?:cookies?|all rights reserved|subscribe|newsletter|sign (?:up|in)|log in|privacy policy|terms of (?:use|service)|advertisement|sponsored)\b|©", re.I)

#: Edges of a block to its container: one that is sure, and any other.
SURE_TIE, TIE = 5.0, 1.5
#: Edges between a container and the one around it.
NESTED = 1.0
#: What a name is worth: always, and for each unit of what the container's text says against it if the name is sure.
NAME, SURE_NAME = 4.0, 1.2


class Element:
    """An open tag: what is around it, and the nearest container that says what it holds."""

    __slots__ = ("block", "depth", "good", "hidden", "in_good", "link", "name", "outer", "parent", "region", "sealed", "sure")

    def __init__(self, name: str, above: Element | None, attributes: str):
        self.name = name
        #: The nearest region, whether it holds content (None without one), whether that is sure, and the region around it.
        self.region, self.good, self.sure, self.outer = (above.region, above.good, above.sure, above.outer) if above else (None, None, False, None)
        #: Whether any region around holds content, and whether all within is one region (a comment's article is a comment).
        self.in_good, self.sealed, self.hidden, self.link = (above.in_good, above.sealed, above.hidden, above.link) if above else (False, False, False, False)
        #: The tree of blocks: the nearest element around this one that is a block.
        self.parent = above.block if above else None
        self.block = self if above is None or name in BLOCK_TAGS else above.block
        self.depth = self.parent.depth + 1 if self.parent and self.block is self else 0 if self.parent is None else self.parent.depth
        if name == "a":
            self.link = True
        if name in HIDDEN_TAGS:
            self.hidden = True
        said = []
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if what == "hidden" or (what == "aria-hidden" and value == "true") or (what == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                self.hidden = True
            elif what in ("class", "id", "role", "itemprop"):
                said.append(value)
        if not self.sealed and name not in ("html", "body"):
            self._judge(" ".join(said))

    def _judge(self, said: str) -> None:
        name, article = self.name, self.in_good
        if name in ("article", "main"):
            bad = bool(said and name == "article" and BAD_ARTICLES.search(said))
            self._hold(not bad, True)
        elif name in SURE_TAGS:
            if not (name == "header" and article):
                self._hold(False, True)
        elif name in WEAK_TAGS:
            self._hold(False, name == "aside" and not article)
        elif said:
            sure = any((SURE_ANYWHERE if article else SURE_OUTSIDE).fullmatch(token) for token in said.split())
            if sure:
                self._hold(False, True)
            elif name in LINE_TAGS:
                return  # a line's name says little
            elif WEAK_NAMES.search(said):
                if not (article and HEADS.search(said)):
                    self._hold(False, False)
            elif not article and GOOD_NAMES.search(said):
                self._hold(True, False)

    def _hold(self, good: bool, sure: bool) -> None:
        self.outer, self.region, self.good, self.sure = self.region, self, good, sure
        self.in_good |= good
        # a page may be one form
        self.sealed = not good and sure and self.name != "form"


class Block:
    """A piece of text, how many of its characters are links, and the element around it."""

    __slots__ = ("at", "linked", "text")

    def __init__(self, text: str, linked: int, at: Element):
        self.text, self.linked, self.at = text, linked, at


def _tag_end(source: str, at: int) -> int:
    """Where the ``>`` of a tag stands that is open at ``at``; -1 if the page ends before."""
    end = source.find(">", at)
    while end >= 0:
        equals = source.find("=", at, end)
        if equals < 0:
            return end
        at = _SPACE.match(source, equals + 1).end()
        if source[at : at + 1] in ('"', "'"):
            close = source.find(source[at], at + 1)
            if close < 0:
                return -1
            at = close + 1
            if at > end:
                end = source.find(">", at)
        elif at > end:
            end = source.find(">", at)
    return -1


def blocks_of(source: str) -> list[Block]:
    """The page's blocks in page order, white space collapsed, references decoded."""
    out: list[Block] = []
    stack = [Element("", None, "")]
    #: where the open elements of each name stand in the stack, and the blocks among them
    where: defaultdict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []
    innermost = lambda names: max((where[n][-1] for n in names if where.get(n)), default=0)
    pieces: list[str] = []
    linked, at, size = 0, 0, len(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append(Block(text, linked, stack[-1]))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if raw and not top.hidden:
            said = html.unescape(raw) if "&" in raw else raw
            pieces.append(said)
            if top.link:
                linked += len(said)

    def close(depth: int) -> None:
        if block_at and block_at[-1] >= depth:
            flush()
        while block_at and block_at[-1] >= depth:
            block_at.pop()
        for e in stack[depth:]:
            where[e.name].pop()
        del stack[depth:]

    while at < size:
        start = source.find("<", at)
        if start < 0:
            say(source[at:])
            break
        after = source[start + 1 : start + 2]
        ending = after == "/"
        named = _NAME.match(source, start + 1 + ending)
        if not named and not (ending and start + 2 < size) and after not in ("!", "?"):
            say(source[at : start + 1])  # a bare sign
            at = start + 1
            continue
        say(source[at:start])
        if not named:  # a comment, a declaration or a broken end tag
            if source.startswith("<!--", start):
                closed = re.compile(r"-?>|.*?--!?>", re.S).match(source, start + 4)
                at = closed.end() if closed else size
            else:
                end = source.find(">", start)
                at = end + 1 if end >= 0 else size
            continue
        end = _tag_end(source, named.end())
        if end < 0:
            break
        at, name = end + 1, named[0].lower()
        if ending:
            if name == "br":
                say(" ")
            elif where.get(name):
                depth = where[name][-1]
                # an end tag of running text does not reach over blocks
                if name in BLOCK_TAGS or not block_at or block_at[-1] < depth:
                    close(depth)
            continue
        attributes = source[named.end() : end]
        if name in _P_ENDS and where.get("p") and where["p"][-1] == block_at[-1]:
            close(where["p"][-1])
        if name in _CLOSES:
            closed, until = _CLOSES[name]
            depth = innermost(closed)
            if depth and (depth > innermost(until) if until else depth == block_at[-1]):
                # a row closes the cell in it too
                close(next((d for d in where["tr"][-1:] if name == "tr" and d > innermost(until)), depth))
        if name in BLOCK_TAGS:
            flush()
        if name in VOID_TAGS:
            if name in ("br", "img", "hr", "input"):
                say(" ")
            continue
        if name in _RAW_TAGS:
            raw = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = raw.end() if raw else size
        elif not (attributes.endswith("/") and name not in BLOCK_TAGS):
            where[name].append(len(stack))
            if name in BLOCK_TAGS:
                block_at.append(len(stack))
            stack.append(Element(name, stack[-1], attributes))
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content), by its own text, links and tag."""
    content, boilerplate = 0.6, 0.4
    words = b.text.count(" ") + 1
    density = min(1.0, b.linked / max(1, len(b.text)))
    if density > 0.5:
        boilerplate += 2.0 * density
    if words < 5:
        boilerplate += 0.5
    if b.at.block.name in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "figcaption"):
        content += 0.8
    content += min(1.5, words / 30)
    if b.text[-1] in ".!?:;\"'”»…":
        content += 0.3
    if words < 15 and _REQUEST.search(b.text):
        boilerplate += 4.0
    elif words < 40 and _NOTICE.search(b.text):
        boilerplate += 0.8
    return content, boilerplate


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut (undirected inner edges).

    A node keeps the label that costs it less if that outweighs all its inner
    edges; its neighbours then carry those edges to a terminal.
    """
    n = len(source)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    source, sink = list(source), list(sink)
    total = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(source[i] - sink[i]) < total[i] - 1e-12:
            continue
        label[i] = keep = source[i] > sink[i]
        for j, c in near[i].items():
            (source if keep else sink)[j] += c
            total[j] -= c
            del near[j][i]
            todo.append(j)
        near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        kept = _dinic([source[i] - sink[i] for i in free], near, free)
        for i, k in zip(free, kept, strict=True):
            label[i] = k
    return [bool(x) for x in label]


def _dinic(surplus: list[float], near: list[dict[int, float]], free: list[int]) -> list[bool]:
    """Who can be reached from the source when no more flows; ``surplus`` is what the source gives (negative: the sink takes)."""
    place = {i: k for k, i in enumerate(free)}
    n = len(free)
    s, t, small = n, n + 1, 1e-12
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, i in enumerate(free):
        if surplus[k] > 0:
            join(s, k, surplus[k], 0.0)
        elif surplus[k] < 0:
            join(k, t, -surplus[k], 0.0)
        for j, c in near[i].items():
            if place[j] > k:
                join(k, place[j], c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > small and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                first = None
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if first is None and room[e] <= small:
                        first = k
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while following[u] < len(out[u]):
                e = out[u][following[u]]
                if room[e] > small and level[to[e]] == level[u] + 1:
                    break
                following[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def distance(a: Element, b: Element) -> int:
    """Steps from the farther of two elements to the nearest block around both."""
    a, b, steps = a.block, b.block, 0
    while a is not b:
        if a.depth >= b.depth:
            a, b = b, a
        b = b.parent
        steps += a.depth <= b.depth or a is b
    return steps


def graph(blocks: list[Block]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Capacities to both terminals and the edges of the page: its blocks, then its containers."""
    source, sink = map(list, zip(*(costs(b) for b in blocks), strict=True))
    edges: list[tuple[int, int, float]] = []
    nodes: dict[Element | None, int] = {}
    # on a page that says where its content is, whatever stands outside is none
    says = any(b.at.in_good for b in blocks)
    against = defaultdict(float)

    def node(region: Element | None) -> int:
        """The region's node, joined to that of the region around it; None stands for what is outside of all."""
        if region not in nodes:
            nodes[region] = len(source)
            source.append(0.0)
            sink.append(0.0)
        return nodes[region]

    for i, b in enumerate(blocks):
        region = b.at.region
        if region or says:
            good = bool(region and b.at.good)
            # outside of what holds the content, a name that is not sure is as good as one that is
            sure = (region.sure if region else True) or (says and not b.at.in_good)
            edges.append((i, node(region), SURE_TIE if sure and not good else TIE))
            against[region] += max(0.0, (sink[i] - source[i]) if good else (source[i] - sink[i]))
        if i:
            edges.append((i - 1, i, 1.5 / (1 + distance(blocks[i - 1].at, b.at))))
    around = list(nodes)
    for region in around:
        while region is not None and (region.outer is not None or (says and not region.in_good)):
            known = region.outer in nodes
            edges.append((nodes[region], node(region.outer), NESTED))
            if known:
                break
            region = region.outer
    for region, i in nodes.items():
        good = bool(region and region.good)
        sure = (region.sure if region else True) or (says and not region.in_good)
        (source if good else sink)[i] += NAME + (SURE_NAME * against[region] if sure or good else 0.0)
    return source, sink, edges


def main_text(source: str) -> str:
    """The blocks labelled content, joined by single spaces."""
    blocks = blocks_of(source)
    if not blocks:
        return ""
    keep = minimum_cut(*graph(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=False) if k)


def extract_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole html.

    A null or empty page has an empty text; repeated pages are read again; null
    keys and urls stay null; other columns are not read. No shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py() or "") for t in b.column(source)]
            yield pa.record_batch([b.column(key).cast(pa.int64()), b.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, source).mapInArrow(rows, f"{key} bigint, {url} string, text string, n_chars bigint")
