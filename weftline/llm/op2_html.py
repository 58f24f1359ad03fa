"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into text blocks with their open elements. A block's classifier gives two costs, of calling it
content and of calling it boilerplate; they become its capacities to source and sink. Neighbours in page
order and blocks of one parent are joined by smoothness edges whose capacity falls with the distance of the two
blocks in the DOM. The minimum cut (max-flow, after blocks whose own costs outweigh all their edges are
settled, which never changes the minimum) separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# Element names of the HTML standard by how they take part.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title template noscript iframe object svg math canvas audio video datalist".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html legend li dd dt option optgroup td th tr tbody thead tfoot".split())
SAME = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
BOILER_TAGS = frozenset("nav footer aside form menu button select textarea input label fieldset dialog search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
CONTENT_TAGS, CONTENT_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar widget related recommended newsletter popup modal overlay cookie cookies consent gdpr comments commentlist disqus replies pagination pager".split()
)
#: Names that sections of an article have too: they tell of boilerplate where the text is short or mostly links.
UNSURE_NAMES = frozenset("banner promotion copyright side rail share sharing social follow subscribe subscription signup login notice alert comment discussion tags toolbar form search".split())
#: Words that go with a name and change nothing.
WITH_NAMES = frozenset("area bar block bottom box button buttons col column container content desktop div entry global group head icons inner item items left link links list main mobile module outer page post posts primary right row secondary section site slot text top unit wrap wrapper".split())
CONTENT_NAMES = frozenset("article content entry post story main body maincontent articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMELESS = HEADINGS | frozenset("html body article main p".split())
#: Elements whose end tags no paragraph's reaches across.
P_SCOPE = frozenset("table body article main section td th".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: A class that begins so tells of a state of the page (a layout with a sidebar), not of what the element is.
STATES = frozenset("with without has no non not layout".split())
STRONG, WEAK, EDGE = 8.0, 2.0, 1.2
SURE, UNSURE, NOTHING, CONTENT = -2, -1, 0, 1
#: Characters up to which a text is short for its name, and the share of link characters from which it is mostly links.
SHORT, LINKS = 300, 0.5
#: An element with more of the page's text than this is no boilerplate for its class or id alone.
SHARE = 0.8


def named(value: str, tag: str) -> int:
    """What a class or id of the list names: SURE or UNSURE boilerplate, CONTENT, or NOTHING; only a whole name tells of boilerplate,
    so ``share-buttons`` does and ``share-price`` does not."""
    found = NOTHING
    for token in html.unescape(value).split():
        words = [x.lower() for x in NAME.split(token) if x]
        if not words or words[0] in STATES:
            continue
        some = not CONTENT_NAMES.isdisjoint(words)
        sure, unsure = BOILER_NAMES.intersection(words), UNSURE_NAMES.intersection(words)
        if sure == {"header"} and some:
            sure = frozenset()  # an entry's own header
        if (sure or unsure) and all(w in BOILER_NAMES or w in UNSURE_NAMES or w in WITH_NAMES for w in words):
            found = min(found, SURE if sure else UNSURE)
        elif some and found == NOTHING:
            found = CONTENT
    return found


class Node:
    """An open element: tag, parent, depth, the nearest block element and the paragraph open here, sizes of text and link text, what its tag and
    role (own) and its names say, and the mark from all (+ content, - boilerplate). Headings and paragraphs have no names: their ids are made from their text."""

    __slots__ = ("block", "depth", "hidden", "link", "linked", "mark", "named", "own", "p", "parent", "size", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.p = self if tag == "p" else None if parent is None or tag in P_SCOPE else parent.p
        self.hidden = bool(parent and parent.hidden) or tag in HIDDEN
        self.link = tag == "a" or bool(parent and parent.link)
        self.mark, self.named, self.size, self.linked = 0.0, NOTHING, 0, 0
        self.own = STRONG if tag in CONTENT_TAGS else -STRONG if tag in BOILER_TAGS or tag == "header" else 0.0
        names = []
        for key, value in ATTR.findall(attrs) if attrs and not attrs.isspace() else ():
            key, value = key.lower(), value.strip("\"'")
            if key == "class" or key == "id" and tag != "section":
                names.append(named(value, tag))
            elif key == "role":
                self.own = -STRONG if value.lower() in BOILER_ROLES else STRONG if value.lower() in CONTENT_ROLES else self.own
            elif key == "style":
                self.hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                self.hidden = True
        if names and tag not in NAMELESS:
            self.named = min(names) if min(names) < 0 else max(names)

    def weigh(self, total: int) -> None:
        """Sets the mark, once the parent's is set and all text sizes are known."""
        parent, strength = self.parent, self.own
        mark = parent.mark if parent else 0.0
        if self.tag in ("h1", "h2", "h3") and parent and parent.tag == "header" and parent.parent and parent.parent.mark > 0:
            strength = STRONG  # an article's own heading stands in its header
        likely = self.size <= SHORT or self.linked > LINKS * self.size
        if self.size <= SHARE * total and (self.named == SURE or self.named == UNSURE and likely):
            strength = -STRONG
        elif self.named == CONTENT and not strength:
            strength = STRONG if mark >= 0 else 0.0
        # what stands inside boilerplate stays boilerplate but for an article; the innermost word counts most
        self.mark = strength + 0.25 * mark if strength else mark
        if strength > 0 and mark < 0 and self.tag not in CONTENT_TAGS and self.tag not in ("h1", "h2", "h3"):
            self.mark = mark


class Block:
    __slots__ = ("linked", "node", "parts", "size")

    def __init__(self, node: Node):
        self.node, self.parts, self.size, self.linked = node, [], 0, 0


def blocks(page: str) -> list[tuple[Node, str, float]]:
    """(element, text, share of link characters) of each block of text in page order."""
    root = here = Node("#root", "", None)
    standing: Counter = Counter()
    nodes: list[Node] = []
    out: list[Block] = []
    open_block: Block | None = None
    at, end = 0, len(page)

    def go_to(x: Node) -> None:
        """Close what stands open below x."""
        nonlocal here
        while here is not x:
            standing[here.tag] -= 1
            here = here.parent

    def close_to(tags: str, stop: str) -> None:
        if not any(standing[t] for t in tags.split()):
            return
        x = here
        while x.parent is not None and x.tag not in stop.split() and x.tag not in ("body", "article", "main", "section", "td", "th"):
            if x.tag in tags.split():
                go_to(x.parent)
                return
            x = x.parent

    def put(text: str) -> None:
        nonlocal open_block
        if here.hidden or not text:
            return
        text = html.unescape(text)
        if open_block is None:
            if not text.strip():
                return
            open_block = Block(here.block)
            out.append(open_block)
        open_block.parts.append(text)
        n = len(text.strip())
        open_block.size += n
        open_block.linked += n if here.link else 0

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if standing[tag]:
                x = here
                while x.tag != tag:
                    x = x.parent
                go_to(x.parent)
            if tag in BLOCK:
                open_block = None
            continue
        if tag in BLOCK:
            open_block = None
            if tag in CLOSES_P and here.p:
                go_to(here.p.parent)
            if tag in SAME:
                close_to(*SAME[tag])
        if tag == "br" and open_block is not None:
            open_block.parts.append(" ")
        if tag in VOID:
            continue
        node = Node(tag, m[3], here)
        nodes.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if tag == "textarea" or stop is None:
                at = stop.end() if stop else end
                continue
            at = stop.end()
            continue
        here = node
        standing[tag] += 1
    for b in out:
        b.node.size += b.size
        b.node.linked += b.linked
    for x in reversed(nodes):
        x.parent.size += x.size
        x.parent.linked += x.linked
    for x in nodes:
        x.weigh(root.size)
    done = []
    for b in out:
        text = " ".join("".join(b.parts).split())
        if text:
            done.append((b.node, text, b.linked / max(1, b.size)))
    return done


def costs(node: Node, text: str, linked: float, marked: bool) -> tuple[float, float]:
    """(cost of content, cost of boilerplate); marked: the page names its content somewhere."""
    score = node.mark
    words = text.count(" ") + 1
    if not node.mark:
        score += -STRONG / 2 if marked else min(WEAK, words / 20) + (WEAK if words >= 15 and text[-1:] in ".!?" else 0) - (0 if words >= 10 or node.tag in ("h1", "h2", "h3", "h4") else WEAK)
    score -= WEAK * (linked > 0.5 and words < 60) + WEAK * 2 * (linked > 0.8 and node.mark <= 0)
    return max(0.0, -score), max(0.0, score)


def distance(a: Node, b: Node) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def min_cut(to_content: list[float], to_boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content at the least total cost: unary costs plus the capacity of each edge cut. Ties fall to boilerplate."""
    n = len(to_content)
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    side: list[bool | None] = [None] * n
    content, boiler = list(to_content), list(to_boiler)
    pull = [sum(w for _, w in x) for x in around]
    todo = deque(range(n))
    while todo:  # settle what no neighbour can turn, and hand its edges to the neighbours as costs
        i = todo.popleft()
        if side[i] is not None or abs(content[i] - boiler[i]) <= pull[i]:
            continue
        side[i] = content[i] < boiler[i]
        for j, w in around[i]:
            if side[j] is None:
                pull[j] -= w
                if side[i]:
                    boiler[j] += w
                else:
                    content[j] += w
                todo.append(j)
    free = [i for i in range(n) if side[i] is None]
    if free:
        at = {x: k for k, x in enumerate(free)}
        s, t = len(free), len(free) + 1
        graph: list[dict[int, float]] = [{} for _ in range(t + 1)]

        def add(a, b, w, back):
            graph[a][b] = graph[a].get(b, 0.0) + w
            graph[b][a] = graph[b].get(a, 0.0) + back

        for i in free:
            add(s, at[i], boiler[i], 0.0)  # cut when i is called boilerplate
            add(at[i], t, content[i], 0.0)
            for j, w in around[i]:
                if side[j] is None and i < j:
                    add(at[i], at[j], w, w)
        reach = max_flow(graph, s, t)
        for i in free:
            side[i] = at[i] in reach
    return [bool(x) for x in side]


def max_flow(graph: list[dict[int, float]], s: int, t: int) -> set[int]:
    """Dinic's algorithm on residual capacities; returns the source's side of the minimum cut."""
    while True:
        level = {s: 0}
        q = deque([s])
        while q:
            u = q.popleft()
            for v, w in graph[u].items():
                if w > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    q.append(v)
        if t not in level:
            return set(level)
        rest = {u: list(graph[u]) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(graph[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = 0
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    graph[a][b] -= flow
                    graph[b][a] = graph[b].get(a, 0.0) + flow
                    if graph[a][b] <= 1e-9 and not cut:
                        cut = k + 1
                del path[cut or 1 :]
                continue
            while rest[u] and not (level.get(rest[u][-1]) == level[u] + 1 and graph[u][rest[u][-1]] > 1e-9):
                rest[u].pop()
            if rest[u]:
                path.append(rest[u][-1])
            else:
                path.pop()
                if path:
                    rest[path[-1]].pop()


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    marked = any(n.mark > 0 for n, _, _ in found)
    both = [costs(n, x, linked, marked) for n, x, linked in found]
    edges = [(i, i + 1, EDGE / max(1, distance(found[i][0], found[i + 1][0]) - 1)) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, (n, _, _) in enumerate(found):
        j = last.get(id(n.parent))
        if j is not None and j < i - 1:
            edges.append((j, i, EDGE / 2))
        last[id(n.parent)] = i
    side = min_cut([c for c, _ in both], [b for _, b in both], edges)
    return " ".join(x for (_, x, _), keep in zip(found, side, strict=True) if keep)


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """df's columns but the page, plus text ('' where nothing is left) and n_chars.

    A null or empty page has no text. Whole pages, a row at a time; repeated rows and further columns pass,
    columns named text or n_chars are replaced.
    """
    keep = [f for f in df.schema.fields if f.name not in (column, "text", "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                texts = [main_text(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [f.name for f in keep] + ["text", "n_chars"])

    return df.select(*[f"`{f.name}`" for f in keep], F.col(column)).mapInArrow(run, schema)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
