"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages, and of its registrable domain's, are aligned to those of up to REFERENCES pages of it by simple tree
matching: the largest set of node pairs that keeps labels, ancestors and order. Only the references' skeletons (labels and depths)
travel. Over all distinct pages, an aligned node whose texts keep coming back (one text, or a pool of menus and adverts) is template,
one whose texts are each page's own is a slot; a block goes where its node is template and its text is one that comes back. Markup
(elements, class names, link density) speaks where that evidence doesn't: on thin sites, and for comments and adverts of one page
only. A page is parsed and aligned once; its blocks are written to the shared folder and judged there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, small_batches, stage
from siftwell.llm.url_rules import host_of

#: Pages of a site that the others are aligned to, in turn for what earlier ones lack.
REFERENCES = 3
#: A text comes back if it is at its node on so many distinct pages; a node is template if so large a share of its pages have such texts.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.8
#: What a page marks as its article is template only where one text is on so large a share of so many distinct pages of the host.
ARTICLE_PAGES = 30
ARTICLE_SHARE = 0.95
#: Skeletons are broadcast up to so many bytes in all, lists of one long a row up to so many rows; beyond, the joins shuffle.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 500_000
#: Template texts of a site that are handled as one array; sites with more are judged by a join.
ARRAY_KEYS = 50_000
#: Outside an article, blocks with more than this share of their text in links are menus.
LINK_SHARE = 0.5
#: Lists of children whose lengths multiply to more are matched a row of numpy at a time, with the same result.
ROWS_FROM = 2_000
#: A task remembers alignments of about so many pairs of nodes in all.
REMEMBERED = 300_000

# HTML's elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form button select dialog menu search datalist option audio video".split()) | RAW
# Words in a class, id or role that name what isn't the article.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus reply replies respond share sharing "
    "social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget skip complementary contentinfo".split()
)
OWN_HEADER = frozenset("article post entry story content title heading".split())
#: Within an article only these can be named as something else, and only by a class or id of nothing but such words.
HOLDERS = frozenset("div section ul ol dl table figure article".split())
# Second levels below which names are registered, under two-letter top levels.
SECOND_LEVELS = ("co", "com", "org", "net", "ac", "gov", "edu")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAME = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_WORDS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "label", "names", "named", "children", "texts", "number", "shape", "size", "hidden")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.texts, self.hidden = tag, [], [], False
        self.names: frozenset = frozenset()
        self.named = False  # whether a whole class, id or role names what isn't the article
        self.label = tag
        if attrs:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAME.finditer(attrs)}
            said = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
            self.names = frozenset(_WORDS.split(said)) - {""}
            self.named = any(words and words <= CHROME for words in (set(_WORDS.split(x)) - {""} for x in said.split())) and not self.names & OWN_HEADER
            self.label = f"{tag}.{_NUMBER.sub('#', ' '.join(found['class'].lower().split()))}" if "class" in found else tag
            self.hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def parse(page: str) -> Node:
    """A tree of a page however broken: texts keep their place among an element's children (as (index, text))."""
    root = Node("#root")
    stack, at = [root], 0
    opened: Counter = Counter()
    match = _TOKEN.search(page)
    while match:
        if match.start() > at:
            stack[-1].texts.append((len(stack[-1].children), page[at : match.start()]))
        at = match.end()
        tag = (match[2] or "").lower()
        if tag and not match[1]:
            if tag in BLOCK:
                _close_for(stack, tag, opened)
            node = Node(tag, match[3])
            stack[-1].children.append(node)
            if tag in RAW:
                if not match[3].endswith("/"):
                    end = _CLOSE[tag].search(page, at)
                    at = end.end() if end else len(page)
            elif tag not in VOID:
                stack.append(node)
                opened[tag] += 1
        elif opened[tag]:  # a closing tag of nothing open is passed by
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    _close(stack, i, opened)
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag not in BLOCK:
                    break
        match = _TOKEN.search(page, at)
    if at < len(page):
        stack[-1].texts.append((len(stack[-1].children), page[at:]))
    _number(root)
    return root


_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}


def _close(stack: list[Node], at: int, opened: Counter) -> None:
    opened.subtract(n.tag for n in stack[at:])
    del stack[at:]


def _close_for(stack: list[Node], tag: str, opened: Counter) -> None:
    """Close what an opening block tag ends without saying so: a paragraph, or its own like within the same list or table."""
    for i in range(len(stack) - 1, 0, -1):
        t = stack[i].tag
        if t == "p" or t in _ENDS.get(tag, ()):
            _close(stack, i, opened)
            if t == "p":
                return _close_for(stack, tag, opened) if tag in _ENDS else None
        elif t in BLOCK and (tag not in _ENDS or t in _HOLDS.get(tag, ())):
            return None
    return None


def _number(root: Node) -> None:
    """Pre-order numbers, and the shape and size of each subtree."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        todo += reversed(node.children)
    for node in reversed(order):
        node.shape = hash((node.label, *(c.shape for c in node.children)))
        node.size = 1 + sum(c.size for c in node.children)


def skeleton(root: Node) -> str:
    """Depths and labels in pre-order: all of a tree that an alignment needs."""
    lines, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        lines.append(f"{depth} {node.label}")
        todo += [(c, depth + 1) for c in reversed(node.children)]
    return "\n".join(lines)


def from_skeleton(said: str) -> Node:
    path: list[Node] = []
    for line in said.split("\n"):
        depth, _, label = line.partition(" ")
        node = Node(label)
        del path[int(depth) :]
        if path:
            path[-1].children.append(node)
        path.append(node)
    _number(path[0])
    return path[0]


def _trim(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many equal shapes both lists begin and end with."""
    i, n, j = 0, min(len(x), len(y)), 0
    while i < n and x[i].shape == y[i].shape:
        i += 1
    while j < n - i and x[-1 - j].shape == y[-1 - j].shape:
        j += 1
    return i, j


def _next_rows(x: list[Node], y: list[Node], weight: Callable[[Node, Node], int], row: np.ndarray):
    """The table of largest matchings of heads of x and y, a row for each of x, behind the given one."""
    shapes: dict[int, int] = {}
    kind = np.array([shapes.setdefault(q.shape, len(shapes)) for q in y])
    first = list({q.shape: q for q in reversed(y)}.values())
    labels: dict[str, list[Node]] = {}
    for q in first:
        labels.setdefault(q.label, []).append(q)
    known: dict[int, np.ndarray] = {}
    for p in x:
        if p.shape not in known:
            if len(known) > 50:
                known.clear()
            of = np.zeros(len(shapes), np.int64)
            for q in labels.get(p.label, ()):
                of[shapes[q.shape]] = weight(p, q)
            known[p.shape] = of[kind]
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + known[p.shape]))])
        yield row


def _largest(x: list[Node], y: list[Node], weight: Callable[[Node, Node], int]) -> int:
    """Weight of the largest matching of two lists that keeps their order."""
    if len(x) * len(y) > ROWS_FROM:
        row = np.zeros(len(y) + 1, np.int64)
        for row in _next_rows(x, y, weight, row):  # noqa: B007
            pass
        return int(row[-1])
    row = [0] * (len(y) + 1)
    for p in x:
        old = 0
        for k, q in enumerate(y, 1):
            was = row[k]
            row[k] = max(was, row[k - 1], old + weight(p, q))
            old = was
    return row[-1]


def _matched(x: list[Node], y: list[Node], weight: Callable[[Node, Node], int]) -> list[tuple[Node, Node]]:
    """The pairs of the largest matching. Of a long table the square root of its rows is kept, and those between are made again."""
    n = len(x)
    if n * len(y) > ROWS_FROM:
        step = int(n**0.5) + 1
        row = np.zeros(len(y) + 1, np.int64)
        kept = [row, *(r for i, r in enumerate(_next_rows(x, y, weight, row), 1) if i % step == 0)]
    else:
        step, kept = n + 1, [[0] * (len(y) + 1)]
    out, i, j = [], n, len(y)
    while i and j:
        begin = (i - 1) // step * step
        best = [kept[begin // step]]
        if n * len(y) > ROWS_FROM:
            best += _next_rows(x[begin:i], y, weight, best[0])
        else:
            for p in x:
                above, row = best[-1], [0]
                for k, q in enumerate(y, 1):
                    row.append(max(above[k], row[-1], above[k - 1] + weight(p, q)))
                best.append(row)
        while i > begin and j:
            if best[i - begin][j] == best[i - begin - 1][j]:
                i -= 1
            elif best[i - begin][j] == best[i - begin][j - 1]:
                j -= 1
            else:
                out.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
    return out


def align(ref: Node, page: Node) -> dict[int, int]:
    """Number of the matched reference node by page node number (simple tree matching), the largest matching at any size.

    Equal shapes at either end of two lists of children are paired at once, which no better matching can undo; the rest is
    matched by the usual dynamic program. Subtrees of equal shapes are weighed once.
    """
    pairs: dict[int, int] = {}
    memo: dict[tuple[int, int], int] = {}

    def weight(a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        return memo[a.shape, b.shape] if a.children and b.children else 1

    def weigh(x: list[Node], y: list[Node]) -> None:
        """Have memo hold all pairs of two lists, those below them first."""
        todo = _unweighed(x, y)
        while todo:
            a, b = todo[-1]
            if (a.shape, b.shape) in memo:
                todo.pop()
                continue
            i, j = _trim(a.children, b.children)
            mx, my = a.children[i : len(a.children) - j], b.children[i : len(b.children) - j]
            below = _unweighed(mx, my)
            if below:
                todo += below
                continue
            ends = sum(n.size for n in a.children[:i]) + sum(n.size for n in a.children[len(a.children) - j :])
            memo[a.shape, b.shape] = 1 + ends + (_largest(mx, my, weight) if mx and my else 0)
            todo.pop()

    def _unweighed(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        ux, uy = ({n.shape: n for n in z if n.children} for z in (x, y))
        return [(p, q) for p in ux.values() for q in uy.values() if p.label == q.label and p.shape != q.shape and (p.shape, q.shape) not in memo]

    todo = [(ref, page)]
    while todo:
        a, b = todo.pop()
        pairs[b.number] = a.number
        x, y = a.children, b.children
        if a.shape == b.shape:
            todo += zip(x, y)
            continue
        i, j = _trim(x, y)
        todo += [*zip(x[:i], y[:i]), *zip(x[len(x) - j :], y[len(y) - j :])]
        mx, my = x[i : len(x) - j], y[i : len(y) - j]
        if mx and my:
            weigh(mx, my)
            todo += _matched(mx, my, weight)
    return pairs


class Aligner:
    """align, once for all pages of one shape and trees of one shape: numbers and matches follow from the shapes alone."""

    def __init__(self):
        self.known: dict[tuple[int, ...], dict[int, int]] = {}
        self.held = 0

    def __call__(self, ref: Node, page: Node) -> dict[int, int]:
        key = ref.shape, ref.size, page.shape, page.size
        pairs = self.known.get(key)
        if pairs is None:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[key] = pairs = align(ref, page)
            self.held += len(pairs)
        return pairs


def _chrome(node: Node, inside: bool) -> bool:
    """Whether a node, within an article or not, is marked as something that isn't the article."""
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if inside:
        return node.named and node.tag in HOLDERS
    named = node.names & CHROME
    return bool(named) and node.tag not in ("html", "body", "main") and not (named == {"header"} and node.names & OWN_HEADER)


def _article(root: Node) -> bool:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main") or n.names & {"main"} and n.tag != "body":
            return True
        todo += [c for c in n.children if not _chrome(c, False)]
    return False


def blocks(root: Node) -> list[tuple[int, str, bool, bool]]:
    """(node number, text, marked as not the article, within what is marked as the article) of all visible blocks, in order."""
    whole = _article(root)
    out: list[tuple[int, str, bool, bool]] = []
    held: list[str] = []
    linked = 0
    state = (0, False, False)  # of the block whose text is held: its node, whether marked, whether within the article

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            node, marked, inside = state
            out.append((node, text, marked or (not inside if whole else linked > LINK_SHARE * len(text)), inside))
        held.clear()
        linked = 0

    stack: list[list] = [[root, 0, 0, False, False, False, state]]  # node, next child and text, marked, inside, in a link, state before
    while stack:
        top = stack[-1]
        node, k, i, marked, inside, link, before = top
        while i < len(node.texts) and node.texts[i][0] == k:
            held.append(node.texts[i][1])
            linked += len(node.texts[i][1]) * link
            i += 1
        if k == len(node.children):
            if node.tag in BLOCK:
                flush()
                state = before
            stack.pop()
            continue
        top[1:3] = k + 1, i
        child = node.children[k]
        if child.tag == "br":
            held.append("\n")
        elif child.tag not in VOID and child.tag not in RAW and child.tag != "head" and not child.hidden:
            off = marked or _chrome(child, inside)
            within = inside or child.tag in ("article", "main") or bool(child.names & {"main"}) and child.tag != "body"
            if child.tag in BLOCK:
                flush()
                stack.append([child, 0, 0, off, within, link or child.tag == "a", state])
                state = (child.number, off, within)
            elif marked or not off:  # a marked element within a line, a button say, is no block of its own and goes
                stack.append([child, 0, 0, off, within, link or child.tag == "a", state])
    flush()
    return out


def domain_of(host: Column) -> Column:
    """The registrable domain of a host: its last two labels, or three below a second level such as co.uk."""
    labels = F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.coalesce(F.try_element_at(labels, F.lit(-2)), F.lit("")).isin(*SECOND_LEVELS)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(labels, F.when(deep, -3).otherwise(-2), F.when(deep, 3).otherwise(2)), "."))


def _sites() -> Column:
    """What a row is aligned with: its host's pages, and its domain's."""
    return F.array(F.xxhash64(F.lit("host"), "host"), F.xxhash64(F.lit("domain"), "domain"))


def references(rows: DataFrame) -> DataFrame:
    """(site, trees array<string>): skeletons of up to REFERENCES pages of each site, picked by hash among those that aren't blank."""
    hashed = rows.where("html RLIKE '\\\\S'").select(F.explode(_sites()).alias("site"), F.xxhash64("html").alias("page"))
    picks = hashed.groupBy("site").agg(*[F.min(F.xxhash64("page", F.lit(k))).alias(f"m{k}") for k in range(REFERENCES)])
    picks = stage(picks, "reference-picks")
    each = hashed.join(bounded(picks, BROADCAST_ROWS), "site").where(" OR ".join(f"xxhash64(page, {k}) = m{k}" for k in range(REFERENCES)))
    each = stage(each.select("site", "page").distinct(), "reference-pages")
    wanted = bounded(each.select(F.col("page").alias("wanted")).distinct(), BROADCAST_ROWS)

    def run(batches):
        seen: set = set()
        for b in batches:
            new = [(p, t) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p not in seen and not seen.add(p)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in new], pa.int64()), pa.array([skeleton(parse(t)) for _, t in new], pa.string())], names=["page", "tree"])

    found = rows.select("html", F.xxhash64("html").alias("page")).join(wanted, F.col("page") == F.col("wanted"), "left_semi")
    trees = found.select("page", "html").mapInArrow(run, "page long, tree string").groupBy("page").agg(F.min("tree").alias("tree"))
    return each.join(trees, "page").groupBy("site").agg(F.array_sort(F.collect_set("tree")).alias("trees"))  # at most REFERENCES


BLOCKS = "array<struct<host:long,domain:long,marked:boolean,inside:boolean,text:string>>"


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, domain, blocks): host and domain of a block are where it lies in the site's reference trees, null if nowhere."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("domain", domain_of(F.col("host")))
    refs = stage(references(rows), "references")
    size = refs.agg(F.sum(F.length(F.concat_ws("", "trees")).cast("long"))).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    for side, name in enumerate(("host", "domain")):
        tree = small(refs.select(F.col("site").alias(f"{name}_site"), F.col("trees").alias(f"{name}_trees")))
        rows = rows.join(tree, F.get(_sites(), F.lit(side)) == F.col(f"{name}_site"), "left")
    kind = rows.schema["id"].dataType.simpleString()

    def places(aligned: Aligner, page: Node, trees: list[Node]) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, tree in enumerate(trees):
            for mine, theirs in aligned(tree, page).items():
                out.setdefault(mine, k << 40 | theirs)
        return out

    def run(batches):
        known: dict[str, Node] = {}
        aligned = Aligner()
        for b in batches:
            out = []
            for page, *trees in zip(*(b.column(i).to_pylist() for i in (4, 5, 6))):
                if len(known) > 200:
                    known.clear()
                for t in {x for ts in trees for x in ts or ()}:
                    if t not in known:
                        known[t] = from_skeleton(t)
                mine = parse(page)
                at = [places(aligned, mine, [known[t] for t in ts or ()]) for ts in trees]
                own: Counter = Counter()
                told = []
                for n, text, marked, inside in blocks(mine):
                    own[n] += 1  # a node whose text its children break up has several blocks
                    where = [None if n not in x else x[n] << 16 | min(own[n], 65535) for x in at]
                    told.append({"host": where[0], "domain": where[1], "marked": marked, "inside": inside, "text": text})
                out.append(told)
            kinds = pa.list_(pa.struct([("host", pa.int64()), ("domain", pa.int64()), ("marked", pa.bool_()), ("inside", pa.bool_()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, kinds)], names=["id", "url", "host", "domain", "blocks"])

    return rows.select("id", "url", "host", "domain", "html", "host_trees", "domain_trees").mapInArrow(run, f"id {kind}, url string, host string, domain string, blocks {BLOCKS}")


def _keys(name: str) -> Column:
    """A page's blocks as keys of (place in its host or domain, text); blocks that lie nowhere have none."""
    placed = F.filter("blocks", lambda b: b[name].isNotNull())
    return F.transform(placed, lambda b: F.xxhash64(F.lit(name), F.col(name), b[name], b["text"], b["inside"]))


def templates(aligned: DataFrame, name: str) -> DataFrame:
    """(name, key) of the texts that are template at their node on the pages of a host or a domain.

    Pages count once for equal texts of what no markup sets aside, so copies of an article under other menus are one page.
    """
    page = F.xxhash64(F.transform(F.filter("blocks", lambda b: ~b["marked"]), lambda b: F.xxhash64(b["text"])))
    told = aligned.select(name, page.alias("page"), F.explode("blocks").alias("b")).where(F.col(f"b.{name}").isNotNull())
    each = told.select(name, "page", F.col(f"b.{name}").alias("at"), "b.inside", F.xxhash64(F.lit(name), F.col(name), f"b.{name}", "b.text", "b.inside").alias("key"))
    texts = stage(each.distinct().groupBy(name, "at", "inside", "key").agg(F.count("*").alias("n")), "page-texts")
    back = F.col("n") >= TEMPLATE_PAGES
    nodes = texts.groupBy(name, "at", "inside").agg(F.sum("n").alias("pages"), F.sum(F.when(back, F.col("n")).otherwise(0)).alias("common"))
    nodes = nodes.where(f"pages >= {TEMPLATE_PAGES} AND common >= {TEMPLATE_SHARE} * pages").withColumnsRenamed({name: "__site", "at": "__at", "inside": "__inside"})
    met = texts.where(back).join(bounded(stage(nodes, "template-nodes"), BROADCAST_ROWS), (F.col(name) == F.col("__site")) & (F.col("at") == F.col("__at")) & (F.col("inside") == F.col("__inside")))
    article = F.lit(name == "host") & (F.col("pages") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("pages"))
    return stage(met.where(~F.col("inside") | article).select(name, "key"), "templates")


def judged_blocks(aligned: DataFrame) -> DataFrame:
    """aligned with hits array<long>, the keys of a page's blocks that are template on its host or domain."""
    judged = aligned.withColumn("hits", F.array().cast("array<bigint>"))
    for name in ("host", "domain"):
        found = templates(aligned, name)
        sizes = found.groupBy(name).agg(F.count("*").alias("size"))
        large = stage(sizes.where(F.col("size") > ARRAY_KEYS).select(F.col(name).alias("__large")), "large-sites")
        lists = found.join(F.broadcast(large), found[name] == large["__large"], "left_anti").groupBy(name).agg(F.collect_set("key").alias("found"))
        with_list = judged.join(bounded(stage(lists, "template-lists"), 1000), name, "left")
        judged = with_list.withColumn("hits", F.concat("hits", F.array_intersect(_keys(name), F.coalesce("found", F.array().cast("array<bigint>"))))).drop("found")
        if large.limit(1).count():  # sites with very many template texts: keys meet them by a join
            judged = stage(judged.withColumn("__row", F.monotonically_increasing_id()), "judged")
            keys = judged.join(F.broadcast(large), judged[name] == large["__large"], "left_semi").select("__row", F.explode(_keys(name)).alias("key"))
            more = keys.join(found.select("key"), "key", "left_semi").groupBy("__row").agg(F.collect_set("key").alias("more"))
            judged = judged.join(more, "__row", "left").withColumn("hits", F.concat("hits", F.coalesce("more", F.array().cast("array<bigint>")))).drop("more", "__row")
    return judged


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for every row of pages: id_col, url, text and n_chars (code points).

    Blocks are joined by an empty line. A block goes where it is marked as not the article, or where it is template on its host or
    domain; a page of nothing but template keeps what isn't marked. Null or empty html has an empty text; pages without a host form a
    host of their own; repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    judged = judged_blocks(stage(page_blocks(pages, id_col, url_col, html_col), "blocks"))

    def template(b: Column) -> Column:
        met = [F.coalesce(F.array_contains("hits", F.xxhash64(F.lit(n), F.col(n), b[n], b["text"], b["inside"])) & b[n].isNotNull(), F.lit(False)) for n in ("host", "domain")]
        return met[0] | met[1]

    plain = F.filter("blocks", lambda b: ~b["marked"])
    slots = F.filter("blocks", lambda b: ~b["marked"] & ~template(b))
    text = F.array_join(F.transform(F.when(F.size(slots) > 0, slots).otherwise(plain), lambda b: b["text"]), "\n\n")
    return judged.select(F.col("id").alias(id_col), "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
