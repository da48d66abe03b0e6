"""Main text of web pages by consensus host paths.

Each page's containers are scored by their share of the page's running text, less what stands in links. Every page
votes with these scores for the generalised tag-class paths of its containers; votes are added per host in Spark, and
each page is extracted again from the elements that its host's winning path names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import durable

# HTML's elements without content, with raw text, that begin a block, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("body div article main section td center".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements a start tag ends, and which elements such a search doesn't leave.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "body": set()}
#: Elements and names that never hold the article.
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu title noembed noframes audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion promos banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar side aside rail widget footer foot masthead topbar header toolbar"
    " comment comments commentlist disqus respond replies reactions share sharing social related recommended recommendations newsletter subscribe subscription signup login search form skip toc tags copyright legal disclaimer".split()
)
#: What may stand beside such a word in a name that says no more than where, how, or how many.
PLACES = frozenset(
    "left right top bottom upper lower first last inner outer site page global main primary secondary mobile desktop sticky fixed box bar wrap wrapper container area block region zone column col panel section group"
    " list links link buttons button btn icons posts post articles stories items item entry message messages body text title thread unit slot row js google the bg".split()
)
#: Of these, in the names of running text, too.
INLINE = frozenset("ad ads advert advertisement advertising sponsor sponsored sponsors cookie cookies comment comments share copyright".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: Names that tell of a layout, not of what the element is.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|is|hide|show)[_-]\S*", re.I)
#: Shares of the page's running text: above NAMED_SHARE an element may be a wrapper of the page whatever its name, with
#: LEFT_SHARE of its own text outside there is nothing else, and an article of ARTICLE_SHARE is the page's.
NAMED_SHARE, LEFT_SHARE, ARTICLE_SHARE = 0.5, 0.02, 0.25
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text", "links", "dropped")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.text = self.links = 0
        self.dropped = False


def parse(html: str) -> Node:
    """A tree of any text whatever and of any depth; unclosed and stray tags are repaired roughly as browsers do."""
    root = node = Node("html", {}, None)
    at, n, lower = 0, len(html), None
    opened: dict[str, int] = {}  # open elements by tag, so that stray end tags cost nothing

    def leave(last: Node) -> Node:
        """Ends the open elements up to this one."""
        here = node
        while here is not last.parent:
            opened[here.tag] -= 1
            here = here.parent
        return here

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            up = node if opened.get(tag) else None
            while up is not None and up.tag != tag:
                if up.tag in BLOCK and tag not in BLOCK:  # an inline end tag doesn't close a block
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                node = leave(up)
            continue
        attrs = {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(m[3])} if m[3] and m[3] != "/" else {}
        if tag == "html":
            root.attrs = root.attrs | attrs
            continue
        if tag in BLOCK and opened.get("p"):
            up = node
            while up.tag not in BLOCK and up.parent is not None:
                up = up.parent
            if up.tag == "p":
                node = leave(up)
        if tag in ENDS and any(opened.get(x) for x in ENDS[tag]):
            up, last = node, None
            while up.parent is not None and up.tag not in FENCE[tag]:
                if up.tag in ENDS[tag]:
                    last = up
                up = up.parent
            if last is not None:
                node = leave(last)
        new = Node(tag, attrs, node)
        node.children.append(new)
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            lower = lower if len(lower) == n else re.sub("[A-Z]", lambda x: x[0].lower(), html)
            end = lower.find(f"</{tag}", at)
            at = n if end < 0 else end
            if end >= 0:
                close = html.find(">", end)
                at = n if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
            node = new
            opened[tag] = opened.get(tag, 0) + 1
    return root


def boilerplate(node: Node) -> bool:
    """Whether an element is no part of the article by its tag, its role, or as it isn't shown."""
    if node.tag in DROPPED:
        return True
    a = node.attrs
    if not a or node.tag == "body":
        return False
    return "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))


def named(node: Node, inside: bool) -> bool:
    """Whether an element's class or id names boilerplate: a word of NAMES, alone or beside words of PLACES only.

    inside: the element is part of an article or main, where ids are what links within the page lead to.
    """
    a = node.attrs
    if not a or node.tag == "body" or node.tag in ("article", "main", "b", "i", "em", "strong", "code", "mark"):
        return False
    names = a.get("class", "")
    if not inside and node.tag != "section":
        names += " " + a.get("id", "")
    words = INLINE if node.tag in ("p", "span", "a") else NAMES
    for name in LAYOUT.sub("", names).split():
        parts = [x.lower() for x in PART.findall(name)]
        if any(x in words for x in parts) and all(x in NAMES or x in PLACES for x in parts):
            return True
    return False


def measure(order: list[Node]) -> None:
    """Text, and text in links, of elements in page order."""
    for x in order:
        x.text = x.links = 0
    for x in reversed(order):
        x.text += sum(len(c.strip()) for c in x.children if isinstance(c, str))
        if x.tag == "a":
            x.links = x.text
        if x.parent is not None:
            x.parent.text += x.text
            x.parent.links += x.links


def walk(root: Node) -> list[Node]:
    """Elements in page order, without those below dropped ones; marks the dropped and measures the text of the rest.

    A name doesn't drop an element that holds main or the page's own article, nor one with most of the page's running
    text that has the page's heading, too, or outside which there is no running text.
    """
    order, todo, some = [], [(root, False, False)], False
    part: set[int] = set()  # elements inside an article or main
    while todo:
        x, section, inside = todo.pop()
        x.dropped = (boilerplate(x) or x.tag == "header" and not section) and x is not root  # an article's own header belongs to it
        if x.dropped:
            continue
        order.append(x)
        if inside:
            part.add(id(x))
        section, inside = section or x.tag in ("article", "main", "section"), inside or x.tag in ("article", "main")
        todo += [(c, section, inside) for c in reversed(x.children) if not isinstance(c, str)]
    measure(order)
    total = order[0].text - order[0].links
    articles = [x for x in order if x.tag == "article" and x.text - x.links >= ARTICLE_SHARE * total]
    holds: set[int] = set()  # ancestors of main and of the longest article
    titled: set[int] = set()
    plain = {id(x): x.text - x.links for x in order if x.tag in HEADING}
    beside = sum(plain.values())  # headings aren't running text
    headed: dict[int, int] = {}
    for x in reversed(order):
        headed[id(x)] = headed.get(id(x), 0) + plain.get(id(x), 0)
        if x.parent is not None:
            headed[id(x.parent)] = headed.get(id(x.parent), 0) + headed[id(x)]
            if x.tag in ("h1", "h2") and x.text or id(x) in titled:
                titled.add(id(x.parent))
    for x in [y for y in order if y.tag == "main"] + ([max(articles, key=lambda y: y.text - y.links)] if articles else []):
        while x.parent is not None and id(x.parent) not in holds:
            x = x.parent
            holds.add(id(x))
    gone: set[int] = set()
    for x in order:
        if x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))
        elif x is not root and id(x) not in holds and named(x, id(x) in part):
            own = x.text - x.links
            left = total - beside - (own - headed[id(x)])
            if own <= NAMED_SHARE * total or id(x) not in titled and left > LEFT_SHARE * own:
                x.dropped = some = True
                gone.add(id(x))
    if some:
        order = [x for x in order if id(x) not in gone]
        measure(order)
    return order


def step(node: Node) -> str:
    """Tag and class, numbers and hashes made general."""
    names = sorted({re.sub(r"[0-9a-f]{8,}|\d+", "#", c.lower()) for c in (node.attrs.get("class") or node.attrs.get("id") or "").split()})
    return ".".join([node.tag, *names])


def path(node: Node, known: dict[int, str]) -> str:
    """The generalised path: a digest of all steps from the root, and the last one. known: those of elements already asked for."""
    way = []
    while node is not None and id(node) not in known:
        way.append(node)
        node = node.parent
    so_far = known[id(node)] if node is not None else ""
    for x in reversed(way):
        own = step(x)
        so_far = known[id(x)] = f"{hashlib.md5(f'{so_far}/{own}'.encode('utf-8', 'surrogatepass')).hexdigest()}/{own}"
    return so_far


def containers(order: list[Node]) -> list[tuple[Node, float]]:
    """Containers with their scores: those on the way down to where the running text divides."""
    total = max(1, order[0].text - order[0].links)
    out = [(order[0], 0.05)]
    depth, beside = {id(order[0]): 0}, {id(order[0]): False}  # beside: a heading stands beside it or what it is in, below the body
    headed = {id(x.parent) for x in order if x.tag in ("h1", "h2") and x.text}
    for x in order[1:]:
        up = x.parent
        depth[id(x)] = depth[id(up)] + 1
        beside[id(x)] = up.tag != "body" and (beside[id(up)] or id(up) in headed)
        if x.tag not in CONTAINER:
            continue
        share = (x.text - x.links) / total
        if share < 0.4:
            continue
        score = share * (1 - x.links / max(1, x.text)) * (0.5 if x.tag == "body" else 1)
        if beside[id(x)]:  # the heading belongs to the article
            score *= 0.6
        if x.tag == "article" or x.attrs.get("itemprop") == "articleBody":
            score *= 1.6
        elif x.tag == "main" or x.attrs.get("role") == "main":
            score *= 1.4
        elif x.tag == "div" or x.tag == "section":
            score *= 1 + 0.04 * min(depth[id(x)], 5)
        out.append((x, score))
    return out


def blocks(top: Node) -> list[str]:
    """The blocks of an element, without dropped ones; white space in them is one blank."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            t = " ".join(unescape("".join(held)).split())
            held.clear()
            if t:
                out.append(t)

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not x.dropped:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            elif x.tag in ("br", "wbr", "img"):
                held.append(" " if x.tag == "br" else "")
            todo += reversed(x.children)
    end()
    return out


def ballots(html: str) -> list[tuple[str, float]]:
    """The votes of a page: each path once, with its best score."""
    got: dict[str, float] = {}
    known: dict[int, str] = {}
    for x, score in containers(walk(parse(html))):
        p = path(x, known)
        got[p] = max(score, got.get(p, 0.0))
    return list(got.items())


def extract(html: str, winner: str | None) -> str:
    """Text of the elements that the winning path names, or of the page's own best container if it has none."""
    order = walk(parse(html))
    if order[0].text == 0:
        return ""
    last = winner.partition("/")[2] if winner else None
    known: dict[int, str] = {}
    found = [x for x in order if last is not None and x.text and step(x) == last and path(x, known) == winner]
    if not found:
        found = [max(containers(order), key=lambda y: y[1])[0]]
    return "\n".join(t for x in found for t in blocks(x))  # equal paths are equally deep, so none is inside another


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page; other columns, whatever their names, are left out.

    A null or empty html, or one without running text, gives an empty text. Pages with a null url, or one without a
    host, share one host's votes. Of paths with equal votes the one that sorts first wins. Repeated rows give
    repeated rows, an empty table an empty one. Ids may be null and of any type. Votes are added per host and path, each
    task sending one row for both.
    """
    rows = pages.select(
        F.col(id_column).alias("_id"), F.col(url_column).alias("_url"), F.coalesce(F.col(html_column), F.lit("")).alias("_html"),
        F.coalesce(F.lower(F.regexp_extract(F.col(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("_host"),
    )

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(host.as_py(), p, s) for host, html in zip(b.column(0), b.column(1)) for p, s in ballots(html.as_py())]
            sums: dict[tuple[str, str], float] = {}
            for host, p, s in out:
                sums[host, p] = sums.get((host, p), 0.0) + round(s * 1000)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([int(v) for v in sums.values()], pa.int64())], ["_host", "_path", "_votes"])

    votes = rows.select("_host", "_html").mapInArrow(vote, "_host string, _path string, _votes long").groupBy("_host", "_path").agg(F.sum("_votes").alias("_votes"))
    best = votes.groupBy("_host").agg(F.min(F.struct((-F.col("_votes")).alias("v"), F.col("_path").alias("p"))).alias("_best")).select("_host", F.col("_best.p").alias("_winner"))
    best = durable(best.join(rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")), "_host"))
    # Hosts with a thousandth of the pages or more are a thousand at most: their winners are told by broadcast, and the
    # pages of the rest, none of them a hot key, are joined by shuffle.
    many = F.broadcast(best.where(F.col("_pages") * 1000 >= (best.agg(F.sum("_pages")).first()[0] or 0)))
    rest = rows.join(many.select("_host"), "_host", "left_anti").join(best.hint("shuffle_hash"), "_host", "left")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(html.as_py(), w.as_py()) for html, w in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "_text", "_n"])

    kind = pages.schema[id_column].dataType.simpleString()
    got = rows.join(many, "_host").unionByName(rest).select("_id", "_url", "_html", "_winner").mapInArrow(again, f"_id {kind}, _url string, _text string, _n long")
    return got.select(F.col("_id").alias(id_column), F.col("_url").alias(url_column), F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
