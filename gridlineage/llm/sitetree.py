"""Main text of web pages by site style trees: same-host pages are merged, and branches of low importance removed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import slices

#: Texts that are less important than this are removed, whatever else is known of them.
IMPORTANT = 0.4
#: Shares of the importance of a content node: how new its texts are, how they are marked up, how long they are.
CONTENT, ARRANGED, LENGTH = 0.6, 0.2, 0.2
#: Share of the element that holds a content node in what its texts are worth.
HOLDER = 0.1
#: Importance of a node that is seen on one page, where entropy says nothing. It weighs as two pages do.
UNKNOWN = 0.6
#: What evidence leaves of importance: names say that a branch is no article, or reader comments; it is a list of links; it stands outside of the article. Texts of the article gain.
NAMED, TALKED, LINKED, OUTSIDE, GAIN = 0.5, 0.3, 0.5, 0.6, 4.0
#: Share of a page's text from which a branch is taken for the page's body, so that its names say nothing.
BODY = 0.5
#: Bytes of the nodes of all hosts that may be broadcast.
BROADCAST_BYTES = 32_000_000

#: Elements by what they do to the text around them.
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre"
    " figure figcaption address hr details summary fieldset nav header footer aside form menu dialog center hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text; those below are shown, but seldom hold an article.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video button select textarea option datalist".split())
DOUBTFUL = frozenset("nav footer aside form menu dialog search".split())
#: Words in class, id and role that name a part which is no article; the second line at the top of a page only, the third whatever its share of the page.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " footer sidebar aside cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social related recommended comment comments disqus respond replies reply widget toolbar pagination pager copyright contentinfo complementary search masthead".split()
)
TOP = frozenset("header banner masthead".split())
TALK = frozenset("comment comments disqus respond replies reply".split())
#: Beginnings of names that tell what a page has or lacks, not what a branch is.
TELLS = ("has", "no", "with", "without", "is", "not")
#: What closes an open element of the same kind when it starts, and where the search for it ends.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table div section article main body blockquote td th tr aside nav header footer form figure".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def named_parts(names: list[str]) -> set[str]:
    """The words of class, id and role names, but of names that tell what a page has or lacks."""
    split = [[w.lower() for w in WORDS.findall(n)] for n in names]
    return {w for words in split if words and words[0] not in TELLS for w in words}


@dataclass(slots=True)
class Node:
    """A block element of a page, or a run of text among blocks (without a tag)."""

    tag: str
    path: str
    above: Node | None = None
    text: str = ""
    look: str = ""
    #: Characters of text, of text in links, and paragraphs, in the whole branch.
    size: int = 0
    links: int = 0
    paragraphs: int = 0
    #: Characters that stand in article and main elements, and characters that no name speaks against.
    within: int = 0
    plain: int = 0
    #: What its tag and names say: 0 nothing, 1 no article, 2 reader comments.
    says: int = 0
    inside: bool = False
    head: bool = False
    below: list[Node] = field(default_factory=list)


class Page(HTMLParser):
    """The tree of a page's block elements, and the texts at its leaves."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "")
        #: All nodes, parents first.
        self.nodes = [self.root]
        # Entries: tag, node, hidden, whether it stands in an article.
        self.open: list[tuple[str, Node, bool, bool]] = [("", self.root, False, False)]
        self.text: list[str] = []
        self.inline: list[str] = []
        self.linked = self.anchors = 0
        self.feed(html)
        self.close()
        self.flush()
        for node in reversed(self.nodes):
            if node.text:
                node.plain, node.within = node.size, node.size * node.inside
            if node.says and not node.head:
                node.plain = node.within = 0
            if node.above is not None:
                node.above.size += node.size
                node.above.links += node.links
                node.above.paragraphs += node.paragraphs
                node.above.within += node.within
                node.above.plain += node.plain

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                at = self.open[-1][1]
                at.below.append(Node("", at.path + ">", at, words, " ".join(self.inline), len(words), min(self.linked, len(words)), inside=self.open[-1][3]))
                self.nodes.append(at.below[-1])
            self.text = []
        self.inline, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.flush()
            return
        block, top = tag in BLOCKS, self.open[-1]
        named = [w for k, v in attrs if v and k in ("class", "id", "role") for w in v.split()] if attrs else ()
        words = named_parts(named) if named and tag not in ("html", "body", "main") else ()
        if not block:
            # Inside a line there is no branch of the tree: elements that aren't shown or are named as a part go at once.
            hidden = top[2] or tag in UNSEEN or tag in DOUBTFUL or bool(words and not words.isdisjoint(PARTS))
            if hidden:
                self.open.append((tag, top[1], True, top[3]))
            else:
                self.inline.append(tag)
                self.anchors += tag == "a"
            return
        self.flush()
        self.anchors = 0
        self.end_open(tag)
        _, at, hidden, inside = self.open[-1]
        style = ".".join([tag, *sorted(named)]) if named else tag
        path = f"{at.path}>{style}"
        if len(path) > 400:
            path = f"#{digest(path):x}"
        node = Node(tag, path, at, inside=inside or tag in ("article", "main"), paragraphs=int(tag == "p"))
        if words and not words.isdisjoint(TALK):
            node.says = 2
        elif tag in DOUBTFUL or (tag == "header" and not inside) or (words and (not words.isdisjoint(PARTS) or (not inside and not words.isdisjoint(TOP)))):
            node.says = 1
        at.below.append(node)
        self.nodes.append(node)
        if tag in ("h1", "main"):
            while at is not None and not at.head:
                at.head, at = True, at.above
        self.open.append((tag, node, hidden, node.inside))

    def end_open(self, tag: str) -> None:
        """Closes what a start tag closes: an open item of a list by the next, a paragraph by any block."""
        kinds = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            was = self.open[i][0]
            if was in kinds:
                del self.open[i:]
                break
            if was in SCOPE:
                break
        for i in range(len(self.open) - 1, max(0, len(self.open) - 4), -1):
            if self.open[i][0] == "p":
                del self.open[i:]
                break
            if self.open[i][0] in SCOPE:
                break

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        block = tag in BLOCKS
        if block:
            self.flush()
            self.anchors = 0
        elif tag == "a":
            self.anchors = max(0, self.anchors - 1)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if not block and self.open[i][0] in BLOCKS:
                break

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.text.append(data)
            if self.anchors:
                self.linked += len(data)


#: Features of a node: a text it holds, its arrangement, its length.
TEXT, LOOK, SIZE = 0, 1, 2


def styled(html: str | None) -> tuple[int, list[tuple[int, int, int]]]:
    """A page's hash, and the (style node, feature, value) of each node of its tree that holds text.

    Nodes of one path are one. A content node has a value TEXT for each different text. LOOK is a hash of the inline
    markup of texts, or of an element's children by tag and class; SIZE is that of the mean branch as a power
    of two. A page goes by its longest text, so copies of an article among other menus are one page.
    """
    if not html:
        return 0, []
    page = Page(html)
    longest, same = "", {}
    for node in page.nodes:
        if node.size:
            same.setdefault(node.path, []).append(node)
            if len(node.text) > len(longest):
                longest = node.text
    out = []
    for path, nodes in same.items():
        if path:
            at = digest(path)
            out += [(at, TEXT, h) for h in {digest(n.text) for n in nodes if n.text}]
            looks = {n.look if n.text else " ".join(dict.fromkeys(b.path[len(path) :] for b in n.below if b.size)) for n in nodes}
            out.append((at, LOOK, digest(*sorted(looks))))
            out.append((at, SIZE, (sum(n.size for n in nodes) // len(nodes)).bit_length()))
    return digest(longest), out


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, feature, value, page) of every style node of every page of (host, html); all but the host are hashes or numbers."""
    names = ["host", "node", "feature", "value", "page"]

    def run(batches):
        for b in batches:
            hosts, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 2_000_000):
                out: list[list] = [[] for _ in names]
                for host, html in zip(hosts[lo:hi], texts[lo:hi], strict=True):
                    page, nodes = styled(html)
                    for node in nodes:
                        for c, v in zip(out, (host, *node, page), strict=True):
                            c.append(v)
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return pages.mapInArrow(run, "host string, node long, feature int, value long, page long")


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, n, importance) of each node of the merged trees.

    n counts the different pages that have the node; copies of a page count once. A text's entropy over the pages
    that hold it is 0 bits where it stands on one, and one or more bits where it stands on several: it's new in
    the first case, and not in the second. Content is the share of new ones among all (text, page) of the node. The
    entropy of arrangement and of length is 1 if they differ on each page and 0 if they are always the same. A
    content node's importance is the mean of the three by their shares, an element's that of the last two. It's drawn to
    UNKNOWN as if two more pages had said so, and one page says nothing.
    """
    counts = nodes.distinct().groupBy("host", "node", "feature", "value").agg(F.count("*").alias("c"))
    n, s, new = F.sum("c"), F.sum(F.col("c") * F.log("c")), F.sum((F.col("c") == 1).cast("long"))
    each = counts.groupBy("host", "node", "feature").agg(n.alias("n"), F.when(F.col("feature") == TEXT, new / n).when(n > 1, 1 - s / (n * F.log(n))).otherwise(1.0).alias("h"))
    share = F.when(F.col("feature") == TEXT, CONTENT).when(F.col("feature") == LOOK, ARRANGED).otherwise(LENGTH)
    mean = each.groupBy("host", "node").agg(F.max(F.when(F.col("feature") == SIZE, F.col("n"))).alias("n"), (F.sum(share * F.col("h")) / F.sum(share)).alias("h"))
    return mean.select("host", "node", "n", ((F.col("h") * (F.col("n") - 1) + 2 * UNKNOWN) / (F.col("n") + 1)).alias("importance"))


def evidence(node: Node, page: Node) -> float:
    """What a page (its root) itself says of a branch: a factor of the importance of its texts, 1 if it says nothing.

    Names and tags count unless the branch is the page's body: it holds the heading, or BODY of the text and
    half of the paragraphs or, on a page without heading, no matter what. Those of reader comments count
    unless the branch holds the heading. A branch of two links or more and little else counts less. If article and main
    elements hold BODY of the text that no name speaks against, all outside counts less and they count more.
    """
    most = node.size >= BODY * page.size and node.says < 2 and (not page.head or 2 * node.paragraphs >= max(page.paragraphs, 1))
    against = 1.0
    if node.says and not (node.head or most):
        against = TALKED if node.says == 2 else NAMED
    if not node.head and node.links >= 0.8 * node.size and sum(b.size > 0 for b in node.below) > 1:
        against = min(against, LINKED)
    if page.within and page.within >= BODY * page.plain:
        if node.text and not node.inside:
            against = min(against, OUTSIDE)
        elif node.inside and against == 1:
            return GAIN
    return against


def kept(html: str | None, known: dict[int, float], judge=evidence) -> list[str]:
    """The texts of a page whose importance, times the strongest evidence against the branches they are in, reaches IMPORTANT.

    known: importance of nodes of the host's tree; that of others is UNKNOWN. A text's importance is that of its
    content node, and to the share HOLDER that of the element which holds it. Gains count where nothing is against a
    text. A branch is removed when all its texts are.
    """
    if not html:
        return []
    root = Page(html).root
    out, stack = [], [(root, 1.0, UNKNOWN)]
    while stack:
        node, factor, holder = stack.pop()
        if not node.size:
            continue
        e = judge(node, root)
        factor = min(factor, e) if e < 1 else max(factor, e) if factor >= 1 else factor
        own = known.get(digest(node.path), UNKNOWN)
        if node.text:
            if factor * ((1 - HOLDER) * own + HOLDER * holder) >= IMPORTANT:
                out.append(node.text)
        else:
            stack += [(b, factor, own) for b in reversed(node.below)]
    return out


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, blocks joined by newlines.

    All pages of a host are merged in a tree of styles, in which a node is the path of tags and classes. A
    node's importance is the entropy of what it holds and of how it is arranged over the host's pages
    (`importance`). Texts below IMPORTANT are removed from each page; what the page's tags, names and links say of a
    branch (`evidence`) moves those that are near it. Only scripts, styles and other things that are not shown go
    before.

    A null page, and one without main text, has an empty text. Rows with equal or null keys are pages of
    their own. Pages without a host in their url, or without a url, are merged with each other. Further
    columns are not read. An empty table gives an empty result.
    """
    host = F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit(""))
    rows = pages.select(host.alias("host"), F.col(html).alias("html"), F.col(key).alias("page_id"), F.col(url).alias("url"))
    # Nodes of one page have the importance UNKNOWN, so they needn't be known.
    found = importance(style_nodes(rows.select("host", "html"))).filter("n > 1")
    found = checkpointed(found.groupBy("host").agg(F.collect_list("node").alias("nodes"), F.collect_list("importance").alias("values")))
    size = found.agg(F.sum(F.size("nodes") * 16 + F.octet_length("host") + 100)).first()[0] or 0
    known = F.broadcast(found) if size <= BROADCAST_BYTES else found
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            nodes, values = b.column(3), b.column(4)
            last, rule = None, {}
            for lo, hi in slices(texts, 2_000_000):
                out = []
                for i in range(lo, hi):
                    now = nodes[i]
                    if now != last:
                        last, rule = now, dict(zip(now.as_py() or (), values[i].as_py() or (), strict=True))
                    out.append("\n".join(kept(texts[i], rule)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "nodes", "values")
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
