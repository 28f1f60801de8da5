"""Main text of web pages, by consensus of a host's pages.

Every page names its likeliest container: its main element, or else its articles, if they hold most of the page's good text, widened to the outermost element in which
headings, paragraphs or lists stand beside them; else, from the body down, the lowest element that no good text stands beside. Good text is text that isn't left out and of
which no more than half is links. The container's path of tags and classes, with digits generalised, is the page's vote. Votes are counted by host in Spark, and each page is
then extracted anew from the containers on its host's winning path; a page without good text there, or whose own main element or articles hold more around that path, keeps
its own container.

Left out everywhere: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, by
element, role and class. A class or id marks an element if all its words do or are mere helpers ("comment-list", "page-header-2", but not "market-share", nor
"with-sidebar"). One such word is enough where the page has an article, by element or class, elsewhere, and the element holds neither an article nor a first heading. Quotations and code are never
marked by class. Character references are decoded, white space in a block becomes one space, blocks are joined by \n.
Nothing else of a container is dropped. Time and memory are in proportion to the page, however deeply it is nested.

Nulls: a null html is empty and gives an empty text; pages with a null url vote together. Repeated pages vote each. Very long pages are parsed whole.
Of equal votes, the path with more text, then the first by name wins. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
CONTAINERS = frozenset("html body article center div main section table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav footer aside form head script style noscript template iframe svg math canvas object embed button select option textarea input dialog menu".split())
LEFT_OUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
#: Words in a class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead comment comments disqus reply replies respond social share sharing related recommended recommendations widget hidden".split()
)
#: Words in a class or id that mark the article.
CONTENT = frozenset("article entry story prose".split())
#: Words that may stand beside either.
HELPERS = frozenset(
    "a area article articles bar bars block blocks body bottom box boxes btn button buttons card cards col column container content entry fixed float form global group grid "
    "inner item items js left link links list lists main mobile module nav navbar outer page panel post posts right row section site slot sticky story strip text the theme title top unit units "
    "wide wrap wrapper center desktop section sections ui app web id new".split()
)
#: Words that say that what a class names stands elsewhere, or not at all: "with-sidebar", "no-comments".
STATES = frozenset("with without has have had no not non is are show shows hide hides toggle toggled".split())
#: Elements that quote: their classes don't mark them.
QUOTES = frozenset("blockquote q cite code pre".split())
#: Elements that belong to the text they stand beside.
FLOW = HEADINGS | QUOTES | frozenset("p ul ol dl figure table header hgroup".split())
#: What a start tag closes when it is open and no barrier stands between.
P_CLOSERS = BLOCKS - {"html", "body", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BARRIERS = frozenset("table td th caption button object html".split())
#: Text of an element is good if less than this share of it is links.
LINKS = 0.5

#: Bytes of paths and hosts that are sent to the pages; with more of them, the pages of a host are dealt into so many shares.
MOST_BYTES, SHARES = 32 << 20, 64

TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
REST = re.compile(r"""(?>(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*)>?""")
#: Attributes one after the other, each with its value, so that no name is found within another name or a value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
USED = frozenset("class id role hidden aria-hidden".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "step", "out", "strict", "proof", "parent", "children", "depth", "chars", "linked", "good", "titles", "proofs")

    def __init__(self, tag: str, step: str, out: bool, parent: "Node | None"):
        self.tag, self.step, self.out, self.parent = tag, step, out, parent
        self.strict = tag in ("article", "main") or parent is not None and parent.strict
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.proof = tag in ("article", "main")
        self.chars = self.linked = self.good = self.titles = self.proofs = 0


def _marked(name: str, strict: bool) -> int:
    """Whether a class or an id says that its element isn't the article's: 2 if all its words do, 1 if some do."""
    words = [w.lower() for w in PARTS.findall(name)]
    found = [w in MARKS and not (strict and w == "header") for w in words]  # an article's own header holds its title
    if not any(found) or any(w in STATES for w in words):
        return 0
    return 2 if all(m or w in HELPERS or len(w) == 1 for m, w in zip(found, words)) else 1


class Tree:
    """A page's elements while it is parsed. Open elements are listed by tag, so that the nearest one of a tag is found at once."""

    def __init__(self):
        self.root = self.at = Node("#", "#", False, None)
        self.opened: dict[str, list[Node]] = {}
        self.doubtful: list[Node] = []

    def open(self, tag: str, attributes: str, void: bool) -> Node:
        parent, step, names = self.at, tag, []
        out = parent.out or tag in LEFT_OUT or (tag == "header" and not parent.strict)
        doubtful = False
        if attributes:
            given: dict[str, str] = {}
            for m in ATTRIBUTE.finditer(attributes):
                if (name := m[1].lower()) in USED:
                    given.setdefault(name, m[2] or m[3] or m[4] or "")
            names = given.get("class", "").split()
            if names:
                step = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names})])
            if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in LEFT_OUT_ROLES:
                out = True
            elif tag not in ("html", "body", "article", "main") and tag not in QUOTES:
                if tag not in HEADINGS:  # a heading's id is made from its words
                    names = [*names, given.get("id", "")]
                marks = max((_marked(n, parent.strict) for n in names), default=0)
                out = out or marks == 2
                doubtful = marks == 1 and not parent.strict
        node = Node(tag, step, out, parent)
        if not out and tag != "body" and not doubtful and any(w.lower() in CONTENT for n in names for w in PARTS.findall(n)):
            node.strict = node.proof = True
        if doubtful and not out:
            self.doubtful.append(node)
        parent.children.append(node)
        if not void:
            self.opened.setdefault(tag, []).append(node)
            self.at = node
        return node

    def close(self, tags, barriers) -> bool:
        """Close the nearest open element of `tags` and all inside it, unless a barrier is nearer."""
        nearest = max((self.opened[t][-1] for t in tags if self.opened.get(t)), key=lambda n: n.depth, default=None)
        if nearest is None or any(self.opened[b][-1].depth >= nearest.depth for b in barriers if self.opened.get(b)):
            return False
        while self.at is not nearest.parent:
            self.opened[self.at.tag].pop()
            self.at = self.at.parent
        return True


def parse(page: str) -> Node:
    """A tree of elements and decoded texts; any input gives one."""
    tree = Tree()
    pos, end = 0, len(page)
    while pos < end:
        m = TAG.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text and not tree.at.out:
            tree.at.children.append(references.unescape(text) if "&" in text else text)
        if not m:
            break
        tag = m[2]
        if tag is None:
            close = "-->" if m[0] == "<!--" else ">"
            pos = page.find(close, m.end())
            pos = end if pos < 0 else pos + len(close)
            continue
        tag = tag.lower()
        rest = REST.match(page, m.end())
        pos = rest.end()
        if m[1]:
            tree.close({tag}, () if tag in ("body", "html", "table") else BARRIERS - {tag})
            continue
        if tag in P_CLOSERS:
            tree.close({"p"}, BARRIERS)
        if tag in CLOSES:
            tags, barriers = CLOSES[tag]
            while tree.close(tags, barriers):
                pass
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, pos)
            tree.open(tag, rest[0], False).out = True
            pos = stop.start() if stop else end
        else:
            tree.open(tag, rest[0], tag in VOID or rest[0].endswith("/>"))
    _weigh(tree.root)
    # elements that one word marks: they go if they hold no article and no first heading, and an article stands elsewhere
    gone = [n for n in tree.doubtful if not n.proofs and not n.titles] if tree.root.proofs else []
    for node in gone:
        node.out = True
    if gone:
        _weigh(tree.root)
    return tree.root


def _walk(node: Node) -> Iterator[tuple[Node | str, bool]]:
    """Every part in page order, elements twice: entered (True) and left (False). Without recursion, as pages may nest deeply."""
    stack: list[tuple[Node | str, bool]] = [(node, True)]
    while stack:
        part, entered = stack.pop()
        yield part, entered
        if entered and not isinstance(part, str):
            if part.out:
                continue
            stack.append((part, False))
            stack += [(c, True) for c in reversed(part.children)]


def _weigh(root: Node) -> None:
    """Characters of every element that aren't white space, those of them in links, and those of its parts that aren't mostly links."""
    open_: list[Node] = []
    links = 0
    for part, entered in _walk(root):
        if isinstance(part, str):
            n = len(part.strip())
            open_[-1].chars += n
            open_[-1].good += 0 if links else n
            open_[-1].linked += n if links else 0
        elif part.out:
            continue
        elif entered:
            open_.append(part)
            part.chars = part.linked = part.good = part.proofs = part.titles = 0
            links += part.tag == "a"
        else:
            open_.pop()
            links -= part.tag == "a"
            part.proofs += part.proof and part.good > 0
            part.titles += part.tag == "h1" and part.chars > 0
            if open_:
                up = open_[-1]
                up.proofs += part.proofs
                up.titles += part.titles
                up.chars += part.chars
                up.linked += part.linked
                up.good += 0 if (part.tag in BLOCKS or part.tag == "td") and part.linked > LINKS * part.chars else part.good


def _outermost(root: Node, tag: str) -> list[Node]:
    """Elements of a tag that aren't inside another one, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == tag:
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.out]
    return found


def _holder(nodes: list[Node]) -> Node:
    """The lowest element that all `nodes` stand in."""
    at = nodes[0]
    for other in nodes[1:]:
        while at is not other:
            if at.depth >= other.depth:
                at = at.parent
            else:
                other = other.parent
    return at


def _widened(node: Node) -> Node:
    """The outermost element in which headings, paragraphs, lists or bare text stand beside what leads to `node`, or a title in whatever element; `node` if there is none."""
    best = at = node
    while at.parent is not None and at.tag != "body":
        up = at.parent
        for c in up.children:
            if c is not at and (c.strip() if isinstance(c, str) else not c.out and c.good and (c.tag in FLOW or c.titles)):
                best = up
                break
        at = up
    return best


def container(root: Node) -> tuple[Node, bool]:
    """The page's own choice, and whether main element or articles named it. Several articles are held by the element that all of them stand in; if nothing else
    stands in it and they share their path, by one of them."""
    for tag in ("main", "article"):
        found = [n for n in _outermost(root, tag) if n.good]
        if found and 2 * sum(n.good for n in found) > root.good:
            holder = _holder(found)
            wide = _widened(holder)
            if wide is holder and holder.good == sum(n.good for n in found) and len({path(n) for n in found}) == 1:
                return found[0], True
            return wide, True
    at = root
    while True:
        inner = [c for c in at.children if not isinstance(c, str) and not c.out and c.tag in CONTAINERS and c.good]
        if len(inner) != 1 or inner[0].good < at.good:
            return at, False
        at = inner[0]


def path(node: Node) -> str:
    steps = []
    while node.parent is not None:
        steps.append(node.step)
        node = node.parent
    return ">".join(reversed(steps))


def on_path(root: Node, wanted: str) -> list[Node]:
    """Containers on a path, in page order."""
    at = [root]
    for step in wanted.split(">") if wanted else []:
        at = [c for node in at for c in node.children if not isinstance(c, str) and not c.out and c.step == step]
    return at


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    for node in nodes:
        for part, _ in _walk(node):
            if isinstance(part, str):
                held.append(part)
            elif part.tag in BLOCKS:
                close()
            elif part.tag in ("br", "td", "th"):
                held.append(" ")
        close()
    return out


def extract(page: str | None, wanted: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    own, sure = container(root)
    here = path(own)
    found = on_path(root, wanted) if wanted is not None else []
    if not any(n.good for n in found) or sure and wanted.startswith(f"{here}>"):
        found = on_path(root, here)
    return "\n".join(blocks(found))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """host and path of every page's container, with its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [container(parse(h or ""))[0] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([path(n) for n in own], pa.string()), pa.array([n.chars for n in own], pa.int64())], ["host", "path", "chars"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, chars long")


def winners(cast: DataFrame) -> DataFrame:
    """The path of each host. Votes are added up before they meet by host, so a host of many pages costs as much as its paths."""
    by_path = cast.where("chars > 0").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return by_path.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("chars"), F.col("path"))).alias("wanted"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, w) for h, w in zip(batch.column("html").to_pylist(), batch.column("wanted").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    paths = C.staged(winners(votes(pages)), "paths")
    if (paths.agg(F.sum(F.octet_length("host") + F.octet_length("wanted"))).first()[0] or 0) <= MOST_BYTES:
        told = rows.join(F.broadcast(paths), "host", "left")
    else:  # pages are dealt by host and a share of the host's pages, so that no host is one task's
        share = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SHARES)).cast("int")
        told = rows.withColumn("share", share).join(paths.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["host", "share"], "left")
    return told.select("page_id", "url", "html", "wanted").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(C.table(spark, sf_dir, "pages"))
