"""Main text of web pages, with site templates removed.

Pages are parsed into elements; every subtree is hashed, hashes are counted per host over all
pages in Spark, and subtrees that recur across many pages of a host are deleted; inside the
article they must be on most pages of the host. Elements that are page furniture by name,
role or class go as well, but a class never takes the article, an h1 or most of the text.
What is left of the article is its text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchscope.llm.common import attach, release
from patchscope.llm.hosts import host
from patchscope.session import checkpointed

#: Elements by name (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title noscript template iframe noembed noframes object svg canvas audio video map datalist".split())
FURNITURE = frozenset("nav footer aside form button select textarea input dialog menu fieldset".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - frozenset("body html option tbody td tfoot th thead tr".split())
#: An opening tag closes the open element of these names, up to the boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption button html object template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in a class or id that mark furniture.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay
nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar toolbar social share sharing related recommended newsletter subscribe signup login
comment comments disqus replies respond pagination pager skip""".split())
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z]+")

#: A subtree is a template if it is on this many pages of a host and on this share of them; hosts of fewer than twice as many pages need half of theirs, LEAST_PAGES at least.
MIN_PAGES, MIN_SHARE = 10, 0.01
LEAST_PAGES = 3
#: The same inside an article, where copied passages recur too.
INSIDE_PAGES, INSIDE_SHARE = 4, 0.8
#: Pages (name and template lists) that are broadcast at most when they are parsed again.
BROADCAST_PAGES = 20_000
#: Kinds of candidates: outside the article, inside, and inside with a class that ends in a furniture word.
OUTSIDE, INSIDE, MARKED = 0, 1, 2


class Element:
    __slots__ = ("name", "marks", "children", "parent", "size", "main")

    def __init__(self, name: str, marks: str, parent: Element | None):
        self.name, self.marks, self.parent = name, marks, parent
        self.children: list[Element | str] = []
        #: Characters of text, and whether an article, a main or an h1 is held; set by ``weigh``.
        self.size, self.main = -1, False


def parse(page: str) -> Element:
    """A tree of elements and decoded texts. Unclosed and stray tags are repaired as browsers do in the plain cases."""
    root = node = Element("html", "", None)
    at, size = 0, len(page)
    while at < size:
        tag = TAG.search(page, at)
        if tag is None:
            break
        if tag.start() > at:
            node.children.append(entities.unescape(page[at : tag.start()]))
        at = tag.end()
        if tag[2] is None:
            if tag[0].startswith("<![CDATA["):
                node.children.append(tag[0][9:].removesuffix("]]>"))
            continue
        name = tag[2].lower()
        if tag[1]:
            if name == "br":
                node.children.append(Element("br", "", node))
                continue
            up, limit = node, SCOPE if name not in SCOPE else frozenset(("html",))
            while up is not None and up.name != name and not (up.name in limit and up is not node):
                up = up.parent
            if up is not None and up.name == name and up.parent is not None:
                node = up.parent
            continue
        if name in ("html", "body") and any(name == x for x in ancestors(node)):
            continue
        if name in CLOSES_P:
            node = close(node, {"p"}, SCOPE)
        if name in IMPLIED:
            node = close(node, *IMPLIED[name])
        if name == "body":
            node = close(node, {"head"}, {"html"})
        child = Element(name, marks(tag[3]), node)
        node.children.append(child)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            text = page[at : end.start() if end else size]
            child.children.append(entities.unescape(text) if name in ("title", "textarea") else text)
            at = end.end() if end else size
        else:
            node = child
    if at < size:
        node.children.append(entities.unescape(page[at:]))
    return root


def ancestors(node: Element | None):
    while node is not None:
        yield node.name
        node = node.parent


def close(node: Element, names: set[str], limit) -> Element:
    """The node to go on at after closing the outermost open element of these names within the limit."""
    found, up = None, node
    while up is not None and up.name not in limit:
        if up.name in names:
            found = up
        up = up.parent
    return found.parent if found is not None else node


def marks(attributes: str) -> str:
    """Class, id, role and visibility of a start tag, the parts that decide."""
    out = []
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                out.append(value)
            elif name == "role":
                out.append(f"role:{value}")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                out.append("hidden:")
    return " ".join(out)


def furniture(node: Element, in_article: bool) -> bool:
    """True for what is no main text by its name, role, class or id."""
    if node.name in UNSEEN or node.name in FURNITURE or node.name == "header" and not in_article:
        return True
    if not node.marks or node.name in ("html", "body", "main", "article"):
        return False
    tokens = node.marks.split()
    if "hidden:" in tokens or any(t.startswith("role:") and t[5:] in ROLES for t in tokens):
        return True
    return any(t in MARKS for t in tokens) and not holds_main(node)


def marked(node: Element) -> bool:
    """True if a class or id ends in a furniture word: it deletes nothing alone, the host's counts have to agree."""
    return any(MARKS.intersection(WORDS.findall(t)[-1:]) for t in node.marks.split() if ":" not in t)


def weigh(root: Element) -> None:
    """Set size and main of all elements of a page."""
    for node in reversed(list(flat(root))):
        inner = [c for c in node.children if isinstance(c, Element)]
        seen = node.name not in UNSEEN
        node.size = sum(c.size for c in inner) + sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)) if seen else 0
        node.main = seen and (node.name in ("article", "main", "h1") or any(c.main for c in inner))


def holds_main(node: Element) -> bool:
    """True if an element holds an article, a main, an h1, or most of the page's text."""
    root = node
    while root.parent is not None:
        root = root.parent
    if root.size < 0:
        weigh(root)
    return node.main or 2 * node.size > root.size


def flat(node: Element):
    """Nodes below, each before what it holds, with no recursion."""
    stack: list[Element] = [node]
    while stack:
        one = stack.pop()
        yield one
        stack += [c for c in reversed(one.children) if isinstance(c, Element)]


def main_nodes(root: Element) -> list[Element]:
    """The outermost articles; else the outermost ``main``; else the whole page. Articles inside furniture, such as comments, do not count."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.name == wanted:
                found.append(node)
            elif not furniture(node, False):
                stack += [c for c in reversed(node.children) if isinstance(c, Element)]
        if found:
            return found
    return [root]


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of each element's subtree (names, marks and texts), by the element's identity."""
    out: dict[int, int] = {}
    for node in reversed(list(flat(root))):
        parts = [f"{out[id(c)]:x}" if isinstance(c, Element) else " ".join(c.split()) for c in node.children]
        out[id(node)] = xxhash.xxh64_intdigest("\x1f".join([node.name, node.marks, *filter(None, parts)])) - (1 << 63)
    return out


def first_look(page: str | None) -> tuple[str, bool, list[tuple[int, int, int]]]:
    """Text without any templates, whether all of the page is the main part, and the subtrees that may be templates, from one parse."""
    if not page:
        return "", True, []
    root = parse(page)
    main = main_nodes(root)
    return _text(main, {}, set(), set()), main == [root], candidates(root, main)


def candidates(root: Element, main: list[Element]) -> list[tuple[int, int, int]]:
    """(hash, kind, hash of the articles, or 0 outside) of the distinct subtrees that may be templates; inside the article blocks with text, but for what holds an h1 or most of the text."""
    hashes = subtree_hashes(root)
    tops = {id(m) for m in main if m is not root}
    around = set()
    for m in main:
        while m is not None:
            around.add(id(m))
            m = m.parent
    wanted: set[tuple[int, int]] = set()
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.name in UNSEEN or node is not root and id(node) not in tops and inside and furniture(node, True):
            continue
        if inside and node.name in BLOCKS and not holds_main(node) and node.size:
            wanted.add((hashes[id(node)], INSIDE))
            if marked(node):
                wanted.add((hashes[id(node)], MARKED))
        elif not inside and id(node) not in around:
            wanted.add((hashes[id(node)], OUTSIDE))
        inside = inside or id(node) in tops
        stack += [(c, inside) for c in node.children if isinstance(c, Element)]
    own = xxhash.xxh64_intdigest(",".join(str(hashes[id(m)]) for m in main)) - (1 << 63)
    return sorted((h, kind, own if kind != OUTSIDE else 0) for h, kind in wanted)


def main_text(page: str | None, templates=(), inside=()) -> str:
    """The text of the main part without templates and furniture: blocks joined by line feeds.

    ``templates`` go outside articles, ``inside`` within them. A page that these would leave
    without any text, or without most of an article, is a copy of others and keeps them.
    """
    if not page:
        return ""
    root, templates, inside = parse(page), set(templates or ()), set(inside or ())
    hashes = subtree_hashes(root) if templates or inside else {}
    main = main_nodes(root)
    if inside:
        weigh(root)
        main_size, gone = sum(m.size for m in main), 0
        stack = list(main)
        while stack:
            node = stack.pop()
            if hashes[id(node)] in inside and not holds_main(node):
                gone += node.size
            else:
                stack += [c for c in node.children if isinstance(c, Element)]
        inside = inside if 2 * gone <= main_size else set()
    text = _text(main, hashes, templates, inside)
    return text or _text(main, {}, set(), set()) if templates else text


def _text(mains: list[Element], hashes: dict[int, int], templates: set[int], inside: set[int]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def template(node: Element, article: bool) -> bool:
        known = inside if article else templates
        return bool(known) and hashes[id(node)] in known and not (article and holds_main(node))

    def end():
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for main in mains:
        article = main.name == "article" or main.name == "main"
        stack: list[tuple[str, Element | str]] = [("open", main)]
        while stack:
            what, node = stack.pop()
            if what == "end":
                end()
            elif isinstance(node, str):
                line.append(node)
            elif node.name == "br":
                line.append(" ")
            elif node is main or not (furniture(node, article) or template(node, article)):
                block = node.name in BLOCKS
                if block:
                    end()
                    stack.append(("end", node))
                stack += [("open", c) for c in reversed(node.children)]
        end()
    return "\n".join(blocks)


def first_pass(pages: DataFrame) -> DataFrame:
    """Every page parsed once: page_id, url, __host, __h (of the html), text, __whole, and the hashes of candidates in three lists with the articles' hash. Stored."""

    def run(batches):
        release()
        for batch in batches:
            looks = [first_look(p.as_py()) for p in batch.column("html")]
            lists = [[[h for h, k, _ in found if k == kind] for _, _, found in looks] for kind in (OUTSIDE, INSIDE, MARKED)]
            articles = [next((a for _, k, a in found if k != OUTSIDE), 0) for _, _, found in looks]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "__host", "__h")), pa.array([t for t, _, _ in looks], pa.string()), pa.array([w for _, w, _ in looks]),
                 *(pa.array(x, longs) for x in lists), pa.array(articles, pa.int64())], ["page_id", "url", "__host", "__h", "text", "__whole", *LISTS, "__article"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, __host string, __h long, text string, __whole boolean, {', '.join(f'{c} array<long>' for c in LISTS)}, __article long"
    return checkpointed(named(pages).mapInArrow(run, schema))


def named(pages: DataFrame) -> DataFrame:
    """page_id, url, html, the host and a hash of the html: with the page_id the row's name; rows of one name are alike."""
    return pages.select("page_id", "url", "html", host(F.col("url")).alias("__host"), F.xxhash64("url", "html").alias("__h"))


#: Candidates outside the articles, inside, and inside with a furniture class.
LISTS = ("__outer", "__inner", "__marked")


def template_counts(looked: DataFrame) -> DataFrame:
    """(host, hash, kind, n_pages) of candidate subtrees over all pages; equal rows count each, but equal articles once for what they hold."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("hashes")) for k, c in zip((OUTSIDE, INSIDE, MARKED), LISTS)])
    rows = looked.select(F.col("__host").alias("host"), F.col("__article").alias("article"), F.inline(kinds)).select("host", "article", "kind", F.explode("hashes").alias("hash"))
    return rows.groupBy("host", "hash", "kind").agg(
        F.count("*").alias("__all"), F.count_distinct(F.when(F.col("kind") != OUTSIDE, F.col("article"))).alias("__articles")).select(
        "host", "hash", "kind", F.when(F.col("kind") == OUTSIDE, F.col("__all")).otherwise(F.col("__articles")).alias("n_pages"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Subtrees on at least ``min_pages`` pages (half of the pages of a small host, see
    LEAST_PAGES) and ``min_share`` of the pages of a host are deleted. Inside an ``article``
    or ``main`` element it takes INSIDE_PAGES and INSIDE_SHARE, since passages that some
    articles of a site share are text, not template, unless a class ends in a word of
    furniture; an h1 or most of the text never goes. NULL or empty html gives empty text;
    pages without host share the empty host. Repeated rows stay and count each; an empty
    table gives none; other columns are not read. Every page is parsed once; those that hold a
    template of their host in the main part are read and parsed again.
    """
    looked = first_pass(pages)
    sizes = pages.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("__rows"))
    counts = template_counts(looked).where(F.col("n_pages") >= min(min_pages, LEAST_PAGES))
    # templates of a host: at most (subtrees of a page) / min_share
    n, rows = F.col("n_pages"), F.col("__rows")
    enough = F.greatest(F.least(F.lit(min_pages), F.ceil(rows / 2)), F.lit(min(min_pages, LEAST_PAGES)))
    often = (n >= enough) & (n >= rows * min_share)
    within = (n >= INSIDE_PAGES) & (n >= rows * INSIDE_SHARE)
    kind = F.col("kind")
    lists = counts.join(sizes, "host").where(F.when(kind == INSIDE, within).otherwise(often))
    lists = lists.groupBy("host").agg(
        F.collect_list(F.when(kind == OUTSIDE, F.col("hash"))).alias("__templates"),
        F.collect_set(F.when(kind != OUTSIDE, F.col("hash"))).alias("__inside"), F.first("__rows").alias("__rows"))
    lists = checkpointed(lists)
    known = attach(looked, lists.withColumnRenamed("host", "__host"), ["__host"], "__rows", "page_id")
    holds = lambda found, wanted: F.coalesce(F.arrays_overlap(found, wanted), F.lit(False))
    changes = (F.col("__whole") & holds("__outer", "__templates")) | holds("__inner", "__inside") | holds("__marked", "__inside")
    again = checkpointed(known.where(changes).select("page_id", "__h", "__templates", "__inside").distinct())
    name = ["page_id", "__h"]
    if not again.take(1):
        return looked.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    same = lambda left: [left["page_id"].eqNullSafe(again["page_id"]), left["__h"] == again["__h"]]
    again = F.broadcast(again) if again.count() <= BROADCAST_PAGES else again
    settled = looked.join(again.select(*name), same(looked), "left_anti").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    source = named(pages)
    rows = source.join(again, same(source)).select(source["page_id"], "url", "html", "__templates", "__inside")

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), t.as_py(), i.as_py()) for p, t, i in zip(batch.column("html"), batch.column("__templates"), batch.column("__inside"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return settled.union(rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long"))
