"""Main text of web pages by wrapper induction.

Pages of a host come from the same templates. For each host ``REFERENCES`` pages are fixed (those with the smallest
hashes of their id under different seeds), and every page's tree is aligned with theirs by simple tree matching: a
large matching of nodes of equal kind that keeps their order and their parents. A node with equal text in its match is a
constant for that reference. A reference tells what is template only if its main text is another (less than half of it
is equal), and a node is template if at least ``AGREE`` such references have it as a constant (all, if there are fewer):
what a page shares with a single other one is content. All other nodes are slots. The main text is the slot that holds
most of the varying text, found by walking down from the body; elements that say what they are (nav, footer, aside,
forms, adverts, comments ...) are never content, and what says it is the article or the main part is the slot. Blocks of
template inside of it are left out as well. Inside an article a class counts only if all of it names boilerplate.

Siblings are compared as runs of equal kind. Runs that agree at either end are matched first; what is left is aligned
by a table of at most ``CELLS`` cells, along its diagonal if it is larger. Trees are walked without recursion. Each page
is aligned by itself with a fixed number of references, so a host with a third of all pages is no hot key while the
references are broadcast; beyond that size they are joined by host, a join that adaptive execution splits.

Defined cases: null and empty pages have the empty text; a null url is a host of its own; a page that is cut off
keeps what it has; equal pages never serve as each other's references; repeated rows are extracted each; other columns
are ignored; an empty table gives no rows.
"""

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import read, ship

REFERENCES, AGREE = 5, 2
#: Cells of an alignment's table.
CELLS = 40_000
#: References are broadcast up to so many hosts and so many bytes in all; beyond that they are joined by host.
MOST_HOSTS, MOST_BYTES = 20_000, 32_000_000

# Names of elements and words of the HTML standard and of common templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSED_BY_BLOCK = frozenset("p".split())
BLOCKS_CLOSING_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("head nav footer aside form script style noscript template iframe textarea title svg canvas object embed video audio map button select input dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side-bar rail menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead comment comments disqus respond replies reply discussion feedback responses reactions guestbook related recommended recirculation share sharing social widget widgets pagination pager toolbar search login hidden skip announcement toast paywall disclaimer copyright legal".split()
)
#: Words that alone may as well name a subject of the article, and words that say nothing beside another.
AMBIGUOUS_WORDS = frozenset("alert consent copyright disclaimer discussion feedback legal login rail reactions recommended related replies respond responses search skip social toast".split())
NEUTRAL_WORDS = frozenset("area bar block box button buttons container content form group inner item items link links list panel post posts section slot thread unit wrap wrapper".split())
HEADER_WORDS = frozenset("header site-header page-header main-header top-header topbar top-bar logo tagline".split())
#: Parts that make a word tell of a state of the page and not of what the element is (no-sidebar, comments-open).
STATE_WORDS = frozenset("no not non without has have with is open closed enabled disabled show shows hide hides".split())
MAIN_WORDS = frozenset("article articlebody article-body post-content post-body entry-content story story-body main-content content main post entry text body-text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element. parts: strings and nodes in order."""

    __slots__ = ("kind", "parts", "role", "size", "spine", "tag", "text_hash", "words")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.words, self.role, self.spine = tag, [], frozenset(), "", tag in ("html", "body")
        self.kind = tag
        if attributes and ("=" in attributes or "hidden" in attributes):
            found: set[str] = set()
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    found.update(value.split())
                    self.kind += f" {name}={value}" if name == "class" else ""
                elif name == "role":
                    self.role = value
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                    found.add("hidden")
            self.words = frozenset(found)

    def children(self) -> list["Node"]:
        return [x for x in self.parts if isinstance(x, Node)]


def in_order(root: Node) -> list[Node]:
    """All elements, parents before their children."""
    out = [root]
    for x in out:
        out += x.children()
    return out


def finish(root: Node) -> None:
    """Hashes and sizes of the text below every element, bottom-up."""
    for x in reversed(in_order(root)):
        x.size, own = 0, []
        for part in x.parts:
            if isinstance(part, Node):
                own.append(part.text_hash)
                x.size += part.size
            elif part and not part.isspace():
                own.append(hash(part))
                x.size += len(part)
        x.text_hash = hash(tuple(own))


def parse(html: str) -> Node:
    """A tree of the page: lenient, with the end tags that the standard lets authors leave out."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)
    search = TOKEN.search
    while at < n:
        m = search(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in VOID:
                if name == "br":
                    stack[-1].parts.append(Node("br"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k].tag not in INLINE:
                    break  # a stray inline end tag closes no block
            continue
        if name in BLOCKS_CLOSING_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if name in SIBLINGS:
            closed, scope = SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in closed:
                    del stack[k:]
                    if name != "tr":
                        break
        node = Node(name, m[3])
        stack[-1].parts.append(node)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>", re.I).search(html, at)
            if name in ("title", "textarea"):
                node.parts.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    finish(root)
    mark_spine(root)
    return root


#: An element with so much of the page's text is no boilerplate by its name, if no other element is named the article.
MOST_OF_PAGE = 0.8


def mark_spine(root: Node) -> None:
    """Mark the elements around the largest article or main part, or around nearly all of the page's text: what they
    are called says nothing of the text inside."""
    size, best, above = 0, None, {}
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag in DROPPED and x.tag != "form":
            continue
        if x.tag in ("article", "main") and not boilerplate(x, False):
            if x.size > size:
                size, best = x.size, x
            continue
        for y in x.children():
            if y.size > size:
                above[id(y)] = x
                todo.append(y)
    up = above.get(id(best)) if best is not None else None
    around = up is not None
    while up is not None:
        up.spine = True
        up = above.get(id(up))
    at = root if not around and not _named(root) else None
    while at is not None:
        at = next((y for y in at.children() if y.size >= MOST_OF_PAGE * root.size and (y.tag not in DROPPED or y.tag == "form")), None)
        if at is not None and any(y.tag not in INLINE for y in at.children()):
            at.spine = True


def _names_boilerplate(word: str) -> bool:
    """Whether a class inside an article can mean nothing else: comments, ad-slot and related-links do, related-work does not."""
    parts = re.split(r"[-_]+", word)
    if word in DROPPED_WORDS or len(parts) == 1:
        return word in DROPPED_WORDS and word not in AMBIGUOUS_WORDS
    return not DROPPED_WORDS.isdisjoint(parts) and all(p in DROPPED_WORDS or p in NEUTRAL_WORDS for p in parts)


def boilerplate(node: Node, inside_article: bool) -> bool:
    """Does the element say that it is no content?"""
    if node.spine:
        return False
    if node.tag in DROPPED or node.role in DROPPED_ROLES:
        return True
    if node.tag == "header":
        return not inside_article
    if not node.words:
        return False
    if not inside_article and not HEADER_WORDS.isdisjoint(node.words):
        return True
    if inside_article:
        return any(_names_boilerplate(w) for w in node.words)
    for w in node.words:
        if w in DROPPED_WORDS or not DROPPED_WORDS.isdisjoint(parts := re.split(r"[-_]+", w)):
            if w in MAIN_WORDS or (w not in DROPPED_WORDS and not STATE_WORDS.isdisjoint(parts)):
                continue
            return True
    return False


def _runs(nodes: list[Node]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for i, x in enumerate(nodes):
        if out and out[-1][0] == x.kind:
            out[-1] = (x.kind, out[-1][1], i + 1)
        else:
            out.append((x.kind, i, i + 1))
    return out


def _aligned(rx: list[tuple[str, int, int]], ry: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Pairs of runs of equal kind in order: a heaviest alignment, where a run weighs as many nodes as can be paired. A
    table of more than CELLS cells is worked out along its diagonal only."""
    n, m = len(rx), len(ry)
    lo = 0
    while lo < min(n, m) and rx[lo][0] == ry[lo][0]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and rx[n - 1 - hi][0] == ry[m - 1 - hi][0]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    n, m = n - lo - hi, m - lo - hi
    if n and m:
        band = m if n * m <= CELLS else max(CELLS // (2 * n), 8)
        weight = [y[2] - y[1] for y in ry[lo : lo + m]]
        best: list[dict[int, int]] = [{} for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below, (kind, first, last) = best[i], best[i + 1], rx[lo + i]
            middle = i * m // n
            for j in range(min(m, middle + band + 1) - 1, max(0, middle - band) - 1, -1):
                v = max(below.get(j, 0), row.get(j + 1, 0))
                if kind == ry[lo + j][0]:
                    v = max(v, min(last - first, weight[j]) + below.get(j + 1, 0))
                row[j] = v
        i = j = 0
        while i < n and j < m:
            here, kind, width = best[i].get(j, 0), rx[lo + i][0], rx[lo + i][2] - rx[lo + i][1]
            if not here and j not in best[i]:
                # Beside the band: step towards it.
                i, j = (i + 1, j) if j > i * m // n else (i, j + 1)
            elif kind == ry[lo + j][0] and here == min(width, weight[j]) + best[i + 1].get(j + 1, 0):
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif here == best[i + 1].get(j, 0):
                i += 1
            else:
                j += 1
    return out + [(lo + n + k, lo + m + k) for k in range(hi)]


def match(a: Node, b: Node, constant: set[int]) -> None:
    """Simple tree matching of two elements of equal kind. Marks nodes of ``a`` (by id) whose match has the same text."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.text_hash == y.text_hash:
            constant.add(id(x))
        xs, ys = x.children(), y.children()
        if xs and ys:
            rx, ry = _runs(xs), _runs(ys)
            for i, j in _aligned(rx, ry):
                todo += zip(xs[rx[i][1] : rx[i][2]], ys[ry[j][1] : ry[j][2]], strict=False)


def find(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag outside of boilerplate."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if boilerplate(x, False):
            continue
        if x.tag == tag:
            out.append(x)
        else:
            todo += reversed(x.children())
    return out


def _named(root: Node) -> list[Node]:
    """The elements that say that they are the article: all outermost parts of it, or one element of another name."""
    for tag in ("article", "main"):
        if found := [x for x in find(root, tag) if tag == "main" or x.size]:
            return found if tag == "article" else [max(found, key=lambda x: x.size)]
    best, todo = None, [root]
    while todo:
        x = todo.pop()
        if boilerplate(x, False):
            continue
        if (not MAIN_WORDS.isdisjoint(x.words) or x.role in ("main", "article")) and (best is None or x.size > best.size):
            best = x
            continue
        todo += reversed(x.children())
    return [best] if best is not None else []


def _varying(root: Node, constant: set[int]) -> dict[int, int]:
    """By node: characters below it that are neither template nor boilerplate; words of links do not count."""
    out: dict[int, int] = {}
    for x in reversed(in_order(root)):
        none = id(x) in constant or x.tag == "a" or boilerplate(x, False)
        out[id(x)] = 0 if none else sum(out[id(p)] if isinstance(p, Node) else len(p.strip()) for p in x.parts)
    return out


def _slot(root: Node, varying: dict[int, int]) -> Node:
    """The element that holds most of the varying text, as deep as one child holds nearly all of it."""
    at = root
    while True:
        children = [x for x in at.children() if x.tag not in INLINE]
        amounts = [varying[id(x)] for x in children]
        total = varying[id(at)]
        if not amounts or max(amounts) < 0.6 * total or not total:
            return at
        child = children[amounts.index(max(amounts))]
        if not any(x.tag not in INLINE for x in child.children()):
            return at  # a single paragraph: its parent is the slot
        at = child


def blocks(node: Node, constant: set[int], inside: bool) -> list[str]:
    """Texts of the blocks below a node in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := " ".join(entities.unescape("".join(line)).split()):
                out.append(text)
            line.clear()

    todo: list = [node]  # strings, elements to open, and None where an element's block ends
    opened = False
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif not isinstance(part, Node):
            line.append(part)
        elif opened and part.tag == "br":
            line.append(" ")
        elif opened and (boilerplate(part, inside) or id(part) in constant):
            if part.tag not in INLINE:
                flush()
        elif opened and part.tag in INLINE:
            todo += reversed(part.parts)
        else:
            flush()
            opened = True
            todo.append(None)
            todo += reversed(part.parts)
    flush()
    return out


def main_text(html: str, references: list[Node]) -> str:
    """The main text of a page, given the trees of reference pages of its host."""
    if not html:
        return ""
    root = parse(html)
    parts = _named(root)
    whole = sum(x.size for x in parts) if parts else root.size
    votes: Counter[int] = Counter()
    telling = 0
    for other in references:
        if other.text_hash != root.text_hash:
            match(root, other, same := set())
            # A near copy has the article's paragraphs, too: only a page of another text tells what is template. With no
            # named article the template is part of what is compared, so only nearly equal pages are left out.
            if sum(_equal(x, same) for x in parts or [root]) < (0.5 if parts else 0.9) * whole:
                votes.update(same)
                telling += 1
    constant = {i for i, n in votes.items() if n >= min(AGREE, telling)}
    varying = _varying(root, constant)
    if parts and (parts[0].tag in ("article", "main") or not telling or varying[id(parts[0])] >= 0.4 * varying[id(root)]):
        inside = {i for x in parts for i in _repeated(x, constant)}
        return "\n\n".join(text for x in parts for text in blocks(x, inside, x.tag == "article"))
    return "\n\n".join(blocks(_slot(root, varying), constant, False))


def _repeated(node: Node, same: set[int]) -> list[int]:
    """The outermost blocks at and below a node that are template. A word in bold or a link is part of its sentence."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if id(x) in same and x.tag not in INLINE:
            out.append(id(x))
        else:
            todo += x.children()
    return out


def _equal(node: Node, same: set[int]) -> int:
    """Characters at and below a node that have the same text in another page."""
    out, todo = 0, [node]
    while todo:
        x = todo.pop()
        if id(x) in same:
            out += x.size
        else:
            todo += x.children()
    return out


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(url_col).alias("host"))
    seeds = [F.min(F.struct(F.xxhash64("page_id", F.lit(k)).alias("h"), F.col("page_id").alias("id"))).alias(f"r{k}") for k in range(REFERENCES)]
    chosen = rows.where("html <> ''").groupBy("host").agg(*seeds).select("host", F.explode(F.array_distinct(F.array(*[f"r{k}.id" for k in range(REFERENCES)]))).alias("page_id"))
    chosen = chosen.persist()
    few = chosen.limit(REFERENCES * MOST_HOSTS + 1).count() <= REFERENCES * MOST_HOSTS
    texts = rows.join(F.broadcast(chosen) if few else chosen, ["host", "page_id"], "left_semi").groupBy("host", "page_id").agg(F.max("html").alias("html"))
    texts = texts.persist()
    amount = texts.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    if few and amount <= MOST_BYTES:
        by_host: dict[str, list[str]] = {}
        for r in texts.orderBy("host", "page_id").toLocalIterator():
            by_host.setdefault(r.host, []).append(r.html)
        table = spark.sparkContext.broadcast(by_host)
        joined = rows.select("page_id", "url", "html", "host")
    else:
        table = None
        listed = texts.groupBy("host").agg(F.array_sort(F.collect_list("html")).alias("refs"))  # REFERENCES at most
        joined = rows.join(listed, "host", "left").select("page_id", "url", "html", "host", "refs")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list[Node]] = {}
        for b in batches:
            refs = b.column(4).to_pylist() if table is None else None
            out = []
            for i, (page, host) in enumerate(zip(b.column(2), b.column(3).to_pylist(), strict=True)):
                if host not in trees:
                    if len(trees) > 256:
                        trees.clear()
                    trees[host] = [parse(x) for x in ((refs[i] or []) if refs is not None else table.value.get(host, []))]
                out.append(main_text(page.as_py(), trees[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(turn, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_main_text": op8_main_text}
ORACLES: dict[str, str] = {}
