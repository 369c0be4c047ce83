"""Main text of web pages by removal of each site's template.

1. A page is parsed into element subtrees; every block or container subtree is hashed over its
   tag and its content.
2. Spark counts, per host, the pages that hold each subtree. The counts are pre-aggregated and
   keyed by (host, hash), so a host with a third of all pages does not meet in one task.
3. Subtrees on at least `SHARE` of a host's pages (and `LEAST` pages) are its template. A host
   has at most (subtrees per page) / SHARE of them, whatever its number of pages, so each host's
   list is bounded. The lists go to every task if their checked size is small; beyond that they
   are joined to pages with the host salted.
4. A page is parsed again, template subtrees are deleted, what its tags, roles and class names
   call boilerplate is deleted too, and the blocks of the main containers remain: every `main` and every
   `article` outside of them that is no comment or teaser; else the whole page.

Inside a main container (article, main) only containers are deleted as template: a plain
paragraph, heading or list item there is the page's own text even if other pages share it. An element that
only looks like boilerplate (a form, or a class such as `sidebar`) stays if it holds `main` or
most of the page's text. Names that authors also give to their own sections (`discussion`, `related`, `share`, `comment`)
remove no element that alone holds text of a main container beside headings. Parsing takes time in proportion to the page, broken or not.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package, written

SHARE, LEAST = 0.3, 5
#: Template hashes and hosts sent to every task at most (about 50 bytes each), and pages of a host for each salt.
SMALL, SALT_PAGES = 200_000, 20_000
#: Parts into which the counts of each host are dealt.
HOST_SALTS = 16

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr table tbody thead tfoot caption figcaption summary ul ol dl".split())
DROP = frozenset("head nav footer aside form menu dialog button select input label fieldset script style noscript template iframe svg math canvas object textarea title audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
# Words of class and id names that mark boilerplate, by what they name whatever they hold, and by what
# they name unless they hold the page.
STRONG = frozenset("ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo cookie cookies consent gdpr breadcrumb breadcrumbs comment comments commentlist reply replies respond discussion disqus related recommended recommendations share sharing newsletter subscribe login search searchbox popup pagination pager skiplink tagcloud byline copyright".split())
MARKS = STRONG | frozenset("promotion banner notice notices alert nav navbar navigation menu menus submenu sidebar side footer header masthead topbar toolbar social follow subscription signup widget modal overlay skip toc tags metadata legal disclaimer".split())
#: In a compound name (cookie-banner, comment_list): words that say what a mark is a part of, and words that only name a state or layout.
PARTS = frozenset("area bar block body bottom box button buttons container content form holder inner item items left link links list menu outer panel right row section slot thread top unit widget wrap wrapper".split())
STATES = frozenset("has have is no not with without hide hidden js".split())
#: Marks that authors also give to the page's own sections: what bears one stays where nothing else of a main container is text.
SOFT = frozenset("comment comments reply replies respond discussion related recommended share sharing byline".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: On article and main, only these count.
OWN = frozenset("comment comments reply replies related promo ad ads teaser".split())
_CLOSED_BY = {
    **{t: frozenset(["p"]) for t in BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend"}},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "tbody": frozenset(["tr", "td", "th", "thead"]), "tfoot": frozenset(["tr", "td", "th", "tbody"]),
}
_SCOPE = frozenset("html body table ul ol dl div section article main aside nav footer header form td th blockquote".split())
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
_STOP = re.compile(r"""[>"']""")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}


class Node:
    """drop: 0 stays, 1 goes unless it holds the page, 2 goes, 3 goes unless it alone holds text of a main container."""

    __slots__ = ("children", "drop", "hash", "tag")

    def __init__(self, tag: str, drop: int = 0) -> None:
        self.tag, self.drop, self.children, self.hash = tag, drop, [], 0


def _marks(name: str, marks: frozenset[str]) -> bool:
    """Whether a class or id name is a mark, or a compound that ends in one or names its part."""
    if name in marks:
        return True
    words = _PART.findall(name)
    if len(words) < 2 or words[0] in STATES:
        return False
    return words[-1] in marks or (words[0] in marks and words[-1] in PARTS)


def _boilerplate(tag: str, attributes: str) -> int:
    found, soft = (1 if tag == "form" else 2) if tag in DROP else 0, False
    if found == 2 or not attributes or tag in ("html", "body"):
        return found
    own = tag in ("article", "main")
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return 2
        if name == "role" and value.strip().lower() in ROLES:
            found = max(found, 1)
        elif name in ("class", "id"):
            names = [_CAMEL.sub("-", x).lower() for x in value.split()]
            if any(_marks(x, (OWN if own else STRONG) - SOFT) for x in names):
                found = 2
            elif any(_marks(x, OWN & SOFT if own else SOFT) for x in names):
                soft = True
            elif not own and any(_marks(x, MARKS) for x in names):
                found = max(found, 1)
    return 3 if soft and found < 2 else found


def _pieces(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """Markup of a page: (kind, tag, attributes, start, end), kind "+" a start tag, "-" an end tag, "!" neither.
    An angle bracket that opens no markup is text. Quotes protect a bracket; where that leaves a
    tag open to the page's end, tags from there on end at their first bracket."""
    at, last, loose, missing = 0, page.rfind(">"), False, set()
    while (a := page.find("<", at)) >= 0 and a < last:
        if page.startswith("<!--", a):
            end = page.find("-->", a + 4)
            at = len(page) if end < 0 else end + 3
            yield "!", "", "", a, at
            continue
        m = _NAME.match(page, a + 1)
        if m is None:
            if page[a + 1] in "!?":
                at = page.index(">", a) + 1
                yield "!", "", "", a, at
            else:
                at = a + 1
            continue
        end = m.end()
        while not loose:
            stop = _STOP.search(page, end)
            if stop is None:
                loose = True
            elif stop[0] == ">":
                break
            else:
                close = -1 if stop[0] in missing else page.find(stop[0], stop.end())
                if close < 0:
                    missing.add(stop[0])
                end = stop.end() if close < 0 else close + 1
        end = page.index(">", m.end()) if loose else stop.start()
        name, at = m[0].lower(), end + 1
        at = (yield ("-", name[1:], "", a, at) if name[0] == "/" else ("+", name, page[m.end() : end], a, at)) or at


class _Stack:
    """Open elements, and how many of each tag are open in all and since the innermost scope."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.all, self.scopes = [root], Counter(), [Counter()]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.all[node.tag] += 1
        if node.tag in _SCOPE:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][node.tag] += 1

    def pop_to(self, tags: frozenset[str]) -> None:
        """Close elements up to the innermost one with one of these tags."""
        while True:
            tag = self.nodes.pop().tag
            self.all[tag] -= 1
            if tag in _SCOPE:
                self.scopes.pop()
            else:
                self.scopes[-1][tag] -= 1
            if tag in tags:
                return

    def near(self, tags: frozenset[str]) -> bool:
        """Whether one of these is open within the innermost scope, or is that scope."""
        inner = self.scopes[-1]
        if any(inner[t] for t in tags):
            return True
        if len(self.scopes) == 1 or tags.isdisjoint(_SCOPE):
            return False
        k = len(self.nodes) - 1 - sum(inner.values())
        return self.nodes[k].tag in tags


def parse(page: str, hashed: bool = True) -> Node:
    """Element tree of a page, broken or not: end tags without a start are skipped, open elements
    end with their parents, and a raw-text element runs to its own end tag."""
    root = Node("html")
    stack, at, n = _Stack(root), 0, len(page)
    pieces, go = _pieces(page), None
    while True:
        try:
            kind, tag, attributes, start, end = pieces.send(go)
        except StopIteration:
            break
        go = None
        if start > at:
            stack.nodes[-1].children.append(page[at:start])
        at = end
        if kind == "-":
            if stack.all[tag] and (tag in BLOCK or tag in _SCOPE or stack.scopes[-1][tag]):
                stack.pop_to(frozenset([tag]))
        elif kind == "+" and tag not in ("html", "body"):
            closes = _CLOSED_BY.get(tag)
            if closes and stack.near(closes):
                stack.pop_to(closes)
            node = Node(tag, _boilerplate(tag, attributes))
            if tag == "header" and (stack.all["article"] or stack.all["main"]):
                node.tag, node.drop = "div", _boilerplate("div", attributes)  # an article's own header holds its title
            stack.nodes[-1].children.append(node)
            if tag in VOID or attributes.endswith("/"):
                continue
            if tag in RAW:
                close = _RAW_END[tag].search(page, at)
                at = go = close.end() if close else n
                continue
            stack.push(node)
    if at < n:
        stack.nodes[-1].children.append(page[at:])
    if hashed:
        _hash(root)
    _keep_page(root)
    return root


def _keep_page(root: Node) -> None:
    """Elements that only look like boilerplate stay if they hold `main`, most of the page's text, or, if
    forms, an article."""
    held: dict[int, tuple[int, bool, bool]] = {}
    todo, doubtful = [(root, False)], []
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if type(c) is Node and c.drop < 2]
            continue
        below = [held.pop(id(c)) for c in node.children if type(c) is Node and c.drop < 2]
        size = sum(len(c) - c.count(" ") for c in node.children if type(c) is str) + sum(x[0] for x in below)
        held[id(node)] = size, node.tag == "main" or any(x[1] for x in below), node.tag == "article" or any(x[2] for x in below)
        if node.drop == 1:
            doubtful.append((node, *held[id(node)]))
    whole = held[id(root)][0]
    for node, size, main, article in doubtful:
        if not (main or 2 * size > whole or (node.tag == "form" and article)):
            node.drop = 2
        elif node.tag in ("form", "header", "footer", "nav", "aside"):
            node.drop, node.tag = 0, "div"
        else:
            node.drop = 0


def _hash(root: Node) -> None:
    """Content hash of every subtree: its tag, its texts and its children's hashes, in order."""
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if type(c) is Node]
            continue
        parts = [node.tag]
        for c in node.children:
            parts.append(f"<{c.hash:x}>" if type(c) is Node else " ".join(c.split()))
        node.hash = xxhash.xxh64_intdigest("\0".join(x for x in parts if x)) - (1 << 63)


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements, and whether they lie inside a main container."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        within = inside or node.tag in ("article", "main")
        todo += [(c, within) for c in reversed(node.children) if type(c) is Node]


def _may_go(node: Node, inside: bool) -> bool:
    """Subtrees that template removal counts and deletes."""
    return node.tag in BLOCK and node.tag not in ("html", "article", "main") and not (inside and node.tag in TEXT)


def subtree_hashes(page: str) -> list[int]:
    return sorted({n.hash for n, inside in _walk(parse(page)) if _may_go(n, inside) and n.children})


def _main(root: Node) -> list[Node]:
    """The containers of the main text: every outermost main or article that has text, else the page."""
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        if node.tag in ("article", "main"):
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if type(c) is Node]
    return found if any(blocks(x) for x in found) else [root]


def blocks(root: Node) -> list[str]:
    """Texts of the blocks below an element, in page order, without dropped elements."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and (text := " ".join(_html.unescape("".join(held)).split())):
            out.append(text)
        held.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if type(x) is str:
            held.append(x)
        elif x is None:
            flush()
        elif x.drop:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br" or x.tag in ("td", "th"):
            held.append(" ")
            todo += reversed(x.children)
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    flush()
    return out


def _prose(root: Node) -> int:
    """Characters of what stays below an element, headings and white space not counted."""
    size, todo = 0, [root]
    while todo:
        node = todo.pop()
        size += sum(len("".join(c.split())) for c in node.children if type(c) is str)
        todo += [c for c in node.children if type(c) is Node and not c.drop and c.tag not in HEADINGS]
    return size


def _holds_article(root: Node) -> bool:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            return True
        todo += [c for c in node.children if type(c) is Node and not c.drop]
    return False


def _rescue(root: Node) -> None:
    """Where nothing but headings stays, the softly marked element with the most text stays after all, if it lies in
    a main container, is one or holds one."""
    if any(_prose(x) for x in _main(root)):
        return
    best, most, todo = None, 0, [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        if node.drop == 3:
            size = _prose(node) if inside or _holds_article(node) else 0
            if size > most:
                best, most = node, size
        elif not node.drop:
            todo += [(c, inside) for c in reversed(node.children) if type(c) is Node]
    if best is not None:
        best.drop = 0


def main_text(page: str, template: set[int] | frozenset[int] = frozenset()) -> str:
    """Main text of one page, given its host's template subtrees."""
    root = parse(page, bool(template))
    if template:
        for node, inside in _walk(root):
            if node.hash in template and _may_go(node, inside):
                node.drop = 2
    _rescue(root)
    return "\n".join(b for x in _main(root) for b in blocks(x))


def hash_column(page: Column) -> Column:
    @arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([subtree_hashes(x.as_py()) if x.is_valid else [] for x in batch], pa.list_(pa.int64()))

    return run(page)


def text_column(page: Column, template: Column) -> Column:
    @arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last: tuple[object, frozenset[int]] = (None, frozenset())
        for pages, templates in batches:
            out = []
            for page, hashes in zip(pages, templates, strict=True):
                values = tuple(hashes.as_py() or ()) if hashes.is_valid else ()
                if values != last[0]:
                    last = (values, frozenset(values))
                out.append(main_text(page.as_py(), last[1]) if page.is_valid else "")
            yield pa.array(out, pa.string())

    return run(page, template)


def host_of(url: Column) -> Column:
    """Host in lower case; empty where the address is null or has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, template, n): the hashes of the subtrees that recur over a host's n pages. Pages without a
    host share no site and get none."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    sizes = hosts.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = hosts.select("host", F.explode(hash_column(F.col("html"))).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    # the counts of one host are dealt out; what is left of them behind the filter is bounded
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
    met = counts.withColumn("salt", F.pmod("hash", F.lit(HOST_SALTS)).cast("int")).join(salted, ["host", "salt"])
    return met.where(F.col("k") >= F.col("n") * share).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"), F.max("n").alias("n"))


def extract_pages(pages: DataFrame, share: float = SHARE, least: int = LEAST, small: int = SMALL, salt_pages: int = SALT_PAGES) -> DataFrame:
    """page_id, url, text for every row. Null html and pages without main text give an empty text;
    repeated rows each count as a page and each report; an empty table stays empty. Other columns
    are not read."""
    ship_package(pages.sparkSession)
    found = written(templates(pages, share, least), "templates")
    size, most = found.agg(F.coalesce(F.sum(F.size("template") + 1), F.lit(0)), F.max("n")).first()
    sited = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if size <= small:
        met = sited.join(F.broadcast(found.select("host", "template")), "host", "left")
    else:
        salts = -(-most // salt_pages)
        salted = found.select("host", "template", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        met = sited.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    return met.select("page_id", "url", text_column(F.col("html"), F.col("template")).alias("text"))
