"""Main text of HTML pages by composite text density.

A tolerant parser builds the node tree. Parts that say what they are (scripts, navigation, footers, forms, adverts,
notices, comments ... by tag or role, or by a class or id) are left out first. A class or id is a hint only: forms like ``no-sidebar``
or ``comments-open`` don't count, a part that holds the page's article or main element stays, and so does one with a loose
hint (``widget``, ``sidebar``) that says it is content as well or holds half of the page's text; where hints would leave no text, none
counts. Every other node gets its composite text density:
characters per tag, adjusted by link characters and link tags. The node whose children's densities have the largest sum
is the core; the smallest density on its path to the body is the threshold; siblings along that path that reach the
threshold, and headings, belong to the text as well. A core inside ``article`` or ``main`` stands for all of that.

Defined results: null, empty and text-free pages give an empty text; unclosed and stray tags are tolerated; nothing is
cut off or limited. Pages are independent, so repeated rows get equal results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, tidied, widened

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of the HTML standard: elements without content, with raw content, and those before which a paragraph ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("body br button caption head html legend option select tbody td tfoot th thead title tr".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
LEFT_OUT = frozenset("head script style nav footer aside form button select textarea template noscript iframe svg canvas object menu dialog title noembed noframes xmp audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of classes and ids that name other parts: firm ones, and loose ones that wrappers of the main text bear, too.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
FIRM = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr popup modal "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer newsletter subscribe signup login".split()
)
LOOSE = frozenset("promo promotion banner notice notices alert overlay sidebar masthead topbar toolbar share sharing social related recommended search widget skip header".split())
CONTENT = frozenset("article content main entry post story text body".split())
#: Words that, before or behind such a word in a class, make it a setting.
BEFORE, BEHIND = frozenset("no has with without hide hides".split()), frozenset("open opened closed on off enabled disabled".split())
_RAW_END = {tag: re.compile(f"</{tag}(?![a-z0-9])", re.I) for tag in RAW}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The tree of a page; character references in texts are decoded, comments and declarations dropped."""
    root = node = Node("#root", None)
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]) if "&" in page[at : m.start()] else page[at : m.start()])
        at = m.end()
        if tag := m[2]:
            tag, attributes = tag.lower(), m[3]
            if page[at - 1] != ">":  # a quote that doesn't end
                cut = page.find(">", at)
                at = size if cut < 0 else cut + 1
            if tag in ENDS_P:
                node = _close(node, "p", ("button", "td", "th", "article", "section", "div")) or node
            if tag in SAME:
                pair = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                for t in pair:
                    node = _close(node, t, SAME[tag]) or node
            child = Node(tag, node, attributes)
            node.children.append(child)
            if tag in RAW:
                ended = _RAW_END[tag].search(page, at)
                cut = size if ended is None else ended.start()
                if tag in ("textarea", "title"):
                    child.children.append(html.unescape(page[at:cut]))
                else:
                    child.children.append(page[at:cut])
                end = page.find(">", cut)
                at = size if end < 0 else end + 1
            elif tag not in VOID:
                node = child
        elif tag := m[1]:
            node = _close(node, tag.lower(), ()) or node
    if at < size:
        node.children.append(html.unescape(page[at:]))
    return root


def _close(node: Node, tag: str, stops: tuple[str, ...]) -> Node | None:
    """The parent of the nearest open element of that name, if none of ``stops`` stands between."""
    at = node
    while at.parent is not None:
        if at.tag == tag:
            return at.parent
        if at.tag in stops:
            return None
        at = at.parent
    return None


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attributes)} if node.attributes else {}


def _says_other(node: Node, inside: bool, have: dict[str, str]) -> bool:
    """Whether a part's tag, role or style says that it isn't main text; ``inside``: within an article or main element."""
    if node.tag in LEFT_OUT or node.tag == "header" and not inside:
        return True
    if not have:
        return False
    return "hidden" in have or have.get("aria-hidden") == "true" or have.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", have.get("style", "")))


def _hints(node: Node, inside: bool, have: dict[str, str]) -> tuple[set[str], bool]:
    """Words of a part's class and id that name other parts, and whether a class of its own says that it is content."""
    found: set[str] = set()
    content = False
    if node.tag in ("body", "html", "main") or node.tag in HEADINGS:
        return found, content
    for name in f"{have.get('class', '')} {have.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        marks = {w for k, w in enumerate(words) if (w in FIRM or w in LOOSE) and not BEFORE.intersection(words[:k]) and not BEHIND.intersection(words[k + 1 :])}
        if inside:
            marks.discard("header")
        found |= marks
        content |= not marks and not CONTENT.isdisjoint(words)
    return (found & {"comment"} if node.tag == "article" else found), content


def _is_main(node: Node, have: dict[str, str]) -> bool:
    return node.tag in ("article", "main") and not _hints(node, True, have)[0] or have.get("role") == "main"


def _chars(node: Node) -> int:
    return sum(sum(map(len, c.split())) if isinstance(c, str) else c.chars for c in node.children)


def _leave_out(root: Node) -> None:
    """Take out the parts that aren't main text by their own word."""
    order: list[tuple[Node, bool]] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _says_other(c, inside, attributes(c))]
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]
    largest: dict[int, int] = {}  # characters of the largest article or main element in a node
    hinted = []
    for node, inside in reversed(order):
        node.chars = _chars(node)
        have = attributes(node)
        most = max((largest[id(c)] for c in node.children if not isinstance(c, str)), default=0)
        if have and (found := _hints(node, inside, have))[0]:
            hinted.append((node, *found, most))
        largest[id(node)] = max(most, node.chars) if _is_main(node, have) else most
    total = root.chars
    out = set()
    for node, words, content, most in hinted:
        if most and 2 * most >= node.chars and COMMENTS.isdisjoint(words):
            continue
        if FIRM.isdisjoint(words) and (content or 2 * node.chars > total):
            continue
        out.add(id(node))
    if not out:
        return
    kept = {id(node): [c for c in node.children if isinstance(c, str) or id(c) not in out] for node, _ in order}
    left = [root]
    some = False
    while left and not some:
        for c in kept[id(left.pop())]:
            if isinstance(c, str):
                some = some or bool(c.strip())
            else:
                left.append(c)
    if some:
        for node, _ in order:
            node.children = kept[id(node)]


def _measure(root: Node) -> list[Node]:
    """Fill in sums and densities of what isn't left out; nodes come back children first."""
    _leave_out(root)
    order, nodes = [], [root]
    while nodes:
        node = nodes.pop()
        order.append(node)
        nodes += [c for c in node.children if not isinstance(c, str)]
    order.reverse()
    for node in order:
        node.chars = _chars(node)
        node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if not isinstance(c, str):
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in order if n.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e)
        node.density = c / t * math.log(c / lc * t / lt) / math.log(base) if c and base > 1 and c * t > lc * lt else 0.0
        node.sum = sum(x.density for x in node.children if not isinstance(x, str))
    return order


def _texts(node: Node, out: list[str]) -> None:
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            edge = [" "] if x.tag in BLOCK else []
            stack += [*edge, *reversed(x.children), *edge]


def main_text(page: str | None) -> str:
    """The main text, with white space as single blanks."""
    if not page:
        return ""
    order = _measure(parse(page))
    root = order[-1]
    body = next((n for n in order if n.tag == "body"), root)
    within = [n for n in order if n.chars]
    if not within:
        return ""
    core = max(reversed(within), key=lambda n: n.sum)
    if core.sum <= 0:
        core = body if body.chars else root
    path = [core]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    semantic = [k for k, n in enumerate(path) if n.tag in ("article", "main") or attributes(n).get("role") == "main"]
    start = semantic[-1] if semantic else 0
    taken, top = {id(path[start])}, path[start]
    for above in path[start + 1 :]:
        taken |= {id(c) for c in above.children if not isinstance(c, str) and c is not top and c.chars and (c.density >= least or c.tag in HEADINGS)}
        top = above
    out: list[str] = []
    on_path = {id(n) for n in path[start + 1 :]}

    def walk(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                if c.strip() and node is not root:
                    out.extend((" ", c, " "))
            elif id(c) in taken:
                _texts(c, out)
                out.append(" ")
            elif id(c) in on_path:
                walk(c)

    if start + 1 < len(path):
        walk(path[-1])
    else:
        _texts(path[start], out)
    return " ".join("".join(out).split())


def plain_text(root: Node) -> str:
    """All visible text of a page, a line for each block."""
    out: list[str] = []
    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("\0")
        elif isinstance(x, str):
            out.append(x.replace("\0", " ") if "\0" in x else x)
        elif x.tag not in ("script", "style", "head", "title", "template", "noscript", "iframe", "svg", "noembed", "noframes", "xmp"):
            edge = [None] if x.tag in BLOCK else []
            stack += [*edge, *reversed(x.children), *edge]
    lines = (" ".join(line.split()) for line in "".join(out).split("\0"))
    return "\n".join(line for line in lines if line)


def extract(df: DataFrame, source: str = "html", target: str = "text", length: str = "n_chars") -> DataFrame:
    """``df`` without the column of pages, with their main texts and lengths in code points; the new names must be free."""
    small_batches(df.sparkSession)
    names = df.columns
    rest = [n for n in names if n != source]
    if clash := {target, length} & set(rest):
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(names.index(source)).to_pylist()]
            kept = [batch.column(names.index(n)) for n in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest, target, length])

    schema = widened(df.drop(source).schema, (target, "string"), (length, "long"))
    return df.mapInArrow(tidied(run), schema)
