"""Main text of web pages by composite text density.

The page's tags become a tree of nodes.  Elements that are boilerplate by their tag or by an exact name (navigation,
forms, comments, ...) are left out, unless nothing that reads like an article stands outside them.  Every node's density is its characters
per tag, adjusted for link characters and link tags; the density sum of a node adds up its children's.  The node with
the largest sum is the core of the article; the smallest density on its path up to the body is the threshold: every
node that reaches it marks the maximum-sum node of its subtree as content.  A suspect word in a name lowers the densities
of its node and all below.  The marked parts, with the headings and
plain blocks between them, are returned whole but for menus and suspect nodes beside the core, one line per block.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import map_rows

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend", "summary"}
SELF_CLOSING = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")), "option": frozenset(("option",)), "p": frozenset(("p",)),
}
SCOPES = frozenset("ul ol dl table body html article section div td th aside main".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select textarea input dialog menu svg math object embed applet canvas audio video title".split())
# Words in class, id or role that name boilerplate.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert disclaimer "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside complementary related recommended recommendations recirculation widget widgets "
    "comment comments commentlist disqus respond reply replies discussion footer header masthead contentinfo search form login signup subscribe subscription newsletter share sharing social toolbar".split()
)
OWN_HEADER = frozenset("entry post article story title headline".split())
CONTENT = frozenset("article main".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# Words that may stand beside a boilerplate word in one name; words that turn its meaning; elements inside a line.
BESIDE = frozenset(
    "left right top bottom box area section list block container wrapper inner outer item items links link bar main site page global primary secondary post article entry story text widget col column the "
    "body user users reader readers thread count wrap slot unit zone placement inline".split()
)
# Words that make any name suspect.
SUSPECT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr sidebar breadcrumb breadcrumbs newsletter comment comments disqus".split())
RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\s*(?:©|\(c\)|\d{4}))[^\n]{0,200}", re.I)  # a line on rights at a page's end
TURNING = frozenset("has no with without not is non hide show after before".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())


PROSE = 60  # characters of a block, without blanks, that read like an article's
NESTED = 64  # boilerplate elements inside each other, around the only text, that are looked at one by one; then all inside the last are kept
MENU_LINKS, MENU_CHARS = 4, 30  # a menu has so many links or more, of so many characters or less on average
DOUBT = 0.01  # what densities inside a suspect node count: many long comments weigh less than one paragraph


class Node:
    __slots__ = ("name", "parent", "parts", "chars", "link_chars", "tags", "link_tags", "density", "sum", "best", "in_content", "holds", "suspect", "doubted")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.parts: list[Node | str] = []  # in page order
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.best = self  # the node of the largest sum in the subtree
        self.holds = False  # whether it holds marked content
        self.suspect = False  # whether a word of its name speaks against it
        self.doubted = parent is not None and parent.doubted  # or of a name around it
        self.in_content = name in CONTENT or (parent is not None and parent.in_content)


def names_noise(token: str) -> bool:
    """Whether a whole class, id or role names boilerplate: `cookie-notice` and `sidebar-left` do, `has-sidebar` and `search-term` don't."""
    words = {w.lower() for w in PARTS.findall(token)}
    if words & OWN_HEADER:  # the article's own header holds its title
        words.discard("header")
    return bool(words & NOISE) and words <= NOISE | BESIDE | OWN_HEADER and not words & TURNING


def is_suspect(name: str, attributes: str) -> bool:
    """Whether a class or id has a word of SUSPECT and none that turns it, in whatever company."""
    if name in CONTENT or name in INLINE or not attributes:
        return False
    tokens = [t for key, value in ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id") for t in value.strip("\"'").split()]
    words = [{w.lower() for w in PARTS.findall(t)} for t in tokens]
    return any(w & SUSPECT and not w & TURNING for w in words)


def is_noise(name: str, attributes: str, in_content: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header":  # of a page; an article's own header holds its title
        return not in_content
    if name in ("body", "html", "article", "main") or name in INLINE or not attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key in ("class", "id", "role") and not (name[0] == "h" and name[1:] in "123456") and any(map(names_noise, value.split())):
            return True
    return False


def parse(page: str, spared: set[int] | frozenset[int] = frozenset(), inside: range = range(0)) -> tuple[Node, dict[int, int], dict[int, int]]:
    """(tree below the body without what names itself boilerplate, characters left out by the place of its tag, and where their last text begins).

    Tags at the places in `spared` and `inside` are kept.  Unclosed tags are closed as browsers do.
    """
    root = here = Node("body", None)
    skip_stack: list[str] = []  # open elements from the boilerplate element on
    skipped, ends, skipping = {}, {}, -1
    at, size = 0, len(page)
    while at < size:
        left = page.find("<", at)
        if left < 0:
            left = size
        if left > at:
            if not skip_stack:
                here.parts.append(page[at:left])
            elif skipping >= 0:
                skipped[skipping] = skipped.get(skipping, 0) + len("".join(page[at:left].split()))
                ends[skipping] = at
        if left == size:
            break
        found = TAG.match(page, left)
        if found is None:
            found = LOOSE_TAG.match(page, left)
        if found is None:  # a lone sign is text; an unfinished tag at the end is none
            if re.match(r"</?[a-zA-Z]", page[left : left + 3]):
                break
            if not skip_stack:
                here.parts.append("<")
            at = left + 1
            continue
        at = found.end()
        if found.re is TAG and found.group(2) is None:
            continue
        closing, name, attributes = found.group(1), found.group(2).lower(), found.group(3) or ""
        if closing:
            if skip_stack:
                if name in skip_stack:
                    while skip_stack.pop() != name:
                        pass
                    continue
                if name not in ("body", "html", "article", "main"):
                    continue
                skip_stack.clear()  # the enclosing element ends, and with it an unclosed boilerplate element
            node = here
            while node is not None and node.name != name and not (name in ("p", "li", "b", "i", "em", "strong", "span", "a", "u", "font") and node.name in SCOPES):
                node = node.parent
            if node is not None and node.name == name and node.parent is not None:
                here = node.parent
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name in ("script", "style", "title", "textarea", "xmp", "noframes") or end:
                at = end.end() if end else size
            continue
        if name in ("html", "body", "head"):
            if name == "head" and not skip_stack:
                skip_stack.append(name)
                skipping = -1
            elif name == "body":
                skip_stack.clear()
            continue
        if skip_stack and name in CONTENT and skipping >= 0:
            skip_stack.clear()  # an article begins, and with it ends an unclosed boilerplate element
        if skip_stack:
            if name not in VOID and not attributes.endswith("/"):
                if name == "p" and "p" in skip_stack[1:]:
                    continue
                skip_stack.append(name)
            continue
        if name in VOID:
            if name in ("br", "wbr"):
                here.parts.append(" " if name == "br" else "")
            elif name == "hr":
                here.parts.append(Node("hr", here))
            continue
        if name in CLOSES_P:
            node = here
            while node is not None and node.name not in SCOPES and node.name != "p":
                node = node.parent
            if node is not None and node.name == "p":
                here = node.parent
        closes = SELF_CLOSING.get(name)
        if closes:
            node = here
            stop = SCOPES if name not in ("td", "th", "tr") else frozenset(("table",))
            while node is not None and node.name not in closes and (node.name not in stop or node.name in ("td", "th") and name in ("td", "th", "tr")):
                node = node.parent
            if node is not None and node.name in closes and node.parent is not None:
                here = node.parent
                if name == "tr" and here.name == "tr":
                    here = here.parent
        if left not in spared and left not in inside and is_noise(name, attributes, here.in_content):
            if not attributes.endswith("/"):
                skip_stack.append(name)
                skipping = left
            continue
        child = Node(name, here)
        child.suspect = is_suspect(name, attributes)
        child.doubted |= child.suspect
        here.parts.append(child)
        if not attributes.endswith("/"):
            here = child
    return root, skipped, ends


def has_content(root: Node) -> bool:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.name in CONTENT and node.chars:
            return True
        todo.extend(p for p in node.parts if type(p) is Node)
    return False


def own_prose(node: Node) -> int:
    """Characters directly in a block and its inline elements, outside links."""
    n, todo = 0, list(node.parts)
    while todo:
        part = todo.pop()
        if type(part) is str:
            n += len("".join(part.split()))
        elif part.name in INLINE and part.name != "a":
            todo.extend(part.parts)
    return n


def has_prose(root: Node) -> bool:
    """Whether the page has a block that reads like an article's, or two that come near it."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name not in HEADINGS and not node.suspect:
            found.append(own_prose(node) if node.name in BLOCK else 0)
            todo.extend(p for p in node.parts if type(p) is Node)
    return max(found, default=0) >= PROSE or sum(n * 2 >= PROSE for n in found) > 1


def tree(page: str) -> Node:
    """The parsed page without its boilerplate elements.

    Only if nothing that reads like an article is left without them, the one with most text is kept after all, and so on inside it.
    """
    spared: set[int] = set()
    inside = range(0)
    while True:
        root, skipped, ends = parse(page, spared, inside)
        measure(root)
        most = max(skipped, key=skipped.__getitem__, default=-1)
        if most < 0 or not skipped[most] or skipped[most] <= root.chars - root.link_chars or has_content(root) or has_prose(root) or inside:
            return root
        spared.add(most)
        if len(spared) > NESTED:
            inside = range(most, ends[most])


def measure(root: Node) -> None:
    """Fills in characters, tags, densities and density sums, from the leaves up, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(p for p in node.parts if type(p) is Node)
    for node in reversed(order):
        own = sum(len("".join(p.split())) for p in node.parts if type(p) is str)
        children = [p for p in node.parts if type(p) is Node]
        node.chars = own + sum(c.chars for c in children)
        node.tags = sum(1 + c.tags for c in children)
        node.link_chars = node.chars if node.name == "a" else sum(c.link_chars for c in children)
        node.link_tags = sum(c.link_tags + (c.name == "a") for c in children)
    total, total_links = max(1, root.chars), root.link_chars
    for node in reversed(order):
        chars, tags = node.chars, max(1, node.tags)
        if chars:
            links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
            plain = max(1, chars - node.link_chars)
            base = math.log(chars / plain * node.link_chars + total_links / total * chars + math.e)
            ratio = chars / links * tags / link_tags
            node.density = chars / tags * max(0.0, math.log(max(1.0, ratio)) / math.log(max(base, 1.000001)) if ratio > 1 else 0.0)
        if node.doubted:
            node.density *= DOUBT
        node.sum = sum(p.density for p in node.parts if type(p) is Node)
        if any(type(p) is str and not p.isspace() for p in node.parts):
            node.sum = max(node.sum, node.density)
        node.best, node.holds = node, False
        for p in node.parts:
            if type(p) is Node and p.best.sum > node.best.sum:
                node.best = p.best


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())


def mark(root: Node, by_density: bool = True) -> set[int]:
    """Marks the content and returns ids of the marked nodes: for every node at the path's threshold, the maximum-sum node below it.

    `by_density=False` marks the whole page (a test's comparison).
    """
    best = root.best
    threshold, node = best.density, best
    while node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    marked, todo = set(), [root]
    while todo:
        node = todo.pop()
        if not by_density or (node.chars and node.density >= threshold):
            up = node.best if by_density else node
            marked.add(id(up))
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        todo.extend(p for p in node.parts if type(p) is Node)
    return marked


def is_menu(node: Node, before: Node | None) -> bool:
    """Whether a block is a list of many short links with no text around them; what a heading announces is none, nor are headings and paragraphs."""
    if node.name not in BLOCK or node.name in HEADINGS or node.name in ("p", "blockquote", "table") or before is not None and before.name in HEADINGS:
        return False
    return node.link_tags >= MENU_LINKS and node.link_chars * 10 >= node.chars * 9 and node.link_chars <= MENU_CHARS * node.link_tags


def left_out(root: Node, marked: set[int]) -> set[int]:
    """Ids of the nodes, and of their direct texts (as pairs), that are no content."""
    out: set[int] = set()
    homes = root.best.in_content  # the page says where its articles are: only they count
    core, node = set(), root.best
    while node is not None:
        core.add(id(node))
        node = node.parent
    todo = [(root, id(root) in marked)]
    while todo:
        node, whole = todo.pop()
        children = [p for p in node.parts if type(p) is Node]
        kept = [k for k, p in enumerate(children) if p.holds]
        for k, child in enumerate(children):
            menu = is_menu(child, children[k - 1] if k else None)
            if child.suspect and id(child) not in core and not root.best.doubted:
                keep, all_of = False, False
            elif homes and not child.in_content:  # on the way to an article
                inner = child.holds
                keep, all_of = inner, False
            elif whole or (homes and child.in_content):
                keep, all_of = not menu, True
            elif child.holds:
                keep, all_of = True, id(child) in marked
            else:
                between = kept and kept[0] < k < kept[-1] and not menu
                heads = child.name in HEADINGS and k + 1 in kept
                keep, all_of = between or heads, True
            if keep:
                todo.append((child, all_of))
            else:
                out.add(id(child))
        if not whole and id(node) not in marked and (homes and not node.in_content or not kept or node.parent is None):
            out.add(-id(node))  # texts directly in a node that is no content itself
    return out


def blocks(root: Node, out_ids: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """One string per block, in page order, without what `left_out` names; text directly inside a block between two inner blocks is one too."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [root]
    while todo:
        part = todo.pop()
        if part is None:
            end()
        elif type(part) is str:
            line.append(part)
        else:
            if part.name in BLOCK:
                end()
                todo.append(None)
            if id(part) in out_ids:
                continue
            silent = -id(part) in out_ids
            todo.extend(p for p in reversed(part.parts) if not (silent and type(p) is str))
    end()
    return out


def main_text(page: str | None, by_density: bool = True) -> str:
    if not page:
        return ""
    root = tree(page)
    lines = blocks(root, left_out(root, mark(root, by_density)) if by_density else frozenset())
    while len(lines) > 1 and RIGHTS.fullmatch(lines[-1]) and not root.best.in_content:
        lines.pop()
    return "\n".join(lines)


def _extract() -> Callable:
    def extract(inputs: list[pa.Array]) -> list[pa.Array]:
        texts = [main_text(page) for page in inputs[0].to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return extract


def extract_text(pages: DataFrame, carry: list[Column], html_col: str = "html") -> DataFrame:
    """`carry` as c0, c1, ... with text and n_chars (code points): one row per input row; no shuffle.

    Null and empty pages, and pages without text, give an empty text.  Broken markup is read as browsers do;
    very long pages are read whole; repeated rows are read each; carried columns may have any names.  An empty table
    gives an empty result.
    """
    return map_rows(pages, carry, [F.col(html_col)], _extract, "text string, n_chars long")
