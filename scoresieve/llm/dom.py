"""A small HTML reader: a tree of elements with the texts between them."""

from __future__ import annotations

import html
import re

#: Elements that begin and end blocks of text. (fixed values: HTML element names)
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, and which are never text of a page.
RAW = frozenset("script style noscript iframe template textarea title xmp noframes svg object canvas".split())
#: Formulas, whose text is text of the block around them. Their tags say nothing about a page's layout.
MATH = frozenset(
    "math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose "
    "msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction maligngroup malignmark mglyph".split()
)
#: annotation: a formula's source, which browsers do not show beside the formula.
HIDDEN = RAW | {"head", "select", "option", "datalist", "audio", "video", "annotation", "annotation-xml"}
CLOSES_P = BLOCKS - {"button", "option", "select", "body", "html", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"} | {"hr"}
#: Elements beyond which no open paragraph is ended.
AROUND_P = ("td", "th", "li", "div", "article", "section", "main", "body", "table", "button")
#: An open element that a start tag ends, and what it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

# A quote opens a value only right after '='; elsewhere it belongs to a name or a value. One that never closes is no quote.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(>?)|[^<]+|<""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_HIDES = re.compile(r"\bhidden\b|\bstyle\b", re.IGNORECASE)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.IGNORECASE)


class Node:
    """An element. items: texts, child nodes and None (a break that ends nothing, as <br>), in order."""

    __slots__ = ("tag", "attrs", "parent", "items", "depth", "number")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list = []
        self.depth = parent.depth + 1 if parent else 0

    def named(self) -> dict[str, str]:
        """Attributes by lower-case name; of repeated ones the first counts."""
        found: dict[str, str] = {}
        for m in _ATTR.finditer(self.attrs):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return found


def parsed(source: str) -> Node:
    """The tree of a page. Unclosed and stray tags are mended as browsers mostly do; an unfinished tag at the end is left out."""
    root = node = Node("#root", "", None)
    stack: list[Node] = []  # open elements, and where each tag is open in it, so that no tag costs a walk over all of them
    where: dict[str, list[int]] = {}

    def last(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def close(at: int) -> Node:
        """End all open elements from place `at` on."""
        while len(stack) > at:
            where[stack.pop().tag].pop()
        return stack[-1] if stack else root

    at, n = 0, len(source)
    match = _TOKEN.match
    while at < n:
        m = match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                node.items.append(html.unescape(text) if "&" in text else text)
            continue
        if not m[4]:  # the page ends within the tag
            break
        tag = tag.lower()
        if m[1]:
            if where.get(tag):
                node = close(where[tag][-1])
            continue
        if tag in CLOSES_P or tag == "p":
            own = last(("p",))
            if own > last(AROUND_P):
                node = close(own)
        if tag in ENDS:
            ends, stops = ENDS[tag]
            own = last(ends)
            if own > last(stops):
                node = close(own)
        elif tag == "body" or tag == "html":
            if node is not root and tag == "html":
                continue
            while node.tag == "head":
                node = close(len(stack) - 1)
        child = Node(tag, m[3], node)
        node.items.append(child)
        if tag in VOID or tag in MATH and m[3].endswith("/"):
            continue
        if tag in RAW:
            if m[3].endswith("/") and tag == "svg":
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else n
            continue
        node = child
        where.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def visible(node: Node) -> bool:
    """Not so: elements that are never text, those whose style says display: none, and those with the attribute hidden and no display of their own."""
    if node.tag in HIDDEN:
        return False
    if not (node.attrs and _HIDES.search(node.attrs)):
        return True
    named = node.named()
    own = _DISPLAY.findall(re.sub(r"/\*.*?\*/", " ", named.get("style", ""), flags=re.DOTALL))
    if own:  # the last one counts, of important ones if there are such
        return ([d for d in own if d[1]] or own)[-1][0].lower() != "none"
    return "hidden" not in named
