"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree."""

from __future__ import annotations

import functools
import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dom import BLOCKS, MATH, Node, parsed, visible
from .trees import Boosted, boosted

#: Pages that the model is trained on; they are generated, as no page comes with labels.
TRAIN_PAGES, TRAIN_FRAGMENTS = 1000, 100
#: Log odds that content loses by turning to boilerplate within itself, and that a node loses by deciding nothing for its subtree.
TURN, OPEN = 4.0, 0.6
#: Margins count up to here; and a node that looks like content pays this share of its margin for being left open.
SURE, LEAN = 4.0, 0.5

TAGS = "body main article section div p h1 h2 h3 h4 ul ol li dl table tr td blockquote pre figure figcaption header footer nav aside form button label address span a details".split()
INSIDE = "article main nav header footer aside form".split()
_TAG_PLACE = {tag: i for i, tag in enumerate(TAGS)}
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PARTS = re.compile(r"[^\W\d_]+")

# Names that pages give to their parts; the generator draws from them, and the model learns which say what.
CONTENT_NAMES = "content article post entry story body text main page single hentry prose copy blog news markdown document chapter".split()
BOILERPLATE_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar links pagination pager tabs toc skip".split(),
    "header": "header masthead banner branding logo site top hero".split(),
    "footer": "footer bottom copyright legal colophon credits imprint".split(),
    "side": "sidebar side aside widget rail secondary related recommended popular trending more recent".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp teaser banner outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert warning message popup modal overlay privacy newsletter subscribe paywall announcement disclaimer".split(),
    "form": "form search login signup register contact subscribe newsletter feedback".split(),
    "comments": "comment comments commentlist respond reply replies discussion disqus reviews thread".split(),
    "share": "share social sharing twitter facebook follow tags categories meta author byline rating".split(),
}
#: Hash range of the tokens of class, id, role and the like.
TOKENS = 1 << 20
_NUMBERS = 30
PLAIN = _NUMBERS + len(TAGS) + len(INSIDE)
#: Parts whose features are laid out at once; a page may have any number.
PARTS_AT_ONCE = 20_000


@dataclass
class Part:
    """A node that is decided about: a block element, or an inline one with attributes."""

    node: Node
    parent: int
    own: int = 0  # characters of its own text
    chars: int = 0
    words: int = 0
    linked: int = 0
    stops: int = 0
    digits: int = 0
    tags: int = 0
    paragraphs: int = 0
    controls: int = 0
    begin: int = 0
    place: int = 0
    truth: int = -1


def _names(node: Node) -> set[int]:
    """Hashes of the words in the attributes that name an element."""
    if not node.attrs:
        return set()
    a = node.named()
    said = " ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""), a.get("aria-label", ""), a.get("itemprop", "")))
    return {zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass")) % TOKENS for m in _PARTS.finditer(_CAMEL.sub(r"\1 \2", said))}


def parts_of(root: Node) -> list[Part]:
    """The decided nodes in page order, the page itself first, with sums over their subtrees."""
    parts = [Part(root, -1)]
    seen = 0
    # (node, index of the part around it, in a link?, items left)
    stack = [(root, 0, False, iter(root.items))]
    while stack:
        node, part, link, items = stack[-1]
        for item in items:
            if isinstance(item, Node):
                if not visible(item):
                    continue
                own = part
                formula = item.tag in MATH
                if item.tag in BLOCKS or (item.attrs and not formula and item.tag not in ("a", "br", "img", "input", "wbr") and item.tag.isalpha()):
                    parts.append(Part(item, part, begin=seen))
                    own = len(parts) - 1
                parts[own].tags += not formula
                parts[own].paragraphs += item.tag == "p"
                parts[own].controls += item.tag in ("input", "button", "select", "textarea", "label")
                stack.append((item, own, link or item.tag == "a", iter(item.items)))
                break
            else:
                p, text = parts[part], item.strip()
                if text:
                    n = len(text)
                    p.own += n
                    p.chars += n
                    p.words += text.count(" ") + 1
                    p.linked += n * link
                    p.stops += text.count(". ") + text.count(", ") + (text[-1] in ".!?")
                    p.digits += sum(map(str.isdigit, text)) if n < 200 else 0
                    seen += n
        else:
            stack.pop()
    for i in range(len(parts) - 1, -1, -1):
        p = parts[i]
        if p.parent >= 0:
            up = parts[p.parent]
            for name in ("chars", "words", "linked", "stops", "digits", "tags", "paragraphs", "controls"):
                setattr(up, name, getattr(up, name) + getattr(p, name))
    return parts


@dataclass
class Features:
    """Of all parts of a page: plain numbers, and the hashed tokens of each part and of those around it."""

    plain: np.ndarray
    own: list[set[int]]
    around: list[frozenset[int]]

    def laid_out(self, tokens: dict[int, int], at: int = 0, to: int | None = None) -> np.ndarray:
        """Rows at:to with a column for each known token (of the part, then of those around it) after the plain ones."""
        plain = self.plain[at:to]
        x = np.zeros((len(plain), PLAIN + 2 * len(tokens)), np.float32)
        x[:, :PLAIN] = plain
        for i in range(len(plain)):
            for shift, names in ((0, self.own[at + i]), (len(tokens), self.around[at + i])):
                for k in names:
                    if k in tokens:
                        x[i, PLAIN + shift + tokens[k]] = 1
        return x


def features(parts: list[Part]) -> Features:
    x = np.zeros((len(parts), PLAIN), np.float32)
    kids: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        kids.setdefault(p.parent, []).append(i)
    total = max(1, parts[0].chars)
    tag_at, in_at = _NUMBERS, _NUMBERS + len(TAGS)
    chars = np.array([p.chars for p in parts], float)
    tags = np.array([p.tags for p in parts], float)
    linked = np.array([p.linked for p in parts], float)
    words = np.array([p.words for p in parts], float)
    stops = np.array([p.stops for p in parts], float)
    paragraphs = np.array([p.paragraphs for p in parts], float)
    controls = np.array([p.controls for p in parts], float)
    up = np.array([max(p.parent, 0) for p in parts])
    density, link = chars / (tags + 1), linked / (chars + 1)
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = np.log1p(chars), np.log1p(words), link, np.log1p(density)
    x[:, 4], x[:, 5], x[:, 6] = stops / (words + 1), np.log1p(paragraphs), chars / total
    x[:, 7], x[:, 8] = [p.begin / total for p in parts], [(p.begin + p.chars) / total for p in parts]
    x[:, 9], x[:, 10], x[:, 11] = np.log1p(controls), [p.digits / (p.chars + 1) for p in parts], [min(p.node.depth, 30) for p in parts]
    x[:, 12], x[:, 13], x[:, 14] = np.log1p(density)[up], link[up], np.log1p(chars)[up]
    x[:, 15], x[:, 16], x[:, 17] = chars / (chars[up] + 1), [p.own / (p.chars + 1) for p in parts], np.log1p(tags)
    x[:, 18], x[:, 19] = chars / (paragraphs + 1), chars / (words + 1)
    for siblings in kids.values():
        own = np.array(siblings)
        n = len(own)
        x[own, 20], x[own, 21] = np.arange(n) / max(1, n - 1), math.log1p(n)
        x[own, 22], x[own, 23] = np.log1p(chars[own].mean()), link[own].mean()
        same: dict[str, int] = {}
        for i in siblings:
            same[parts[i].node.tag] = same.get(parts[i].node.tag, 0) + 1
        x[own, 24] = [same[parts[i].node.tag] for i in siblings]
        x[own[1:], 25], x[own[1:], 26] = np.log1p(chars[own[:-1]]), link[own[:-1]]
        x[own[:-1], 27], x[own[:-1], 28] = np.log1p(chars[own[1:]]), link[own[1:]]
        x[own, 29] = paragraphs[own].sum() / n
    names: list[set[int]] = []
    around: list[frozenset[int]] = []
    for i, p in enumerate(parts):
        if p.node.tag in _TAG_PLACE:
            x[i, tag_at + _TAG_PLACE[p.node.tag]] = 1
        names.append(_names(p.node))
        if p.parent < 0:
            around.append(frozenset())
            continue
        x[i, in_at:PLAIN] = x[p.parent, in_at:PLAIN]
        above = parts[p.parent].node.tag
        if above in INSIDE:
            x[i, in_at + INSIDE.index(above)] = 1
        # (Parts share the set of those around them wherever it does not grow.)
        around.append(around[p.parent] | names[p.parent] if not names[p.parent] <= around[p.parent] else around[p.parent])
    return Features(x, names, around)


def states(parts: list[Part], margins: np.ndarray) -> np.ndarray:
    """For each part 0 (open), 1 (content) or 2 (boilerplate): the best consistent labelling of the tree.

    A node is content, boilerplate or open. Below boilerplate all is boilerplate; below content all is content unless a
    subtree turns, at a price; below open nodes anything goes. The page itself (the first part) is open.
    """
    n = len(parts)
    margins = np.clip(margins, -SURE, SURE)
    good, bad = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
    content, boiler = good.copy(), bad.copy()
    leaf = np.ones(n, bool)
    for p in parts:
        if p.parent >= 0:
            leaf[p.parent] = False
    own = np.array([p.own > 0 for p in parts], bool)
    undecided = np.where(leaf, -1e9, np.where(own, np.maximum(good, bad), 0) - OPEN - LEAN * np.maximum(margins, 0))
    for i in range(n - 1, -1, -1):
        up = parts[i].parent
        if up >= 0:
            content[up] += max(content[i], boiler[i] - TURN)
            boiler[up] += boiler[i]
            undecided[up] += max(content[i], boiler[i], undecided[i])
    state = np.zeros(n, np.int8)
    for i, p in enumerate(parts):
        above = state[p.parent] if p.parent >= 0 else 0
        if p.parent < 0:
            state[i] = 0
        elif above == 2:
            state[i] = 2
        elif above == 1:
            state[i] = 1 if content[i] >= boiler[i] - TURN else 2
        else:
            state[i] = (0, 1, 2)[int(np.argmax([undecided[i], content[i], boiler[i]]))]
    return state


def decoded(parts: list[Part], margins: np.ndarray) -> np.ndarray:
    """For each part whether its own text is kept: that of content, and of open parts that look like content by themselves."""
    state = states(parts, margins)
    return (state == 1) | ((state == 0) & (margins > 0))


def blocks(root: Node, keep: dict[int, bool]) -> list[str]:
    """Texts of the kept parts in page order; keep: by id of a part's node. White space within a block is one space."""
    out: list[str] = []
    run: list[str] = []

    def cut():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack = [(root, keep.get(id(root), False), iter(root.items), False)]
    while stack:
        node, kept, items, block = stack[-1]
        for item in items:
            if isinstance(item, Node):
                if not visible(item):
                    continue
                if item.tag == "br":
                    run.append(" ")
                    continue
                is_block = item.tag in BLOCKS
                if is_block:
                    cut()
                stack.append((item, keep.get(id(item), kept), iter(item.items), is_block))
                break
            elif kept:
                run.append(item)
        else:
            stack.pop()
            if block:
                cut()
    cut()
    return out


# ---- generated pages with labels


def _sentence(rng: random.Random, words: list[str], least: int, most: int) -> str:
    own = rng.choices(words, k=rng.randint(least, most))
    return " ".join(w + ("," if rng.random() < 0.08 else "") for w in own).capitalize() + rng.choice(["."] * 6 + ["!", "?"])


class _Maker:
    """Writes one page in a layout of its own. Content is between marks \\x01 and \\x02, which the trees carry to the labels."""

    def __init__(self, seed: int):
        self.rng = rng = random.Random(seed)
        letters = rng.sample(["th", "er", "an", "in", "on", "re", "st", "en", "ou", "la", "de", "ti", "es", "é", "sch", "ung", "ci", "ar", "mo", "ka", "lu", "pe"], 12)
        self.words = ["".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(250)]

    def odd(self) -> str:
        """Content that is no prose: lists in a line, shouting, repeats, numbers, marks."""
        rng, n = self.rng, self.rng.randint(1, 40)
        own = rng.choices(self.words, k=n)
        style = rng.randint(0, 4)
        if style == 0:
            return " | ".join(own)
        if style == 1:
            return " ".join(w.upper() + "!!" for w in own)
        if style == 2:
            return " ".join(w + rng.choice(["***", "###", "$$$", "%%%"]) for w in own)
        if style == 3:
            return " ".join([own[0]] * n)
        return " ".join(str(rng.randint(0, 10**9)) if rng.random() < 0.5 else w for w in own)

    def text(self, least: int = 1, most: int = 8, short: int = 3, long: int = 18) -> str:
        return " ".join(_sentence(self.rng, self.words, short, long) for _ in range(self.rng.randint(least, most)))

    def name(self, pool: list[str]) -> str:
        rng, own = self.rng, self.rng.choice(pool)
        if rng.random() < 0.5:
            own = rng.choice([f"{own}-{rng.choice(['box', 'list', 'block', 'inner', 'item', 'wrapper'])}", f"{rng.choice(['site', 'page', 'main', 'c'])}-{own}", own.capitalize(), f"{own}_{rng.randint(1, 99)}"])
        return f' {rng.choice(["class", "class", "id"])}="{own}"'

    def links(self, n: int) -> str:
        rng = self.rng
        items = [f'<a href="/{rng.choice(self.words)}">{" ".join(rng.choices(self.words, k=rng.randint(1, 4)))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else rng.choice([" | ", " ", " &middot; "]).join(items)

    def boilerplate(self, kind: str) -> str:
        rng = self.rng
        name = self.name(BOILERPLATE_NAMES[kind]) if rng.random() < 0.9 or kind in ("comments", "notice", "ad") else ""
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = tag if rng.random() < 0.6 else "div"
        if tag == "div" and not name:
            name = self.name(BOILERPLATE_NAMES[kind])
        if kind == "menu":
            inside = self.links(rng.randint(2, 12))
        elif kind == "header":
            inside = rng.choice(["", "<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>"]).format(" ".join(rng.choices(self.words, k=3))) + (self.links(rng.randint(1, 6)) if rng.random() < 0.6 else "")
        elif kind == "footer":
            inside = rng.choice(["&copy; {} &middot; {}", "<p>&copy; 2020 {}</p><p>{}</p>", "{} {}", "<div>{}</div><div>{}</div>"]).format(" ".join(rng.choices(self.words, k=2)), self.text(1, 2)) + (self.links(rng.randint(1, 8)) if rng.random() < 0.4 else "")
        elif kind == "side":
            inside = f"<h3>{' '.join(rng.choices(self.words, k=2))}</h3>" * (rng.random() < 0.7) + (self.links(rng.randint(2, 8)) if rng.random() < 0.6 else "".join(f"<p>{self.text(1, 3)}</p>" for _ in range(rng.randint(1, 3))))
        elif kind in ("ad", "notice"):
            inside = rng.choice(["{}", "<p>{}</p>", "<span>{}</span>", '<a href="/x">{}</a>', "<p>{}</p><button>Ok</button>"]).format(self.text(1, 3))
        elif kind == "form":
            inside = "".join(f"<label>{rng.choice(self.words)}</label><input name=x>" for _ in range(rng.randint(1, 4))) + f"<button>{rng.choice(self.words)}</button>" + (f"<p>{self.text(1, 2)}</p>" if rng.random() < 0.4 else "")
        elif kind == "comments":
            one = rng.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li><cite>{}</cite><p>{}</p></li>", "<article class='comment'><header>{}</header><p>{}</p></article>", "<p><b>{}</b> {}</p>", "<div><span>{}</span><div>{}</div></div>"])
            many = "".join(one.format(rng.choice(self.words), self.text(1, 5)) for _ in range(rng.randint(1, 6)))
            inside = f"<h3>{rng.randint(1, 30)} {rng.choice(['comments', 'replies', rng.choice(self.words)])}</h3>" * (rng.random() < 0.6) + (f"<ul>{many}</ul>" if one.startswith("<li") else many)
        else:
            inside = self.links(rng.randint(1, 6)) if rng.random() < 0.6 else f"<span>{' '.join(rng.choices(self.words, k=3))}</span>"
        return f"<{tag}{name}>{inside}</{tag}>"

    def content(self) -> str:
        rng = self.rng
        title = self.text(1, 1, 1, 9) if rng.random() < 0.5 else " ".join(rng.choices(self.words, k=rng.randint(1, 10)))
        out = [f"<h1>{title}</h1>"] * (rng.random() < 0.85)
        one, strange = rng.random() < 0.25, rng.random() < 0.25
        for i in range(1 if one else rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                body = rng.choice(self.words).capitalize() + "." if rng.random() < 0.12 else self.text(1, rng.choice([2, 5, 14]))
                if strange and rng.random() < 0.7:
                    body = self.odd()
                if rng.random() < 0.2 and not strange:
                    body += f' <a href="/y">{rng.choice(self.words)}</a> ' + self.text(1, 2)
                style = rng.random()
                out.append(f"<p><b>{body}<br>" if style < 0.15 else f"<p>{body}" if style < 0.25 else f"<p{self.name(['lead', 'intro', 'text'])}>{body}</p>" if style < 0.3 else f"<p>{body}</p>")
            elif kind < 0.82:
                out.append(f"<h2>{' '.join(rng.choices(self.words, k=rng.randint(1, 6)))}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.text(1, 2)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{self.text(1, 3)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<pre>{self.text(1, 3)}</pre>")
            elif kind < 0.97:
                out.append(f"<figure><figcaption>{self.text(1, 1)}</figcaption></figure>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{rng.choice(self.words)}</td><td>{self.text(1, 1)}</td></tr>" for _ in range(3)) + "</table>")
        marked = [f"\x01{x}\x02" for x in out]
        for kind in rng.sample(["ad", "share", "side", "notice", "form", "menu", "comments"], rng.choice([0, 0, 0, 1, 1, 2])):
            marked.insert(len(marked) if kind == "comments" else rng.randint(0, len(marked)), self.boilerplate(kind))
        inside = "".join(marked)
        if rng.random() < 0.6:
            inside = f"<article{self.name(CONTENT_NAMES) if rng.random() < 0.4 else ''}>{inside}</article>"
        else:
            inside = f"<div{self.name(CONTENT_NAMES)}>{inside}</div>"
        for _ in range(rng.choice([0, 0, 1, 2])):
            inside = f"<{rng.choice(['div', 'section', 'main'])}{self.name(['wrapper', 'container', 'main', 'content', 'row', 'layout']) if rng.random() < 0.7 else ''}>{inside}</div>"
        return inside

    def page(self) -> str:
        rng = self.rng
        before = rng.sample(["menu", "header", "notice", "ad", "menu", "form", "share", "side"], rng.randint(0, 4))
        after = rng.sample(["side", "comments", "share", "ad", "form", "footer", "notice", "menu"], rng.randint(0, 4))
        if rng.random() < 0.8 and "footer" not in after:
            after.append("footer")
        body = "".join(self.boilerplate(k) for k in before) + self.content() + "".join(self.boilerplate(k) for k in after)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"

    def fragment(self) -> str:
        """Bare text with inline markup, and perhaps paragraphs, in the body or with no page around it."""
        rng = self.rng
        bare = self.text(1, 4) + rng.choice(["", f" <b>{rng.choice(self.words)}</b> ", f"<br>{self.text(1, 2)}"]) + self.text(1, 2)
        many = "".join(f"<p>{self.text(1, 6)}</p>" for _ in range(rng.randint(0, 4)))
        some = "".join(self.boilerplate(k) for k in rng.sample(["menu", "footer", "ad", "form", "share"], rng.randint(0, 2)))
        text = f"\x01{bare}{many}\x02{some}" if rng.random() < 0.6 else f"{some}\x01{many}<p>{bare}</p>\x02"
        return f"<html><body>{text}</body></html>" if rng.random() < 0.5 else text


def _labelled(source: str) -> tuple[Features, np.ndarray, np.ndarray]:
    """Features of a generated page's parts, which of them are pure, and whether they are content."""
    root = parsed(source)
    inside = False
    own: dict[int, list[int]] = {}
    stack = [(root, iter(root.items))]
    while stack:
        node, items = stack[-1]
        for i, item in enumerate(items):
            if isinstance(item, Node):
                stack.append((item, iter(item.items)))
                break
            for c in item:
                if c in "\x01\x02":
                    inside = c == "\x01"
                elif not c.isspace():
                    for up, _ in stack:
                        own.setdefault(id(up), [0, 0])[inside] += 1
        else:
            stack.pop()
    parts = parts_of(_unmarked(root))
    seen = [own.get(id(p.node), [0, 0]) for p in parts]
    pure = np.array([(a == 0) != (b == 0) for a, b in seen], bool)
    truth = np.array([b > 0 for _, b in seen])
    return features(parts), pure, truth


def _unmarked(root: Node) -> Node:
    stack = [root]
    while stack:
        node = stack.pop()
        node.items = [x if isinstance(x, Node) else x.replace("\x01", "").replace("\x02", "") for x in node.items]
        stack += [x for x in node.items if isinstance(x, Node)]
    return root


@dataclass
class Model:
    trees: Boosted
    tokens: dict[int, int]  # column of each hashed token that the training pages use

    def margins(self, pages: list[Features]) -> np.ndarray:
        """Of all parts of all pages, one after the other; laid out for a bounded number of parts at a time."""
        out, some, n = [], [], 0
        for page in pages:
            for at in range(0, len(page.plain), PARTS_AT_ONCE):
                some.append(page.laid_out(self.tokens, at, at + PARTS_AT_ONCE))
                n += len(some[-1])
                if n >= PARTS_AT_ONCE:
                    out.append(self.trees.margins(np.concatenate(some)))
                    some, n = [], 0
        if some:
            out.append(self.trees.margins(np.concatenate(some)))
        return np.concatenate(out) if out else np.zeros(0)


@functools.cache
def trained(pages: int = TRAIN_PAGES, fragments: int = TRAIN_FRAGMENTS) -> Model:
    found = [_labelled(_Maker(seed).page()) for seed in range(pages)] + [_labelled(_Maker(seed).fragment()) for seed in range(10_000, 10_000 + fragments)]
    seen = sorted({k for f, _, _ in found for names in f.own for k in names})
    tokens = {k: i for i, k in enumerate(seen)}
    x = np.concatenate([f.laid_out(tokens)[pure] for f, pure, _ in found])
    return Model(boosted(x, np.concatenate([truth[pure] for _, pure, truth in found]).astype(float)), tokens)


def main_text(source: str, model: Model) -> str:
    return main_texts([source], model)[0]


def main_texts(sources: list[str], model: Model) -> list[str]:
    pages = [(root := parsed(s), parts_of(root)) for s in sources]
    margins = model.margins([features(parts) for _, parts in pages])
    out, at = [], 0
    for root, parts in pages:
        n = len(parts)
        keep = decoded(parts, margins[at : at + n])
        at += n
        out.append("\n\n".join(blocks(root, {id(p.node): bool(k) for p, k in zip(parts, keep, strict=True)})))
    return out


def extracted(html: Column, model: Model | None = None) -> Column:
    """The main text of each whole page: kept blocks in page order, joined by an empty line.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go. Character
    references are decoded, white space within a block becomes one space. Null and empty pages, and pages with no
    content, give the empty string. Text outside all elements counts as the page's own. The text of MathML stays in its
    block, without annotations (the formula's source). Each row is a page of its own, so repeated rows give the same text
    and an empty table none; a tie between labels goes to open, then content. A very long page is laid out
    in pieces of PARTS_AT_ONCE parts, and no tag costs a walk over the open elements. No columns are added or named.
    """
    model = model or trained()

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        out, group, size = [], [], 0
        for i in range(len(column)):
            source = column[i].as_py() or ""
            group.append(source)
            size += len(source)
            if size > 500_000 or i == len(column) - 1:
                out += main_texts(group, model)
                group, size = [], 0
        return pa.array(out, pa.string())

    return extract(html)
