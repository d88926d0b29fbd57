"""Leaf blocks of an HTML page with the features of their ancestors and texts."""

from __future__ import annotations

import re
from html import unescape

#: A comment, declaration or tag, or a tag that the page's end cuts off. Quantifiers don't give back and a cut-off tag takes all the rest, so matching is linear.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|</?[A-Za-z].*+""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][A-Za-z0-9_:.-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
NAME_PART = re.compile(r"[A-Za-z]{2,}")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
HIDDEN = frozenset("script style noscript template textarea title svg math iframe object head select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag closes an open element of these, up to a container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
} | {t: {"p"} for t in "p div section article aside header footer nav main form ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre figure fieldset hr address details".split()}
CONTAINERS = frozenset("body div section article aside header footer nav main form ul ol table td th blockquote figure fieldset html details dl".split())


class Element:
    """An open element: its tag, the names that no element above it has, and the innermost name. Chains of these share their upper parts."""

    __slots__ = ("tag", "above", "names", "inner", "main", "sums")

    def __init__(self, tag: str, above: Element | None, names: tuple[str, ...], main: bool):
        self.tag, self.above, self.names, self.main = tag, above, names, main
        self.inner: str = names[-1] if names else above.inner if above else ""
        self.sums: tuple[float, float] | None = None

    def path(self) -> list[str]:
        """All distinct names from the outermost element to this one."""
        chain, at = [], self
        while at is not None:
            chain.append(at.names)
            at = at.above
        return [n for names in reversed(chain) for n in names]


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element

    @property
    def path(self) -> list[str]:
        return self.element.path()

    @property
    def main(self) -> bool:
        return self.element.main


def _own_features(tag: str, attributes: str) -> tuple[list[str], bool | None]:
    found, main = [tag], None
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            found += ["." + p.lower() for p in NAME_PART.findall(value)]
        elif name == "hidden":
            found.append(".hidden")
        elif name in ("data-main", "data-other"):
            main = name == "data-main"
    return found, main


def blocks(html: str) -> list[Block]:
    """Blocks of visible text in page order, white space inside each turned into one space.

    Tolerates what pages get wrong: elements left open, end tags without a start,
    documents cut off. ``data-main`` marks the main text of labelled pages,
    ``data-other`` what within it is none; neither is a feature. Elements may be
    nested to any depth and carry any number of names.
    """
    out: list[Block] = []
    stack = [Element("", None, (), False)]
    inherited: set[str] = set()  # names in the chain of open elements
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), stack[-1]))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if opened.get("a"):
                linked += len(text.strip())

    def pop_to(at: int) -> None:
        while len(stack) > at:
            gone = stack.pop()
            opened[gone.tag] -= 1
            inherited.difference_update(gone.names)

    at, n = 0, len(html)
    while at < n:
        m = MARKUP.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            if tag == "br":
                parts.append(" ")
                continue
            flush()
        if m[1]:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if tag not in INLINE or not any(stack[i].tag in CONTAINERS for i in range(k + 1, len(stack))):
                    pop_to(k)
            continue
        if tag in HIDDEN and tag != "head":
            end = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES.get(tag, ()):
                pop_to(k)
                break
            if stack[k].tag in CONTAINERS:
                break
        own, main = _own_features(tag, m[3])
        fresh = tuple(n for n in dict.fromkeys(own) if n not in inherited)
        inherited.update(fresh)
        stack.append(Element(tag, stack[-1], fresh, stack[-1].main if main is None else main))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def _size(n: int) -> str:
    return "0" if n < 10 else "1" if n < 40 else "2" if n < 100 else "3" if n < 250 else "4"


def own_features(found: list[Block]) -> list[list[str]]:
    """Names of each block's own features: its text's shape, its place, and the innermost name around it."""
    out, n = [], len(found)
    for i, b in enumerate(found):
        size = len(b.text)
        share = b.linked / size
        own = ["bias", "size" + _size(size), "links" + ("0" if share < 0.1 else "1" if share < 0.6 else "2")]
        last = b.text[-1]
        own.append("end." if last in ".!?" else "end:" if last in ":;,|" else "end-")
        sign = b.text.find("\N{COPYRIGHT SIGN}")
        if sign >= 0:
            own.append("copyright" if 5 * sign <= 2 * size else "copyright later")
        if sum(map(str.isdigit, b.text)) * 5 > size:
            own.append("digits")
        own.append("first" if i == 0 else "last" if i + 1 == n else "inside")
        own.append("inner" + b.element.inner)
        out.append(own)
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of all features of each block: its own, and the tags and name parts of all its ancestors."""
    return [[*own, *b.path] for own, b in zip(own_features(found), found)]
