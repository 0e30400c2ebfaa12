"""One page's blocks: a tolerant reader of HTML for the site style tree.

The tree holds block elements, and inline ones whose names say what they are;
a node's path is the chain of (tag, normalised class and id) from the root.
White space, comments and markup aside, every character of a page is in one
text run, which belongs to the innermost node around it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements by what the HTML standard says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption colgroup ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption colgroup dd dt head html legend li tbody td tfoot th thead tr".split())
#: An element ends an open one of these, up to the element that holds both.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
}
P_STAYS = frozenset("table td th caption button object template html".split())
#: Branches that the tree's importance judges; other blocks go with the container around them.
CONTAINERS = frozenset("div section ul ol dl table center details fieldset figure blockquote span".split())
ARTICLES = frozenset("article main".split())

#: Elements that never hold an article's text.
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas audio video button select textarea label dialog menu head title applet noembed noframes xmp".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids that say what a branch is.
NOISE_WORDS = frozenset(
    (
        "ad ads advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion promoted "
        "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager paging toolbar topbar masthead sidebar rail footer "
        "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
        "share sharing social related recommended recommendations trending widget widgets comment comments disqus respond reply replies copyright disclaimer form"
    ).split()
)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements within more open ones than this belong to the last node above them, as in browsers.
DEEPEST = 512
#: Longer numbers in a class or an id count pages and items, short ones columns and kinds.
DIGITS = re.compile(r"\d{3,}")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z](?P<loose>[^>]*)>|<[!?/][^>]*>|<[/a-zA-Z!?][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|href|src)(?=[\s=/>]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    path: int
    noise: bool
    inside: bool
    children: list[str] = field(default_factory=list)


_PATHS: dict[tuple[int, str], int] = {}


def digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def path_of(parent: int, name: str) -> int:
    key = (parent, name)
    if key not in _PATHS:
        if len(_PATHS) > 200_000:
            _PATHS.clear()
        _PATHS[key] = digest(f"{parent}/{name}")
    return _PATHS[key]


@dataclass
class Page:
    """nodes[0] is the root; items are (node, raw text), or None between blocks; links are (node, target)."""

    nodes: list[Node]
    items: list[tuple[int, str] | None]
    links: list[tuple[int, str]]

    @property
    def marked(self) -> bool:
        """Whether the page marks its article."""
        return any(n.tag in ARTICLES and not n.noise for n in self.nodes)


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        if m.start() == 0 or rest[m.start() - 1] in " \t\n\r\f/\"'":
            out.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    return out


def named_noise(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the element says by its name that it isn't the article's text; inside: within an article."""
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or HIDDEN.search(attributes.get("style", "")) or attributes.get("role", "").strip().lower() in NOISE_ROLES:
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = set(WORD.findall(CAMEL.sub(" ", names).lower()))
    return not words.isdisjoint(NOISE_WORDS) or ("header" in words and not inside)


def _name(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(set(DIGITS.sub("0", attributes.get("class", "")).lower().split()))
    return f"{tag}.{'.'.join(classes)}#{DIGITS.sub('0', attributes.get('id', ''))}"


def read_page(text: str) -> Page:
    """Nodes, text runs and links of a page, however broken its markup is."""
    nodes = [Node("", -1, 0, False, False)]
    items: list[tuple[int, str] | None] = []
    links: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and the node that text in them belongs to
    opened: Counter[str] = Counter()
    at, size = 0, len(text)

    def drop(i: int) -> None:
        for name, _ in stack[i:]:
            opened[name] -= 1
        del stack[i:]

    def close(names: tuple[str, ...], barrier: frozenset | tuple, outermost: bool = False) -> None:
        found = 0
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                found = i
                if not outermost:
                    break
            elif stack[i][0] in barrier:
                break
        if found:
            items.append(None)
            drop(found)

    while at < size:
        m = TAG.search(text, at)
        if m is None:
            items.append((stack[-1][1], text[at:]))
            break
        if m.start() > at:
            items.append((stack[-1][1], text[at : m.start()]))
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                items.append((stack[-1][1], " "))
                continue
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    if tag in BLOCKS:
                        items.append(None)
                        drop(i)
                    else:
                        opened[tag] -= 1
                        del stack[i]
                    break
                if stack[i][0] in BLOCKS and tag not in BLOCKS:
                    break  # an inline end tag doesn't end a block
            continue
        if m["loose"] is not None:
            tag, rest = re.match(r"<([a-zA-Z][^\s/>]*)", m[0])[1].lower(), m["loose"]
        elif m["start"]:
            tag, rest = m["start"].lower(), m["rest"]
        else:
            continue
        if tag in VOID:
            if tag == "hr":
                close(("p",), P_STAYS)
                items.append(None)
            elif tag == "br":
                items.append((stack[-1][1], " "))
            elif tag == "img" and rest:
                links.append((stack[-1][1], _attributes(rest).get("src", "")))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = end.end() if end else size
            continue
        attributes = _attributes(rest) if rest else {}
        if tag in CLOSES_P:
            close(("p",), P_STAYS)
        if tag in ENDS:
            close(*ENDS[tag], outermost=True)
        upper = stack[-1][1]
        over = nodes[upper]
        inside = over.inside or tag in ARTICLES
        noise = over.noise or named_noise(tag, attributes, inside)
        if (tag in BLOCKS and len(stack) < DEEPEST) or (noise and not over.noise):
            name = _name(tag, attributes)
            if not over.children or over.children[-1] != name:
                over.children.append(name)
            nodes.append(Node(tag, upper, path_of(over.path, name), noise, inside and not noise))
            upper = len(nodes) - 1
        if tag in BLOCKS:
            items.append(None)
        if tag == "a":
            links.append((upper, attributes.get("href", "")))
        stack.append((tag, upper))
        opened[tag] += 1
    return Page(nodes, items, links)


def plain(raw: str) -> str:
    """Character references decoded, white space as single spaces."""
    return " ".join(html.unescape(raw).split())


def blocks(page: Page, keeps: list[bool]) -> list[str]:
    """The text of each block in page order, of the nodes that are kept."""
    out, run = [], []
    for item in [*page.items, None]:
        if item is None:
            if run:
                # References are decoded run by run: markup ends one.
                text = " ".join("".join(map(html.unescape, run)).split())
                if text:
                    out.append(text)
                run = []
        elif keeps[item[0]]:
            run.append(item[1])
    return out
