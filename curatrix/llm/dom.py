"""Block elements of HTML pages, with their text, as flat lists in document order."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from html import unescape

#: Elements that end with their start tag, that never hold an article's text, and that don't break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template title textarea select option datalist button iframe object canvas audio video svg math noframes noembed xmp".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: What a start tag closes if it is open, and where the search for it ends.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "tbody": ("thead tbody tfoot tr td th", ("table",)), "thead": ("tbody tr", ("table",)), "tfoot": ("thead tbody tr td th", ("table",)), "body": ("head", ()),
}
#: What may stand in a head; what ends a table's cell; roots of drawings and formulas, what holds HTML in them, and the tags that end them.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
CELLS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
FOREIGN = frozenset(("svg", "math"))
_HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_BREAKS_OUT = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_STAYS = frozenset(("button", "table", "td", "th", "object"))  # a paragraph outside of these isn't closed from inside

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for t in RAW}


@dataclass
class Dom:
    """Node i's descendants are i + 1 to end[i]; the parent of the first, the page, is -1. text: that of nodes which have any."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    n_tags: list[int] = field(default_factory=list)

    def open(self, parent: int, tag: str, attributes: str) -> int:
        i = len(self.parent)
        self.parent.append(parent)
        self.end.append(i + 1)
        self.depth.append(self.depth[parent] + 1 if i else 0)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append("")
        self.linked.append(0)
        self.n_tags.append(1)
        return i


class Open:
    """A stack of open elements that knows, in constant time, where each name stands and which drawing or formula is open."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.foreign: list[int] = []  # of each element, where the drawing or formula begins whose content comes next; -1 for HTML

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name: str) -> bool:
        return bool(self.places.get(name))

    def push(self, name: str) -> None:
        at = self.foreign[-1] if self.foreign else -1
        if name in FOREIGN:
            at = len(self.names) if at < 0 else at
        elif at >= 0 and name in _HOLDS_HTML:
            at = -1
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.foreign.append(at)

    def cut(self, depth: int) -> None:
        """Closes all elements from that place on."""
        while len(self.names) > depth:
            self.places[self.names.pop()].pop()
            self.foreign.pop()

    def last(self, *names: str) -> int:
        """The innermost place of any of the names; -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def first(self, name: str) -> int:
        return self.places[name][0]

    @property
    def drawing(self) -> int:
        return self.foreign[-1] if self.foreign else -1


def _skip(skipping: Open, tag: str, closing: bool, closed: bool, outside: Callable[[str], bool]) -> bool:
    """Follows a tag within a dropped element: the elements open in it, itself first. False: it has ended before this tag.

    closed: the tag ends in "/>". outside: whether an element of that name is open around the dropped one.
    """
    if closing:
        if tag in skipping:
            skipping.cut(skipping.last(tag))
            return True
        if tag not in VOID and outside(tag):
            skipping.cut(0)
            return False
        return True
    if tag == "body" or (len(skipping) == 1 and "head" in skipping and tag not in IN_HEAD) or (tag in CELLS and "table" not in skipping and (outside("td") or outside("th"))):
        skipping.cut(0)
        return False
    at = skipping.drawing
    if at >= 0 and tag in _BREAKS_OUT:
        skipping.cut(at)
        if not len(skipping):
            return False
        at = -1
    if tag in ("button", "option", "select") and tag in skipping and "template" not in skipping:
        # a second one ends the first
        skipping.cut(skipping.first(tag))
        if tag == "select":
            return True
        if not len(skipping):
            return False
    if tag not in VOID and tag not in RAW and not (closed and (at >= 0 or tag in FOREIGN)):
        skipping.push(tag)
    return True


def parse(html: str) -> Dom:
    """A page's blocks. A run of text and inline elements between blocks is a node "#text", or its element's own text if that has no other.

    Never fails: what isn't markup is text, what isn't closed ends with its parent or the page. Each tag takes constant time,
    however deep it stands.
    """
    dom = Dom()
    stack, names = [dom.open(-1, "#page", "")], Open()
    names.push("#page")
    skipping = Open()  # the dropped element that is open, and the elements open in it
    inlines: Counter[str] = Counter()  # the inline elements open since the last block began or ended
    run: list[str] = []
    links = linked = inner = 0

    def flush() -> None:
        nonlocal linked, inner
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                at = dom.open(stack[-1], "#text", "")
                dom.text[at], dom.linked[at], dom.n_tags[at] = text, min(linked, len(text)), 1 + inner
        linked = inner = 0

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            dom.end[stack.pop()] = len(dom.parent)
        names.cut(depth)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        begin = m.start() if m else size
        if begin > at and len(skipping) == 1 and "head" in skipping and not html[at:begin].isspace():
            skipping.cut(0)
        if begin > at and not len(skipping):
            part = unescape(html[at:begin])
            run.append(part)
            if links:
                linked += len(part)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, closed = tag.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "").endswith("/")
        if len(skipping):
            foreign = skipping.drawing >= 0
            if _skip(skipping, tag, closing, closed, lambda t: t in names or inlines[t] > 0):
                if tag in RAW and not closing and not (closed and foreign):
                    at = _ENDS[tag].search(html, at).end()
                continue
        if tag in INLINE:
            inner += 1
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag == "br":
                run.append(" ")
            if closing and inlines[tag] > 0:
                inlines[tag] -= 1
            elif not closing and tag not in VOID:
                inlines[tag] += 1
            continue
        if tag in DROPPED:
            if not closing:
                run.append(" ")
                if tag in RAW:
                    at = _ENDS[tag].search(html, at).end()
                elif not (closed and tag in FOREIGN):
                    skipping.push(tag)
            continue
        if closing:
            if tag in names:
                close(names.last(tag))
                links = 0
                inlines.clear()
            else:
                flush()
            continue
        flush()
        links = 0
        inlines.clear()
        which, until = CLOSES.get(tag, ("", ()))
        ended = names.last(*which.split())
        if ended > max(0, names.last(*until)):
            close(ended)
        ended = names.last("p")
        if ended > names.last(*_STAYS):
            close(ended)
        if tag in VOID:
            continue
        stack.append(dom.open(stack[-1], tag, m[3] or m[6] or ""))
        names.push(tag)
    close(0)
    _merge(dom)
    return dom


def _merge(dom: Dom) -> None:
    """Gives an element whose only child is a run of text that text."""
    n = len(dom.parent)
    only = [i for i in range(n - 1) if dom.end[i] == i + 2 and dom.tag[i + 1] == "#text"]
    if not only:
        return
    gone = [False] * n
    for i in only:
        dom.text[i], dom.linked[i], dom.n_tags[i] = dom.text[i + 1], dom.linked[i + 1], dom.n_tags[i + 1]
        gone[i + 1] = True
    new, to = 0, []
    for g in gone:
        to.append(new)
        new += not g
    to.append(new)
    keep = [i for i in range(n) if not gone[i]]
    dom.parent = [to[dom.parent[i]] if dom.parent[i] >= 0 else -1 for i in keep]
    dom.end = [to[dom.end[i]] for i in keep]
    for name in ("depth", "tag", "attributes", "text", "linked", "n_tags"):
        values = getattr(dom, name)
        setattr(dom, name, [values[i] for i in keep])
