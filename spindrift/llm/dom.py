"""A forgiving reader of HTML that gives the elements of a page as flat lists, parents before children."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that only mark words; they are no nodes of their own.
MARKS = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements whose content isn't markup, and isn't shown.
RAW = frozenset("script style noscript iframe title textarea".split())
#: Elements that hold markup which isn't shown: they end with their own end tag, with their parent's, or at a block that they can't hold.
HIDDEN = frozenset("template object svg annotation annotation-xml select canvas audio video".split())
#: A block inside one of these closes nothing outside it.
_SCOPES = frozenset(("object", "template"))
#: Elements that end a drawing, outside the parts of it that may hold a page's elements.
_NO_DRAWING = frozenset("b big br code em embed i img meta nobr ruby s small span strong strike sub sup table tt u var".split())
_PAGE_IN_DRAWING = frozenset("foreignobject desc title".split())
#: Blocks that a list of options may hold.
_IN_SELECT = frozenset("option legend div hr".split())
#: Foreign elements, which ``/>`` ends at once.
FOREIGN = frozenset(("svg", "math"))
#: Text outside all elements is judged as if it stood in one of these.
TOP = "article"
#: Elements that begin a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY_SIBLING = {
    "p": BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr", "tbody"},
    "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "head": {"body"},
}
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/>\"']+)")


@dataclass
class Page:
    """Element i has ``tags[i]``, ``parents[i]`` (-1 at the top) and ``attributes[i]``.

    ``texts`` are (element, block, text): the text's innermost node and the number of its block.
    """

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)


def attributes_of(source: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare, alone in _ATTRIBUTE.findall(source):
        found.setdefault((name or alone).lower(), html.unescape(double or single or bare))
    return found


def parse(source: str) -> Page:
    """The page's elements and texts; broken markup gives what it can, and never an error."""
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements: tag, node (the nearest node for marks and what isn't shown)
    block, links, hidden, node = 0, 0, 0, -1
    at, end = int(source.startswith("\ufeff")), len(source)

    def close(depth: int) -> None:
        nonlocal links, hidden, node
        links -= sum(open_tag == "a" for open_tag, _ in stack[depth:])
        hidden -= sum(open_tag in HIDDEN for open_tag, _ in stack[depth:])
        del stack[depth:]
        node = stack[-1][1] if stack else -1

    def innermost(tags: frozenset[str]) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in tags), -1)

    while at < end:
        token = _TOKEN.match(source, at)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            text = token[0]
            if text.startswith(("<!", "<?")) or hidden:
                continue
            if not text.isspace() or page.texts:
                page.texts.append((node, block, html.unescape(text) if "&" in text else text))
                page.linked.append(links > 0)
            continue
        tag = tag.lower()
        if token["end"]:
            depth = innermost(frozenset((tag,)))
            if depth >= 0 and not (tag in MARKS and any(open_tag in BLOCKS for open_tag, _ in stack[depth:])):
                close(depth)
            if tag in BLOCKS and not hidden:
                block += 1
            continue
        drawing = -1
        if hidden:
            drawing = innermost(frozenset(("svg",)))
            if drawing >= 0 and innermost(_PAGE_IN_DRAWING) > drawing:
                drawing = -1
            if drawing >= 0 and (tag in _NO_DRAWING or tag in BLOCKS):
                close(drawing)
                drawing = -1
            if tag in BLOCKS and tag not in _IN_SELECT and (depth := innermost(frozenset(("select",)))) >= 0:
                close(depth)
        if tag in BLOCKS:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] not in _SCOPES and (stack[depth][0] not in BLOCKS or tag in _CLOSED_BY_SIBLING.get(stack[depth][0], ())):
                if stack[depth][0] in BLOCKS:
                    close(depth)
                depth -= 1
            block += not hidden
        if tag == "br" and not hidden:
            page.texts.append((node, block, " "))
            page.linked.append(False)
        if tag in FOREIGN and token["attrs"].endswith("/"):
            continue
        if tag in RAW and drawing < 0:
            ending = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(source, at)
            at = ending.end() if ending else end
            continue
        if hidden or tag in HIDDEN:
            if tag not in VOID and not token["attrs"].endswith("/"):
                hidden += tag in HIDDEN
                links += tag == "a"
                stack.append((tag, node))
            continue
        if tag not in MARKS:
            page.tags.append(tag)
            page.parents.append(node)
            page.attributes.append(attributes_of(token["attrs"]))
            if tag in VOID or (token["attrs"].endswith("/") and tag not in BLOCKS):
                continue
            node = len(page.tags) - 1
            stack.append((tag, node))
        elif tag not in VOID:
            links += tag == "a"
            stack.append((tag, node))
    if any(node < 0 and not text.isspace() for node, _, text in page.texts):
        _add_top(page)
    return page


def _add_top(page: Page) -> None:
    """A node for text outside all others: the root of a fragment, or one beside a whole page's elements."""
    whole = "html" in page.tags or "body" in page.tags
    shift, top = (0, len(page.tags)) if whole else (1, 0)
    page.parents = [p + shift for p in page.parents]
    page.tags.insert(top, TOP)
    page.parents.insert(top, -1)
    page.attributes.insert(top, {})
    page.texts = [(node + shift if node >= 0 else top, block, text) for node, block, text in page.texts]
