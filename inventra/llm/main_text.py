"""HTML extraction by tree scoring.

A page is read in one pass into a tree of its block elements.  Each paragraph
passes points for its length and its commas to the elements above it, all of
them to its parent and a half, a third and so on further up.  A container is
worth its points less its link density; the best one is kept, whole where it
lies in an article, with those of its siblings that are prose as well.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are known by element, role, id or class.  They are marked, not cut, while the
page is read: marked parts pass no points outside, and are left out of the text
at the end.  A mark gives way where it can't be meant for what it holds: a form
or menu around the article, a page of which nothing else would be left.  Class
names count as wholes: each word of a name must be one of those below, so
``article-header`` and ``social policy`` are prose as anything else.

Time is linear in the page, whatever stands in it.

Defined results: a null, empty or textless page has the text "", an empty table
no rows.  Unclosed, crossed, unknown and cut off tags never fail; a tag or
comment that the page's end cuts off is dropped.  Repeated rows are extracted
each.  Other columns stay as they are; one that has the name of the result gives
way to it.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they are.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object canvas audio video annotation annotation-xml".split())
TO_THE_END = frozenset("script style textarea title".split())
CONTROL = frozenset("button select label".split())
CUT = frozenset("nav footer aside form fieldset menu dialog header".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption header footer nav aside form address details summary fieldset menu center hgroup dialog".split())
SPACE = frozenset("br td th img option".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre tr dt dd blockquote figcaption caption summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = frozenset("ul ol dl table blockquote pre figure details".split())
KEEP = frozenset("article main body html".split())
CLOSES = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"})}
# Words of class names and ids, and roles.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
HARD = COMMENTS | frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsors sponsored sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr skiplink".split())
SOFT = frozenset("promo promos promotion promoted notice notices popup popups modal overlay newsletter subscribe subscription signup login share sharing sharethis addthis related recommended recommendations widget widgets masthead".split())
WEAK = frozenset("header footer banner legal social search copyright toolbar tools top bottom".split())
NEUTRAL = frozenset("site page global left right primary secondary box bar area container wrapper wrap section list block inner outer links link buttons button form thread items item group content text js".split())
OWN = frozenset("article post entry story blog user reader main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]*+)(\s*+=\s*+)?")
_BARE = re.compile(r"[^\s>]*+")
_HINTS = frozenset("class id role hidden style aria-hidden href".split())
_END_COMMENT = re.compile(r"--!?>")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("articles", "children", "comment", "cut", "inside", "length", "links", "mark", "parent", "points", "tag", "total")

    def __init__(self, tag: str, parent: Node | None, mark: str, comment: bool):
        self.tag, self.parent, self.children = tag, parent, []
        self.mark, self.comment, self.cut = mark, comment, False
        self.inside = bool(parent and (parent.inside or parent.tag in ("article", "main")))
        self.points = self.total = 0.0
        self.length = self.links = self.articles = 0


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[int, dict[str, str]]:
    """Where the tag ends whose attributes begin at ``at`` (behind its >, or -1
    where the page ends first), and what its attributes of interest say.
    ``last`` has where each kind of quote stands last in the page."""
    size, found = len(page), {}
    while at < size:
        if page[at] == ">":
            return at + 1, found
        m = _ATTRIBUTE.match(page, at)
        at = m.end() if m.end() > at else at + 1
        value = ""
        if m[2] and at < size:
            quote = page[at]
            if quote in "\"'" and last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if m[1].lower() in _HINTS:
            found.setdefault(m[1].lower(), value)
    return -1, found


def _mark(tag: str, attributes: dict[str, str]) -> tuple[str, bool]:
    """Why an element may be none of the article's: "hidden", "tag", "hard",
    "soft" or "weak" (by its names), "" for no reason; and whether it is for
    readers' comments."""
    mark = "tag" if tag in CUT else ""
    if not attributes or tag in KEEP:
        return mark, False
    style = attributes.get("style", "").lower().replace(" ", "")
    if attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return "hidden", False
    hard, comment = attributes.get("role", "").strip().lower() in ROLES, False
    soft = weak = other = False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = _WORD.findall(token)
        known = all(w in HARD or w in SOFT or w in WEAK or w in NEUTRAL or w in OWN for w in words)
        if known and any(w in HARD for w in words):
            hard = True
            comment |= any(w in COMMENTS for w in words)
        elif known and any(w in SOFT for w in words):
            soft = True
        elif any(w in WEAK for w in words) and all(w in WEAK or w in NEUTRAL for w in words):
            weak = True
        else:
            other |= not all(w in NEUTRAL for w in words)
    return mark or ("hard" if hard else "soft" if soft else "weak" if weak and not other else ""), comment


def parsed(page: str) -> Node:
    """The tree of block elements; a text is (text, its length inside links)."""
    root = node = Node("html", None, "", False)
    said: list[str] = []
    linked = 0
    link: Node | None = None  # The element in which the open link began.
    skip, depth = "", 0  # An inline element that is left out, and how deep in its kind.
    held: Counter[str] = Counter()  # Open elements by tag.
    last = {quote: page.rfind(quote) for quote in "\"'"}
    unended: set[str] = set()
    pos, size = 0, len(page)

    def flush():
        nonlocal linked
        if said:
            text = " ".join(html.unescape("".join(said)).split())
            if text:
                node.children.append((text, min(linked, len(text))))
            said.clear()
        linked = 0

    def leave():
        nonlocal node, link
        flush()
        held[node.tag] -= 1
        if link is node:
            link = None
        node = node.parent

    while pos < size:
        at = page.find("<", pos)
        chunk = page[pos:] if at < 0 else page[pos:at]
        if chunk and not skip:
            said.append(chunk)
            if link:
                linked += len(html.unescape(chunk).strip())
        if at < 0:
            break
        after, third = page[at + 1 : at + 2], page[at + 2 : at + 3]
        closing = after == "/"
        if after in ("!", "?") or (closing and not (third.isascii() and third.isalpha())):
            if page.startswith("<!--", at) and not page.startswith((">", "->"), at + 4):
                m = _END_COMMENT.search(page, at + 4)
                pos = m.end() if m else 0
            else:
                pos = page.find(">", at) + 1
            if not pos:
                break
            continue
        if not (closing or (after.isascii() and after.isalpha())):
            if not skip:
                said.append("<")
            pos = at + 1
            continue
        name = _NAME.match(page, at)
        tag = name[1].lower()
        pos, attributes = _attributes(page, name.end(), last)
        if pos < 0:
            break
        inline = not closing and tag not in BLOCK and tag not in VOID
        if tag in RAW or tag in CONTROL or (tag == "a" and inline and _mark(tag, attributes)[0] in ("hidden", "hard", "soft")):
            # Left out up to its end; a control that begins anew before it ends has none.
            if not closing and tag not in unended:
                m = re.compile(rf"</{tag}(?=[\s/>])" if tag in RAW else rf"</?{tag}(?=[\s/>])", re.I).search(page, pos)
                if m and m[0].startswith("</"):
                    pos = page.find(">", m.end()) + 1 or size
                elif not m:
                    unended.add(tag)
                    pos = size if tag in TO_THE_END else pos
            continue
        if skip and tag == skip and tag not in VOID:
            depth += -1 if closing else 1
            skip = skip if depth else ""
            continue
        block = tag in BLOCK
        if block:
            skip = ""
        elif skip:
            continue
        if closing:
            if tag == "a":
                link = None
            elif block and held[tag] and (tag != "p" or node.tag == "p"):
                while node.tag != tag:
                    leave()
                leave()
            continue
        if tag in SPACE:
            said.append(" ")
        elif block or tag == "hr":
            if node.tag == "p":
                leave()
            if node.tag in CLOSES.get(tag, ()):
                leave()
            flush()
            if block:
                mark, comment = _mark(tag, attributes)
                child = Node(tag, node, mark, comment)
                node.children.append(child)
                node = child
                held[tag] += 1
        elif inline:
            if tag == "a":
                link = node if "href" in attributes else None
            elif _mark(tag, attributes)[0] in ("hidden", "hard", "soft"):
                skip, depth = tag, 1
    while node is not root:
        leave()
    flush()
    return root


def _order(root: Node) -> list[Node]:
    """Every element before what it holds, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def density(n: Node) -> float:
    return n.links / n.length if n.length else 0.0


def _measure(order: list[Node]) -> None:
    """Points, lengths, links and articles of each subtree, marks unregarded."""
    for n in reversed(order):
        n.total, n.length, n.links, n.articles = 0.0, 0, 0, 0
        for c in n.children:
            if isinstance(c, Node):
                n.total += c.total
                n.length += c.length
                n.links += c.links
                n.articles += c.articles + (c.tag in ("article", "main") and c.length > 0)
            else:
                n.total += _points(c[0])
                n.length += len(c[0])
                n.links += c[1]


def _points(text: str) -> float:
    return 1 + text.count(",") + text.count("،") + text.count("，") + min(len(text) / 100, 3)


def _cut(n: Node, root: Node, level: int) -> bool:
    """Whether a mark holds: level 0 heeds all, 1 no weak ones, 2 no soft ones."""
    if n.mark == "hidden":
        return True
    if n.mark == "tag":
        most = n.tag in ("form", "header", "dialog") and 2 * n.total > root.total and density(n) < 0.3
        return not (n.articles or most or (n.tag == "header" and n.inside))
    if n.mark == "weak":
        return level < 1 and (not n.inside or density(n) > 0.5)
    around = n.articles and not n.comment and 2 * n.total > root.total
    return n.mark != "" and not around and (n.mark == "hard" or level < 2)


def _score(order: list[Node]) -> None:
    """Passes each paragraph's points up, not out of what is cut."""
    for n in order:
        n.points = 0.0
    for n in order:
        for c in n.children:
            if isinstance(c, Node):
                continue
            points = _points(c[0])
            holder = n.parent if n.tag in LEAF and n.parent and not n.cut else n
            for share in (1, 2, 3, 4, 5):
                holder.points += points / share
                if holder.cut or holder.parent is None:
                    break
                holder = holder.parent


def _worth(n: Node) -> float:
    return n.points * (1 - density(n))


def _texts(node: Node, out: list[str]) -> None:
    stack: list = [node]
    while stack:
        n = stack.pop()
        if not isinstance(n, Node):
            out.append(n[0])
        elif not n.cut or n is node:
            stack += reversed(n.children)


def _chosen(order: list[Node]) -> list[Node]:
    """The best container and its siblings that are kept, in page order."""
    best, gone = None, set()
    for n in order:
        if n.cut or id(n.parent) in gone:
            gone.add(id(n))
        elif n.points and (best is None or _worth(n) > _worth(best)):
            best = n
    if best is None:
        return []
    above = []
    n = best
    while n is not None:
        above.append(n)
        n = n.parent
    for kind in ("article", "main"):
        whole = [n for n in above if n.tag == kind]
        if whole:
            best = whole[-1]
            break
    if best.parent is None:
        return [best]
    around = [c for c in best.parent.children if isinstance(c, Node) and not c.cut]
    floor = max(10.0, _worth(best) / 5)
    if best.tag in ("article", "main"):
        return [c for c in around if c is best or (c.tag == best.tag and _worth(c) >= floor)]
    prose = lambda c: density(c) < 0.25 and ((c.tag == "p" and c.length > 40) or (c.tag not in LEAF and _worth(c) >= floor))
    sure = [i for i, c in enumerate(around) if c is best or prose(c)]
    out = []
    for i, c in enumerate(around):
        between = sure[0] <= i <= sure[-1]
        if i in sure or (between and (c.tag in LEAF or c.tag in FLOW) and density(c) < 0.5) or (c.tag in HEADING and i < sure[-1] and density(c) < 0.5):
            out.append(c)
    return out


def main_text(page: str | None) -> str:
    """The main text: blocks in page order with an empty line between."""
    if not page:
        return ""
    root = parsed(page)
    order = _order(root)
    _measure(order)
    for level in range(3):
        for n in order:
            n.cut = _cut(n, root, level)
        _score(order)
        out: list[str] = []
        for n in _chosen(order):
            _texts(n, out)
        if out:
            return "\n\n".join(out)
    return ""


def main_texts(df: DataFrame, page_html: str = "html", out: str = "text"):
    """``df`` with the main text of ``page_html`` as the column ``out``."""
    from collections.abc import Iterator

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p) for p in batch.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(page_html)))
