"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph scores by its length and commas and passes
its points to its ancestors, less with each level; a container's points are discounted by its
link density. The best container is kept, with those siblings that score like it or read like
its paragraphs; menus, notices and the like inside are dropped by what their tags and names say, where
a name can't as well be a subject of the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed values of the HTML standard: elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption li dd dt option optgroup legend summary".split())
#: An opening tag ends an open element of the second kind, looking no further up than the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
DROPPED = set("nav footer aside form button select input label svg canvas object audio video head dialog menu search datalist map math".split()) | RAW
#: Words in a class, id or role that mark what isn't the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|adverts?|advertisements?|adbox|adslot|banners?|sponsor(?:ed|s)?|promos?|promoted|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"sidebars?|footers?|masthead|topbar|toolbar|(?:site|page|main|global|top)-?header|comments?|disqus|respond|replies|discussion|"
    r"cookies?|consent|gdpr|popups?|modals?|overlay|newsletter|subscribe|signup|login|share|sharing|"
    r"related|recommend(?:ed|ations)?|more-stories|read-?more|widgets?|pagination|pager|copyright|disclaimer|skip-?link|complementary|"
    r"contentinfo|tagcloud|author-?box|paywall|outbrain|taboola|(?:reader|user|visitor)s?-?(?:responses?|letters|feedback|reviews))(?=$|[\s_-]|\d)|"
    r"comments(?=$|[\s_-]|\d)|(?:^|[\s_-])comment(?:list|form|area|section|box)|sidebar|navbar|breadcrumb|cookie(?:bar|banner|notice|consent)|advert(?!or)|disqus|(?:^|\s)responses(?=$|\s)"
)
#: Words that also name an article's subjects: they count in names that hold nothing else but words for
#: page parts, and inside an article only for what doesn't read like a section of it.
AMBIGUOUS = set("ads side notice notices alert alerts reviews subscription social legal search form forms tag tags".split())
PARTS = set(
    "bar box banner list links link wrap wrapper container panel block area widget section buttons button icons icon menu nav slot unit top bottom left right "
    "inner outer header footer page site main col column cloud input field group row message text msg info warning error success".split()
) - {"info"}
GOOD = re.compile(r"(?:^|[\s_-])(?:articles?|article-?body|body|content|entry|hentry|main|page|posts?|post-?body|story|text|blog)(?=$|[\s_-]|\d)")
_HEADER = re.compile(r"(?:^|\s)header(?=$|\s)")
#: Names of what holds one article; a header in it is the article's own.
ARTICLE = re.compile(r"(?:^|[\s_-])(?:articles?|article-?body|content|entry|hentry|posts?|post-?body|story)(?=$|[\s_-]|\d)")
# The standard's tokens: what begins a tag, white space and stray slashes, a name, an equals sign, an unquoted value.
_TAG = re.compile(r"<(?:(?P<end>/?)(?P<tag>[a-zA-Z][^\t\n\f\r />]*)|(?P<other>[!?]|/))")
_GAP = re.compile(r"[\t\n\f\r /]*")
_NAME = re.compile(r"[^\t\n\f\r />][^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
_COMMENT_END = re.compile(r"--!?>")
#: Points reach so many levels up; further ones would get less than a two-hundredth.
LEVELS = 66
_SPACE = re.compile(r"\s+")


def _ambiguous(names: str) -> bool:
    """Whether a name consists of an ambiguous word and words for page parts only."""
    for token in names.split():
        words = re.split(r"[_-]+|(?<=[a-z])(?=[A-Z\d])", token)
        words = [w.lower() for w in words if w]
        if any(w in AMBIGUOUS for w in words) and all(w in AMBIGUOUS or w in PARTS or w.isdigit() for w in words):
            return True
    return False


def _trust_prose(root: Node, weak: list[Node]) -> None:
    """Inside an article, ambiguous names don't count for what reads like a section of it.

    That is: it has a heading and a paragraph of a sentence or more, few links and no form controls.
    One pass over the tree counts these for all elements, children before parents.
    """
    order, stack, within = [], [root], set()
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "article" or node.one or id(node) in within:
            within.update(id(c) for c in node.children if isinstance(c, Node))
        stack.extend(c for c in node.children if isinstance(c, Node))
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    heading: set[int] = set()
    prose: set[int] = set()
    controls: set[int] = set()
    for node in reversed(order):
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        inside = [c for c in node.children if isinstance(c, Node)]
        n = chars[id(node)] = own + sum(chars[id(c)] for c in inside)
        links[id(node)] = n if node.tag == "a" else sum(links[id(c)] for c in inside)
        if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and n or any(id(c) in heading for c in inside):
            heading.add(id(node))
        if node.tag == "p" and n >= 25 and links[id(node)] < 0.5 * n or any(id(c) in prose for c in inside):
            prose.add(id(node))
        if node.tag in ("form", "input", "button", "select", "textarea") or any(id(c) in controls for c in inside):
            controls.add(id(node))
    for node in weak:
        k = id(node)
        if k in within and k in heading and k in prose and k not in controls and links[k] < 0.25 * chars[k]:
            node.bad = node.named = False


class Node:
    __slots__ = ("tag", "parent", "children", "bad", "named", "weak", "good", "one", "holds", "hidden", "score", "chars", "link_chars", "own")

    def __init__(self, tag: str, parent: Node | None, names: str = "", hidden: bool = False):
        self.tag, self.parent, self.children = tag, parent, []
        strong = bool(names) and bool(BOILERPLATE.search(names) or tag != "header" and _HEADER.search(names))
        self.weak = bool(names) and not strong and tag not in DROPPED and _ambiguous(names)
        self.named = (strong or self.weak) and tag not in ("html", "body", "main", "article")
        self.bad = tag in DROPPED or self.named
        self.good = tag in ("article", "main") or bool(names and GOOD.search(names))
        #: Holds one article, by its element or name; holds: an article or main element is in it.
        self.one, self.holds = tag == "article" or bool(names and ARTICLE.search(names)), False
        self.hidden, self.score, self.chars, self.link_chars, self.own = hidden, 0.0, 0, 0, False


class _Quotes:
    """Finds the ends of quoted values in one pass: what isn't closed is only searched for once."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in ('"', "'", "]]>")}

    def end(self, quote: str, at: int) -> int:
        return self.page.find(quote, at) if at <= self.last[quote] else -1


def attributes(page: str, at: int, quotes: _Quotes) -> tuple[dict[str, str], bool, int]:
    """The attributes of the tag whose name ends at `at`, whether it closes itself, and its end.

    By the standard's attribute states; but a tag with a quote that never closes ends at its first
    `>`, where the standard gives up the rest of the page. A tag that never ends takes the rest.
    """
    given: dict[str, str] = {}
    n = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return given, False, n
        if page[at] == ">":
            return given, page[at - 1] == "/", at + 1
        m = _NAME.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        m = _EQUALS.match(page, at)
        if m:
            at = m.end()
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                end = quotes.end(quote, at + 1)
                if end < 0:
                    end = page.find(">", at)
                    return given, False, n if end < 0 else end + 1
                value, at = page[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(page, at)
                value, at = m[0], m.end()
        given.setdefault(name, value.lower())


def _after_other(page: str, at: int, quotes: _Quotes) -> tuple[str, int]:
    """The text in, and the end of, a comment, a CDATA section, a doctype or a stray end at `at`."""
    n = len(page)
    if page.startswith("<!--", at):
        if page.startswith(">", at + 4):
            return "", at + 5
        if page.startswith("->", at + 4):
            return "", at + 6
        m = _COMMENT_END.search(page, at + 4)
        return "", m.end() if m else n
    if page.startswith("<![CDATA[", at):
        end = quotes.end("]]>", at)
        if end >= 0:
            return page[at + 9 : end], end + 3
    end = page.find(">", at)
    return "", n if end < 0 else end + 1


def parse(page: str) -> Node:
    """A forgiving tree: unclosed elements end with their container, stray ends are ignored.

    Its time grows with the page's length, whatever the page is.
    """
    root = node = Node("html", None)
    at, n, quotes = 0, len(page), _Quotes(page)
    open_: dict[str, int] = {}  # open elements by tag
    headers: list[Node] = []
    weak: list[Node] = []

    def leave(to: Node) -> Node:
        up = node
        while up is not to:
            open_[up.tag] -= 1
            up = up.parent
        return to

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            node.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]))
        if m["tag"] is None:
            text, at = _after_other(page, m.start(), quotes)
            if text:
                node.children.append(text)
            continue
        tag = m["tag"].lower()
        given, closes_itself, at = attributes(page, m.end(), quotes)
        if m["end"]:
            up = node if open_.get(tag) else None
            while up is not None and up.tag != tag:
                up = None if up.tag in ("article", "table") and tag not in BLOCK else up.parent
            if up is not None and up.parent is not None:
                node = leave(up.parent)
            continue
        names = " ".join(given[k] for k in ("class", "id", "role") if given.get(k)).strip()
        style = given.get("style", "").replace(" ", "")
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if tag in ("html", "body"):
            if names and node is root:
                root.good = root.good or bool(GOOD.search(names))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in CLOSES_P and open_.get("p"):
            up = node
            while up is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up is not None and up.tag == "p":
                node = leave(up.parent)
        if tag in ENDS and any(open_.get(e) for e in ENDS[tag][0]):
            ended, stop = ENDS[tag]
            up = node
            while up is not None and up.tag not in ended and up.tag not in stop:
                up = up.parent
            if up is not None and up.tag in ended:
                node = leave(up.parent)
        child = Node(tag, node, names, hidden)
        node.children.append(child)
        if tag == "header":
            headers.append(child)
        if child.weak:
            weak.append(child)
        if tag in ("article", "main"):  # what holds the article isn't what its name says
            up = node
            while up is not None and not up.holds and up.tag not in DROPPED and not (up.named and up.parent is not None and up.parent.tag == "article"):
                up.holds = True
                if up.tag in ("article", "main"):
                    break
                up.bad, up = False, up.parent
        if tag not in VOID and not closes_itself or tag == "p":
            node = child
            open_[tag] = open_.get(tag, 0) + 1
    if weak:
        _trust_prose(root, weak)
    for h in headers:  # a header that isn't an article's is the site's
        up, level = h.parent, 0
        while up is not None and not up.one and level < LEVELS:
            if up.tag == "main":
                break
            up, level = up.parent, level + 1
        own = up is not None and (up.one or up.tag == "main") and (up.tag == "article" or not up.holds)
        h.bad = h.bad or not own
    return root


def _kept(child: Node) -> bool:
    return not (child.bad or child.hidden)


def _measure(top: Node) -> list[Node]:
    """Text and link lengths of all kept nodes (children before parents), without recursion."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and _kept(c))
    order.reverse()
    for node in order:
        own = "".join(c for c in node.children if isinstance(c, str))
        size = len(_SPACE.sub(" ", own).strip())
        node.own = size > 0
        node.chars += size
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None and node is not top:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    return order


def _text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or _kept(x):
            if x.tag == "br":
                out.append(" ")
            stack.extend(reversed(x.children))
    return "".join(out)


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def score_tree(top: Node) -> Node:
    """The best container: paragraphs pass points to ancestors, links discount them."""
    order = _measure(top)
    scored = []
    for node in order:
        inline = all(isinstance(c, str) or c.tag not in BLOCK for c in node.children)
        if node.tag not in BLOCK or node is top or not inline or node.chars < 25:
            continue
        text = _text(node)
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(node.chars // 100, 3)
        if node.tag in ("li", "td", "dd", "dt"):
            points *= 0.5
        points *= 1 - _density(node)
        up, level = node.parent, 0
        while up is not None:
            if not up.score:
                scored.append(up)
                up.score = 8.0 if up.good else 0.0
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if up is top or level == LEVELS:
                break
            up, level = up.parent, level + 1
    best, most = top, -1.0
    for node in scored:
        s = node.score * (1 - _density(node))
        if s > most:
            best, most = node, s
    # up to the article that holds it
    up = best
    while up is not top and up.parent is not None:
        up = up.parent
        if up.tag in ("article", "main") and up is not top:
            best = up
    return best


def kept_nodes(best: Node, top: Node) -> list:
    """The best container and those of its siblings that belong to the article."""
    if best is top or best.parent is None:
        return [best]
    out, limit = [], max(10.0, 0.2 * best.score * (1 - _density(best)))
    for s in best.parent.children:
        if s is best:
            out.append(s)
        elif isinstance(s, str):
            continue
        elif _kept(s) and s.tag == "header":
            if _density(s) < 0.5:  # an article's own, with its heading
                out.append(s)
        elif _kept(s):
            score = s.score * (1 - _density(s))
            near = s.tag == "p" and (s.chars > 80 and _density(s) < 0.25 or s.chars and not s.link_chars and _text(s).rstrip().endswith((".", "!", "?")))
            title = s.tag in ("h1", "h2") and _density(s) == 0 and best.tag not in ("article", "main")
            if score >= limit or near or title:
                out.append(s)
    return out


def blocks(nodes: list) -> list[str]:
    """The texts of all blocks under the nodes in page order, white space collapsed, none empty."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    end = object()
    top = set(map(id, nodes))
    while stack:
        x = stack.pop()
        if x is end:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif id(x) in top or _kept(x):
            if x.tag in BLOCK:
                flush()
                stack.append(end)
            elif x.tag == "br":
                now.append(" ")
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    top = parse(page)
    found = blocks(kept_nodes(score_tree(top), top))
    if not found:  # everything lies in containers whose names mislead: go by elements alone
        stack = [top]
        while stack:
            node = stack.pop()
            node.bad, node.chars, node.link_chars, node.score = node.tag in DROPPED, 0, 0, 0.0
            stack.extend(c for c in node.children if isinstance(c, Node))
        found = blocks(kept_nodes(score_tree(top), top))
    return "\n".join(found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text, '' if there is none) and n_chars of every page.

    A null or empty page gives ''; null ids and urls are kept; repeated rows stay repeated;
    other columns are ignored; each page is handled by itself, so nothing is shuffled.
    """

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_batches(columns, each, "page_id long, url string, text string, n_chars long")
