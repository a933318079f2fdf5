"""HTML extraction: paragraphs give points to their ancestors, the best container is kept."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.llm.columns import others, small_batches, text_of

# The roles of tags
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title "
                "audio video select noframes noembed".split())
DROPPED = frozenset("nav header footer aside form menu dialog button head label fieldset option".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 "
                   "h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead "
                   "tr ul".split()) | DROPPED
PARAGRAPHS = frozenset("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd dt".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot button label option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td".split())
# A tag that begins closes an open one of the same kind: (kind, tags where the search ends)
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
# Names of classes, ids and roles of what is no article
UNLIKELY = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|banner|breadcrumbs?|consent|cookies?|"
    r"footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|outbrain|"
    r"pager|pagination|popup|promo\w*|related|share|sharing|sidebar|signup|skip|"
    r"social|sponsor\w*|subscribe|taboola|toolbar|widget|alert|alertdialog|dialog|complementary|contentinfo|"
    r"search)(?:$|[_-])"
    r"|^(?:(?:site|top|global)[_-])?header$", re.I)
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|replies|reply|respond)(?:$|[_-])", re.I)
COMMENT = re.compile(r"^(?:comments?|comment[_-](?:body|content|text)|reply|replies)$", re.I)
# Names that tell how a box is laid out or set, not what is in it
LAYOUT = re.compile(r"^(?:has|no|not|with|without|is|hide|show)[_-]"
                    r"|[_-](?:container|wrapper|wrap|layout|inner|open|closed|enabled|disabled|active)$", re.I)
# What tells the items of a discussion: when, by whom, and what one may do
AUTHORED = re.compile(r"(?:^|[\s_-])(?:author|avatar|byline|nick(?:name)?|poster|user(?:name)?)(?:$|[\s_-])", re.I)
DATED = re.compile(r"(?:^|[\s_-])(?:ago|date|posted|time|timestamp)(?:$|[\s_-])", re.I)
DATES = re.compile(r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}|\d+ \w+ ago|ago|il y a|vor|hace)\b", re.I)
ANSWERS = re.compile(r"^\W*(?:reply|respond|report|quote|upvote|like|répondre|signaler|antworten|melden|responder)\W*$", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(
    r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOTED = ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop")
BLANK = re.compile(r"\s+")
CLOSED = re.compile(r"(?:^|[\s\"'])/$")  # but not as the end of a bare value

MIN_LENGTH = 25       # characters of a paragraph that gives points
SIBLING_SHARE = 0.2   # of the best score, and the least score of a sibling that is kept
SIBLING_LENGTH = 80
WHOLE_SHARE = 0.9     # of the page's points that the article has at least
LINKED_SHARE = 0.4    # of a box's text in links; beyond it is a list of links
MARK_LENGTH = 60      # characters of a text that says who, when or what to do


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None = None
    names: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)  # nodes and texts
    score: float = 0.0


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        if name.lower() in NOTED:
            found[name.lower()] = html.unescape(a or b or c)
    return found


def parse(page: str) -> Node:
    """The tree of a page. Ends that are missing are set where the next tag or the page needs them."""
    root = node = Node("html")
    at, end = 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            node.children.append(html.unescape(page[at:stop]))
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag == "p" and not _open(node, frozenset(["p"]), frozenset()):
                continue
            to = _open(node, frozenset([tag]), frozenset(["td", "th", "table"]) if tag == "p" else frozenset())
            if to is not None and to.parent is not None:
                node = to.parent
            continue
        if tag == "html":
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES_P:
            to = _open(node, frozenset(["p"]), frozenset(["td", "th", "table", "button"]))
            node = to.parent if to is not None else node
            if tag in BLOCKS and node.tag not in BLOCKS:  # inline tags left open end with their block
                node = _block(node)
        if tag in CLOSED_BY:
            kinds, ends = CLOSED_BY[tag]
            to = _open(node, kinds, ends)
            node = to.parent if to is not None else node
        extra = _attributes(token[3]) if token[3].strip(" /\t\n") else {}
        child = Node(tag, node, " ".join(filter(None, (extra.get("class"), extra.get("id"), extra.get("role")))),
                     "hidden" in extra or extra.get("aria-hidden") == "true"
                     or "display:none" in extra.get("style", "").replace(" ", "").lower())
        node.children.append(child)
        if tag not in VOID and not CLOSED.search(token[3]):
            node = child
    return root


def _open(node: Node | None, tags: frozenset, ends: frozenset) -> Node | None:
    """The nearest open node with one of ``tags``, below the first of ``ends``."""
    while node is not None and node.tag not in tags:
        if node.tag in ends:
            return None
        node = node.parent
    return node


def _block(node: Node) -> Node:
    """The nearest open block, when inline tags were left open inside it."""
    while node.parent is not None and node.tag not in BLOCKS:
        node = node.parent
    return node


WRAPPERS = frozenset(["form", "fieldset"])  # tags that may hold a whole page


def prune(root: Node) -> None:
    """Take out what is never part of an article: menus, notices, adverts, forms, comments.

    Names of layout boxes often hold such words, and some pages are one form: a box that holds the
    article, or most of the page's text, stays.
    """
    _drop(root, lambda c: c.hidden or _comments(c) or c.tag in DROPPED and c.tag not in WRAPPERS and not (
        c.tag == "header" and _within_article(c)))
    named = _drop(root, lambda c: c.tag in WRAPPERS or _unlikely(c), False)
    if named:
        holders = _holders(root)
        _drop(root, lambda c: c in named and c not in holders)
    threads = _threads(root)
    if threads:
        _drop(root, lambda c: c in threads)


def _drop(root: Node, unlikely: Callable[[Node], bool], out: bool = True) -> set[Node]:
    """The nodes that ``unlikely`` names; with ``out`` they are taken out with all they hold."""
    found: set[Node] = set()
    stack = [root]
    while stack:
        here = stack.pop()
        gone = {c for c in here.children if isinstance(c, Node) and unlikely(c)}
        found |= gone
        if out and gone:
            here.children = [c for c in here.children if c not in gone]
        stack += [c for c in here.children if isinstance(c, Node)]
    return found


def _roles(node: Node) -> list[str]:
    return [name for name in node.names.split() if not LAYOUT.search(name)]


def _comments(node: Node) -> bool:
    """Comments, but no box that holds an article of another name; an article only if it is one."""
    if not node.names or node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return any(COMMENT.search(name) for name in _roles(node))
    if not any(COMMENTS.search(name) for name in _roles(node)):
        return False
    stack = [node]
    while stack:
        here = stack.pop()
        if here.tag == "main" or here.tag == "article" and not any(COMMENT.search(n) for n in here.names.split()):
            return False
        stack += [c for c in here.children if isinstance(c, Node)]
    return True


def _threads(root: Node) -> set[Node]:
    """Discussions, told by their structure: items alike that each say who wrote, when, or how to answer.

    They are none if nothing of the page is left without them, as on a page that is one.
    """
    boxes = defaultdict(list)
    order = [n for n in lengths(root)]
    for node in order:
        if node.parent is not None and node.tag in ("div", "li", "article", "section", "tr", "dd", "blockquote"):
            boxes[node.parent, node.tag, node.names.split()[0] if node.names else ""].append(node)
    found: set[Node] = set()
    for items in boxes.values():
        if len(items) >= 2 and sum(_is_post(i) for i in items) * 4 >= 3 * len(items):
            found |= set(items)
    points = _subtree_points(root)
    told = sum(points[n] for n in found if not any(a in found for a in _ancestors(n.parent)))
    left = points[root] - told
    return found if found and left >= 1 else set()


def _is_post(node: Node) -> bool:
    """Whether a box has text, and two marks of a post: its writer, its date, a way to answer."""
    writer = date = answer = prose = False
    stack = [node]
    while stack:
        here = stack.pop()
        texts = [c.strip() for c in here.children if isinstance(c, str) and c.strip()]
        short = sum(map(len, texts)) <= MARK_LENGTH
        if here is not node and short:
            writer = writer or bool(AUTHORED.search(here.names))
            date = date or here.tag == "time" or bool(DATED.search(here.names))
        if short:
            date = date or any(DATES.search(t) for t in texts)
            answer = answer or here.tag in ("a", "span", "button", "div") and any(ANSWERS.match(t) for t in texts)
        prose = prose or not short
        stack += [c for c in here.children if isinstance(c, Node)]
    return writer + date + answer >= 2 and not any(
        isinstance(c, Node) and c.tag in ("h1", "h2") for c in node.children)


def _unlikely(node: Node) -> bool:
    if not node.names or node.tag in ("html", "body", "article", "main") or LIKELY.search(node.names):
        return False
    roles = [name for name in _roles(node) if UNLIKELY.search(name)]
    if all(name.lower() == "header" for name in roles):
        return bool(roles) and node.tag not in HEADINGS and not _within_article(node)
    return True


def _holders(root: Node) -> set[Node]:
    """The nodes that hold the page's article, or more than half of the points of its paragraphs.

    The article or main with most points is the article, if it has a quarter of all.
    """
    points = _subtree_points(root)
    articles = [n for n in points if n.tag in ("article", "main")]
    best = max(articles, key=points.get, default=None)
    if best is not None and points[best] > 0 and points[best] * 4 >= points[root]:
        return set(_ancestors(best))
    return {n for n in points if points[n] * 2 > points[root]}


def _subtree_points(root: Node) -> dict[Node, float]:
    """The points of all paragraphs within each node, children first."""
    sizes = lengths(root)
    points = dict.fromkeys(sizes, 0.0)
    for node, (total, linked, commas) in sizes.items():
        if node.tag in PARAGRAPHS and total - linked >= MIN_LENGTH:
            points[node] = max(points[node], _points(total, linked, commas))
        if node.parent is not None and node is not root:
            points[node.parent] += points[node]
    return points


def _within_article(node: Node) -> bool:
    """A header inside an article that holds its heading is part of it."""
    to = _open(node.parent, frozenset(["article", "main"]), frozenset())
    return to is not None and any(
        isinstance(c, Node) and c.tag in ("h1", "h2", "h3") for c in node.children)


def lengths(node: Node) -> dict[Node, tuple[int, int, int]]:
    """(characters, those within links, commas) of every node's text, children first."""
    out: dict[Node, tuple[int, int, int]] = {}
    order, stack = [], [node]
    while stack:
        here = stack.pop()
        order.append(here)
        stack += [c for c in here.children if isinstance(c, Node)]
    for here in reversed(order):
        total = linked = commas = 0
        for c in here.children:
            if isinstance(c, str):
                text = c.strip()
                total += len(text)
                commas += text.count(",")
            else:
                t, k, m = out[c]
                total, linked, commas = total + t, linked + k, commas + m
        out[here] = (total, total if here.tag == "a" else linked, commas)
    return out


def _points(total: int, linked: int, commas: int) -> float:
    return (1 + commas + min(total // 100, 3)) * (1 - linked / total)


def score(root: Node, sizes: dict[Node, tuple[int, int, int]]) -> list[Node]:
    """Nodes that got points, with ``score`` discounted by link density.

    A paragraph has a point, one for each comma and one for each 100 characters, three at
    most for these; its parent gets all of them, its grandparent half, the ancestors above
    a third by their distance.
    """
    got: list[Node] = []
    for node, (total, linked, commas) in sizes.items():
        if node.tag not in PARAGRAPHS or total - linked < MIN_LENGTH:
            continue
        points = _points(total, linked, commas)
        above, distance = node.parent, 0
        while above is not None and distance < 5:
            if not above.score:
                got.append(above)
                above.score = 1e-9 + (5.0 if above.tag in ("article", "main") else 0.0) \
                    + (2.0 if LIKELY.search(above.names) else 0.0)
            above.score += points / (1, 2, 6, 9, 12)[distance]
            above, distance = above.parent, distance + 1
    for node in got:
        total, linked, _ = sizes[node]
        node.score *= 1 - linked / max(1, total)
    return got


def main_nodes(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order.

    Where the best has less than ``WHOLE_SHARE`` of the page's points, its article lies in several boxes: the
    lowest box around it that has as much is taken, less its lists of links and boxes without a point. A title in a
    box of its own comes along.
    """
    sizes = lengths(root)
    scored = score(root, sizes)
    if not scored:
        found = [n for n in sizes if n.tag in ("article", "main")]
        return [max(found, key=lambda n: sizes[n][0])] if found else [root]
    best = max(scored, key=lambda n: n.score)
    inside = [n for n in _ancestors(best) if n.tag in ("article", "main")]
    best = inside[-1] if inside else best  # an article is one container, also with sections in it
    if best.parent is None:
        return [best]
    points = _subtree_points(root)
    whole = best
    if not inside:
        whole = next(n for n in _ancestors(best) if points[n] >= WHOLE_SHARE * points[root])
    if whole is not best:
        kept = _sound_parts(whole, best, points, sizes)
    else:
        least = max(10.0, SIBLING_SHARE * best.score)
        kept = [c for c in best.parent.children if isinstance(c, Node) and (
            c is best or c.score >= least or c.tag == best.tag == "article"
            or c.tag in ("p", "h1") and sizes[c][0] - sizes[c][1] >= (1 if c.tag == "h1" else SIBLING_LENGTH)
            and sizes[c][1] <= sizes[c][0] // 4)]
    return _with_title(kept, whole, sizes)


def _sound_parts(whole: Node, best: Node, points: dict, sizes: dict) -> list[Node]:
    """The children of a box that hold text of the article; boxes around the best are looked into."""
    around, kept, stack = set(_ancestors(best.parent)), [], [whole]
    while stack:
        node = stack.pop()
        if node is whole or node in around:
            stack += reversed([c for c in node.children if isinstance(c, Node)])
            continue
        total, linked, _ = sizes[node]
        if node is best or total and linked <= LINKED_SHARE * total and (points[node] > 0 or node.tag in PARAGRAPHS):
            kept.append(node)
    return kept


def _with_title(kept: list[Node], whole: Node, sizes: dict) -> list[Node]:
    """``kept``, led by the page's title where that stands in a box beside or above it."""
    chosen, order = set(kept), _page_order(whole)
    if any(n.tag == "h1" and any(a in chosen for a in _ancestors(n)) for n in order):
        return kept
    first = next((i for i, n in enumerate(order) if n in chosen), 0)
    titles = [n for n in order[:first] if n.tag == "h1" and sizes[n][0] and sizes[n][1] * 2 < sizes[n][0]]
    return titles[-1:] + kept


def _page_order(node: Node) -> list[Node]:
    """All nodes of the page that ``node`` is in, parents first."""
    *_, root = _ancestors(node)
    out, stack = [], [root]
    while stack:
        here = stack.pop()
        out.append(here)
        stack += reversed([c for c in here.children if isinstance(c, Node)])
    return out


def _ancestors(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def block_texts(nodes: list[Node]) -> list[str]:
    """The texts of the blocks in page order; white space within one is one space."""
    blocks: list[str] = []
    open_text: list[str] = []

    def close() -> None:
        text = BLANK.sub(" ", "".join(open_text)).strip()
        if text:
            blocks.append(text)
        open_text.clear()

    stack: list = list(reversed(nodes))
    while stack:
        here = stack.pop()
        if here is None:
            close()
        elif isinstance(here, str):
            open_text.append(here)
        elif here.tag == "br":
            open_text.append(" ")
        elif here.tag in BLOCKS:
            close()
            stack.append(None)
            stack += reversed(here.children)
        else:
            stack += reversed(here.children)
    close()
    return blocks


def main_text(page: str) -> str:
    """The article of one page, a block a line."""
    if "<" not in page:
        return BLANK.sub(" ", html.unescape(page)).strip()
    root = parse(page)
    prune(root)
    return "\n".join(block_texts(main_nodes(root)))


def extract(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with ``text``, the main text of ``html``, and ``n_chars``, its length.

    A page's tree is built with the usual repairs of missing ends. Menus, headers, footers,
    sidebars, notices, adverts, forms and comments go by tag, class, id and role, but no box
    that holds the article goes by its name. The
    paragraphs that are left give points for length and commas to their ancestors; a
    container's points are discounted by its share of linked text. The best container is
    kept, and siblings that score well or are plain paragraphs beside it.

    Null or empty page, or one without text: ``""`` and 0. Text without any tag: the text.
    Broken tags, references and unclosed comments end where the page does. Repeated rows:
    the same text. Empty table: empty. Other columns stay; input columns ``text`` and
    ``n_chars`` are replaced. One page is handled at a time, by loops, not recursion, so
    depth is no limit. One pass without a shuffle.
    """
    small_batches(df.sparkSession)
    rest = df.select(*others(df, "text", "n_chars"))
    names = rest.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch["_page"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", text string"
    return rest.withColumn("_page", text_of("html")).mapInArrow(each, schema).withColumn(
        "n_chars", F.char_length("text").cast("long"))
