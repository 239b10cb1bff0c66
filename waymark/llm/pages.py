"""Operator 3: main text of web pages by tree scoring.

Boilerplate elements go first, save those that hold most of the page's text.  Each paragraph then gives points for its length and commas to its ancestors,
fewer with each level; an element's score is discounted by the share of its text that stands in links.  The
best element and those of its siblings that score well make up the article.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, table, texts

#: HTML element names and the words of class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav footer aside form button select option datalist dialog menu svg canvas object audio video map".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist cookie cookies consent disqus footer form header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion related reply replies respond search share sharing shares sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar toc warning widget widgets".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that only say what part of a page a name means: a name of these and of words of boilerplate leaves no doubt.
STRUCTURE = frozenset("area article articles bar block body bottom box button buttons cell col column container content count counter entry feed field group head heading holder icon icons inner item items left line link links list main message module outer page panel post posts region right row section site slot story text thread title top unit wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
KEPT_ALWAYS = frozenset(("html", "body", "article", "main"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Words that turn a following word of a class or id into a statement about the page: no-sidebar, has-header.
LAYOUT = frozenset("no has with without hide hides".split())
#: A subtree marked by class, id, role or as a form stays if it holds more than this share of the page's points.
MOST = 0.5
#: Comments go, however many, if the rest of the page has so many points.
OTHER_POINTS = 1.0
#: A name that holds a word of boilerplate among others goes only with this share of text in links, or without a paragraph of
#: so many characters.
DOUBTFUL_LINKS, PARAGRAPH = 0.33, 80

#: Points that an element has by its name: they decide between blocks of a few words each.
TAG_POINTS = {"article": 25.0, "main": 25.0}
#: Points are divided by 1, 2, 4, 6, ...; from this divisor on they are nothing.
LEVELS = 16

#: What begins a tag, comment or declaration, and the rest of a tag with its quoted values.
START = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
REST = re.compile(r"((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: Tags whose quotes don't close that are read so before quotes are ignored in the rest of a page: each costs a look at all of it.
OPEN_QUOTES = 8
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
WORD = re.compile(r"[a-z]+")
#: What a sentence ends with.
ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？", '"', "”", "»", "’", ")")


#: How sure a name is that an element is boilerplate.
NO, MAYBE, SURELY = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "children", "score", "scored", "size", "marked", "comments")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.score, self.scored, self.marked, self.comments = 0.0, False, NO, False
        self.size = (0, 0, 0)  # characters, characters in links, commas


def names_boilerplate(value: str) -> int:
    """Whether a name of a class or id has a word of boilerplate that no word of LAYOUT stands before: SURELY if its other
    words are such or of STRUCTURE, else MAYBE (share-of-voice)."""
    found = NO
    for name in value.split():
        words = WORD.findall(name)
        if any(w in BOILERPLATE and LAYOUT.isdisjoint(words[:i]) for i, w in enumerate(words)):
            found = max(found, SURELY if all(w in BOILERPLATE or w in STRUCTURE for w in words) else MAYBE)
    return found


def judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, bool]:
    """Whether an element and all it holds is left out by its name or as hidden; how sure its form, role, class or id makes
    it boilerplate; and whether those name comments."""
    if tag in DROPPED and tag != "form" or tag == "header" and not in_article:
        return True, SURELY, False
    mark, comments = SURELY if tag == "form" else NO, False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            if tag not in KEPT_ALWAYS:
                return True, SURELY, False
        if name == "role" and value in ROLES:
            mark = SURELY
        if name in ("class", "id"):
            sure = names_boilerplate(value)
            mark = max(mark, sure)
            comments |= sure == SURELY and not COMMENTS.isdisjoint(WORD.findall(value))
    return False, NO if tag in KEPT_ALWAYS else mark, comments


def tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, tag, attributes) of each tag in turn, and at last (text, "", "", ""); comments, declarations and
    what elements of raw text hold are left out.

    Every character is looked at a bounded number of times: what follows the last ">" holds no tag.
    """
    at = here = 0
    last, open_quotes = html.rfind(">") + 1, 0
    parts: list[str] = []
    while m := START.search(html, here):
        slash, tag = m.group(1), m.group(2)
        if m.group() == "<!--":
            parts.append(html[at : m.start()])
            end = html.find("-->", m.end())
            at = here = len(html) if end < 0 else end + 3
            continue
        if m.start() >= last:
            break
        if tag is None:
            parts.append(html[at : m.start()])
            at = here = html.index(">", m.end()) + 1
            continue
        rest = REST.match(html, m.end()) if open_quotes < OPEN_QUOTES else None
        if rest is None:
            open_quotes += 1
            end = html.find(">", m.end())
            if end < 0:
                break
            attributes, here = html[m.end() : end], end + 1
        else:
            attributes, here = rest.group(1), rest.end()
        before, tag = "".join([*parts, html[at : m.start()]]), tag.lower()
        parts.clear()
        at = here
        if tag in RAW and not slash:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, here)
            at = here = close.end() if close else len(html)
            parts.append(before)
            continue
        yield before, slash, tag, attributes
    yield "".join([*parts, html[at:]]), "", "", ""


def parse(html: str) -> Node:
    """Tree of elements and texts, without boilerplate.  Missing end tags are implied; any text parses."""
    root = Node("#root", None)
    stack = [root]
    skip = 0  # height of the stack at which left-out content began
    at: defaultdict[str, list[int]] = defaultdict(list)  # places on the stack by name
    walls: list[int] = []  # of cells, articles and main elements, which an inline end tag doesn't leave
    others: list[int] = []  # of blocks but paragraphs and cells, which an implied end doesn't leave

    def close(k: int) -> None:
        nonlocal skip
        for x in stack[k:]:
            at[x.tag].pop()
        del stack[k:]
        for places in (walls, others):
            while places and places[-1] >= k:
                places.pop()
        if skip >= len(stack):
            skip = 0

    for before, slash, tag, attributes in tokens(html):
        if before and not skip:
            stack[-1].children.append(unescape(before))
        if not tag:
            break
        if slash:
            if at[tag] and (tag in BLOCKS or not walls or walls[-1] <= at[tag][-1]):
                close(at[tag][-1])
            continue
        if tag in VOID or attributes.endswith("/") and tag in DROPPED:
            if tag in ("br", "hr", "wbr", "img") and not skip:
                stack[-1].children.append(" " if tag != "wbr" else "")
            continue
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS else ())
        k = max((at[c][-1] for c in closes if at[c]), default=0)
        if k and (not others or others[-1] <= k):
            close(k)
        node = Node(tag, stack[-1])
        if not skip:
            left_out, node.marked, node.comments = judged(tag, attributes, bool(at["article"] or at["main"]))
            if left_out:
                skip = len(stack)
            else:
                stack[-1].children.append(node)
        at[tag].append(len(stack))
        if tag in ("td", "th", "article", "main"):
            walls.append(len(stack))
        if tag in BLOCKS and tag not in ("p", "td", "th"):
            others.append(len(stack))
        stack.append(node)
    return root


def walk(node: Node):
    """Nodes under ``node`` in page order, without recursion."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, Node):
            stack.extend(reversed(x.children))


def measure(root: Node) -> None:
    """Set each node's characters, characters in links and commas, children before parents."""
    order = [x for x in walk(root) if isinstance(x, Node)]
    for x in reversed(order):
        chars = linked = commas = 0
        for c in x.children:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
                commas += c.count(",") + c.count("、") + c.count("،") + c.count("，")
            else:
                chars, linked, commas = chars + c.size[0], linked + c.size[1], commas + c.size[2]
        x.size = (chars, chars if x.tag == "a" else linked, commas)


def paragraphs(root: Node) -> list[Node]:
    """Paragraph elements, and other blocks that hold text of their own."""
    return [x for x in walk(root) if isinstance(x, Node) and (x.tag in PARAGRAPHS or (x.tag in BLOCKS or x.tag == "#root") and any((isinstance(c, str) and c.strip()) or (isinstance(c, Node) and c.tag not in BLOCKS) for c in x.children))]


def points(p: Node) -> float:
    chars, linked, commas = p.size
    return (1 + commas + min(chars / 100, 3)) * (1 - linked / chars) if chars else 0.0


def prune(root: Node) -> None:
    """Take out the marked subtrees that are boilerplate by what they hold, too.

    A subtree whose name leaves no doubt goes unless it holds most of the page's paragraph points, as a wrapper of the
    whole page does.  Comments may outweigh the article: they go if the rest of the page has text, unless the article
    itself (its element, or a main heading) stands among them.  A doubtful name goes only with text in links or no paragraph.
    """
    order = [x for x in walk(root) if isinstance(x, Node)]
    if not any(x.marked for x in order):
        return
    measure(root)
    held, longest, core = dict.fromkeys(map(id, order), 0.0), dict.fromkeys(map(id, order), 0), dict.fromkeys(map(id, order), False)
    for p in paragraphs(root):
        held[id(p)], longest[id(p)] = points(p), p.size[0]
    for x in reversed(order):
        core[id(x)] |= x.tag in ("h1", "main") or x.tag == "article" and not x.comments
        if x.parent is not None:
            up = id(x.parent)
            held[up] += held[id(x)]
            longest[up], core[up] = max(longest[up], longest[id(x)]), core[up] or core[id(x)]
    whole = held[id(root)]

    def stays(x: Node) -> bool:
        if not x.marked:
            return True
        chars, linked, _ = x.size
        if x.marked == MAYBE:
            return longest[id(x)] >= PARAGRAPH and linked <= DOUBTFUL_LINKS * chars
        if x.comments and not core[id(x)] and whole - held[id(x)] >= OTHER_POINTS:
            return False
        return held[id(x)] > MOST * whole

    for x in order:
        x.children = [c for c in x.children if isinstance(c, str) or stays(c)]


def score(root: Node) -> list[Node]:
    """Give every ancestor of a paragraph its points; returns the scored elements."""
    scored: list[Node] = []
    prune(root)
    measure(root)
    for p in paragraphs(root):
        if not p.size[0]:
            continue
        own = points(p)
        x, level = p.parent if p.tag in PARAGRAPHS and p.parent else p, 1.0
        while x is not None and level < LEVELS:
            if not x.scored:
                x.scored = True
                x.score = TAG_POINTS.get(x.tag, 0.0)
                scored.append(x)
            x.score += own / level
            x, level = x.parent, level * 2 if level < 2 else level + 2
    return scored


def chosen(root: Node) -> list[Node]:
    """The best element and its good siblings, in page order; ties go to the outermost, then to the first."""
    scored = score(root)
    if not scored:
        return []
    worth = {}
    for x in scored:
        chars, linked, _ = x.size
        worth[id(x)] = x.score * (1 - linked / chars if chars else 0)
    best = max(scored, key=lambda x: worth[id(x)])
    # an element that holds nothing else is as good as what it holds
    while best.parent is not None and best.parent.parent is not None and best.parent.size[0] == best.size[0]:
        best = best.parent
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * worth.get(id(best), 0.0))
    out = []
    for s in best.parent.children:
        if s is best or isinstance(s, Node) and (worth.get(id(s), 0) >= least or _good_paragraph(s)):
            out.append(s)
    return out


def _good_paragraph(s: Node) -> bool:
    """Whether a sibling of the best element belongs to it: a paragraph, or a block that holds one, with few links for its
    length; a short one without a link and ended as a sentence is."""
    if s.tag not in PARAGRAPHS and not any(isinstance(x, Node) and x.tag in PARAGRAPHS for x in walk(s)):
        return False
    chars, linked, _ = s.size
    if not chars or linked >= 0.25 * chars:
        return False
    return s.tag in HEADINGS or chars >= PARAGRAPH or not linked and "".join(x for x in walk(s) if isinstance(x, str)).rstrip().endswith(ENDS)


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space turned into single spaces; empty blocks are left out."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    for node in nodes:
        stack: list[tuple[Node | str, bool]] = [(node, False)]
        while stack:
            x, closing = stack.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            if x.tag in BLOCKS:
                end()
            if not closing:
                stack.append((x, True))
                stack.extend((c, False) for c in reversed(x.children))
        end()
    return out


def extract(html: str) -> str:
    """Main text of a page, its blocks joined by an empty line; the empty text if there is none."""
    return "\n\n".join(blocks(chosen(parse(html)))) if html else ""


def extract_pages(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points).

    A null or empty page, and one without a paragraph, has an empty text.  Whole pages are read, in time that grows with
    their length; repeated rows stay; an empty table gives no rows; columns named as the added ones are replaced.
    """

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            got = [extract(t) for t in texts(batch, html_col)]
            return {"text": got, "n_chars": [len(t) for t in got]}

        return f

    return add_columns(pages, make, "text string, n_chars long", keep)


def op3_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))
    return extract_pages(pages, keep=["page_id", "url"])
