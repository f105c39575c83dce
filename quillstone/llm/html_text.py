"""Main text of web pages by tree scoring.

The page becomes a tree.  Parts that never hold the article (menus, forms, footers,
notices, adverts, reader comments and the like, by tag, role and class words) are
cut; on a page without article or main, one that is suspect by its class or role only
and holds most of the text is not.  Paragraphs then pass points for their length and commas to their
ancestors, less with each level; an ancestor's points are discounted by its share of
link text.  If the best container lies inside an article or main element, that one is
kept with those siblings that score near it.  Else the best container is kept with all
that stands beside it and beside its ancestors, however short, but for what consists
of links in the main.

How it runs.  One Arrow map over the pages, no shuffle; memory is one batch.  Parsing
and scoring take time in proportion to the page, also on hostile ones (deep nesting,
open quotes, stray end tags).

Defined results.  Null or empty html: empty text.  No paragraph at all: empty text.
Unclosed or misnested tags: closed where a browser would close them.  A quote that is
never closed: tags end at their first `>` from there on.  Equal scores: the first
container.  Repeated rows: each reported.  Empty table: empty result.  Extra columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z][^\s/>]*")
UNTIL_QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CUT_TAGS = frozenset("nav footer aside form button select menu dialog svg canvas object script style head title noscript iframe template textarea input label fieldset audio video map applet".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar side rail aside notice notices cookie cookies consent gdpr banner alert warning "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended recommendations share sharing social comment comments reply replies disqus discussion feedback "
    "form subscribe subscription newsletter signup login popup modal overlay widget toolbar pager pagination skip hidden copyright outbrain taboola".split()
)
NEVER_CUT = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main".split())
WEIGHT = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "form": -3.0, "th": -5.0}
LEAST_PARAGRAPH, SIBLING_SHARE, MOST_LINKED = 25, 0.2, 0.5


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "cut", "depth")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children, self.cut = tag, attributes, parent, [], False
        self.depth = parent.depth + 1 if parent else 0


def is_suspect(node: Node) -> bool:
    """Whether a class, id, role or style says that the node is no part of the article."""
    a = node.attributes
    if not a or node.tag in NEVER_CUT and node.tag != "article":
        return False
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()))
    if node.tag == "article":  # a reader's comment may be an article too
        return bool(words & {"comment", "comments", "reply", "replies", "ad", "advert", "promo", "sponsored", "related"})
    return bool(words & CUT_WORDS or a.get("role", "").lower() in CUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))


class Tags:
    """The tags of a page in order, each found in time that its own length bounds."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end_of(self, at: int) -> int:
        """Where the tag whose attributes start here ends (its `>`), or -1."""
        k = at
        while self.quotes:
            m = UNTIL_QUOTE_OR_END.search(self.page, k)
            if m and m[0] == ">":
                return m.start()
            k = self.page.find(m[0], m.end()) + 1 if m else 0
            if not k:
                self.quotes = False  # an open quote: looked for once only
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it ends an element, attributes) of the next tag; no name for comments and the like."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                return start, len(page) if end < 0 else end + 1, "", False, ""
            ends = page.startswith("</", start)
            name = NAME.match(page, start + 1 + ends)
            if name:
                end = self.end_of(name.end())
                if end < 0:
                    return None
                return start, end + 1, name[0].lower(), ends, page[name.end() : end]
            at = start + 1
        return None


def parse(page: str) -> Node:
    """The tree of a page.  Children are nodes and strings (references decoded)."""
    root = Node("#root", {}, None)
    top, at, size, tags = root, 0, len(page), Tags(page)
    opened: dict[str, list[Node]] = {}  # open elements by tag, and all open blocks
    open_blocks: list[Node] = []

    def close(to: Node) -> None:
        nonlocal top
        while True:
            opened[top.tag].pop()
            if top.tag in BLOCK:
                open_blocks.pop()
            done, top = top is to, top.parent
            if done:
                return

    def open_one(wanted, stop) -> Node | None:
        """The innermost open element of the wanted tags, if none of the stopping ones lies inside it."""
        last = [x[-1] for t in wanted if (x := opened.get(t))]
        if not last:
            return None
        found = max(last, key=lambda n: n.depth)
        if stop is BLOCK:
            reach = open_blocks[-1].depth if open_blocks else 0
        else:
            reach = max((x[-1].depth for t in stop if (x := opened.get(t))), default=0)
        return found if found.depth > reach else None

    while at < size:
        tag_found = tags.after(at)
        text = page[at : tag_found[0]] if tag_found else page[at:]
        if text:
            top.children.append(html.unescape(text) if "&" in text else text)
        if not tag_found:
            break
        _, at, tag, ends, rest = tag_found
        if not tag:
            continue
        if ends:
            if tag in BLOCK:
                found = open_one((tag,), {"table"} if tag in ("p", "li", "div") else ())
            else:
                found = open_one((tag,), BLOCK)
            if found:
                close(found)
            continue
        if tag in CLOSES_P and (p := open_one(("p",), {"table", "td", "th", "button"})):
            close(p)
        if tag in SAME_LEVEL and (same := open_one(*SAME_LEVEL[tag])):
            close(same)
            if tag == "tr" and (outer := open_one(("tr",), {"table"})):
                close(outer)
        node = Node(tag, {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}, top)
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if not end:
                at = size
            else:
                close_at = page.find(">", end.end())
                at = size if close_at < 0 else close_at + 1
            continue
        if tag not in VOID and not rest.endswith("/"):
            top = node
            opened.setdefault(tag, []).append(node)
            if tag in BLOCK:
                open_blocks.append(node)
    return root


def blocks(node: Node) -> list[str]:
    """The texts of the blocks under a node, in page order, white space made single."""
    out, run = [], []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    if node.cut:
        return out
    work = [(node, 0)]
    flush_on = lambda n: n.tag in BLOCK
    while work:
        n, k = work.pop()
        if k == 0 and flush_on(n):
            flush()
        while k < len(n.children):
            c = n.children[k]
            k += 1
            if isinstance(c, str):
                run.append(c)
            elif c.tag == "br":
                run.append(" ")
            elif not c.cut:
                work.append((n, k))
                work.append((c, 0))
                break
        else:
            if flush_on(n):
                flush()
    flush()
    return out


def cut_parts(root: Node) -> list[Node]:
    """Cut what is no article; gives the nodes that stay, each after its ancestors."""
    every, work = [], [(root, False)]
    while work:
        n, inside = work.pop()
        inside = inside or n.tag in ("article", "main")
        every.append(n)
        for c in reversed(n.children):
            if isinstance(c, str):
                continue
            if c.tag == "header":
                # the site's header goes; an article's own header keeps its headings
                c.cut = not inside
                if inside:
                    c.children = [x for x in c.children if not isinstance(x, str) and x.tag in HEADINGS]
            else:
                c.cut = c.tag in CUT_TAGS
            if not c.cut:
                work.append((c, inside))
    size: dict[int, int] = {}  # text outside links
    for n in reversed(every):
        size[id(n)] = 0 if n.tag == "a" else sum(len(c.strip()) if isinstance(c, str) else size.get(id(c), 0) for c in n.children)
    least = size[id(root)] / 2 if not any(n.tag in ("article", "main") for n in every) else float("inf")
    order, work = [], [root]
    while work:
        n = work.pop()
        order.append(n)
        for c in reversed(n.children):
            if not isinstance(c, str) and not c.cut:
                c.cut = c.tag != "header" and is_suspect(c) and size[id(c)] <= least
                if not c.cut:
                    work.append(c)
    return order


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = cut_parts(root)
    length: dict[int, int] = {}
    linked: dict[int, int] = {}
    commas: dict[int, int] = {}
    own: dict[int, int] = {}
    for n in reversed(order):
        texts = [c for c in n.children if isinstance(c, str)]
        kids = [c for c in n.children if not isinstance(c, str) and not c.cut]
        here = sum(len(" ".join(t.split())) for t in texts)
        inline = [c for c in kids if c.tag not in BLOCK]
        own[id(n)] = here + sum(own[id(c)] for c in inline)
        commas[id(n)] = sum(t.count(",") for t in texts) + sum(commas[id(c)] for c in inline)
        length[id(n)] = here + sum(length[id(c)] for c in kids)
        linked[id(n)] = length[id(n)] if n.tag == "a" else sum(linked[id(c)] for c in kids)

    def scored(least: int) -> dict[int, list]:
        score: dict[int, list] = {}
        for n in order:
            if n.tag not in PARAGRAPHS or own[id(n)] < least:
                continue
            points = 1.0 + commas[id(n)] + min(own[id(n)] / 100.0, 3.0)
            up, level = (n if n.tag in ("div", "section", "article", "main", "td") else n.parent), 0
            while up is not None and level < 5:
                entry = score.setdefault(id(up), [WEIGHT.get(up.tag, 0.0), up])
                entry[0] += points / (1, 2, 6, 9, 12)[level]
                up, level = up.parent, level + 1
        for k, entry in score.items():
            entry[0] *= 1.0 - linked[k] / max(1, length[k])
        return score

    score = scored(LEAST_PARAGRAPH) or scored(1)
    if not score:
        return ""
    best = None
    for n in order:  # in page order: the first of equals
        if id(n) in score and (best is None or score[id(n)][0] > score[id(best)][0]):
            best = n
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    if best.tag in ("article", "main"):
        limit = max(10.0, SIBLING_SHARE * score.get(id(best), [0.0])[0])
        out = []
        for c in best.parent.children:
            if c is best:
                out += blocks(c)
            elif not isinstance(c, str) and not c.cut:
                near = id(c) in score and score[id(c)][0] >= limit
                plain = c.tag == "p" and length[id(c)] > 80 and linked[id(c)] < 0.25 * length[id(c)]
                if near or plain:
                    out += blocks(c)
        return "\n\n".join(out)
    top = best
    while top.parent is not None and top.tag not in ("body", "html"):
        for c in top.parent.children:
            if not isinstance(c, str) and c is not top and not c.cut and c.tag in BLOCK:
                c.cut = linked[id(c)] > MOST_LINKED * length[id(c)]
        top = top.parent
    return "\n\n".join(blocks(top))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SCHEMA)
