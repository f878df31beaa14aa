"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 5).

A page is parsed into its block elements and, as leaves, its runs of inline text. Every node gets features: its tag, tokens of
its class, id and role attributes, how near ancestors with such tokens are and what share of the page they hold (a wrapper named has-sidebar holds
the article, a sidebar does not), whether a name only tells a state (has-, no-, -open), depth, place among its siblings and their texts, and density measures
of its subtree (characters, links, tags, punctuation). Trees give each node the odds of being main text. Decoding labels nodes
content, boilerplate or mixed so that everything below a content node is content and everything below a boilerplate node is
boilerplate; the labelling of highest likelihood follows from the leaves to the root, so no node contradicts an ancestor.

The trees are fitted on made-up page layouts, filled with texts and with the labels that their makers know, and on at most
`sample_pages` pages (default 200, by a hash of the id) that mark their article up with semantic elements, as they are and with these
elements renamed to plain ones. All pages are then extracted whole.

Defined results: null and empty html give an empty text, an empty table no rows; character references are decoded once; white space in a block becomes one
space; blocks come in page order, joined by a line feed; pages of any length are parsed whole, in linear time; broken markup is parsed to the end: of an element that is left out but has no
end tag only the tag goes, except that a script, style, text area or title runs to the end of the page, as in browsers, and a stray option to the next tag; a tag that the page breaks off in
goes; a head ends by itself, as its elements hold no text; words in noscript, math and object elements are text like any other, and
the trees decide; of equally likely labellings a node takes boilerplate before content before mixed; repeated rows give equal results; further columns are kept.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import boosting
from tracewright.llm.common import portions, table, without

SAMPLE_PAGES = 200
#: Larger pages stay out of the sample (not out of the extraction), so that the driver holds at most SAMPLE_PAGES times this.
SAMPLE_PAGE_BYTES = 1 << 18
#: Names, values and gaps in a tag up to which a > in quotes does not end it.
ATTRIBUTES = 64
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){{0,{ATTRIBUTES}}}+)/?>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
#: Elements whose content is left out if they have an end tag of their own: form controls, and what browsers don't show as text. Scripts,
#: styles, text areas and titles are single tokens.
SKIP = frozenset("template select datalist iframe svg button".split())
HINT = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAMES = re.compile(r"[^\s\"']+")
#: The words of a name, those of camel case too.
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a copyright line says.
LEGAL = re.compile(r"©|\(c\)\s|copyright|rights reserved", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend label".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption dd dt li legend label summary body html".split())
SAME = {"li": frozenset(["li"]), "p": frozenset(["p"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
SCOPE = frozenset("html body div article main section nav aside table ul ol dl form header footer td th blockquote".split())
CELLS = frozenset(["tr", "td", "th"])
#: By the tag of a new element, the open elements of its scope that it ends.
ENDS = {t: SAME.get(t, frozenset()) | (frozenset(["p"]) if t in CLOSES_P else frozenset()) for t in CLOSES_P | SAME.keys()}

TAG_GROUPS = {
    "paragraph": frozenset("p pre blockquote dd figcaption".split()),
    "heading": frozenset("h1 h2 h3 h4 h5 h6 hgroup".split()),
    "item": frozenset("li dt".split()),
    "list": frozenset("ul ol dl menu dir".split()),
    "plain": frozenset("div section td th tr table tbody center figure details".split()),
    "main": frozenset("article main".split()),
    "off": frozenset("nav footer aside header form dialog fieldset label legend address menu".split()),
}
OFF_WORDS = frozenset(
    "nav navbar navigation menu foot footer header masthead banner topbar side sidebar aside ad ads advert advertisement adverts sponsor sponsored promo promotion comment comments reply replies respond disqus share sharing social cookie cookies consent notice alert gdpr popup modal overlay related recommended widget breadcrumb breadcrumbs pager pagination subscribe newsletter signup login search form tags meta byline author copyright legal skip toolbar contentinfo complementary dialog feedback reviews rating outbrain taboola".split()
)
ON_WORDS = frozenset("content article post entry main story body text page articlebody maincontent prose lead blog news".split())
#: Words that make a name with one of OFF_WORDS in it say how a page looks rather than what an element is.
STATE_WORDS = frozenset("has have no not with without is open opened closed off on free left right none fixed sticky layout enabled disabled hide hidden show shown active single logged in".split())
FAR = 9
FEATURES = [f"tag_{g}" for g in TAG_GROUPS] + "text_leaf off_tokens on_tokens state_tokens off_steps off_share off_paragraphs on_steps state_above off_tag_above main_above list_above depth place of_siblings same_tag chars log_chars words link_share tags_per_char stops word_length share_of_page from_start blocks paragraphs caps digits legal before after before_links after_links parent_chars parent_links".split()


class Node:
    __slots__ = ("tag", "parent", "children", "text", "order", "links", "hints", "depth", "scope", "cells", "chars", "link_chars", "tags", "blocks", "paragraphs", "stops", "caps", "digits", "legal", "words", "start", "off_near", "on_near", "state_above", "off_tag_above", "main_above", "list_above")

    def __init__(self, tag: str, parent: Node | None, hints: tuple[int, int, int] = (0, 0, 0)):
        self.tag, self.parent, self.children, self.text, self.links, self.hints = tag, parent, [], None, 0, hints
        self.tags = 0


@functools.lru_cache(maxsize=1 << 14)
def _name(name: str) -> tuple[int, int, int]:
    """Tokens of one class, id or role: of what is left out, of main text, and of the former in a name that tells a state. A long token may be
    joined from one of these words and another."""
    words = [w.lower() for w in TOKENS.findall(name)]
    known = lambda w, of: w in of or len(w) > 6 and any(len(x) > 5 and (w.startswith(x) or w.endswith(x)) for x in of)
    on = sum(known(w, ON_WORDS) for w in words)
    off = sum(known(w, OFF_WORDS) for w in words)
    return (0, on, off) if not STATE_WORDS.isdisjoint(words) else (off, on, 0)


def _hints(attributes: str) -> tuple[int, int, int]:
    off = on = state = 0
    if attributes:
        for m in HINT.finditer(attributes):
            for name in NAMES.findall(m[1]):
                a, b, c = _name(name[:64])
                off, on, state = off + a, on + b, state + c
    return off, on, state


def _depth(v: Node) -> int:
    return v.depth


def _skipped(tokens: list[re.Match]) -> dict[int, int]:
    """By the place of a SKIP element's start tag, the place of its own end tag; elements without one are missing."""
    unclosed, count, ends = [], dict.fromkeys(SKIP, 0), {}
    for i, m in enumerate(tokens):
        name = (m[3] or m[6] or "").lower()
        if name not in SKIP:
            continue
        if not (m[2] or m[5]):
            if name != "svg" or not (m[4] or m[7] or "").endswith("/"):
                unclosed.append((name, i))
                count[name] += 1
        elif count[name]:
            found = ""
            while found != name:
                found, at = unclosed.pop()
                count[found] -= 1
            ends[at] = i
    return ends


def parse(html: str) -> Node:
    """The block elements of a page as a tree; runs of inline text are leaves with text."""
    html += ">"  # ends a tag that the page breaks off in; not part of a text
    root = Node("html", None)
    root.depth, root.scope, root.cells = 0, 0, 0
    at, run, links, inline, in_link, end = root, [], 0, 0, 0, 0
    opened: dict[str, list[Node]] = {}

    def flush() -> None:
        nonlocal links, inline
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                leaf = Node("#text", at)
                leaf.text, leaf.links, leaf.tags = text, min(links, len(text)), inline
                at.children.append(leaf)
            run.clear()
        links = inline = 0

    def close(node: Node) -> None:
        """End node and all in it that is still open."""
        nonlocal at
        stop = node.parent
        while at is not stop:
            opened[at.tag].pop()
            at = at.parent

    tokens, until = list(TOKEN.finditer(html)), -1
    skipped = _skipped(tokens)
    for i, m in enumerate(tokens):
        if i <= until:
            continue
        if m.start() > end:
            piece = html[end : m.start()]
            run.append(piece)
            if in_link:
                links += len(piece)
        until = skipped.get(i, i)
        end = tokens[until].end()
        name = m[3] or m[6]
        if not name:
            if m[1]:
                inline += 1
            continue
        tag = name.lower()
        closing = m[2] or m[5]
        if tag not in BLOCK:
            inline += 1
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                run.append(" ")
            elif tag == "option" and not closing:  # a stray one: its text goes to the next tag
                end = tokens[i + 1].start() if i + 1 < len(tokens) else len(html)
            continue
        flush()
        if closing:
            if opened.get(tag):
                close(opened[tag][-1])
            in_link = 0
            continue
        ends = ENDS.get(tag)
        if ends:
            limit = at.cells if tag in CELLS else at.scope
            outer = [found[k] for t in ends if (found := opened.get(t)) and (k := bisect.bisect_right(found, limit, key=_depth)) < len(found)]
            if outer:
                close(min(outer, key=_depth))
        if tag in ("html", "body"):
            continue
        in_link = 0
        child = Node(tag, at, _hints(m[4] if m[3] else m[7]))
        at.children.append(child)
        if tag != "hr":
            child.depth = at.depth + 1
            child.scope = child.depth if tag in SCOPE else at.scope
            child.cells = child.depth if tag in SCOPE and tag not in CELLS else at.cells
            opened.setdefault(tag, []).append(child)
            at = child
    if end < len(html) - 1:
        run.append(html[end:-1])
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order, with subtree measures filled in."""
    out, stack, start = [], [root], 0
    while stack:
        v = stack.pop()
        p = v.parent
        v.depth = p.depth + 1 if p else 0
        if p:
            v.off_near, v.on_near = p if p.hints[0] else p.off_near, p if p.hints[1] else p.on_near
            v.state_above = p.state_above + p.hints[2]
            v.off_tag_above = p.off_tag_above or p.tag in TAG_GROUPS["off"]
            v.main_above = p.main_above or p.tag in TAG_GROUPS["main"]
            v.list_above = p.list_above or p.tag in TAG_GROUPS["list"]
        else:
            v.off_near = v.on_near = None
            v.state_above = 0
            v.off_tag_above = v.main_above = v.list_above = False
        v.start = start
        t = v.text
        if t is not None:
            v.chars, v.link_chars, v.blocks, v.words = len(t), v.links, 1, t.count(" ") + 1
            v.stops = t.count(".") + t.count(",") + t.count("!") + t.count("?")
            v.caps, v.digits = int(t[:1].isupper()), int(any(c in t[:200] for c in "0123456789"))
            v.paragraphs, v.legal = int(p.tag in TAG_GROUPS["paragraph"]), int(LEGAL.search(t[:200]) is not None)
            start += v.chars
        else:
            v.chars = v.link_chars = v.blocks = v.words = v.stops = v.caps = v.digits = v.legal = v.paragraphs = 0
            v.tags += 1
        out.append(v)
        stack.extend(reversed(v.children))
    for v in reversed(out):
        p = v.parent
        if p:
            p.chars += v.chars
            p.link_chars += v.link_chars
            p.blocks += v.blocks
            p.words += v.words
            p.stops += v.stops
            p.caps += v.caps
            p.digits += v.digits
            p.legal += v.legal
            p.paragraphs += v.paragraphs
            p.tags += v.tags
    return out


def features(nodes: list[Node]) -> np.ndarray:
    page = max(1, nodes[0].chars) if nodes else 1
    paragraphs = max(1, nodes[0].paragraphs) if nodes else 1
    rows = []
    place = {}
    for v in nodes:
        same: dict[str, int] = {}
        for c in v.children:
            same[c.tag] = same.get(c.tag, 0) + 1
        for i, c in enumerate(v.children):
            place[id(c)] = (i, len(v.children), same[c.tag])
    for v in nodes:
        p = v.parent
        i, n, same_tag = place.get(id(v), (0, 1, 1))
        before = p.children[i - 1] if p and i > 0 else None
        after = p.children[i + 1] if p and i + 1 < n else None
        tag = p.tag if v.text is not None and p else v.tag
        chars = max(1, v.chars)
        off, on, state = p.hints if v.text is not None and p else v.hints
        a, b = v.off_near, v.on_near
        rows.append(
            [float(tag in g) for g in TAG_GROUPS.values()]
            + [
                float(v.text is not None), off, on, state, min(v.depth - a.depth, FAR) if a else FAR + 1, a.chars / page if a else 0.0, a.paragraphs / paragraphs if a else 0.0, min(v.depth - b.depth, FAR) if b else FAR + 1, v.state_above, float(v.off_tag_above), float(v.main_above), float(v.list_above), v.depth, i / n, n, same_tag,
                v.chars, math.log1p(v.chars), v.words, v.link_chars / chars, v.tags / chars, v.stops / chars, v.chars / max(1, v.words), v.chars / page, v.start / page, v.blocks, v.paragraphs,
                v.caps / max(1, v.blocks), v.digits / max(1, v.blocks), v.legal / max(1, v.blocks), before.chars if before else -1, after.chars if after else -1,
                before.link_chars / max(1, before.chars) if before else -1, after.link_chars / max(1, after.chars) if after else -1, p.chars if p else 0, p.link_chars / max(1, p.chars) if p else 0,
            ]
        )
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


MIXED = -1.5


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """Whether each node is content, by the consistent labelling of highest likelihood."""
    n = len(nodes)
    at = {id(v): k for k, v in enumerate(nodes)}
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    keep, drop, mixed = yes.tolist(), no.tolist(), [MIXED] * n
    best, label = [0.0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        v = nodes[k]
        for c in v.children:
            j = at[id(c)]
            keep[k] += keep[j]
            drop[k] += drop[j]
            mixed[k] += best[j]
        options = (drop[k], keep[k], mixed[k] if v.children else -math.inf)
        best[k] = max(options)
        label[k] = options.index(best[k])
    out = [False] * n
    final = [0] * n
    for k, v in enumerate(nodes):
        up = final[at[id(v.parent)]] if v.parent else 2
        final[k] = label[k] if up == 2 else up
        out[k] = final[k] == 1
    return out


def _with_labels(html: str, is_main, change=None) -> tuple[list[Node], list[int | None]]:
    """Nodes and labels (None: holds both, or no text). is_main: whether a leaf is main text; change: what to do to the tree afterwards."""
    root = parse(html)
    stack, chosen = [root], set()
    while stack:
        v = stack.pop()
        stack += v.children
        if v.text is not None:
            if is_main(v):
                chosen.add(id(v))
            v.text = v.text.replace(MARK, "") or "."
    if change:
        change(root)
    nodes = nodes_of(root)
    main: dict[int, int] = {}
    for v in reversed(nodes):
        if v.text is not None:
            main[id(v)] = v.chars if id(v) in chosen else 0
        else:
            main[id(v)] = sum(main[id(c)] for c in v.children)
    return nodes, [None if not v.chars or 0 < main[id(v)] < v.chars else int(main[id(v)] == v.chars) for v in nodes]


def _above(v: Node, tags: frozenset) -> bool:
    while v is not None:
        if v.tag in tags:
            return True
        v = v.parent
    return False


def _renamed(root: Node) -> None:
    """Make semantic containers plain ones, with a token that tells in their place."""
    stack = [root]
    while stack:
        v = stack.pop()
        stack += v.children
        if v.tag in TAG_GROUPS["main"]:
            v.tag, v.hints = "div", (v.hints[0], v.hints[1] + 1, v.hints[2])


MARK = "\ue000"


def _texts(chooser: random.Random, stock: list[str], words: int) -> str:
    source = chooser.choice(stock).split()
    at = chooser.randrange(max(1, len(source) - words))
    return " ".join(source[at : at + words]) or "text"


def made_up_page(chooser: random.Random, stock: list[str]) -> str:
    """A page of a random layout; every run of main text begins with MARK."""
    say = lambda a, b: entities.escape(_texts(chooser, stock, chooser.randint(a, b)), quote=False)
    plain = chooser.random() < 0.5  # no semantic elements
    named = chooser.random() < 0.85  # tokens that tell
    old = plain and chooser.random() < 0.2  # a layout without sections, its links in lines

    def state() -> str:
        """A name that says how the page looks by a word for what is left out."""
        word = chooser.choice("sidebar comments ads cookie menu nav newsletter header footer banner share related search".split())
        return chooser.choice("has-{} no-{} with-{} {}-open {}-closed {}-off {}-free {}-left {}-right layout-{} {}-fixed".split()).format(word)

    def wrapper(inner: str) -> str:
        names = [chooser.choice("content page wrapper main post site-content single-post container article-page".split())] if chooser.random() < 0.7 else []
        names += [state() for _ in range(chooser.randint(0 if names else 1, 2))]
        chooser.shuffle(names)
        return f'<div class="{" ".join(names)}">{inner}</div>'

    def box(tag: str, name: str, inner: str) -> str:
        if chooser.random() < 0.15:
            name += " " + name.split()[0] + chooser.choice(["-left", "-right", "-open", "-fixed", " is-open"])
        tag = ("center" if old else "div") if plain and chooser.random() < 0.8 else tag
        hint = f' {chooser.choice(["class", "id", "class"])}="{name}"' if named and (tag == "div" or chooser.random() < 0.5) else ""
        return f"<{tag}{hint}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        if old or chooser.random() < 0.15:
            mark = chooser.choice([" | ", " ", " &middot; ", " - "])
            return (f"{say(1, 5)}. " if chooser.random() < 0.4 else "") + mark.join(f'<a href="/{k}">{say(1, 2)}</a>' for k in range(chooser.randint(1, b)))
        return "<ul>" + "".join(f'<li><a href="/{k}">{say(1, 4)}</a></li>' for k in range(chooser.randint(a, b))) + "</ul>"

    def paragraph() -> str:
        body, style = say(2, 90) if chooser.random() < 0.85 else say(1, 3), chooser.random()
        if style < 0.15:
            cut = body.find(" ")
            body = f'{body[:cut]} <a href="/x">{say(1, 3)}</a>{body[cut:]}' if cut > 0 else body
        return f"<p><b>{MARK}{body}<br>" if style > 0.85 else f"<p>{MARK}{body}</p>" if style > 0.2 else f"<div>{MARK}{body}</div>"

    def body() -> str:
        parts = [paragraph() for _ in range(chooser.choice([1, 1, 2, 3, 4, 6, 9, 14]))]
        if chooser.random() < 0.15:
            parts.insert(chooser.randrange(len(parts) + 1), "<ul>" + "".join(f"<li>{MARK}{say(3, 20)}</li>" for _ in range(chooser.randint(2, 5))) + "</ul>")
        if chooser.random() < 0.15:
            parts.insert(chooser.randrange(len(parts) + 1), f"<h2>{MARK}{say(2, 6)}</h2>")
        if chooser.random() < 0.1:
            parts.insert(chooser.randrange(len(parts) + 1), f"<blockquote>{MARK}{say(5, 40)}</blockquote>")
        if chooser.random() < 0.1:
            parts.insert(chooser.randrange(len(parts) + 1), "<table>" + "".join(f"<tr><td>{MARK}{say(1, 5)}</td><td>{MARK}{say(1, 5)}</td></tr>" for _ in range(2)) + "</table>")
        if chooser.random() < 0.25:
            parts.insert(chooser.randrange(1, len(parts) + 1), box("aside", chooser.choice(["ad", "advert", "promo", "related", "share social", "newsletter signup"]), say(3, 25)))
        title = f"<h1>{MARK}{say(2, 12)}</h1>" if chooser.random() < 0.9 else ""
        return title + "".join(parts)

    def comments() -> str:
        if chooser.random() < 0.35:
            name = chooser.choice(["commentlist", "comment-list", "comments", "replies", "usercomments"])
            list_tag, item = chooser.choice([("ol", "li"), ("ul", "li"), ("div", "div")])
            one = chooser.choice([' class="comment"', ' class="comment even"', "", ' class="item"', ' class="entry"'])
            some = "".join(f"<{item}{one}><p>{say(1, 3)}</p><p>{say(5, 60)}</p></{item}>" for _ in range(chooser.randint(1, 5)))
            return (f"<h3>{say(1, 3)}</h3>" if chooser.random() < 0.4 else "") + f'<{list_tag} class="{name}">{some}</{list_tag}>'
        some = "".join(box("div", "comment", f"<p>{say(1, 3)}</p><p>{say(5, 60)}</p>") for _ in range(chooser.randint(1, 5)))
        return box("section", chooser.choice(["comments", "comments-area", "reader-comments"]), f"<h3>{say(1, 3)}</h3>{some}")

    page = []
    if chooser.random() < 0.3:
        page.append(box("header", chooser.choice(["header", "site-header", "masthead"]), f"<h2>{say(1, 4)}</h2><p>{say(2, 10)}</p>"))
    if chooser.random() < 0.8:
        page.append(box("nav", chooser.choice(["nav", "menu", "main-menu"]), links(2, 9)))
    if chooser.random() < 0.3:
        page.append(box("div", chooser.choice(["notice", "cookie-notice", "alert"]), f"<p>{say(4, 30)}</p>"))
    if chooser.random() < 0.5:
        page.append(f'<div class="{chooser.choice(["ad", "ads", "advert", "sponsored"])}">{say(3, 25)}</div>')
    bare = chooser.random() < 0.15
    main = body() if bare or old else box(chooser.choice(["article", "main"]), chooser.choice(["content", "article", "post", "entry-content", "story"]), body())
    if chooser.random() < 0.3:
        main = wrapper(main)
    side = lambda: f"<h3>{say(1, 4)}</h3>{links(2, 6)}" + (f"<p>{say(4, 30)}</p>" if chooser.random() < 0.7 else "")
    if chooser.random() < (0.5 if old else 0.12):  # columns of a table
        cells = [main]
        if chooser.random() < 0.7:
            cells.insert(0, links(2, 9))
        if chooser.random() < 0.4 or len(cells) == 1:
            cells.append(side())
        first = f"<tr><td colspan={len(cells)}>{links(1, 3) if chooser.random() < 0.5 else say(1, 4)}</td></tr>" if chooser.random() < 0.3 else ""
        page.append(f"<table>{first}<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>")
    else:
        page.append(main)
        if chooser.random() < 0.3:
            page.append(box("aside", chooser.choice(["sidebar", "side", "widget"]), side()))
    if chooser.random() < 0.35:
        page.append(comments())
    if chooser.random() < 0.25:
        page.append(f'<form action="/s"><label>{say(1, 5)}</label><input name="q"><p>{say(1, 12)}</p></form>')
    if chooser.random() < 0.85:
        page.append(box("footer", chooser.choice(["footer", "site-footer", "copyright"]), f"{chooser.choice(['&copy;', 'Copyright'])} {say(1, 4)} &middot; {say(3, 14)}" if chooser.random() < 0.6 else f"<p>{say(3, 20)}</p>{links(1, 4)}"))
    elif chooser.random() < 0.5:
        page.append(f'<div id="{chooser.choice(["bottom", "end", "last", "base"])}"><p>{chooser.choice(["&copy;", "Copyright"])} {say(1, 5)}</p>' + (f"<p><a href=/i>{say(1, 2)}</a></p>" if chooser.random() < 0.5 else "") + "</div>")
    if old:
        page = [x for part in page for x in (part, "<hr>")]
    if chooser.random() < 0.4:
        page = [wrapper("".join(page))]
    return f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title></head><body>{''.join(page)}</body></html>"


_STOCK = ["The committee met on Monday, and after a long debate it agreed that the new road should be built by spring. Few of those present spoke against it. Others, who had come from far away, asked for more time and were told that none was left."]


def train(sample: list[str], layouts: int = 500, seed: int = 5) -> boosting.Trees:
    """Trees from made-up layouts and from sample pages whose article is marked up by semantic elements."""
    chooser = random.Random(seed)
    article, off = TAG_GROUPS["main"], TAG_GROUPS["off"]
    x, y, stock = [], [], []

    def add(nodes: list[Node], labels: list[int | None]) -> None:
        rows = features(nodes)
        kept = [k for k, v in enumerate(labels) if v is not None]
        x.append(rows[kept])
        y.extend(labels[k] for k in kept)

    for html in sample:
        nodes, labels = _with_labels(html, lambda v: _above(v, article) and not _above(v, off))
        stock += [v.text for v in nodes if v.text and v.chars > 200][:3]
        if any(v.tag in article for v in nodes):
            add(nodes, labels)
            add(*_with_labels(html, lambda v: _above(v, article) and not _above(v, off), _renamed))
    stock = stock or _STOCK
    for _ in range(layouts):
        html = made_up_page(chooser, stock)
        nodes, labels = _with_labels(html, lambda v: MARK in v.text)
        add(nodes, labels)
    return boosting.fit(np.concatenate(x), np.array(y, dtype=float))


def main_text(html: str | None, trees: boosting.Trees) -> str:
    return main_texts([html], trees)[0]


def main_texts(pages: list[str | None], trees: boosting.Trees) -> list[str]:
    """Main text of every page; nodes of all pages are scored together."""
    trees_of = [nodes_of(parse(p)) if p else [] for p in pages]
    rows = [features(n) for n in trees_of if n]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in trees_of:
        kept = decode(nodes, odds[at : at + len(nodes)]) if nodes else []
        at += len(nodes)
        out.append("\n".join(v.text for v, k in zip(nodes, kept, strict=True) if k and v.text is not None))
    return out


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, id_col: str = "page_id", html_col: str = "html") -> boosting.Trees:
    """Trees for these pages, from at most sample_pages of them."""
    n = pages.count()
    lot = F.pmod(F.xxhash64(F.lit("page sample"), F.col(id_col)), F.lit(1 << 30))
    share = min(1.0, (2 * sample_pages + 50) / max(1, n))
    rows = pages.select(lot.alias("lot"), F.col(id_col).cast("string").alias("i"), F.col(html_col).cast("string").alias("h")).where((F.octet_length("h") <= SAMPLE_PAGE_BYTES) & (F.col("lot") < int(share * (1 << 30))))
    return train([r["h"] for r in rows.orderBy("lot", "i").limit(sample_pages).collect()])


def extract(pages: DataFrame, trees: boosting.Trees, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """pages without the html, with the main text and n_main_text_chars, in place of columns of these names. The trees, some kilobytes, are
    broadcast."""
    pages = without(pages, out_col, f"n_{out_col}_chars", keep=html_col)
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    place, names = pages.columns.index(html_col), [c for c in pages.columns if c != html_col]

    def extracted(batches):
        for b in portions(batches, place):
            texts = main_texts(b.column(place).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != place), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, out_col, f"n_{out_col}_chars"])

    fields = [f for f in pages.schema.fields if f.name != html_col]
    return pages.mapInArrow(extracted, T.StructType([*fields, T.StructField(out_col, T.StringType()), T.StructField(f"n_{out_col}_chars", T.LongType())]))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract(pages, fit(pages), "html", "text").withColumnRenamed("n_text_chars", "n_chars")
