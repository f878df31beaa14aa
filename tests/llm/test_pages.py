"""Hand-written pages in layouts that the made-up training pages do not hold word for word: the main text, and nothing else, comes out."""

import pytest

from tracewright.llm import html_text

ARTICLE = [
    "The bridge is open again",
    "After nine months of repairs the old bridge over the river was opened to traffic on Monday morning, two weeks ahead of plan.",
    "Engineers had found cracks in three of the main beams last summer. The town, which pays for a third of the work, asked for a slower but cheaper repair.",
    "Lorries of more than twelve tonnes still have to take the road through the valley, said the mayor, until the last beam has been replaced.",
]
INNER = f"<h1>{ARTICLE[0]}</h1>" + "".join(f"<p>{p}</p>" for p in ARTICLE[1:])
WANT = "\n".join(ARTICLE)
NAV = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li><li><a href=/d>Contact</a></li></ul>"
SIDE = f"<h3>Most read</h3><ul><li><a href=/1>Snow in the hills</a></li><li><a href=/2>New bakery</a></li><li><a href=/3>Trains are late</a></li></ul>"
FOOT = "<footer><p>&copy; 2024 The Valley Post. All rights reserved.</p></footer>"
COMMENTS = ["I drove over it this morning, and it looks great. Well done to all of them!", "Nine months for three beams? My grandfather would have done that in a week."]
WRAPPERS = "content has-sidebar|page-with-sidebar|main no-sidebar|layout-sidebar-right|post has-comments|single-post comments-open|site-content ad-free|article-page newsletter-off|wrapper menu-open".split("|")
OTHERS = "with-cookie-bar|no-ads page|has-banner|hasSidebar singlePost|header-fixed content|layout nav-left|comments-closed|with-related|sidebar-none|logged-in search-off".split("|")


@pytest.fixture(scope="module")
def trees():
    return html_text.train([], layouts=500)


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("inner", ['<div class="post">{}</div>', "<article>{}</article>", "{}"])
@pytest.mark.parametrize("name", WRAPPERS + OTHERS)
def test_wrappers(trees, name, inner):
    assert html_text.main_text(page(f'<div class="{name}">{inner.format(INNER)}</div>'), trees) == WANT


@pytest.mark.parametrize("name", WRAPPERS + OTHERS)
def test_wrappers_around_all(trees, name):
    whole = f'<div class="{name}"><nav>{NAV}</nav><div class="post">{INNER}</div><div class="sidebar">{SIDE}</div>{FOOT}</div>'
    assert html_text.main_text(page(whole), trees) == WANT


TABLES = {
    "links left": f"<table><tr><td>{NAV}</td><td>{INNER}</td></tr></table>",
    "links right": f"<table><tr><td>{INNER}</td><td>{SIDE}</td></tr></table>",
    "three columns": f"<table><tr><td>{NAV}</td><td>{INNER}</td><td>{SIDE}</td></tr></table>",
    "widths": f'<table width=100%><tr><td colspan=2><a href=/>Valley Post</a></td></tr><tr><td width=150>{NAV}</td><td valign=top>{INNER}</td></tr></table>',
    "bare links": f"<table><tr><td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>Sport</a></td><td>{INNER}</td></tr></table>",
}


@pytest.mark.parametrize("name", TABLES)
def test_tables(trees, name):
    assert html_text.main_text(page(TABLES[name]), trees) == WANT


def said(tag: str, item: str, name: str, one: str) -> str:
    return f'<{tag} class="{name}">' + "".join(f'<{item} class="{one}"><p>Anna says:</p><p>{c}</p></{item}>' for c in COMMENTS) + f"</{tag}>"


LISTS = {
    "commentlist": said("ol", "li", "commentlist", "comment"),
    "comment-list": said("ol", "li", "comment-list", "comment even"),
    "commentsList": said("ul", "li", "commentsList", "item"),
    "discussion": f'<div id="comments"><h3>2 comments</h3>{said("ul", "li", "thread", "depth-1")}</div>',
    "usercomments": said("div", "div", "usercomments", "entry"),
}


@pytest.mark.parametrize("name", LISTS)
def test_comments(trees, name):
    assert html_text.main_text(page(f'<nav>{NAV}</nav><div class="post">{INNER}</div>{LISTS[name]}{FOOT}'), trees) == WANT


PLAIN = {
    "sidebar with a state": f'<div class="content">{INNER}</div><div class="sidebar sidebar-right">{SIDE}</div>',
    "open menu": f'<div class="menu menu-open">{NAV}</div><div class="content">{INNER}</div>',
    "cookie bar": f'<div class="cookie-bar is-open"><p>We use cookies to make this page better for you. You can refuse them.</p></div><div class="main">{INNER}</div>',
    "bottom line": f'<main>{INNER}</main><div id="bottom"><p>Copyright 2024 The Valley Post</p><p><a href=/i>Imprint</a></p></div>',
    "camel case": f'<div class="siteHeader"><p>The Valley Post</p></div><div class="mainContent">{INNER}</div><div class="siteFooter"><p>Copyright 2024 The Valley Post</p></div>',
    "sidebar in a page with one": f'<div class="page-with-sidebar"><div class="entry">{INNER}</div><div class="sidebar">{SIDE}</div></div>',
}


@pytest.mark.parametrize("name", PLAIN)
def test_other_layouts(trees, name):
    assert html_text.main_text(page(PLAIN[name]), trees) == WANT
