"""Names of classes and ids: nothing of a text is lost by them, boilerplate goes."""

import random

import pytest

from tilewright.llm import html_text

LONG = "This is a long paragraph, with commas, of quite some words, that scores many points, and more than others."
BODY = "<h1>Title</h1>" + f"<p>{LONG}</p>" * 4
WANT = ["Title", *[LONG] * 4]


def got(page):
    return html_text.extract(page).split("\n\n")


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="layout has-sidebar">', '<div class="page sidebar-left"><div class="content">', '<div id=wrap class="nav-fixed">', '<div class="content-sidebar-wrap">', '<div class="with-comments"><div class="no-footer">', '<form id="aspnetForm" method="post"><div class="main-content">', '<div class="widget-area share-enabled">', '<body class="menu sidebar"><div class="single has-related-posts">', '<div class="hidden-nav"><section class="header">'],
)
def test_wrappers(wrapper):
    side = '<div class="sidebar"><p>Short, side text</p></div><div class="comments"><p>I think, dear readers, that this is, all in all, a bad comment.</p></div>'
    assert got(f"<html>{wrapper}{BODY}{side}</html>") == WANT


def test_headings_and_sections_keep_their_ids():
    ids = ["hidden-markov-models", "social-impact", "navigation-at-sea", "legal-history", "discussion", "comments", "related", "notices"]
    heads = "".join(f"<h2 id={i}>About {k}</h2><p>{LONG} {k}</p>" for k, i in enumerate(ids))
    want = WANT + [t for k in range(len(ids)) for t in (f"About {k}", f"{LONG} {k}")]
    assert got(f"<article>{BODY}{heads}</article>") == want
    assert got(f"<div id=content>{BODY}{heads}</div>") == want
    sections = "".join(f"<section id={i}><h2>About {k}</h2><p>{LONG} {k}</p><p>{LONG}</p></section>" for k, i in enumerate(["comments-on-method", "discussion", "legal-history", "impact-of-advertising", "related-work"]))
    want = WANT + [t for k in range(5) for t in (f"About {k}", f"{LONG} {k}", LONG)]
    assert got(f"<article>{BODY}{sections}</article>") == want
    assert got(f"<div id=content>{BODY}{sections}</div>") == want


def test_after_an_article():
    assert got(f"<body><article>{BODY}</article><h2>Appendix</h2><ul><li>one</li><li>two</li></ul><p>Note.</p></body>") == [*WANT, "Appendix", "one", "two", "Note."]
    assert got(f"<main><article>{BODY}</article><article>{BODY}</article><p>Short end.</p></main>") == [*WANT, *WANT, "Short end."]
    assert got(f"<main><div class=menu><a href=/>x</a></div><article>{BODY}</article><div class=related-posts><p><a href=/a>Other, nice, page</a></p></div></main>") == WANT


@pytest.mark.parametrize("name", ["comments", "comment-list", "comments-area", "fb-comments", "sidebar", "right-sidebar-2", "site-footer", "cookie-notice", "CookieBanner", "newsletterSignup", "social-share", "share-buttons", "related-posts", "breadcrumbs", "main-nav", "ad", "ad-slot", "top-ad", "acme-advert", "promo-box", "pagination", "widget", "reply-form", "popup-overlay"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_boilerplate(name, attribute):
    junk = f'<div {attribute}="{name}"><p>Some words, of no use, that stand beside the text, and go.</p></div>'
    for page in (f"<body><div class=content>{BODY}</div>{junk}</body>", f"<body><div class=content>{BODY}{junk}</div></body>", f"<body><article>{BODY}{junk}</article></body>"):
        assert got(page) == WANT


def test_many_comments_are_no_article():
    comments = "<div id=comments>" + f"<article class=comment><p>{LONG} I say.</p></article>" * 30 + "</div>"
    assert got(f"<body><article>{BODY}</article>{comments}</body>") == WANT
    assert got(f"<body><div class=content>{BODY}{comments}</div></body>") == WANT


def test_random_names_lose_nothing():
    """Random slugs on headings, layout classes on wrappers: every block of the text comes out."""
    r = random.Random(11)
    words = "hidden social navigation legal discussion comments share sidebar footer banner menu notices related markov impact history models method sea theory results".split()
    layouts = ["has-{}", "with-{}", "no-{}", "{}-left layout", "{}-fixed", "{}-wrap", "page-{}", "content-{}-wrap", "two-{}"]
    for n in range(300):
        parts, want = ["<h1>Title of it</h1>"], ["Title of it"]
        for k in range(r.randrange(3, 7)):
            slug = "-".join(r.choice(words) for _ in range(r.randrange(1, 5)))
            parts.append(f"<h2 id='{slug}'>Part {k}</h2>" + f"<p>{LONG} {k}</p>" * 2)
            want += [f"Part {k}", f"{LONG} {k}", f"{LONG} {k}"]
        body = "".join(parts)
        for _ in range(r.randrange(3)):
            body = f'<div class="{r.choice(layouts).format(r.choice(["sidebar", "nav", "footer", "menu", "banner", "header"]))}">{body}</div>'
        frame = r.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<section>{}</section>"])
        page = f"<html><body><nav><a href=/>Home</a></nav>{frame.format(body)}<footer>Foot</footer></body></html>"
        assert got(page) == want, (n, page)


def test_very_long_pages():
    body = "".join(f"<p>{LONG} {k}</p>" for k in range(20_000))
    assert len(got(f"<body><div class='page has-sidebar'>{body}</div></body>")) == 20_000
    assert got("<div class=sidebar>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000) == [LONG]
