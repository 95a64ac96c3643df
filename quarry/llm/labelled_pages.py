"""Labelled pages, made by rule for this repository: the main text lies between <!--+--> and <!---->.

Each page is a layout (what wraps the story), a story, and blocks of boilerplate before, after, beside and inside it.
The words themselves carry no meaning; only the markup around them does.
"""

from __future__ import annotations

import random

#: Class and id words of what is left out; fixed values.
BOILER_WORDS = [
    "nav", "navbar", "navigation", "menu", "topbar", "masthead", "footer", "foot", "sidebar", "aside", "ad", "ads", "adv", "advert", "adverts",
    "advertisement", "advertising", "adsense", "adbox", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "social", "share", "sharing", "related",
    "recommended", "recommendations", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "login", "search", "copyright", "disclaimer",
    "hidden", "skip", "outbrain", "taboola", "tagcloud",
]
COMMENT_WORDS = ["comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"]
HEADER_WORDS = ["header", "head", "topnav", "siteheader"]
#: Class and id words of stories and of what wraps them; fixed values.
STORY_WORDS = ["content", "article", "post", "entry", "story", "main", "body", "text", "page", "wrapper", "container", "layout", "site", "primary", "column", "single"]
QUALIFIERS = ["no", "has", "with", "without", "show", "hide", "enable", "closed", "open"]
ENDINGS = ["box", "list", "wrap", "block", "area", "links", "inner", "container", "item", "bar", "section"]
STARTS = ["site", "page", "main", "left", "right", "top", "bottom", "post", "article", "content", "entry"]
CARDS = ["card", "teaser", "tile", "tease"]
BOILER_TAGS = ["nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset", "button", "select"]
ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"]


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("aeioulnrst", k=rng.randrange(2, 8))) for _ in range(n))


def _links(rng: random.Random) -> str:
    return "".join(f'<li><a href="/">{_words(rng, rng.randrange(1, 4))}</a></li>' for _ in range(rng.randrange(2, 7)))


def _inner(rng: random.Random) -> str:
    kind = rng.randrange(4)
    if kind == 0:
        return f"<ul>{_links(rng)}</ul>"
    text = _words(rng, rng.randrange(2, 40))
    return text if kind == 1 else f"<p>{text}</p>" if kind == 2 else f"<h3>{_words(rng, 3)}</h3><p>{text} <a href='/'>{_words(rng, 2)}</a></p>"


def _comments(rng: random.Random) -> str:
    word = rng.choice(COMMENT_WORDS)
    tag = rng.choice(["div", "section", "aside"])
    each = rng.choice(["<article>%s</article>", '<div class="body">%s</div>', "%s", '<article class="content">%s</article>'])
    inner = "".join(each % f"<p>{_words(rng, rng.randrange(3, 50))}</p>" for _ in range(rng.randrange(1, 4)))
    key = rng.choice(["class", "id"])
    return f'<{tag} {key}="{word}{rng.choice(["", "-list", "-area", "-form"])}"><h2>{_words(rng, 2)}</h2>{inner}</{tag}>'


def boilerplate(rng: random.Random, inside: bool) -> str:
    """A block that is left out; inside: for use within a story."""
    kind = rng.randrange(12)
    if kind < 5:
        word = rng.choice(BOILER_WORDS + ([] if inside else HEADER_WORDS))
        name = rng.choice([word, word, f"{rng.choice(STARTS)}-{word}", f"{word}-{rng.choice(ENDINGS)}"])
        tag = rng.choice(["div", "div", "section", "ul", "p", "span", "aside"])
        inner = _links(rng) if tag == "ul" else _words(rng, rng.randrange(2, 20)) if tag in ("p", "span") else _inner(rng)
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'
    if kind < 8:
        tag = rng.choice([t for t in BOILER_TAGS if not (inside and t == "header")])
        return f"<{tag}>{_inner(rng)}</{tag}>"
    if kind == 8:
        return f'<div {rng.choice(["hidden", chr(34).join(["style=", "display:none", ""]), "aria-hidden=" + chr(34) + "true" + chr(34)])}>{rng.choice(["%s", "<main>%s</main>", "<article>%s</article>"]) % _inner(rng)}</div>'
    return f'<div role="{rng.choice(ROLES)}">{_inner(rng)}</div>'


def _story(rng: random.Random, broken: bool) -> str:
    """Title, paragraphs and other blocks, with boilerplate in between if broken."""
    title = f"<h1>{_words(rng, rng.randrange(2, 9))}</h1>"
    parts = [rng.choice([title, f"<header>{title}</header>", f'<h2 class="title">{_words(rng, 4)}</h2>', ""])]
    for _ in range(rng.randrange(2, 7)):
        text = _words(rng, rng.randrange(3, 60))
        kind = rng.randrange(9)
        parts.append(
            f"<p>{text}</p>" if kind < 4
            else f'<p>{text} <a href="/">{_words(rng, 2)}</a> {_words(rng, 5)}</p>' if kind == 4
            else f"<ul><li>{text}</li><li>{_words(rng, 3)}</li></ul>" if kind == 5
            else f"<blockquote>{text}</blockquote>" if kind == 6
            else f'<div class="{rng.choice(STORY_WORDS)}">{text}<br>{text}</div>' if kind == 7
            else f"<figure><figcaption>{text}</figcaption></figure><pre>{text}</pre>"
        )
        if broken and rng.random() < 0.3:
            parts.append(f"<!---->{boilerplate(rng, True) if rng.random() < 0.85 else _comments(rng)}<!--+-->")
    return f"<!--+-->{''.join(parts)}<!---->"


def _wrapped(rng: random.Random, story: str) -> str:
    """A story in an element around which a name may speak of boilerplate that is elsewhere."""
    kind = rng.randrange(8)
    own = rng.choice([f' class="{rng.choice(STORY_WORDS)}"', f' class="{rng.choice(STORY_WORDS)}-{rng.choice(STORY_WORDS)}"', "", f' id="{rng.choice(STORY_WORDS)}"'])
    if kind < 3:
        story = f"<{rng.choice(['article', 'main'])}{own}>{story}</main></article>"
    elif kind == 3:
        story = f"<main{own}><article>{story}</article></main>"
    elif kind == 4:
        story = f"<table><tr><td>{story}</td></tr></table>"
    elif kind == 5:
        story = f"<div{own}>{story}</div>"
    outer = rng.randrange(6)
    word = rng.choice(BOILER_WORDS + COMMENT_WORDS + HEADER_WORDS)
    if outer == 0:
        story = f'<div class="{rng.choice(["", "content ", "post ", "page-"])}{rng.choice(QUALIFIERS)}-{word}">{story}</div>'
    elif outer == 1:
        story = f'<div class="{rng.choice([f"{rng.choice(COMMENT_WORDS)}-{rng.choice(QUALIFIERS[-2:])}", "content-sidebar", "search-results", "results search-results"])}">{story}</div>'
    elif outer == 2:
        story = f'<form action="/" method="post">{story}</form>'
    return story


def pages(n: int = 1500, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        story = _wrapped(rng, _story(rng, rng.random() < 0.6))
        before = "".join(boilerplate(rng, False) for _ in range(rng.randrange(0, 4)))
        after = "".join(rng.choice([boilerplate(rng, False), _comments(rng)]) for _ in range(rng.randrange(0, 4)))
        if "<article" in story or "<main" in story:
            # plain words beside a real story
            beside = rng.choice(["", "", f"<p>{_words(rng, rng.randrange(2, 9))}</p>", f"<div>{_words(rng, rng.randrange(2, 9))}</div>"])
        else:
            card = f'<article class="{rng.choice(CARDS)}"><p>{_words(rng, rng.randrange(2, 9))}</p></article>'
            beside = rng.choice(["", "", card, f"<aside>{card}</aside>", '<p><a href="/">' + _words(rng, 2) + '</a> | <a href="/">' + _words(rng, 1) + "</a></p>"])
        out.append(f"<html><body>{before}{story}{beside}{after}</body></html>" if rng.random() < 0.5 else f"<html><body>{before}{beside}{story}{after}</body></html>")
    return out
