"""Labelled training pages, generated: boilerplate of many kinds around articles in many layouts.

Elements that hold the article carry ``data-label="1"``; the trainer reads the marks, the features don't.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ter ven dor sal in ra te po que sch ou er an the ion ung".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentence(r: random.Random) -> str:
    return _words(r, r.randint(1, 25)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def _prose(r: random.Random) -> str:
    text = " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 4, 8, 16])))
    if r.random() < 0.25:
        text += f' <a href="/x">{_words(r, r.randint(1, 4))}</a> {_sentence(r)}'
    return text


def _named(r: random.Random, tags: list[str], names: list[str]) -> tuple[str, str]:
    tag = r.choice(tags)
    how = r.choice(["class", "class", "id", ""] if tag not in ("div", "section", "p", "ul") else ["class", "class", "id"])
    name = r.choice(["", "site-", "main-", "page-", "top-", "js-"]) + r.choice(names) + r.choice(["", "", "-box", "-wrap", "-list", "s"])
    return (f'<{tag} {how}="{name}">' if how else f"<{tag}>"), f"</{tag}>"


def _links(r: random.Random) -> str:
    items = [f'<a href="/{i}">{_words(r, r.randint(1, 3))}</a>' for i in range(r.randint(2, 9))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " "]).join(items)


def _boiler(r: random.Random, where: str) -> str:
    kind = r.choice({"top": ["nav", "header", "ad", "notice", "crumb", "form"], "mid": ["ad", "ad", "share", "form", "notice", "related"], "end": ["footer", "aside", "ad", "comments", "related", "form", "nav", "notice", "legal"]}[where])
    if kind == "nav":
        a, b = _named(r, ["nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "navigation-links"])
        return a + (_links(r) if not a.startswith("<ul") else "".join(f"<li><a href='/'>{_words(r, 2)}</a></li>" for _ in range(5))) + b
    if kind == "header":
        a, b = _named(r, ["header", "div"], ["header", "masthead", "banner", "topbar", "logo"])
        return a + r.choice([f"<h1>{_words(r, 3)}</h1>", f"<p>{_sentence(r)}</p>", _words(r, 4), _links(r)]) + b
    if kind == "ad":
        a, b = _named(r, ["div", "div", "aside", "p", "section"], ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "sponsored"])
        return a + r.choice([_sentence(r), f"<p>{_prose(r)}</p>" if not a.startswith("<p") else _prose(r), f'<a href="/buy">{_words(r, 5)}</a>']) + b
    if kind == "notice":
        a, b = _named(r, ["div", "section", "aside", "div"], ["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "newsletter", "popup", "modal", "subscribe"])
        return a + f"<p>{_prose(r)}</p>" + r.choice(["", "<button>OK</button>"]) + b if r.random() < 0.6 else a + _sentence(r) + b
    if kind == "crumb":
        a, b = _named(r, ["div", "ul", "nav"], ["breadcrumb", "crumbs"])
        return a + "".join(f"<li><a href='/'>{_words(r, 1)}</a></li>" for _ in range(3)) + b
    if kind == "form":
        return f'<form action="/s"><label>{_words(r, 2)}</label><input name="q"><p>{_sentence(r)}</p><button>{_words(r, 1)}</button></form>'
    if kind == "share":
        a, b = _named(r, ["div", "ul"], ["share", "social", "sharing", "toolbar"])
        return a + _links(r).replace("<ul>", "").replace("</ul>", "") + b
    if kind == "related":
        a, b = _named(r, ["div", "section", "aside"], ["related", "recommended", "more", "teaser", "popular", "trending"])
        return a + f"<h3>{_words(r, 2)}</h3>" + _links(r) + r.choice(["", f"<p>{_sentence(r)}</p>"]) + b
    if kind == "comments":
        a, b = _named(r, ["div", "section", "ol", "ul"], ["comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses"])
        inner = "".join(f'<{x} class="comment"><p>{_prose(r)}</p></{x}>' for x in [r.choice(["div", "li", "article"])] * r.randint(1, 5))
        return a + r.choice([f"<h3>{_words(r, 1)}</h3>", ""]) + inner + b
    if kind == "aside":
        a, b = _named(r, ["aside", "div"], ["sidebar", "side", "widget", "aside", "rail"])
        return a + r.choice([f"<h3>{_words(r, 2)}</h3>", ""]) + r.choice([_links(r), f"<p>{_prose(r)}</p>", _sentence(r)]) + b
    a, b = _named(r, ["footer", "div", "footer"], ["footer", "copyright", "legal", "bottom", "disclaimer", "footnote-bar"])
    return a + r.choice([f"&copy; {_words(r, 1)}.example &middot; {_sentence(r)}", f"<p>{_sentence(r)}</p>" + _links(r), _links(r)]) + b


def _article(r: random.Random) -> str:
    mark = ' data-label="1"'
    out = [f"<h1{mark}>{r.choice([_sentence(r), _words(r, 6)])}</h1>"] if r.random() < 0.85 else []
    if r.random() < 0.15:
        out = [f"<header{mark}>{''.join(out)}<p{mark}>{_sentence(r)}</p></header>"]
    for _ in range(r.choice([1, 2, 4, 7, 12])):
        k = r.random()
        if k < 0.72:
            out.append(f"<p{mark}>{_prose(r)}</p>" if r.random() < 0.85 else f"<p{mark}><b>{_prose(r)}<br>")
        elif k < 0.80:
            out.append(f"<h2{mark}>{_words(r, 4)}</h2>")
        elif k < 0.86:
            out.append(f"<ul{mark}>" + "".join(f"<li{mark}>{_sentence(r)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif k < 0.90:
            out.append(f"<blockquote{mark}><p{mark}>{_prose(r)}</p></blockquote>")
        elif k < 0.93:
            out.append(f"<table{mark}><tr{mark}><td{mark}>{_words(r, 2)}</td><td{mark}>{_sentence(r)}</td></tr></table>")
        elif k < 0.95:
            out.append(f"<pre{mark}>{_words(r, 8)}</pre>")
        elif k < 0.97:
            out.append(f"<div{mark}>{_prose(r)}</div>")
        else:
            out.append(_boiler(r, "mid"))
    wrap = r.choice(["article", "article", "main", "div-c", "div-c", "div", "section"])
    names = ["content", "article", "post", "entry", "story", "main", "body", "text", "post-body", "article-body", "entry-content"]
    start = f'<div class="{r.choice(names)}"{mark}>' if wrap == "div-c" else f"<{wrap}{mark}>"
    inner = start + "".join(out) + f"</{wrap.split('-')[0]}>"
    if r.random() < 0.25:
        inner = f"<main{mark}>{inner}</main>"
    elif r.random() < 0.25:
        inner = f'<div id="{r.choice(["wrapper", "page", "container", "content"])}"{mark}>{_boiler(r, "top")}{inner}{_boiler(r, "end")}</div>'
    return inner


def page(seed: int) -> str:
    r = random.Random(seed)
    top = "".join(_boiler(r, "top") for _ in range(r.randint(0, 4)))
    end = "".join(_boiler(r, "end") for _ in range(r.randint(0, 5)))
    tail = r.choice(["</body></html>", "</body></html>", ""])
    return f'<!DOCTYPE html><html><head><title>{_words(r, 4)}</title><style>p{{}}</style></head><body data-label="1">{top}{_article(r)}{end}{tail}'


def pages(n: int = 400) -> list[str]:
    return [page(i) for i in range(n)]
