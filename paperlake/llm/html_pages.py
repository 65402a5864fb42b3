"""Web pages with known main text, made by rule: the labelled rows that the extractor is fitted on.

Every page is drawn from a seeded generator: a layout of wrappers, headers,
menus, notices, adverts, side columns, forms, comments and footers around one
article. Labels come from the generator, not from tag or class names, and both
plain and telling names occur on either side.
"""

from __future__ import annotations

import random

_MAIN_NAMES = ("content", "article", "post", "main", "entry-content", "story", "post-body", "page-content", "text", "article-body")
_PLAIN_NAMES = ("", "", "", "container", "wrapper", "row", "col", "inner", "block", "section", "box")
_OTHER_NAMES = {
    "header": ("header", "site-header", "masthead", "top-bar", "banner", "page-header", "branding"),
    "nav": ("nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "navigation", "pagination"),
    "notice": ("cookie-notice", "notice", "alert", "cookie-banner", "gdpr", "message", "consent", "popup"),
    "ad": ("ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot", "banner-ad"),
    "side": ("sidebar", "aside", "widget", "related", "side", "most-read", "tags", "recommended"),
    "share": ("share", "social", "share-bar", "follow-us", "byline-share"),
    "comments": ("comments", "comment-list", "responses", "discussion", "replies", "comment"),
    "form": ("newsletter", "subscribe", "search-form", "signup", "login", "contact-form"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "colophon", "page-footer"),
}


class PageMaker:
    """``page()`` gives HTML in which attribute ``data-main`` marks the elements that hold main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        parts = ("the", "of", "an", "er", "tion", "ing", "ou", "st", "re", "le", "de", "un", "ß", "é", "ción", "ung", "is", "ha")
        found = ["".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
        if r.random() < 0.1:  # odd texts are main text as well
            mark = r.choice(("***", "!!", " |", "%%%"))
            found = [w.upper() + mark for w in found]
        return " ".join(found).capitalize()

    def sentences(self, n: int) -> str:
        return " ".join(self.words(2, 16) + self.r.choice((".", ".", ".", "?", ",", "")) for _ in range(n))

    def named(self, kind: str) -> str:
        """Attributes for an element that is not main text."""
        r = self.r
        if r.random() < 0.2:
            return r.choice(("", ' class="block"', ' class="box"', ' class="inner"'))
        return f' {r.choice(("class", "class", "id"))}="{r.choice(_OTHER_NAMES[kind])}{r.choice(("", "", " left", " clearfix"))}"'

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>'

    def menu(self) -> str:
        r = self.r
        if r.random() < 0.7:
            close = r.choice(("</li>", "</li>", ""))
            return f"<ul>{''.join(f'<li>{self.link()}{close}' for _ in range(r.randint(2, 12)))}</ul>"
        return r.choice((" | ", " ", " &gt; ")).join(self.link() for _ in range(r.randint(2, 8)))

    def other(self, kind: str) -> str:
        r, n = self.r, self.named(kind)
        if kind == "header":
            inner = r.choice(("", f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.link()}</div>", f"<p>{self.words(2, 6)}</p>"))
            return f"<{(t := r.choice(('header', 'div')))}{n}>{inner}{self.other('nav') if r.random() < 0.6 else self.link()}</{t}>"
        if kind == "nav":
            return f"<{(t := r.choice(('nav', 'nav', 'div', 'ul')))}{n if t != 'nav' or r.random() < 0.5 else ''}>{self.menu()}</{t}>"
        if kind == "notice":
            return f"<div{n}><p>{r.choice(('We use cookies. ', '', 'Notice: '))}{self.sentences(r.randint(1, 2))}</p>{r.choice(('', '<button>OK</button>', self.link()))}</div>"
        if kind == "ad":
            inner = r.choice((self.sentences(1), self.sentences(2), self.link(), f"<p>{self.sentences(1)}</p>", f'<img src="x">{self.words(1, 5)}'))
            return f"<div{n}>{inner}</div>"
        if kind == "side":
            blocks = "".join(
                f"<div{self.named('side')}><h3>{self.words(1, 3)}</h3>{r.choice((self.menu(), f'<p>{self.sentences(2)}</p>', f'<p>{self.link()}</p>'))}</div>"
                for _ in range(r.randint(1, 3))
            )
            return f"<{(t := r.choice(('aside', 'aside', 'div')))}{n if t == 'div' or r.random() < 0.5 else ''}>{blocks}</{t}>"
        if kind == "share":
            return f"<{(t := r.choice(('ul', 'div')))}{n}>{''.join(f'<li>{self.link()}</li>' if t == 'ul' else self.link() for _ in range(r.randint(2, 5)))}</{t}>"
        if kind == "comments":
            items = "".join(
                f"<{(t := r.choice(('div', 'li', 'article')))} class=\"{r.choice(('comment', 'comment-body', 'reply'))}\"><p>{self.words(1, 2)}</p>"
                f"{''.join(f'<p>{self.sentences(r.randint(1, 4))}</p>' for _ in range(r.randint(1, 2)))}</{t}>"
                for _ in range(r.randint(1, 6))
            )
            return f"<{(t := r.choice(('section', 'div', 'ol')))} {r.choice(('class', 'id'))}=\"{r.choice(_OTHER_NAMES['comments'])}\"><h3>{self.words(1, 2)}</h3>{items}</{t}>"
        if kind == "form":
            return f"<form{n}><p>{self.words(2, 8)}</p><label>{self.words(1, 2)}</label><input type=\"text\"><button>{self.words(1, 2)}</button></form>"
        inner = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1)}", f"<p>&copy; {self.words(2, 8)}</p>", self.menu() + f"<p>{self.words(2, 9)}</p>"))
        return f"<{(t := r.choice(('footer', 'footer', 'div')))}{n if t == 'div' or r.random() < 0.4 else ''}>{inner}</{t}>"

    def block(self) -> str:
        """One block of an article, marked as main text."""
        r, m = self.r, ' data-main="1"'
        kind = r.random()
        if kind < 0.72:
            text = self.sentences(r.choice((1, 1, 2, 3, 5, 8)))
            if r.random() < 0.15:
                text += " " + self.link() + " " + self.words(1, 9)
            if r.random() < 0.15:
                return f"<p{m}><b>{text}<br>"
            return f"<p{m}>{text}{r.choice(('</p>', '</p>', '</p>', ''))}"
        if kind < 0.82:
            return f"<{(t := r.choice(('h2', 'h3', 'h4')))}{m}>{self.words(1, 8)}</{t}>"
        if kind < 0.9:
            items = "".join(f"<li{m}>{self.words(1, 15)}{r.choice(('', '.'))}</li>" for _ in range(r.randint(2, 6)))
            return f"<{(t := r.choice(('ul', 'ol')))}{m}>{items}</{t}>"
        if kind < 0.94:
            return f"<blockquote{m}><p{m}>{self.sentences(2)}</p></blockquote>"
        if kind < 0.97:
            return f"<pre{m}>{self.words(3, 20)}</pre>"
        cells = "".join(f"<tr{m}><td{m}>{self.words(1, 3)}</td><td{m}>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4)))
        return f"<table{m}>{cells}</table>"

    def article(self) -> str:
        r, m = self.r, ' data-main="1"'
        blocks = [self.block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 25)))]
        if r.random() < 0.75:
            blocks.insert(0, f"<{(t := r.choice(('h1', 'h1', 'h2')))}{m}>{self.words(1, 12)}</{t}>")
        for kind, odds in (("ad", 0.25), ("share", 0.2), ("notice", 0.05), ("form", 0.08), ("side", 0.06)):
            if r.random() < odds:
                blocks.insert(r.randint(0, len(blocks)), self.other(kind))
        text = "".join(blocks)
        if r.random() < 0.12:  # blocks that stand in the page itself
            return text
        for _ in range(r.choice((0, 0, 1, 2))):
            name = r.choice(_MAIN_NAMES + _PLAIN_NAMES)
            text = f"<div{m}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{text}</div>"
        tag, name = r.choice((("article", ""), ("article", "post"), ("main", ""), ("div", r.choice(_MAIN_NAMES)), ("div", ""), ("section", r.choice(_MAIN_NAMES))))
        return f"<{tag}{m}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{text}</{tag}>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.05:  # nothing but text
            return f"<html><body>{self.article()}</body></html>"
        odds = {"header": 0.5, "nav": 0.6, "notice": 0.3, "ad": 0.5}
        before = "".join(self.other(k) for k, p in odds.items() if r.random() < p)
        after = [self.other(k) for k, p in (("comments", 0.35), ("side", 0.4), ("form", 0.2), ("ad", 0.2), ("nav", 0.1), ("share", 0.1)) if r.random() < p]
        r.shuffle(after)
        middle = self.article()
        if r.random() < 0.3:
            middle = (self.other("side") + middle) if r.random() < 0.5 else (middle + self.other("side"))
        for _ in range(r.choice((0, 0, 1, 2))):
            name = r.choice(_PLAIN_NAMES + _MAIN_NAMES[:1])
            middle = f"<div data-main=\"1\"{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{middle}</div>"
        body = before + middle + "".join(after) + (self.other("footer") if r.random() < 0.8 else "")
        if r.random() < 0.3:
            body = f'<div data-main="1" id="page">{body}</div>'
        head = f"<head><title>{self.words(1, 8)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}{r.choice(('</body></html>', ''))}"


def labelled_pages(n: int, seed: int) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
