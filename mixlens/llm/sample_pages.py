"""Labelled pages to learn from, made from a seed: many layouts, with each text block known to be article or not."""

from __future__ import annotations

import random

_SYLLABLES = "ba be bi bo da de di do fa fe ga go ka ke la le li lo ma me mi na ne no pa pe ra re ri ro sa se si so ta te ti to va ve za zu ön és ñar tion ment ung the and".split()
#: Attribute names that sites use for each part of a page.
_NAMES = {
    "main": "content article post entry-content story-body main page-content text article-body prose".split(),
    "nav": "nav menu navbar main-menu navigation topnav breadcrumb".split(),
    "header": "header masthead site-header topbar page-head".split(),
    "footer": "footer site-footer bottom copyright legal".split(),
    "ad": "ad ads advert banner sponsored promo ad-slot advertisement".split(),
    "side": "sidebar side widget related rail recommended trending aside".split(),
    "notice": "cookie-notice consent alert notice gdpr-banner newsletter popup modal".split(),
    "comments": "comments comment-list discussion reader-comments replies disqus".split(),
    "share": "share social tools share-buttons follow".split(),
}
_CONTENT, _OTHER = "\x01", "\x02"


class Maker:
    """Pages whose text blocks begin with a mark: \\x01 for the article, \\x02 for the rest."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.r.choice(". . . ! ? ; .\n".split(" "))

    def prose(self, low: int = 1, high: int = 7) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        style = self.r.random()
        if style < 0.05:
            text = text.upper().replace(" ", "!! ")
        elif style < 0.1:
            text = " ".join(w + self.r.choice(["###", "%%%", "***", "&amp;&amp;"]) for w in text.split())
        elif style < 0.13:
            text = text.replace(" ", " | ")
        return text

    def attributes(self, part: str, hidden: float = 0.25) -> str:
        name = self.r.choice(_NAMES[part]) if self.r.random() > hidden else self.word() + self.r.choice(["", "-x", "__y"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def element(self, tags: str, part: str, body: str, bare: float = 0.2) -> str:
        tag = self.r.choice(tags.split())
        given = "" if tag not in ("div", "section", "ul") and self.r.random() < bare else self.attributes(part)
        return f"<{tag}{given}>{body}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{_OTHER}{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice([" ", " | ", ""]).join(items)

    def nav(self) -> str:
        if self.r.random() < 0.25:
            return f"<{(tag := self.r.choice(['div', 'p', 'center']))}{self.attributes('nav', 0.7) if tag == 'div' else ''}>{self.links()}</{tag}>"
        return self.element("nav nav div ul", "nav", self.links())

    def advert(self) -> str:
        return self.element("div div aside section p", "ad", _OTHER + (self.prose(1, 2) if self.r.random() < 0.7 else f'<a href="#">{self.words(2, 8)}</a>'))

    def header(self) -> str:
        tag = self.r.choice(["div", "div", "h1", "p"])
        inner = f"<{tag}>{_OTHER}{self.words(1, 4)}</{tag}>" + (self.nav() if self.r.random() < 0.5 else f"<p>{_OTHER}{self.words(2, 8)}</p>")
        return self.element("header header div", "header", inner)

    def footer(self) -> str:
        parts = [f"<p>{_OTHER}&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}</p>", f"{_OTHER}&copy; {self.words(1, 3)} {self.prose(1, 2)}", self.links()]
        if self.r.random() < 0.15:
            return f"<{(tag := self.r.choice(['p', 'div', 'center']))}>{self.links(1, 4)}</{tag}>"
        return self.element("footer footer footer div", "footer", "".join(self.r.sample(parts, self.r.randint(1, 2))))

    def sidebar(self) -> str:
        cards = [f"<h3>{_OTHER}{self.words(1, 4)}</h3>" + (self.links() if self.r.random() < 0.6 else f"<p>{_OTHER}{self.prose(1, 2)}</p>") for _ in range(self.r.randint(1, 3))]
        return self.element("aside aside div section", "side", "".join(cards))

    def notice(self) -> str:
        return self.element("div div section aside dialog", "notice", f"<p>{_OTHER}{self.prose(1, 2)}</p>" + (f"<button>{_OTHER}{self.words(1, 2)}</button>" if self.r.random() < 0.6 else ""))

    def form(self) -> str:
        return f"<form><label>{_OTHER}{self.words(1, 3)}</label><input name=q>" + (f"<p>{_OTHER}{self.sentence()}</p>" if self.r.random() < 0.4 else "") + f"<button>{_OTHER}{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        one = lambda: self.element("div li article", "comments", f"<b>{_OTHER}{self.word()}</b><p>{_OTHER}{self.prose(1, 3)}</p>")
        return self.element("section div div", "comments", f"<h3>{_OTHER}{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5))), bare=0.0)

    def share(self) -> str:
        return self.element("div ul", "share", self.links(1, 4))

    def paragraph(self) -> str:
        text = self.prose()
        roll = self.r.random()
        if roll < 0.2:
            text = f"<b>{text}" + self.r.choice(["</b>", "<br>", "<br/>"])
        elif roll < 0.35:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.sentence()}'
        elif roll < 0.45:
            text = f"<span>{text}</span><br>{self.sentence()}"
        return f"<p>{_CONTENT}{text}" + ("</p>" if self.r.random() < 0.85 else "")

    def article(self) -> str:
        tag = self.r.choice(["h1", "h1", "h1", "h2", "h3"])
        parts = [f"<{tag}>{_CONTENT}{self.words(2, 10)}</{tag}>"] if self.r.random() < 0.8 else []
        if parts and self.r.random() < 0.2:
            parts = [f"<header>{parts[0]}<p>{_CONTENT}{self.words(2, 5)}</p></header>"]
        for _ in range(self.r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            roll = self.r.random()
            if roll < 0.74:
                parts.append(self.paragraph())
            elif roll < 0.8:
                parts.append(f"<h2>{_CONTENT}{self.words(1, 7)}</h2>")
            elif roll < 0.85:
                parts.append("<ul>" + "".join(f"<li>{_CONTENT}{self.sentence()}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif roll < 0.88:
                parts.append(f"<blockquote>{_CONTENT}{self.prose(1, 3)}</blockquote>")
            elif roll < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{_CONTENT}{self.words(1, 5)}<td>{_CONTENT}{self.words(1, 5)}" for _ in range(3)) + "</table>")
            elif roll < 0.92:
                parts.append(f"<figure><img src=x><figcaption>{_CONTENT}{self.sentence()}</figcaption></figure>")
            else:
                parts.append(f"<div>{_CONTENT}{self.prose()}</div>")
        if not parts:
            parts = [self.paragraph()]
        for extra, odds in ((self.advert, 0.2), (self.share, 0.15), (self.sidebar, 0.06), (self.form, 0.06), (self.notice, 0.05)):
            if self.r.random() < odds:
                parts.insert(self.r.randint(1, len(parts)), "</p>" + extra())
        if self.r.random() < 0.1:
            parts = [f"<div>{x}</div>" for x in parts]
        body = "".join(parts)
        roll = self.r.random()
        if roll < 0.35:
            return f"<article>{body}</article>" if self.r.random() < 0.7 else self.element("article", "main", body, bare=0.0)
        if roll < 0.45:
            return f"<main>{body}</main>"
        if roll < 0.6:  # nothing but the text tells it from the rest
            return body
        if roll < 0.65:
            return f"<table><tr><td>{self.links()}</td><td>{body}</td></tr></table>"
        return "".join(["<div>" * (deep := self.r.choice([0, 0, 0, 1, 3])), f"<{(tag := self.r.choice(['div', 'div', 'section']))}{self.attributes('main', 0.6)}>{body}</{tag}>", "</div>" * deep])

    def page(self) -> str:
        top = [f() for f, odds in ((self.header, 0.4), (self.nav, 0.75), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.15)) if self.r.random() < odds]
        self.r.shuffle(top)
        middle = [self.article()]
        for part, odds, first in ((self.sidebar, 0.4, 0.4), (self.comments, 0.3, 0.0), (self.advert, 0.2, 0.5), (self.share, 0.1, 0.3)):
            if self.r.random() < odds:
                middle.insert(0 if self.r.random() < first else len(middle), part())
        body = "".join(middle)
        if self.r.random() < 0.4:
            body = f"<div{self.attributes('main', 0.6)}>{body}</div>"
        bottom = [f() for f, odds in ((self.advert, 0.15), (self.notice, 0.1), (self.footer, 0.85)) if self.r.random() < odds]
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{''.join(top)}{body}{''.join(bottom)}</body></html>"
