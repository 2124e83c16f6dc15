"""Labelled pages to train the block classifier on: composed from templates with invented
words, each text block marked as article or not."""

from __future__ import annotations

import random
import re
from html import escape

SYLLABLES = "an ba cor de el fi gan her in jo ka lor men no os pe qui ra sen tor un ve wi xa yo zu sch keit ção ñe ée über".split()


class PageMaker:
    """Draws pages; `texts` collects (block text, is article) in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        return self.words(low, high).capitalize() + self.r.choice((".", ".", ".", "!", "?"))

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def put(self, text: str, label: int, tag: str, attrs: str = "", inside: str | None = None) -> str:
        """One leaf block."""
        self.texts.append((" ".join(text.split()), label))
        return f"<{tag}{attrs}>{inside or escape(text)}</{tag}>"

    def name(self, *choices: str) -> str:
        """A class or id attribute, at times none."""
        r = self.r
        if r.random() < 0.25:
            return ""
        word = r.choice(choices)
        return f' {r.choice(("class", "class", "id"))}="{r.choice((word, word + "-" + r.choice(("box", "wrap", "area", "inner", "block")), "site-" + word, word + " clearfix"))}"'

    def links(self, low: int, high: int, label: int = 0) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            t = self.words(1, 3)
            out.append(self.put(t, label, "li", inside=f'<a href="/x">{escape(t)}</a>'))
        return "<ul>" + "".join(out) + "</ul>"

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div"))
        return f"<{tag}{self.name('nav', 'menu', 'navbar', 'breadcrumb', 'toc')}>" + self.links(3, 8) + f"</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "div"))
        body = self.put(self.words(1, 4), 0, self.r.choice(("div", "p", "h1", "h2")), self.name("logo", "title", "brand", "tagline"))
        return f"<{tag}{' class=' + chr(34) + 'header' + chr(34) if tag == 'div' else self.name('header', 'masthead', 'top')}>" + body + (self.menu() if self.r.random() < 0.5 else "") + f"</{tag}>"

    def advert(self) -> str:
        word = self.r.choice(("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"))
        tag = self.r.choice(("div", "div", "aside", "section"))
        attr = f' class="{self.r.choice((word, word + " " + "box", word + "-slot"))}"'
        if self.r.random() < 0.6:
            return self.put(self.prose(1, 2), 0, tag, attr)
        return f"<{tag}{attr}>" + "".join(self.put(self.prose(1, 2), 0, "p") for _ in range(self.r.randint(1, 2))) + f"</{tag}>"

    def notice(self) -> str:
        word = self.r.choice(("cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "disclaimer", "message"))
        return f'<div class="{word}{self.r.choice(("", "-bar", "-banner"))}"' + self.r.choice(("", ' role="alert"', ' role="dialog"')) + ">" + self.put(self.prose(1, 3), 0, "p") + (self.put(self.words(1, 2), 0, "button") if self.r.random() < 0.5 else "") + "</div>"

    def form(self) -> str:
        body = self.put(self.words(2, 8), 0, self.r.choice(("p", "h3", "div", "legend")))
        body += "".join(f"<div>{self.put(self.words(1, 3), 0, 'p')}<input name='a'></div>" for _ in range(self.r.randint(1, 3)))
        return f"<form{self.name('search', 'newsletter', 'subscribe', 'login', 'contact', 'signup')}>" + body + self.put(self.words(1, 2), 0, "button") + "</form>"

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        attr = self.name("sidebar", "widget", "related", "rail") if tag == "aside" else f' class="{self.r.choice(("sidebar", "widget", "related", "recommended", "side", "popular", "trending", "rail"))}"'
        body = self.put(self.words(1, 3), 0, self.r.choice(("h2", "h3", "h4"))) if self.r.random() < 0.8 else ""
        body += "".join(self.put(self.prose(1, 3), 0, "p") for _ in range(self.r.randint(0, 3)))
        body += self.links(2, 6) if self.r.random() < 0.6 else ""
        return f"<{tag}{attr}>" + body + f"</{tag}>"

    def comments(self) -> str:
        tag = self.r.choice(("section", "div", "div", "ol"))
        word = self.r.choice(("comments", "comment-list", "responses", "discussion", "disqus", "replies", "reader-comments"))
        item = self.r.choice(("div", "article", "li"))
        body = self.put(f"{self.r.randint(1, 99)} " + self.words(1, 2), 0, "h3") if tag != "ol" and self.r.random() < 0.7 else ""
        for _ in range(self.r.randint(1, 5)):
            inner = self.put(self.words(1, 2), 0, self.r.choice(("div", "p", "h4")), self.name("author", "user", "meta")) if self.r.random() < 0.6 else ""
            inner += "".join(self.put(self.prose(1, 5), 0, "p") for _ in range(self.r.randint(1, 2)))
            body += f'<{item}{self.name("comment", "reply", "response")}>' + inner + f"</{item}>"
        return f'<{tag} {self.r.choice(("class", "id"))}="{word}">' + body + f"</{tag}>"

    def share(self) -> str:
        return f'<div class="{self.r.choice(("share", "social", "share-buttons", "tags", "follow"))}">' + self.links(2, 4) + "</div>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        attr = f' class="{self.r.choice(("footer", "copyright", "colophon"))}"' if tag == "div" else self.name("footer", "copyright", "bottom")
        if self.r.random() < 0.5:
            t = "© " + self.words(1, 3) + " · " + self.prose(1, 2)
            return self.put(t, 0, tag, attr, escape(t).replace("©", "&copy;").replace("·", "&middot;"))
        body = "".join(self.put(self.prose(1, 2), 0, "p") for _ in range(self.r.randint(1, 2)))
        return f"<{tag}{attr}>" + body + (self.links(2, 5) if self.r.random() < 0.5 else "") + f"</{tag}>"

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            title = self.put(self.words(1, 12).capitalize() + r.choice(("", ".", "")), 1, r.choice(("h1", "h1", "h2")))
            parts.append(f"<header>{title}</header>" if r.random() < 0.12 else title)
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.66:
                text = r.choice((self.prose(1, 8), self.prose(1, 3), self.words(1, 3).capitalize() + ".", self.words(3, 200)))
                if r.random() < 0.15:
                    mid = self.words(1, 3)
                    inside = f'{escape(text)} <a href="/y">{escape(mid)}</a> {r.choice(("<b>", "<em>", "<span>"))}{escape(self.words(0, 2))}'
                    self.texts.append((" ".join(re.sub(r"<[^>]*>", "", inside).split()), 1))
                    parts.append(f"<p>{inside}</p>")
                else:
                    parts.append(self.put(text, 1, "p"))
            elif kind < 0.74:
                parts.append(self.put(self.words(1, 8), 1, r.choice(("h2", "h3", "h4"))))
            elif kind < 0.80:
                parts.append("<blockquote>" + self.put(self.prose(1, 3), 1, "p") + "</blockquote>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(self.put(self.words(2, 14), 1, "li") for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                parts.append("<table>" + "".join("<tr>" + "".join(self.put(self.words(1, 3), 1, "td") for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.91:
                parts.append(self.put(self.words(4, 20), 1, "pre"))
            elif kind < 0.94:
                parts.append(self.advert())
            elif kind < 0.96:
                parts.append(self.sidebar())
            elif kind < 0.98:
                parts.append(self.form())
            else:
                parts.append(self.notice())
        if r.random() < 0.15:
            parts.append(self.share())
        if r.random() < 0.1:
            parts.append(self.comments())
        shape = r.random()
        if shape < 0.5:
            return f"<article{self.name('post', 'article', 'entry') if r.random() < 0.4 else ''}>" + "".join(parts) + "</article>"
        if shape < 0.65:
            return "<main>" + "".join(parts) + "</main>"
        word = r.choice(("content", "article", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "text", "body"))
        return f'<div {r.choice(("class", "id"))}="{word}">' + "".join(parts) + "</div>"

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        self.texts: list[tuple[str, int]] = []
        before = [f for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.sidebar, 0.2), (self.form, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.share, 0.2), (self.advert, 0.2), (self.sidebar, 0.35), (self.comments, 0.4), (self.form, 0.2), (self.footer, 0.85), (self.notice, 0.1)) if r.random() < p]
        if r.random() < 0.4:
            r.shuffle(before)
        html = "<!DOCTYPE html><html><head><title>x</title></head><body>"
        html += "".join(f() for f in before) + self.article() + "".join(f() for f in after) + "</body></html>"
        return html, self.texts


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[tuple[str, int]]]]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(count)]
