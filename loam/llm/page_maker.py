"""Pages with known main text, to learn from. Words of main text hold a q, others don't;
the features of nodes don't see letters."""

from __future__ import annotations

import numpy as np

from .dom import Node

OPAQUE = "c1 x7 wrap inner box col row container u-12 grid css-k2 block outer item unit".split()


def labels(nodes: list[Node]) -> np.ndarray:
    """Whether each node is or holds a run of main text."""
    out = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):
        out[i] |= "q" in nodes[i].text
        if out[i] and nodes[i].parent >= 0:
            out[nodes[i].parent] = True
    return out


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *of: str) -> str:
        return of[self.rng.integers(len(of))]

    def word(self, main: bool) -> str:
        letters = self.rng.integers(0, 15, self.rng.integers(1, 9))
        return "".join("abcdefghijklmno"[x] for x in letters) + ("q" if main else "")

    def words(self, n: int, main: bool, stops: float = 0.12) -> str:
        return " ".join(self.word(main) + (self.pick(".", ",", ".", "!") if self.chance(stops) else "") for _ in range(n))

    def size(self, few: int, many: int) -> int:
        return int(np.exp(self.rng.uniform(np.log(few), np.log(many + 1))))

    def named(self, tag: str, *names: str) -> str:
        """An opening tag; mostly with a telling class or id, else an opaque one or none."""
        r = self.rng.random()
        if names and r < 0.5:
            name = self.pick(*names)
            if self.chance(0.3):
                name = self.pick(*OPAQUE) + self.pick("-", "_", " ") + name
            return f'<{tag} {self.pick("class", "class", "id")}="{name}">'
        return f'<{tag} class="{self.pick(*OPAQUE)}">' if r < 0.7 else f"<{tag}>"

    def links(self, n: int, tag: str = "li") -> str:
        one = lambda: f'<a href="/{self.word(False)}">{self.words(self.size(1, 4), False, 0)}</a>'
        if tag == "li":
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return self.pick(" ", " | ", "").join(one() for _ in range(n))

    def para(self, main: bool) -> str:
        n = self.size(1, 150) if main else self.size(4, 40)
        text = self.words(n, main)
        if self.chance(0.25):
            cut = text.split(" ")
            i = int(self.rng.integers(len(cut)))
            cut[i] = self.pick("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "{}<br>", "<span>{}</span>", "<b>{}").format(cut[i])
            text = " ".join(cut)
        return f"<p>{text}" + ("</p>" if self.chance(0.9) else "")

    def menu(self) -> str:
        tag = self.pick("nav", "nav", "div", "ul", "section")
        return self.named(tag, "nav", "menu", "navbar", "main-nav", "breadcrumbs", "toc", "site-navigation") + self.links(self.size(2, 12), self.pick("li", "li", "a")) + f"</{tag}>"

    def header(self) -> str:
        tag = self.pick("header", "header", "div")
        title = self.pick("h1", "div", "p", "h2")
        inner = f"<{title}>{self.words(self.size(1, 5), False, 0)}</{title}>" + (f"<p>{self.words(self.size(2, 40), False)}</p>" if self.chance(0.4) else "") + (self.menu() if self.chance(0.5) else "")
        return self.named(tag, "header", "site-header", "masthead", "top", "banner", "logo") + inner + f"</{tag}>"

    def footer(self) -> str:
        tag = self.pick("footer", "footer", "div")
        inner = f"&copy; {self.words(self.size(1, 90), False)}"
        if self.chance(0.5):
            inner = f"<p>{inner}</p>" + (self.links(self.size(1, 8)) if self.chance(0.6) else "")
        return self.named(tag, "footer", "site-footer", "bottom", "colophon", "copyright", "legal") + inner + f"</{tag}>"

    def side(self) -> str:
        tag = self.pick("aside", "aside", "div", "section")
        inner = "".join(self.pick(f"<h3>{self.words(2, False, 0)}</h3>" + self.links(self.size(2, 8)), f"<p>{self.words(self.size(3, 120), False)}</p>", self.advert()) for _ in range(self.rng.integers(1, 4)))
        return self.named(tag, "sidebar", "side", "widget", "related", "recommended", "trending", "secondary", "rail") + inner + f"</{tag}>"

    def advert(self) -> str:
        tag = self.pick("div", "div", "aside", "section", "p")
        inner = self.words(self.size(1, 90), False)
        if tag != "p" and self.chance(0.4):
            inner = f"<p>{inner}</p>"
        name = self.pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor")
        return f'<{tag} class="{name}">{inner}</{tag}>'

    def notice(self) -> str:
        tag = self.pick("div", "div", "section", "aside", "p")
        inner = self.words(self.size(4, 90), False)
        if tag != "p":
            inner = f"<p>{inner}</p>" + (f"<button>{self.word(False)}</button>" if self.chance(0.6) else "")
        name = self.pick("cookie", "cookie-banner", "consent", "notice", "notification", "alert", "gdpr", "popup", "newsletter", "disclaimer", "paywall")
        return f'<{tag} {self.pick("class", "id", "role")}="{name}">{inner}</{tag}>'

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(self.size(1, 3), False, 0)}</label><input name=a>" for _ in range(self.rng.integers(1, 4)))
        return self.named("form", "search", "login", "subscribe", "contact", "signup") + (f"<p>{self.words(self.size(3, 20), False)}</p>" if self.chance(0.4) else "") + fields + f"<button>{self.word(False)}</button></form>"

    def comments(self) -> str:
        tag, each = self.pick("section", "div", "ol", "ul", "aside"), self.pick("div", "article", "li", "p")
        body = lambda: self.pick(f"<p>{self.words(self.size(3, 80), False)}</p>", self.words(self.size(3, 80), False))
        many = "".join(f'<{each} class="{self.pick("comment", "reply", "comment-body", "response")}">' + (f"<h4>{self.word(False)}</h4>" if self.chance(0.4) else "") + body() + f"</{each}>" for _ in range(self.size(1, 8)))
        head = f"<h2>{self.words(self.size(1, 3), False, 0)}</h2>" if self.chance(0.6) else ""
        return f'<{tag} {self.pick("class", "id")}="{self.pick("comments", "comment-list", "responses", "replies", "discussion", "reader-comments", "disqus")}">{head}{many}</{tag}>'

    def share(self) -> str:
        return self.named("div", "share", "social", "share-buttons", "tags", "related", "byline", "meta") + self.links(self.size(1, 5), self.pick("li", "a")) + "</div>"

    def story(self) -> str:
        """Blocks of main text, and now and then something that isn't any among them."""
        out = [f"<h1>{self.words(self.size(1, 12), True, 0)}</h1>"] if self.chance(0.85) else []
        if out and self.chance(0.1):
            out[0] = f"<header>{out[0]}</header>"
        for _ in range(self.size(1, 18)):
            r = self.rng.random()
            if r < 0.76:
                out.append(self.para(True))
            elif r < 0.83:
                h = self.pick("h2", "h2", "h3", "h4")
                out.append(f"<{h}>{self.words(self.size(1, 8), True, 0)}</{h}>")
            elif r < 0.87:
                tag = self.pick("ul", "ol")
                out.append(f"<{tag}>" + "".join(f"<li>{self.words(self.size(1, 20), True)}</li>" for _ in range(self.rng.integers(2, 7))) + f"</{tag}>")
            elif r < 0.90:
                out.append(f"<blockquote>{self.para(True)}</blockquote>")
            elif r < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(self.size(1, 4), True, 0)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rng.integers(2, 5))) + "</table>")
            elif r < 0.94:
                out.append(f'<figure><img src="a.png"><figcaption>{self.words(self.size(2, 12), True)}</figcaption></figure>')
            elif r < 0.95:
                out.append(f"<pre>{self.words(self.size(3, 30), True, 0)}</pre>")
            elif r < 0.96:
                out.append(f"<div>{self.words(self.size(3, 60), True)}</div>")
            else:
                out.append(self.pick(self.advert(), self.share(), self.notice(), self.form(), self.side()))
        return "".join(out)

    def page(self) -> str:
        r = self.rng.random()
        if r < 0.6:
            main = self.named("article", "post", "article", "entry", "story") if self.chance(0.3) else "<article>"
            main += self.story() + "</article>"
        elif r < 0.8:
            main = self.named("div", "post-content", "article-body", "entry-content", "content", "story", "main", "text", "post") + self.story() + "</div>"
        elif r < 0.9:
            main = self.named("main", "content", "main") + self.story() + "</main>"
        else:
            main = self.story()
        others = [f for f in (self.menu, self.header, self.advert, self.notice, self.side, self.form, self.menu, self.share) if self.chance(0.4)]
        after = [f for f in (self.comments, self.side, self.share, self.advert, self.form, self.notice) if self.chance(0.4)]
        inside = [f for f in (self.comments, self.share, self.advert) if self.chance(0.08)]
        if inside and main.endswith(">") and r < 0.9:
            cut = main.rindex("</")
            main = main[:cut] + "".join(f() for f in inside) + main[cut:]
        if self.chance(0.3):
            main = f"<main>{main}</main>" if r < 0.8 else main
        body = "".join(f() for f in others) + main + "".join(f() for f in after) + (self.footer() if self.chance(0.8) else "")
        for _ in range(self.rng.integers(0, 3)):
            body = self.named("div", "page", "wrapper") + body + "</div>" if self.chance(0.5) else body
        return f"<html><head><title>{self.words(3, False)}</title></head><body>{body}</body></html>"


def page(rng: np.random.Generator) -> str:
    return _Maker(rng).page()
