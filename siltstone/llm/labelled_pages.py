"""Labelled pages: HTML whose main text is known, from which the extraction's weights are learned.

Pages are put together from parts that sites have in common (menus, notices, adverts, side columns,
comments, articles in several kinds of markup), drawn by a seeded generator. Every page comes as a list
of (markup, whether it is main text), whose joined markups are the page. Own pages can be labelled in
the same form and given to ``html.fit``.
"""

from __future__ import annotations

import random

Page = list[tuple[str, bool]]
_SYLLABLES = "ba den ti or lu sam ver no ki est ra pol mi gan te hu".split()
#: Names that sites give to the containers of each kind of part.
NAMES = {
    "ad": "ad ads advert advertisement sponsored promo banner".split(),
    "notice": "cookie-notice consent newsletter subscribe popup paywall alert".split(),
    "menu": "nav navbar menu breadcrumb pagination toolbar".split(),
    "side": "sidebar widget related recommended share-buttons trending tags".split(),
    "footer": "footer site-footer copyright".split(),
    "header": "site-header masthead topbar".split(),
    "comment": "comments comment-list responses replies".split(),
    "main": "content article-body post entry story post-content page-text".split(),
    "": "wrapper container row inner col box section block".split(),
}


class _Maker:
    def __init__(self, seed: int):
        self.pick = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        made = ["".join(self.pick.choices(_SYLLABLES, k=self.pick.randint(1, 4))) for _ in range(self.pick.randint(least, most))]
        return " ".join(made).capitalize() + "."

    def named(self, kind: str) -> str:
        return f'{self.pick.choice(("class", "class", "id"))}="{self.pick.choice(NAMES[kind])}"'

    def links(self, n: int) -> str:
        made = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n)]
        return "<ul><li>" + "</li><li>".join(made) + "</li></ul>" if self.pick.random() < 0.6 else " | ".join(made)

    def aside(self, kind: str) -> str:
        """A part that isn't main text."""
        if kind == "menu":
            tag, inner = self.pick.choice(("nav", f"div {self.named(kind)}", f"ul {self.named(kind)}")), self.links(self.pick.randint(3, 12))
        elif kind == "comment":
            tag, inner = f"{self.pick.choice(('div', 'section'))} {self.named(kind)}", "".join(f"<p><b>{self.words(1, 2)}</b> {self.words(3, 40)}</p>" for _ in range(self.pick.randint(1, 6)))
        elif kind == "side":
            tag, inner = self.pick.choice(("aside", f"div {self.named(kind)}")), f"<h3>{self.words(1, 3)}</h3>" + self.links(self.pick.randint(2, 8)) + self.pick.choice(("", f"<p>{self.words(5, 30)}</p>"))
        elif kind == "links":
            tag, inner = self.pick.choice(("div", f"div {self.named('')}", "table", "section")), self.links(self.pick.randint(3, 15))
        elif kind == "form":
            tag, inner = "form", f"<label>{self.words(1, 2)}</label><input name=q><button>{self.words(1, 1)}</button>"
        elif kind == "footer":
            tag, inner = self.pick.choice(("footer", f"div {self.named(kind)}")), f"&copy; {self.words(2, 12)} " + self.links(2)
        elif kind == "header":
            tag, inner = self.pick.choice(("header", f"div {self.named(kind)}")), f"<b>{self.words(1, 4)}</b>" + self.links(2)
        else:
            tag, inner = f"div {self.named(kind)}", self.words(3, 30) + self.pick.choice(("", '<a href="/x">More</a>', "<button>Yes</button>"))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def prose(self) -> str:
        made = self.words(15, 90)
        if self.pick.random() < 0.4:
            made += f' {self.words(2, 9)} <a href="/y">{self.words(1, 3)}</a> <b>{self.words(1, 3)}</b> {self.words(4, 20)}'
        return self.pick.choice((f"<p>{made}</p>", f"<p>{made}</p>", f"<p>{made}</p>", f"<p>{made}", f"<blockquote>{made}</blockquote>", f"<ul><li>{made}</li><li>{self.words(5, 20)}</li></ul>"))

    def page(self) -> Page:
        tag = self.pick.choice(("article", "main", f"div {self.named('main')}", f"div {self.named('main')}", f"div {self.named('')}", "section"))
        out: Page = [(f"<html><head><title>{self.words(2, 6)}</title></head><body>", False)]
        out += [(self.aside(k), False) for k in ("header", "menu", "notice", "form", "links", "ad") if self.pick.random() < 0.6]
        if self.pick.random() < 0.3:
            out.append((f"<div>{self.words(1, 5)}</div>", False))
        out.append((f"<div {self.named('')}><{tag}>", False))
        out.append((f"<h1>{self.words(3, 9)}</h1>", True))
        for _ in range(self.pick.randint(3, 9)):
            out.append((self.prose(), True))
            if self.pick.random() < 0.2:
                out.append((f"<h2>{self.words(2, 6)}</h2>", True))
            if self.pick.random() < 0.2:
                out.append((self.aside(self.pick.choice(("ad", "notice", "side", "menu"))), False))
        out.append((f"</{tag.split()[0]}></div>", False))
        out += [(self.aside(k), False) for k in ("side", "links", "comment", "ad", "footer") if self.pick.random() < 0.6]
        return [*out, ("</body></html>", False)]


def labelled_pages(n: int = 150, seed: int = 11) -> list[Page]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
