"""Labelled pages to train on: invented sites with known main text, over many layouts.

A page is assembled from parts (menus, notices, adverts, sidebars, an article, comments, forms, footers) whose tags and
names vary as they do on the web; each block's label is known from the part it was made for.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el en fi ga ho in ka le lo ma mi na no or pa qui ra re sa se ta ti to un va ve zu ée ñi ß ü".split()
#: Names that parts go by.
NAMES = {
    "nav": "nav navbar menu navigation topnav breadcrumb breadcrumbs pagination pager tabs links".split(),
    "head": "header masthead banner topbar branding site logo top".split(),
    "foot": "footer foot bottom colophon legal copyright credits".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense teaser".split(),
    "side": "sidebar side aside widget widgets related recommended popular trending rail more".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall".split(),
    "form": "form search login contact subscribe signup".split(),
    "share": "share social sharing follow tools meta byline tags".split(),
    "comments": "comments comment replies reply discussion disqus respond thread".split(),
    "body": "article content post entry story main text body page blog single".split(),
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        made = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        marks = rng.choice(["", "", "", "", "%%%", "&amp;", "!!", " |"])
        return " ".join(w + (marks if marks and rng.random() < 0.5 else "," if rng.random() < 0.06 else "") for w in made).capitalize()

    def prose(self) -> str:
        rng = self.rng
        n = rng.choice([1, 1, 1, 2, 3, 4, 6, 9])
        return " ".join(self.words(1, rng.choice([1, 2, 6, 14, 20])) + "." for _ in range(n))

    def block(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        end = "" if tag == "p" and self.rng.random() < 0.1 else f"</{tag}>"
        bold = "<b>" if self.rng.random() < 0.08 else ""
        self.out.append(f"<{tag}{attributes}>{bold}{text}{'<br>' if bold and self.rng.random() < 0.5 else ''}{end}")
        self.labels.append(label)

    def named(self, kind: str) -> str:
        rng = self.rng
        name = rng.choice(NAMES[kind])
        if rng.random() < 0.3:
            name += rng.choice(["-wrap", "-box", "-inner", " clearfix", "-list", "-1", "_area"])
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(["col", "row", "block", "grid"])}"'])

    def open(self, kind: str, tags: dict[str, float], plain: float = 0.0) -> str:
        tag = self.rng.choices(list(tags), list(tags.values()))[0]
        bare = tag not in ("div", "section", "ul", "td") and self.rng.random() < 0.6 or self.rng.random() < plain
        self.out.append(f"<{tag}{'' if bare else self.named(kind)}>")
        return f"</{tag}>"

    def links(self) -> None:
        rng = self.rng
        self.out.append("<ul>")
        for _ in range(rng.randint(2, 7)):
            text = self.words(1, rng.choice([1, 2, 5]))
            self.block("li", f'<a href="/{rng.randint(1, 99)}">{text}</a>', 0)
        self.out.append("</ul>")

    def junk(self, kind: str) -> None:
        rng = self.rng
        tags = {"nav": {"nav": 3, "div": 2}, "head": {"header": 3, "div": 2}, "foot": {"footer": 4, "div": 2}, "ad": {"div": 5, "aside": 1, "section": 1}, "side": {"aside": 3, "div": 3, "section": 1}, "notice": {"div": 4, "section": 1, "aside": 1}, "form": {"form": 4}, "share": {"div": 4}, "comments": {"section": 3, "div": 4}}[kind]
        end = self.open(kind, tags)
        if kind == "nav":
            self.links()
        elif kind == "head":
            self.block(rng.choice(["h1", "h2", "div", "p", "a"][:4]), self.words(1, 4), 0)
            if rng.random() < 0.6:
                inner = self.open("nav", {"nav": 3, "div": 2})
                self.links()
                self.out.append(inner)
        elif kind == "foot":
            self.out.append(f"&copy; {self.words(1, 3)} &middot; {self.prose()}")
            self.labels.append(0)
            if rng.random() < 0.4:
                self.links()
            if rng.random() < 0.4:
                self.block("p", self.prose(), 0)
        elif kind in ("ad", "notice", "share"):
            if rng.random() < 0.5:
                self.out.append(self.prose())
                self.labels.append(0)
            else:
                for _ in range(rng.randint(1, 2)):
                    self.block(rng.choice(["p", "p", "h3", "div", "span"][:4]), self.prose(), 0)
        elif kind == "side":
            for _ in range(rng.randint(1, 3)):
                self.block(rng.choice(["h2", "h3", "h4"]), self.words(1, 4), 0)
                if rng.random() < 0.5:
                    self.links()
                else:
                    self.block("p", self.prose(), 0)
        elif kind == "form":
            self.block(rng.choice(["label", "p", "div", "legend"][1:]), self.words(1, 6), 0)
            self.out.append('<input type="text" name="q"><button>Go</button>')
        elif kind == "comments":
            self.block(rng.choice(["h2", "h3"]), self.words(1, 3), 0)
            for _ in range(rng.randint(1, 5)):
                tag = rng.choice(["div", "li", "article"])
                self.out.append(f'<{tag} class="comment">')
                if rng.random() < 0.6:
                    self.block("div", self.words(1, 3), 0, ' class="author"')
                self.block("p", self.prose(), 0)
                self.out.append(f"</{tag}>")
        self.out.append(end)

    def article(self) -> None:
        rng = self.rng
        self.out.append("<main>" if rng.random() < 0.25 else "<div>" if rng.random() < 0.2 else "")
        end = self.open("body", {"article": 6, "div": 4, "section": 1, "main": 2, "td": 0.3}, plain=0.1)
        if rng.random() < 0.85:
            wrap = rng.random() < 0.15
            self.out.append("<header>" if wrap else "")
            self.block(rng.choice(["h1", "h1", "h1", "h2"]), self.words(2, 12), 1)
            self.out.append("</header>" if wrap else "")
        for i in range(rng.choice([1, 2, 3, 5, 8, 14, 25])):
            kind = rng.random()
            if kind < 0.8 or i == 0:
                self.block("p", self.prose(), 1)
            elif kind < 0.86:
                self.block(rng.choice(["h2", "h3"]), self.words(1, 7), 1)
            elif kind < 0.9:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    self.block("li", self.prose(), 1)
                self.out.append("</ul>")
            elif kind < 0.93:
                self.block(rng.choice(["blockquote", "pre", "figcaption"]), self.prose(), 1)
            elif kind < 0.95:
                self.block("div", self.prose(), 1)
            elif kind < 0.975:
                self.junk(rng.choice(["ad", "side", "share", "notice"]))
            else:
                self.out.append(f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>")
                self.labels += [1, 1]
        if rng.random() < 0.15:
            self.junk(rng.choice(["comments", "form", "share", "side"]))
        self.out.append(end)


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page's html, and for each of its blocks whether it is main text."""
    rng = random.Random(seed)
    page = _Page(rng)
    page.out.append("<!DOCTYPE html><html><head><meta charset=utf-8><title>x</title><style>p{margin:0}</style><script>var a='</p>';</script></head><body>")
    for kind, p in (("notice", 0.25), ("head", 0.45), ("nav", 0.6), ("ad", 0.4), ("form", 0.15), ("side", 0.2)):
        if rng.random() < p:
            page.junk(kind)
    page.article()
    for kind, p in (("share", 0.15), ("comments", 0.35), ("side", 0.35), ("form", 0.2), ("ad", 0.25), ("nav", 0.15), ("foot", 0.8), ("notice", 0.2)):
        if rng.random() < p:
            page.junk(kind)
    page.out.append("</body></html>")
    return "".join(page.out), page.labels
