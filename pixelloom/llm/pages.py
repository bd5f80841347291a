"""Made-up pages with known main text, for training the block labeller.

Words are random syllables, so nothing can be learned from them but a few words of page furniture; layouts, tag
names, class names, nesting, and unclosed tags are drawn at random. ``page`` returns the blocks' labels along
with the page, as 1 for main text.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da el fi go hu in jo ka lu me no or pa qui re si tu un vo we xi ya zu th er on st".split()

#: Names that page furniture and main text go by.
FURNITURE = {
    "menu": ("nav menu navbar main-nav topnav breadcrumb breadcrumbs navigation site-menu", "home about contact login search products next previous"),
    "header": ("header masthead site-header top banner logo branding", "welcome blog news subscribe"),
    "footer": ("footer site-footer bottom copyright legal colophon", "copyright rights reserved privacy terms imprint"),
    "sidebar": ("sidebar aside side widget related recommended popular tags right-col", "related popular archive recent tags categories"),
    "notice": ("cookie cookies consent gdpr notice alert banner newsletter popup modal", "cookies accept consent privacy subscribe newsletter we use"),
    "advert": ("ad ads advert adsense sponsored promo promotion banner-ad", "sponsored advertisement buy sale offer shop"),
    "form": ("form search-form login-form signup contact-form", "name email password submit send search"),
    "share": ("share social sharing follow buttons", "share tweet facebook follow like"),
    "comments": ("comments comment comment-list commentlist replies responses discussion", "reply comment says posted permalink"),
}
TAGS = {"menu": ("nav", "div", "ul", "header"), "header": ("header", "div"), "footer": ("footer", "div", "section"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside"), "advert": ("div", "aside", "section", "ins"), "form": ("form", "div"), "share": ("div", "ul", "p"), "comments": ("div", "section", "ol")}
MAIN = ("content", "main", "post", "entry", "article", "article-body", "post-content", "entry-content", "story", "text", "body-text", "page-content")
NEUTRAL = ("wrapper", "container", "row", "inner", "col", "block", "box", "clearfix", "x1", "wrap", "page", "outer", "layout")


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return w.capitalize() if self.r.random() < 0.12 else w

    def words(self, low: int, high: int) -> str:
        mark = self.r.choice(["", "", "", "!!", "***", "|"])
        return " ".join(self.word() + mark for _ in range(self.r.randint(low, high))) + self.r.choice([".", ".", "", "!"])

    def text(self, label: int, low: int, high: int, furniture: str = "") -> None:
        t = self.words(low, high)
        if furniture and self.r.random() < 0.5:
            t = self.r.choice(FURNITURE[furniture][1].split()) + " " + t
        if label and self.r.random() < 0.15:
            t = t.replace(" ", " <a href=\"/x\">", 1) + "</a>" if " " in t else t
        if label and self.r.random() < 0.1:
            t = self.r.choice(["<b>", "<em>", "<span>"]) + t + self.r.choice(["", "<br>"])
        self.out.append(t)
        self.labels.append(label)

    def open(self, tag: str, name: str = "") -> None:
        key = self.r.choice(["class", "class", "id"])
        more = " " + self.r.choice(NEUTRAL) if name and key == "class" and self.r.random() < 0.3 else ""
        self.out.append(f'<{tag} {key}="{name}{more}">' if name else f"<{tag}>")

    def shut(self, tag: str) -> None:
        if tag not in ("p", "li") or self.r.random() < 0.85:
            self.out.append(f"</{tag}>")

    def furniture(self, kind: str) -> None:
        r, tag = self.r, self.r.choice(TAGS[kind])
        named = tag in ("div", "section", "ul", "ol", "p", "ins") or r.random() < 0.5
        self.open(tag, r.choice(FURNITURE[kind][0].split()) if named else "")
        if kind in ("menu", "share") or kind == "sidebar" and r.random() < 0.5:
            inner = "" if tag in ("ul", "ol") else "ul"
            if kind == "sidebar":
                self.open("h3")
                self.text(0, 1, 3, kind)
                self.out.append("</h3>")
            if inner:
                self.open(inner)
            for _ in range(r.randint(2, 8)):
                self.out.append("<li><a href=\"/\">")
                self.text(0, 1, 3, kind)
                self.out.append("</a>")
                self.shut("li")
            if inner:
                self.out.append(f"</{inner}>")
        elif kind == "comments":
            item = "li" if tag == "ol" else "div"
            for _ in range(r.randint(1, 4)):
                self.open(item, r.choice(["comment", "reply", "comment-body", ""]))
                for _ in range(r.randint(1, 3)):
                    self.open("p")
                    self.text(0, 2, 40, kind)
                    self.shut("p")
                self.out.append(f"</{item}>")
        elif kind == "form":
            self.out.append("<label>")
            self.text(0, 1, 3, kind)
            self.out.append('</label><input name="q"><button>')
            self.text(0, 1, 2, kind)
            self.out.append("</button>")
        else:
            bare = r.random() < 0.5
            for _ in range(1 if bare else r.randint(1, 3)):
                if not bare:
                    self.open("p")
                self.text(0, 1, 30, kind)
                if not bare:
                    self.out.append("</p>")
        self.out.append(f"</{tag}>")

    def main(self) -> None:
        r = self.r
        wraps = []
        for _ in range(r.randint(0, 2)):
            wraps.append(("div", r.choice(NEUTRAL)))
        # the main text's element is named by its tag, by its class, or by both
        style = r.random()
        if style < 0.6:
            wraps.append((r.choice(["article", "article", "main"]), r.choice(MAIN) if r.random() < 0.3 else ""))
        if style >= 0.45:
            wraps.append(("div", r.choice(MAIN)))
        for t, n in wraps:
            self.open(t, n)
        if r.random() < 0.85:
            self.open("h1")
            self.text(1, 1, 12)
            self.out.append("</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.7:
                self.open("p")
                self.text(1, 1, 70)
                self.shut("p")
            elif x < 0.78:
                t = r.choice(["h2", "h3", "h4"])
                self.open(t)
                self.text(1, 1, 8)
                self.out.append(f"</{t}>")
            elif x < 0.86:
                t = r.choice(["ul", "ol"])
                self.open(t)
                for _ in range(r.randint(1, 5)):
                    self.out.append("<li>")
                    self.text(1, 1, 20)
                    self.shut("li")
                self.out.append(f"</{t}>")
            elif x < 0.9:
                self.out.append("<blockquote>")
                self.text(1, 3, 30)
                self.out.append("</blockquote>")
            elif x < 0.93:
                self.out.append("<table><tr><td>")
                self.text(1, 1, 6)
                self.out.append("</td><td>")
                self.text(1, 1, 6)
                self.out.append("</td></tr></table>")
            elif x < 0.96:
                self.out.append("<pre>")
                self.text(1, 2, 20)
                self.out.append("</pre>")
            else:
                self.furniture(r.choice(["advert", "share", "sidebar", "notice"]))
        if r.random() < 0.15:
            self.furniture("comments")
        for t, _ in reversed(wraps):
            self.out.append(f"</{t}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.out.append("<html><head><title>x</title></head><body>")
        wrap = r.random() < 0.3
        if wrap:
            self.open("div", r.choice(NEUTRAL))
        before = ["header", "menu", "notice", "advert", "form"]
        after = ["sidebar", "share", "comments", "advert", "footer", "menu", "notice", "form"]
        for k in before:
            if r.random() < (0.6 if k == "menu" else 0.35):
                self.furniture(k)
        if r.random() < 0.15:
            self.furniture("sidebar")
        self.main()
        for k in after:
            if r.random() < (0.7 if k == "footer" else 0.25):
                self.furniture(k)
        if wrap:
            self.out.append("</div>")
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def page(seed: int) -> tuple[str, list[int]]:
    return Maker(seed).page()
