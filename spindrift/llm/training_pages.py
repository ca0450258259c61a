"""Web pages with known main text, written by a seeded generator, to fit the extraction on.

Every run of main text begins with a private-use character, which no other text has. Layouts,
tags, names, order and amounts vary: semantic and plain containers, menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, and such things inside the article too.
"""

from __future__ import annotations

import random

MARK = "\ue000"
_SYLLABLES = "an ber che de el en er for ge ha in ka li men no ou pre qui re sch ta tion un ver wo zu é ñ ü".split()
_NAMES = {
    "main": ["content", "article-body", "post-content", "entry-content", "story", "main-content", "articleBody", "text", "post", "page-content", "prose", "entry"],
    "menu": ["nav", "menu", "main-menu", "navbar", "navigation", "breadcrumb", "topnav", "pagination", "tabs", "toc"],
    "header": ["header", "site-header", "masthead", "banner", "topbar", "branding", "logo"],
    "footer": ["footer", "site-footer", "foot", "copyright", "colophon", "legal", "imprint", "bottom"],
    "side": ["sidebar", "side", "related", "widget", "right-rail", "recommended", "trending", "more-stories", "popular", "tags"],
    "advert": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "adsense", "advertisement", "commercial", "teaser-ad"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall-message", "disclaimer"],
    "form": ["search-form", "login", "contact-form", "searchbox", "signin", "register", "search"],
    "comment": ["comments", "comment-list", "disqus", "replies", "respond", "reader-comments", "discussion", "responses"],
    "share": ["share", "social", "sharing-buttons", "follow-us", "post-meta", "byline"],
}
_TAGS = {
    "menu": ["nav", "nav", "div", "ul", "menu"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "advert": ["div", "div", "aside", "section", "p"],
    "notice": ["div", "section", "aside", "dialog", "p"], "form": ["form", "form", "div"], "comment": ["section", "div", "div", "aside"], "share": ["div", "ul", "p"],
}


class _Writer:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def words(self, low: int, high: int) -> str:
        made = ["".join(self.random.choices(_SYLLABLES, k=self.random.randint(1, 4))) for _ in range(self.random.randint(low, high))]
        return " ".join(made)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.random.choice("...?!") for _ in range(self.random.randint(low, high)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.words(1, 1)}">{text}</a>'

    def named(self, kind: str, tag: str, p: float = 0.85) -> str:
        """A start tag; semantic tags may go without a telling name, others may have one that tells nothing."""
        if not self.chance(p if tag in ("div", "ul", "p", "section") else 0.5):
            return f"<{tag}>" if tag not in ("div", "p", "ul", "section") else f'<{tag} class="{self.random.choice(["box", "row", "col-4", "c1", "wrap"])}">'
        return f'<{tag} {self.random.choice(["class", "class", "id"])}="{self.random.choice(_NAMES[kind])}">'

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link(self.words(1, 5))}</li>" for _ in range(self.random.randint(low, high))) + "</ul>"

    def boilerplate(self, kind: str) -> str:
        tag = self.random.choice(_TAGS[kind])
        start = self.named(kind, tag, 1.0 if kind in ("advert", "notice", "comment") or tag == "p" else 0.85)
        if kind == "menu":
            inside = self.links(2, 9) if tag != "ul" else "".join(f"<li>{self.link(self.words(1, 3))}</li>" for _ in range(self.random.randint(2, 9)))
        elif kind == "header":
            inside = self.link(self.words(1, 3)) + self.random.choice(["", f"<p>{self.words(2, 8)}</p>", f"<h1>{self.words(1, 4)}</h1>", f"<nav>{self.links(2, 6)}</nav>", f"<div>{self.words(1, 6)}</div>"])
        elif kind == "footer":
            inside = self.random.choice(["&copy; ", "", "Copyright "]) + self.words(1, 5) + " &middot; " + self.sentences(1, 2) + self.random.choice(["", self.links(2, 6), f"<p>{self.sentences(1, 3)}</p>"])
        elif kind == "side":
            inside = self.random.choice(["", f"<h3>{self.words(1, 4)}</h3>"]) + self.random.choice([self.links(2, 8), f"<p>{self.sentences(1, 4)}</p>", f"<div>{self.link(self.words(3, 9))}</div><p>{self.words(5, 20)}</p>"])
        elif kind == "form":
            inside = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>' + self.random.choice(["", f"<p>{self.sentences(1, 2)}</p>"])
        elif kind == "comment":
            each = (f"<{t}{c}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 5)}</p></{t}>" for t, c in [self.random.choice([("div", ' class="comment"'), ("li", ""), ("article", ' class="comment"'), ("div", "")])] for _ in range(self.random.randint(1, 6)))
            inside = self.random.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(each)
        elif kind == "share":
            inside = " ".join(self.link(self.words(1, 2)) for _ in range(self.random.randint(1, 5))) if tag != "ul" else "".join(f"<li>{self.link(self.words(1, 1))}</li>" for _ in range(4))
        else:
            text = self.sentences(1, 4)
            inside = self.random.choice([text, f"<p>{text}</p>" if tag != "p" else text, text + self.link(self.words(1, 4)), f"<span>{text}</span>"])
        return f"{start}{inside}</{tag}>"

    def main_block(self) -> str:
        text = MARK + self.sentences(1, self.random.choice([1, 2, 6, 20]))
        if self.chance(0.05):
            text = MARK + self.words(1, 3)
        if self.chance(0.15):
            text += " " + self.link(self.words(1, 4)) + " " + self.words(1, 9) + "."
        kind = self.random.random()
        if kind < 0.62:
            return f"<p>{text}</p>" if self.chance(0.9) else f"<p>{text}"
        if kind < 0.7:
            return f"<p><b>{text}<br>"
        if kind < 0.78:
            return f"<h{(h := self.random.randint(2, 3))}>{MARK}{self.words(1, 8)}</h{h}>"
        if kind < 0.84:
            tag = self.random.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{MARK}{self.sentences(1, 2)}</li>" for _ in range(self.random.randint(1, 5))) + f"</{tag}>"
        if kind < 0.89:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.92:
            return f"<pre>{text}</pre>"
        if kind < 0.95:
            return f"<figure><img src='x.png'><figcaption>{MARK}{self.words(3, 9)}</figcaption></figure>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{text}</div>"

    def article(self) -> str:
        blocks = [self.main_block() for _ in range(self.random.choice([1, 2, 3, 5, 8, 15, 40]))]
        if self.chance(0.35):
            for _ in range(self.random.randint(1, 3)):
                blocks.insert(self.random.randint(0, len(blocks)), self.boilerplate(self.random.choice(["advert", "share", "side", "notice", "form", "menu"])))
        if self.chance(0.12):
            blocks.append(self.boilerplate("comment"))
        if self.chance(0.1):
            blocks.append(self.boilerplate("footer"))
        title = f"<h1>{MARK}{self.words(1, 10)}</h1>"
        if self.chance(0.15):
            title = f"<header>{title}</header>"
        if self.chance(0.85):
            blocks.insert(0, title)
        body = "".join(blocks)
        tag = self.random.choice(["article", "article", "article", "main", "div", "div", "section"])
        if self.chance(0.15):
            body = f"<div>{body}</div>"
        if tag in ("div", "section"):
            return f"{self.named('main', tag, 0.9)}{body}</{tag}>"
        return f"<{tag}>{body}</{tag}>" if self.chance(0.6) else f"{self.named('main', tag)}{body}</{tag}>"

    def page(self) -> str:
        before = [kind for kind, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("form", 0.2), ("advert", 0.5), ("side", 0.2)) if self.chance(p)]
        after = [kind for kind, p in (("share", 0.2), ("comment", 0.4), ("side", 0.4), ("advert", 0.3), ("form", 0.2), ("menu", 0.1), ("footer", 0.8), ("notice", 0.2)) if self.chance(p)]
        parts = [self.boilerplate(kind) for kind in before] + [self.article() if not self.chance(0.04) else ""] + [self.boilerplate(kind) for kind in after]
        if self.chance(0.2):
            parts = ['<div class="wrapper">', *parts, "</div>"]
        if self.chance(0.2):
            parts.insert(len(before), "<!-- here -->")
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return f"{head}<body>{''.join(parts)}" + ("</body></html>" if self.chance(0.9) else "")

    def fragment(self) -> str:
        """Main text alone, outside elements or in a few blocks, without a page around it."""
        text = MARK + self.sentences(1, self.random.choice([1, 3, 12]))
        if self.chance(0.5):
            return text + self.random.choice(["", f" <b>{MARK}{self.words(1, 4)}</b>", f"<br>{MARK}<i>{self.words(1, 9)}</i>."])
        return self.random.choice(["", f"<h1>{MARK}{self.words(1, 8)}</h1>"]) + "".join(self.main_block() for _ in range(self.random.randint(1, 6)))


def training_pages(n: int, seed: int) -> list[str]:
    """``n`` pages, every twentieth of them a fragment."""
    writers = [_Writer(seed * 1_000_003 + i) for i in range(n)]
    return [writer.fragment() if i % 20 == 19 else writer.page() for i, writer in enumerate(writers)]
