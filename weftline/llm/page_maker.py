"""Made-up web pages with known main text, for training and testing the block labeller."""

from __future__ import annotations

import html
import random

SYLLABLES = ["the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve", "que es ción ado mente el la de os ar er ía ó ñ", "le ment tion re é è au eux ou pa vi ch", "der sch ung keit ein ß ä ü ö be ver ge zu en", "ka no shi ta ra mi to ku ri 日 本 語 の を"]
BOILER = "home menu about contact login sign up subscribe search privacy policy terms cookies accept share tweet comment reply posted by related read more next previous tags category archive copyright rights reserved advertisement sponsored newsletter email follow us".split()
# Names that sites give to the parts of a page.
MAIN = ["content", "main-content", "post", "entry-content", "article-body", "story", "post-content", "articleBody", "main", "text", "page-content", "blog-post", "entry", "article", "body-text", "news-detail", "single"]
SIDE = ["sidebar", "side", "widget", "related", "recommended", "aside", "right-column", "popular", "more-stories", "rail", "secondary", "infobox-links", "author-box", "tag-cloud"]
ADS = ["ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "ad-slot", "adsbygoogle", "commercial", "partner", "promotion"]
NOTICE = ["cookie", "cookie-notice", "notice", "alert", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "message-bar", "disclaimer", "banner-notice"]
COMMENTS = ["comments", "comment-list", "comment", "responses", "disqus", "reader-comments", "replies", "discussion", "commentlist", "respond"]
MENU = ["menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "topbar", "tabs", "pagination", "links", "toc", "site-nav", "mega-menu"]
SHARE = ["share", "social", "sharing", "social-links", "follow", "buttons", "toolbar", "meta", "byline-tools"]
WRAP = ["container", "wrapper", "row", "page", "site", "layout", "inner", "col", "grid", "outer", "wrap", "column"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: set[str] = set()
        self.other: set[str] = set()
        self.syllables = [self.r.choice(SYLLABLES).split() for _ in range(2)]

    def words(self, n: int) -> str:
        r, s = self.r, self.syllables[self.r.random() < 0.15]
        out = []
        for k in range(n):
            w = "".join(r.choice(s) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
            if k == 0 or r.random() < 0.06:
                w = w.capitalize()
            if r.random() < 0.08:
                w += r.choice(",.;")
            out.append(w)
        return " ".join(out)

    def prose(self) -> str:
        r = self.r
        t = self.words(r.choice((1, 3, 8, 15, 40, 40, 90, 160))) + r.choice((".", ".", "!", "", "?"))
        if (kind := r.random()) < 0.06:
            t = " ".join(w + r.choice(("***", "&&&", "$$$", "%%%", "###")) for w in t.split())
        elif kind < 0.1:
            t = "!! ".join(t.upper().split())
        elif kind < 0.13:
            t = " | ".join(t.split())
        elif kind < 0.16:
            t = " ".join([self.words(1)] * r.randint(3, 40))
        return t

    def label(self) -> str:
        r = self.r
        return " ".join(r.sample(BOILER, r.randint(1, 3))) if r.random() < 0.5 else self.words(r.randint(1, 4))

    def inside(self, text: str, keep: bool) -> str:
        """The text as markup; its plain form goes to main or other."""
        r = self.r
        (self.main if keep else self.other).add(" ".join(text.split()))
        t = html.escape(text, quote=r.random() < 0.5)
        words = t.split(" ")
        if len(words) > 4 and r.random() < 0.3:
            k = r.randrange(len(words) - 2)
            tag = r.choice(("b", "i", "em", "strong", "a href='/x'", "span class='x'", "code"))
            words[k] = f"<{tag}>{words[k]}"
            words[k + 1] += f"</{tag.split()[0]}>"
            t = " ".join(words)
        if r.random() < 0.1:
            t = t.replace(" ", r.choice(("\n", "  ", "<br> ", "&nbsp;")), 1)
        return t

    def named(self, names: list[str], tags=("div", "div", "section")) -> tuple[str, str]:
        r = self.r
        tag, name = r.choice(tags), r.choice(names)
        if r.random() < 0.15:
            name += r.choice(("-1", "_box", " clearfix", "-wrap", " active"))
        kind = r.choice(("class", "class", "id"))
        return f'<{tag} {kind}="{name}">', f"</{tag}>"

    def links(self, n: int) -> str:
        r = self.r
        style = r.random()
        items = [f'<a href="/{k}">{self.inside(self.label(), False)}</a>' for k in range(n)]
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" if r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return r.choice((" | ", " ", "\n")).join(items) if style < 0.8 else "".join(f"<p>{x}</p>" for x in items)

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            a, z = ("<nav>", "</nav>") if r.random() < 0.5 else self.named(MENU, ("div", "ul", "nav"))
            return a + self.links(r.randint(2, 12)) + z
        if kind == "header":
            a, z = ("<header>", "</header>") if r.random() < 0.6 else self.named(["header", "masthead", "site-header", "top", "branding"])
            t = f"<{'h1' if r.random() < 0.3 else 'div'}>{self.inside(self.label(), False)}</{'h1' if False else 'div'}>" if r.random() < 0.5 else f"<p>{self.inside(self.words(r.randint(2, 9)), False)}</p>"
            return a + t + (self.links(r.randint(2, 6)) if r.random() < 0.4 else "") + z
        if kind == "footer":
            a, z = ("<footer>", "</footer>") if r.random() < 0.6 else self.named(["footer", "site-footer", "bottom", "colophon", "legal", "copyright"])
            t = r.choice(("© ", "", "Copyright ")) + self.words(r.randint(2, 20)) + r.choice((" · ", ". ", " ")) + self.words(r.randint(1, 14))
            return a + (f"<p>{self.inside(t, False)}</p>" if r.random() < 0.5 else self.inside(t, False)) + (self.links(r.randint(2, 8)) if r.random() < 0.4 else "") + z
        if kind == "ad":
            a, z = self.named(ADS, ("div", "div", "aside", "section", "ins"))
            return a + (f"<p>{self.inside(self.prose(), False)}</p>" if r.random() < 0.4 else self.inside(self.prose(), False)) + z
        if kind == "side":
            a, z = ("<aside>", "</aside>") if r.random() < 0.5 else self.named(SIDE, ("div", "aside", "section"))
            body = f"<h3>{self.inside(self.label(), False)}</h3>" if r.random() < 0.6 else ""
            body += "".join(f"<p>{self.inside(self.prose(), False)}</p>" for _ in range(r.randint(0, 3))) if r.random() < 0.5 else self.links(r.randint(2, 8))
            return a + body + z
        if kind == "notice":
            a, z = self.named(NOTICE)
            return a + f"<p>{self.inside(self.prose(), False)}</p>" + (f"<button>{self.inside(self.label(), False)}</button>" if r.random() < 0.6 else "") + z
        if kind == "form":
            a, z = r.choice(((f'<form action="/{r.choice(("search", "login", "subscribe"))}">', "</form>"), ('<div class="search-form"><form>', "</form></div>"), ('<div class="signup"><form>', "</form></div>")))
            return a + "".join(r.choice(("<label>{}</label><input>", "<p>{}</p><input type=text>", "<button>{}</button>", "<legend>{}</legend>", "<div>{}</div>")).format(self.inside(self.label() if r.random() < 0.6 else self.prose(), False)) for _ in range(r.randint(1, 4))) + z
        if kind == "comments":
            a, z = self.named(COMMENTS, ("div", "section", "ol"))
            body = f"<h3>{self.inside(self.label(), False)}</h3>" if r.random() < 0.7 else ""
            for _ in range(r.randint(1, 5)):
                x, y = r.choice((("<li class='comment'>", "</li>"), ("<div class='comment'>", "</div>"), ("<div class='comment-body'>", "</div>"), ("<article class='comment'>", "</article>"), ("<div>", "</div>")))
                body += x + (f"<span class=author>{self.inside(self.words(2), False)}</span>" if r.random() < 0.3 else f"<h4>{self.inside(self.words(2), False)}</h4>" if r.random() < 0.4 else "") + "".join(f"<p>{self.inside(self.prose(), False)}</p>" for _ in range(r.randint(1, 2))) + y
            return a + body + z
        a, z = self.named(SHARE, ("div", "ul", "p"))
        return a + self.links(r.randint(1, 5)) + z

    def article(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.85:
            h = r.choice(("h1", "h1", "h2"))
            out.append(f"<{h}>{self.inside(self.words(r.randint(1, 14)), True)}</{h}>")
        style = r.random()
        for _ in range(r.choice((1, 2, 4, 7, 12, 25))):
            k = r.random()
            if k < 0.72:
                t = self.inside(self.prose(), True)
                if r.random() < 0.15:  # emphasis that is never closed, with a break before the next block
                    t = f"<b>{t}<br>"
                    out.append(f"<p>{t}" if r.random() < 0.8 else f"<p>{t}</p>")
                elif style < 0.1:
                    out.append(f"<p>{t}")
                elif style < 0.18:
                    out.append(f"<div>{t}</div>")
                else:
                    out.append(f"<p>{t}</p>")
            elif k < 0.8:
                h = r.choice(("h2", "h3", "h4"))
                out.append(f"<{h}>{self.inside(self.words(r.randint(1, 8)), True)}</{h}>")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.inside(self.prose(), True)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote>{self.inside(self.prose(), True)}</blockquote>")
            elif k < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.inside(self.words(r.randint(1, 4)), True)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.97:
                out.append(f"<pre>{self.inside(self.words(8), True)}</pre>")
            else:
                out.append(self.boiler(r.choice(("ad", "side", "share", "form", "notice", "nav"))))
        if r.random() < 0.12:
            out.append(self.boiler(r.choice(("comments", "share", "side", "form"))))
        body = "".join(out)
        k = r.random()
        if k < 0.5:
            a, z = "<article>", "</article>"
        elif k < 0.6:
            a, z = "<main>", "</main>"
        elif k < 0.7:
            a, z = '<main><article class="post">', "</article></main>"
        elif k < 0.95:
            a, z = self.named(MAIN)
        else:
            a, z = "<div>", "</div>"
        return a + body + z

    def page(self) -> str:
        r = self.r
        before = [k for k, p in (("notice", 0.2), ("header", 0.5), ("nav", 0.75), ("form", 0.15), ("ad", 0.5), ("side", 0.2), ("share", 0.1)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("comments", 0.3), ("side", 0.4), ("ad", 0.35), ("form", 0.2), ("nav", 0.2), ("notice", 0.15), ("footer", 0.8)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        body = "".join(map(self.boiler, before)) + self.article() + "".join(map(self.boiler, after))
        for _ in range(r.choice((0, 0, 1, 2))):
            a, z = self.named(WRAP)
            body = a + body + z
        title = html.escape(self.words(6))
        tail = "</body></html>" if r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";x(1);</script></head><body>{body}<!-- end -->{tail}'


def make_page(seed: int) -> tuple[str, set[str]]:
    """A page, and the texts of its main blocks (texts that are also elsewhere on the page are left out)."""
    m = Maker(seed)
    page = m.page()
    return page, m.main - m.other
