"""Labelled pages from which the extraction model is trained.

Pages are composed here from the parts that web pages are made of, with the names that authors
give to those parts; every block of text carries its label. Words are random letters, so nothing
but structure, names and shape can be learned from them. Half of the pages name nothing that holds
content: their articles lie in plain elements, table cells, the body or no element at all.
"""

from __future__ import annotations

import random

_NAMES = {
    "header": ["hero-logo", "top-bar", "header", "masthead", "site-header", "topbar", "branding", "page-header", "banner-top"],
    "nav": ["topnav", "subnav", "skip-link", "breadcrumb", "pager", "toc", "nav", "menu", "navbar", "main-menu", "breadcrumbs", "navigation", "pagination", "toc-links", "tabs"],
    "notice": ["cookie", "privacy-popup", "modal", "overlay", "paywall", "notification", "notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "message-bar", "warning", "disclaimer"],
    "ad": ["advertising", "sponsor", "adv", "ad-container", "promotion", "banner-ad", "ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner", "adsense", "sponsor-box"],
    "aside": ["complementary", "rail", "trending", "most-read", "sidebar-right", "see-also", "sharing", "aside", "sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "share", "social-links", "author-box", "tags"],
    "form": ["search", "searchbox", "form", "feedback-form", "search-form", "newsletter", "subscribe", "login", "signup", "contact-form"],
    "comments": ["commentlist", "comment-section", "user-comments", "comment-thread", "comments", "comment-list", "comment", "disqus", "responses", "reader-comments", "replies", "discussion"],
    "footer": ["contentinfo", "foot", "site-info", "bottom-bar", "footer", "site-footer", "bottom", "copyright", "legal", "colophon"],
}
_TAGS = {"header": "header", "nav": "nav", "aside": "aside", "form": "form", "footer": "footer"}
_ROLES = {"header": "banner", "nav": "navigation", "aside": "complementary", "form": "search", "footer": "contentinfo", "notice": "alert"}
_BODY = ["main", "content", "article", "post", "entry-content", "article-body", "main-content", "story", "post-body", "text", "entry", "body-text"]
_WRAP = ["", "wrapper", "container", "page", "row", "site", "layout", "inner", "col-8", "grid", "clearfix"]
_PLAIN = ["", "", "", "intro", "lead", "section", "caption", "quote", "c12", "x1", "note-text"]


#: Attribute of the elements that hold the article; the model never sees it.
CONTENT_SIGN = "data-content"


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        alphabet = r.choice(["abdeilnorstu", "aeioucmnprs", "abcdefghijklmnopqrstuvwxyz", "äeiouüchnst"])
        out = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 11))) for _ in range(r.randint(low, high))]
        text = " ".join(out)
        return text.capitalize() + r.choice([".", ".", ".", "", "!", "?", " ***"])

    def mark(self, text: str, content: bool) -> str:
        """Text of one block; the sign before it tells its label to labelled_blocks()."""
        return ("\ue001" if content else "\ue000") + text

    def named(self, tag: str, names: list[str], inner: str, extra: str = "") -> str:
        name = self.r.choice(names)
        if not name:
            return f"<{tag}{extra}>{inner}</{tag}>"
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}"{extra}>{inner}</{tag}>'

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="#">{self.mark(self.words(1, 3), False)}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>"

    def junk(self, kind: str) -> str:
        r = self.r
        tag = _TAGS.get(kind, "div") if r.random() < 0.5 else r.choice(["div", "div", "section"])
        bound = r.choice([4, 12, 25, 60])
        text = lambda low=1, high=bound: self.mark(self.words(low, high), False)
        if kind == "nav":
            inner = self.links(r.randint(2, 8))
        elif kind == "form":
            choice = f"<select><option>{text(1, 2)}<option>{text(1, 2)}</select>" if r.random() < 0.3 else ""
            inner = f'<label>{text(1, 3)}</label><input type="text">{choice}<p>{text(2, 12)}</p><button>{text(1, 2)}</button>'
        elif kind == "comments":
            inner = "".join(f"<div>{'<p>' * (k % 2)}{text(3, 40)}{'</p>' * (k % 2)}</div>" for k in range(r.randint(1, 4)))
            inner = (f"<h2>{text(1, 2)}</h2>" if r.random() < 0.6 else "") + inner
        elif kind == "aside":
            inner = f"<h3>{text(1, 3)}</h3>" + (self.links(r.randint(2, 5)) if r.random() < 0.6 else f"<p>{text()}</p>")
        elif kind == "footer":
            inner = r.choice(["", "&copy; "]) + text(3, 25) + (self.links(2) if r.random() < 0.3 else "")
        elif kind == "header":
            inner = r.choice([f"<h1>{text(1, 4)}</h1>", f"<div>{text(1, 5)}</div>", f"<a href='/'>{text(1, 3)}</a>", text(1, 6), f"<h1>{text(1, 3)}</h1><p>{text(2, 8)}</p>"])
        elif kind == "notice" and r.random() < 0.1:
            return f"<noscript>{text(3, 12)}</noscript>"
        else:
            inner = text() if r.random() < 0.5 else f"<p>{text()}</p>" * r.randint(1, 2)
        if kind in _ROLES and r.random() < 0.2:
            return f'<{tag} role="{_ROLES[kind]}">{inner}</{tag}>'
        bare = tag == _TAGS.get(kind) and r.random() < 0.6
        return f"<{tag}>{inner}</{tag}>" if bare else self.named(tag, _NAMES[kind], inner)

    def prose(self, style: tuple[int, int] = (1, 60)) -> str:
        """One part of an article; style bounds the words of its paragraphs."""
        r = self.r
        text = lambda low=style[0], high=style[1]: self.mark(self.words(low, max(low, high)), True)
        kind = r.random()
        if kind < 0.72:
            link = f' <a href="#">{self.words(1, 3)}</a> {self.words(2, 9)}' if r.random() < 0.25 else ""
            bold = f"<b>{text()}<br>" if r.random() < 0.1 else text() + link
            return f"<p>{bold}" + "</p>" * (r.random() < 0.9)
        if kind < 0.78:
            level = r.randint(2, 4)
            return f"<h{level}>{text(1, 8)}</h{level}>"
        if kind < 0.86:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{text(1, 15)}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if kind < 0.90:
            return f"<blockquote><p>{text(3, 30)}</p></blockquote>"
        if kind < 0.93:
            return f"<pre>{text(2, 30)}</pre>"
        if kind < 0.96:
            return f"<table><tr><th>{text(1, 2)}</th><td>{text(1, 5)}</td></tr><tr><td>{text(1, 2)}</td><td>{text(1, 4)}</td></tr></table>"
        if kind < 0.98:
            return f"<figure><img src='a.png'><figcaption>{text(2, 12)}</figcaption></figure>"
        return self.named("div", _PLAIN, text(5, 60))

    def article(self) -> str:
        r = self.r
        style = r.choice([(1, 60), (1, 60), (1, 3), (1, 6), (5, 20), (20, 90)])
        parts = [self.prose(style) for _ in range(r.choice([r.randint(1, 5), r.randint(3, 14), r.randint(10, 40)]))]
        if r.random() < 0.8:
            title = f"<h1>{self.mark(self.words(1, 10), True)}</h1>"
            parts.insert(0, f"<header>{title}</header>" if r.random() < 0.1 else title)
        for kind, share in (("ad", 0.25), ("form", 0.12), ("aside", 0.15), ("notice", 0.12), ("nav", 0.06)):
            if r.random() < share:
                parts.insert(r.randint(1, len(parts)), self.junk(kind))
        if r.random() < 0.15:
            parts.append(self.junk("comments"))
        if r.random() < 0.08:
            parts.append(self.junk("footer"))
        if r.random() < 0.2:
            cut = len(parts) // 2
            parts = parts[:cut] + [self.named(r.choice(["div", "section"]), _PLAIN, "".join(parts[cut:]) or self.prose())]
        inner = "".join(parts)
        kind, sign = r.random(), " " + CONTENT_SIGN
        if kind < 0.4:
            return f"<article{sign}>{inner}</article>" if r.random() < 0.7 else self.named("article", _BODY, inner, sign)
        if kind < 0.54:
            return f"<main{sign}>{inner}</main>" if r.random() < 0.5 else f"<main{sign}><article{sign}>{inner}</article></main>"
        if kind < 0.57:
            return inner
        if kind < 0.72:
            return f'<div role="{r.choice(["main", "main", "article"])}"{sign}>{inner}</div>'
        return self.named(r.choice(["div", "div", "section"]), _BODY, inner, sign)

    def bare_junk(self, kind: str) -> str:
        """A part of a page that nothing names: its shape alone tells."""
        r = self.r
        text = lambda low, high: self.mark(self.words(low, high), False)
        tag = r.choice(["div", "div", "p", "section", "center"])
        link = lambda low, high: f'<a href="#">{text(low, high)}</a>'
        if kind in ("nav", "aside", "header"):
            shape = r.random()
            if shape < 0.45:
                return self.links(r.randint(2, 9))
            if shape < 0.7:
                return f"<{tag}>" + r.choice([" | ", " ", " &middot; ", "<br>"]).join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 7))).replace(">", ">\ue000", 1) + f"</{tag}>"
            if shape < 0.85:
                return f"<div><h3>{text(1, 3)}</h3>{self.links(r.randint(2, 6))}</div>"
            return "".join(f"<div>{link(1, 4)}</div>" for _ in range(r.randint(1, 5)))
        if kind == "footer":
            return f"<{tag}>{self.mark('&copy; ' + self.words(1, 10), False)}</{tag}>"
        if kind == "form":
            return self.junk("form") if r.random() < 0.5 else f"<form><input><p>{text(1, 6)}</p><button>{text(1, 2)}</button></form>"
        return f"<{tag}>{r.choice([text(1, 4), link(2, 9)])}</{tag}>"

    def bare_prose(self) -> str:
        r = self.r
        style = r.choice([(1, 60), (5, 20), (8, 40), (20, 90)])
        parts = [self.prose(style) for _ in range(r.choice([1, 1, 2, r.randint(2, 6), r.randint(4, 20)]))]
        if r.random() < 0.6:
            parts.insert(0, f"<h{(h := r.choice('1112'))}>{self.mark(self.words(1, 10), True)}</h{h}>")
        return "".join(parts)

    def bare_page(self) -> str:
        """A page whose article no tag or name tells."""
        r = self.r
        kind = r.random()
        if kind < 0.12:  # running text without any block
            text = self.mark(self.words(3, 120), True)
            article = text if r.random() < 0.5 else text + "<br><br>" + self.words(3, 60)
            article = article if r.random() < 0.4 else f"<div>{article}</div>"
        elif kind < 0.22:
            article = "".join(f"<div>{self.mark(self.words(6, 70), True)}</div>" for _ in range(r.randint(1, 8)))
        else:
            article = self.bare_prose()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            article = self.named("div", _PLAIN[:3] + ["c1", "x1", "col", "box", "inner", "row"], article)
        junk = lambda k: self.junk(k) if r.random() < 0.4 else self.bare_junk(k)
        first = [junk(k) for k, share in (("header", 0.25), ("nav", 0.45), ("ad", 0.2), ("notice", 0.15)) if r.random() < share]
        last = [junk(k) for k, share in (("aside", 0.3), ("ad", 0.2), ("form", 0.15), ("footer", 0.45)) if r.random() < share]
        if r.random() < 0.12:  # cells of a table as columns of a page
            cells = [f"<td>{''.join(first) or self.links(3)}</td>", f"<td>{article}</td>"] + [f"<td>{self.links(4)}</td>"] * (r.random() < 0.3)
            body = f"<table><tr>{''.join(cells)}</tr>" + f"<tr><td>{''.join(last)}</td></tr>" * bool(last) + "</table>"
        else:
            body = "".join([*first, article, *last])
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body = self.named("div", _WRAP, body)
        if r.random() < 0.25:
            return body
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>"

    def page(self) -> str:
        if self.r.random() < 0.5:
            return self.bare_page()
        return self.named_page()

    def named_page(self) -> str:
        r = self.r
        parts = [self.article()]
        for kind, share, before in (("notice", 0.35, 0.7), ("ad", 0.5, 0.6), ("nav", 0.75, 0.85), ("header", 0.55, 1.0), ("aside", 0.45, 0.2), ("form", 0.25, 0.4), ("comments", 0.4, 0.0), ("ad", 0.2, 0.0), ("footer", 0.75, 0.0)):
            if r.random() < share:
                parts.insert(0 if r.random() < before else len(parts), self.junk(kind))
        body = "".join(parts)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            body = self.named("div", _WRAP, body)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """Pages in which each block of text starts with U+E001 (content) or U+E000 (not content)."""
    composer = Composer(seed)
    return [composer.page() for _ in range(n)]
