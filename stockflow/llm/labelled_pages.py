"""Labelled pages to train the extraction of main text on, laid out by rule from a stated seed.

Each page sets an article among menus, headers, footers, sidebars, notices, adverts, forms and comments, marked
up in one of several common ways: by element, by class or id, by both, or by no name at all. Texts of either
label are of any length and punctuation, so that they do not give the label away. Some pages have next to nothing
but a short article and what readers wrote below it.
"""

from __future__ import annotations

import random

PAGES = 160
SEED = 7

_SYLLABLES = "an be ci do el fa go hi in ka lo mer nu or per qui ra sol tem un ver".split()


class _Writer:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)

    def pick(self, *choices: str) -> str:
        return self.random.choice(choices)

    def words(self, low: int, high: int) -> list[str]:
        return ["".join(self.random.choices(_SYLLABLES, k=self.random.randint(1, 4))) for _ in range(self.random.randint(low, high))]

    def text(self, low: int, high: int) -> str:
        text = self.pick(" ", " ", " ", " | ").join(self.words(low, high))
        return text.capitalize() + self.pick(".", ".", ".", "", "!", "?")

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{w}">{w}</a>' for w in self.words(low, high)]

    def listed(self, items: list[str]) -> str:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def some(self, chance: float, text: str) -> str:
        return text if self.random.random() < chance else ""

    def paragraph(self) -> str:
        text = self.text(*self.random.choice([(1, 3), (4, 15), (20, 60), (60, 120)]))
        if self.random.random() < 0.2:
            text = f"{text} {self.links(1, 1)[0]} {self.text(2, 12)}"
        return self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p>{text}")

    def other_in_article(self) -> str:
        """What stands within an article and is no part of it."""
        return self.pick(
            f'<div class="{self.pick("ad", "ads", "advert", "sponsored", "promo-box")}" data-label="other">{self.text(3, 30)}</div>',
            f'<aside data-label="other"><p>{self.text(5, 30)}</p></aside>',
            f'<aside class="{self.pick("related", "more", "sidebar")}" data-label="other"><h3>{self.text(1, 4)}</h3>{self.listed(self.links(3, 6))}</aside>',
            f'<div class="{self.pick("share", "social-share", "tags", "article-meta")}" data-label="other">{" ".join(self.links(2, 5))}</div>',
            f'<form class="{self.pick("newsletter", "signup", "inline-form")}" data-label="other"><label>{self.text(2, 6)}</label><input name="e"><button>{self.text(1, 2)}</button></form>',
            f'<div class="{self.pick("notice", "alert", "cookie-notice")}" data-label="other"><p>{self.text(5, 25)}</p></div>',
            f'<nav data-label="other">{self.listed(self.links(2, 6))}</nav>',
            f'<footer data-label="other">{self.text(2, 15)}</footer>',
        )

    def part(self) -> str:
        """A part of an article other than a paragraph."""
        return self.pick(
            f"<h2>{self.text(1, 8)}</h2>{self.paragraph()}",
            f"<h3>{self.text(1, 8)}</h3>{self.paragraph()}",
            self.listed([self.text(1, 20) for _ in range(4)]),
            self.listed([self.text(1, 12) + " " + self.links(1, 1)[0] for _ in range(3)]),
            f"<ol><li>{self.text(2, 20)}<li>{self.text(2, 20)}</ol>",
            f"<blockquote><p>{self.text(5, 40)}</p></blockquote>",
            f"<blockquote>{self.text(5, 40)}</blockquote>",
            f"<pre>{self.text(3, 30)}</pre>",
            f"<figure><img src='x'><figcaption>{self.text(2, 15)}</figcaption></figure>",
            f"<table><tr><th>{self.text(1, 2)}</th><th>{self.text(1, 2)}</th></tr><tr><td>{self.text(1, 4)}</td><td>{self.text(1, 4)}</td></tr></table>",
            f"<dl><dt>{self.text(1, 2)}</dt><dd>{self.text(4, 20)}</dd></dl>",
            f"<section><h2>{self.text(1, 6)}</h2>{self.paragraph()}{self.paragraph()}</section>",
            f"<div>{self.paragraph()}{self.paragraph()}</div>",
        )

    def article(self) -> str:
        title = self.pick(f"<h1>{self.text(3, 14)}</h1>", f"<header><h1>{self.text(3, 14)}</h1></header>", "")
        parts = [self.paragraph() for _ in range(self.random.randint(1, 8))]
        for _ in range(self.random.choice([0, 0, 1, 2, 4])):
            parts.insert(self.random.randint(0, len(parts)), self.part())
        for _ in range(self.random.choice([0, 0, 1, 2])):
            parts.insert(self.random.randint(0, len(parts)), self.other_in_article())
        if self.random.random() < 0.25:
            parts.append(self.comments())
        body = title + "".join(parts)
        opened, closed = self.random.choice(
            [
                ("<article {}>", "</article>"),
                ("<article {}>", "</article>"),
                ('<article class="post" {}>', "</article>"),
                ("<main {}>", "</main>"),
                ("<main {}><article>", "</article></main>"),
                ('<div class="article-body" {}>', "</div>"),
                ('<div id="content" {}>', "</div>"),
                ('<div class="entry-content" {}><div>', "</div></div>"),
                ('<section class="story" {}>', "</section>"),
                ('<div role="main" {}>', "</div>"),
                ('<div id="main" {}><div class="post"><div class="post-body">', "</div></div></div>"),
                ("<div {}>", "</div>"),
                ("<div {}><div>", "</div></div>"),
                ('<div class="container"><div class="col" {}>', "</div></div>"),
                ('<div class="row"><div {}>', "</div></div>"),
                ("<table><tr><td {}>", "</td></tr></table>"),
            ]
        )
        return opened.format('data-label="content"') + body + closed

    def bare(self) -> str:
        """An article without an element of its own."""
        blocks = [f"<h1>{self.text(3, 14)}</h1>", *(f"<p>{self.text(4, 80)}</p>" for _ in range(self.random.randint(2, 6)))]
        return "".join(b.replace(">", ' data-label="content">', 1) for b in blocks)

    def comments(self) -> str:
        posts = "".join(
            f'<{t} class="{c}"><{self.pick("p", "div")}>{self.text(2, 40)}</{t}>'
            for t, c in [(self.pick("div", "li", "article"), self.pick("comment", "comment-body", "reply")) for _ in range(self.random.randint(1, 4))]
        )
        if self.random.random() < 0.3:
            posts = "".join(f"<p>{self.text(1, 30)}</p>" for _ in range(self.random.randint(1, 3)))
        tag = self.pick("section", "div", "aside", "ol")
        title = self.some(0.6, f"<h3>{self.text(1, 4)}</h3>")
        name = self.pick("comments", "comment-list", "reader-comments", "disqus_thread", "discussion", "responses", "replies", "feedback")
        return f'<{tag} {self.pick("class", "id")}="{name}" data-label="other">{title}{posts}</{tag}>'

    def above(self) -> str:
        parts = [
            self.pick(
                f"<nav>{self.listed(self.links(3, 8))}</nav>",
                f'<div class="{self.pick("menu", "navbar", "main-nav", "breadcrumb")}">{self.pick(self.listed(self.links(3, 8)), " ".join(self.links(3, 8)))}</div>',
                f'<ul id="nav">{"".join(f"<li>{x}</li>" for x in self.links(3, 7))}</ul>',
            ),
            self.some(0.5, self.pick(
                f"<header><h1>{self.text(1, 5)}</h1><p>{self.text(2, 12)}</p></header>",
                f'<header class="site-header"><div class="logo">{self.text(1, 3)}</div><nav>{self.listed(self.links(3, 6))}</nav></header>',
                f'<div id="{self.pick("header", "masthead", "topbar")}"><h2>{self.text(1, 5)}</h2><span>{self.text(2, 8)}</span></div>',
            )),
            self.some(0.5, f'<div class="{self.pick("ad", "ads", "advert", "ad-banner", "sponsor")}">{self.text(2, 40)}</div>'),
            self.some(0.3, self.notice()),
            self.some(0.2, f'<form class="search" action="/s"><input name="q"><button>{self.text(1, 2)}</button></form>'),
        ]
        self.random.shuffle(parts)
        return "".join(parts)

    def notice(self) -> str:
        text = self.text(5, 40)
        if self.random.random() < 0.4:
            words = text.split(" ")
            words.insert(self.random.randint(1, len(words)), self.pick("cookies", "cookie", "consent", "newsletter"))
            text = " ".join(words)
        inner = self.pick(f"<p>{text}</p>", text) + self.some(0.6, f"<button>{self.text(1, 2)}</button>")
        if "<button>" in inner and self.random.random() < 0.4:
            return self.pick(f"<div>{inner}</div>", f"<section>{inner}</section>", f"<div><div>{inner}</div></div>")
        return self.pick(
            f'<div class="{self.pick("cookie-banner", "notice", "consent", "gdpr", "alert", "newsletter")}">{inner}</div>',
            f'<section id="{self.pick("cookie-notice", "popup", "subscribe")}">{inner}</section>',
            f'<div role="{self.pick("alert", "dialog")}">{inner}</div>',
        )

    def below(self) -> str:
        footer = self.pick(
            f"<footer>{self.pick('&copy; ', '')}{self.text(2, 30)}</footer>",
            f"<footer><p>{self.text(2, 30)}</p>{self.listed(self.links(2, 5))}</footer>",
            f'<div {self.pick("class", "id")}="{self.pick("footer", "site-footer", "copyright", "bottom")}">{self.pick("&copy; ", "")}{self.text(2, 30)}</div>',
        )
        parts = [
            self.some(0.4, self.pick(
                f"<aside><h3>{self.text(1, 4)}</h3>{self.listed(self.links(3, 8))}</aside>",
                f"<aside><p>{self.text(4, 40)}</p></aside>",
                f'<div class="{self.pick("sidebar", "related-posts", "widget", "side-rail", "recommended")}"><h3>{self.text(1, 4)}</h3>{self.pick(self.listed(self.links(3, 8)), f"<p>{self.text(4, 40)}</p>")}</div>',
            )),
            self.some(0.35, self.comments()),
            self.some(0.25, f'<form {self.some(0.7, "class=contact")}><label>{self.text(1, 6)}</label><input><p>{self.text(2, 15)}</p><button>{self.text(1, 2)}</button></form>'),
            self.some(0.25, self.notice()),
            self.some(0.2, f'<div class="ad">{self.text(2, 40)}</div>'),
        ]
        self.random.shuffle(parts)
        return "".join(parts) + footer

    def lean(self) -> str:
        """A page of one or two short paragraphs, with little or nothing around them."""
        blocks = self.some(0.4, f"<h1>{self.text(1, 6)}</h1>")
        blocks += "".join(f"<p>{self.text(1, 14)}</p>" for _ in range(self.random.randint(1, 2)))
        inside, after = self.some(0.6, self.comments()), self.some(0.3, self.comments())
        opened, closed = self.random.choice(
            [
                ("<article {}>", "</article>"),
                ("<article {}>", "</article>"),
                ("<main {}>", "</main>"),
                ('<div class="post" {}>', "</div>"),
                ("<div {}>", "</div>"),
                ("<div {}><div>", "</div></div>"),
            ]
        )
        before = self.some(0.3, f"<nav>{self.listed(self.links(2, 5))}</nav>") + self.some(0.3, self.notice())
        end = self.some(0.3, f"<footer>{self.text(1, 8)}</footer>")
        return before + opened.format('data-label="content"') + blocks + inside + closed + after + end

    def page(self) -> str:
        if self.random.random() < 0.25:
            return f'<html><body data-label="other">{self.lean()}</body></html>'
        opened, closed = self.random.choice([("", ""), ("", ""), ("<div id='page'>", "</div>"), ("<div class='wrapper'><div class='row'>", "</div></div>")])
        end = self.pick("</body></html>", "</body></html>", "")
        article = self.bare() if self.random.random() < 0.15 else self.article()
        return f'<html><head><title>{self.text(2, 9)}</title><script>var a="</p>";</script></head><body data-label="other">{opened}{self.above()}{article}{self.below()}{closed}{end}'


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages with ``data-label`` attributes; the same for the same seed."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(pages)]
