"""Labelled pages the extraction model is trained on: made here, from layouts written for the purpose.

What stands under an element with the attribute data-main is main text; the attribute is no feature.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ber cor del en fi gal hor in jo kel lum mi nor os pra qui ren sol tur um ver wen yl zon".split()


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 1, b: int = 18) -> str:
        x = self.words(a, b)
        x = x.upper() + self.r.choice(("!!", "!", ".")) if self.r.random() < 0.08 else x.capitalize() + self.r.choice((".", ".", ".", "?", ""))
        return " | ".join(x.split()) if self.r.random() < 0.06 else x

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 1, 2, 3, 5, 8))))

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(a, b)}</a>'

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def body(self) -> str:
        out = [f"<{h}>{self.words(1, 12)}</{h}>" for h in [self.pick("h1", "h1", "h2")] if self.r.random() < 0.85]
        for _ in range(self.r.choice((1, 2, 4, 7, 12, 20))):
            kind = self.r.random()
            if kind < 0.6:
                out.append(f"<p>{self.prose()}</p>")
            elif kind < 0.68:
                out.append(f"<p><b>{self.prose()}<br>")
            elif kind < 0.74:
                out.append(f"<h{self.r.randint(2, 4)}>{self.words(1, 7)}</h3>")
            elif kind < 0.79:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>")
            elif kind < 0.83:
                out.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif kind < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif kind < 0.9:
                out.append(f"<pre>{self.words(2, 20)}</pre>")
            elif kind < 0.94:
                out.append(f"<p>{self.sentence()} {self.link()} {self.sentence()}</p>")
            elif kind < 0.96:
                out.append(f"<p>&copy; {self.prose()}</p>")
            elif kind < 0.98:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                out.append(f"<div>{self.prose()}</div>")
        return "".join(out)

    def advert(self) -> str:
        c = self.pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "advertisement")
        return self.pick(f'<div class="{c}">{self.prose()}</div>', f'<div id="{c}"><p>{self.prose()}</p></div>', f'<aside class="{c}"><p>{self.sentence()}</p>{self.link()}</aside>', f'<section class="{c}"><h3>{self.words(1, 4)}</h3><p>{self.prose()}</p></section>')

    def notice(self) -> str:
        c = self.pick("cookie", "cookie-banner", "consent", "notice", "gdpr", "newsletter", "subscribe", "paywall", "alert", "popup", "modal")
        return self.pick(f'<div class="{c}">{self.sentence()} <button>{self.word()}</button></div>', f'<div id="{c}"><p>{self.prose()}</p><a href="#">{self.word()}</a></div>', f'<section class="{c}" role="alert"><p>{self.prose()}</p></section>', f'<div role="dialog" class="{c}"><p>{self.prose()}</p></div>')

    def menu(self) -> str:
        n = self.r.randint(2, 9)
        return self.pick(f"<nav>{self.links(n)}</nav>", f'<div class="{self.pick("menu", "nav", "navbar", "topnav")}">{self.links(n)}</div>', "<nav>" + " ".join(self.link() for _ in range(n)) + "</nav>", f'<ul id="menu">{"".join(f"<li>{self.link()}" for _ in range(n))}</ul>', f"<nav>{self.links(n)}<p>{self.sentence()}</p></nav>", f'<div class="breadcrumb">{self.link()} &gt; {self.link()} &gt; {self.word()}</div>')

    def header(self) -> str:
        return self.pick(f"<header><div>{self.words(1, 4)}</div><p>{self.sentence()}</p></header>", f"<header><h1>{self.words(1, 3)}</h1>{self.menu()}</header>", f'<div class="{self.pick("header", "masthead", "topbar")}"><p>{self.prose()}</p></div>', f'<div id="header">{self.link()}<span>{self.words(1, 6)}</span></div>', f'<header class="site-header"><p>{self.prose()}</p></header>')

    def footer(self) -> str:
        return self.pick(f"<footer>&copy; {self.word()}.example &middot; {self.prose()}</footer>", f"<footer><p>{self.prose()}</p>{self.links(3)}</footer>", f'<div class="footer"><p>&copy; {self.words(1, 5)}</p><p>{self.prose()}</p></div>', f'<div id="footer">{self.prose()}</div>', f"<footer>{self.prose()}</footer>")

    def sidebar(self) -> str:
        c = self.pick("sidebar", "side", "widget", "related", "recommended", "trending", "popular", "teaser")
        return self.pick(f"<aside><h3>{self.words(1, 3)}</h3>{self.links(4)}</aside>", f'<div class="{c}"><h4>{self.words(1, 3)}</h4><p>{self.prose()}</p>{self.links(3)}</div>', f"<aside><p>{self.prose()}</p><p>{self.prose()}</p></aside>", f'<aside class="{c}"><p>{self.prose()}</p></aside>', f'<div id="{c}"><ul><li>{self.sentence()}</li><li>{self.link(3, 8)}</li></ul></div>')

    def comments(self) -> str:
        n = self.r.randint(1, 5)
        c = self.pick("comments", "comment-list", "responses", "discussion", "replies", "disqus")
        each = "".join(self.pick(f"<p>{self.prose()}</p>", f'<div class="comment"><b>{self.word()}</b><p>{self.prose()}</p></div>', f"<li><p>{self.prose()}</p></li>", f'<article class="comment"><p>{self.prose()}</p></article>') for _ in range(n))
        return self.pick(f'<section class="{c}"><h3>{self.words(1, 2)}</h3>{each}</section>', f'<div id="{c}">{each}</div>', f'<div class="{c}"><h2>{self.words(1, 2)}</h2>{each}</div>', f'<ol class="{c}">{each}</ol>')

    def form(self) -> str:
        return self.pick(f"<form><label>{self.words(1, 4)}</label><input><button>{self.word()}</button></form>", f'<form class="search"><p>{self.sentence()}</p><button>{self.word()}</button></form>', f"<form><p>{self.prose()}</p><textarea>{self.word()}</textarea></form>")

    def share(self) -> str:
        return f'<div class="{self.pick("share", "social", "tags", "byline", "meta", "author-bio")}">' + self.pick(" ".join(self.link(1, 1) for _ in range(3)), f"<span>{self.words(1, 5)}</span>", self.sentence()) + "</div>"

    def page(self) -> str:
        r = self.r
        some = lambda p, f: f() if r.random() < p else ""
        body = self.body()
        if r.random() < 0.45:  # what intrudes between blocks of the article
            intruder = self.pick("advert", "share", "notice", "form", "sidebar", "comments")
            body = self.pick(body + "@", body.replace("</p>", "</p>@", 1) if "</p>" in body else body + "@").replace("@", f"<!--off-->{getattr(self, intruder)()}<!--on-->")
        main = self.pick("<article data-main>@</article>", "<article data-main>@</article>", "<article data-main>@</article>", "<main><article data-main>@</article></main>", "<main data-main>@</main>", '<div class="content" data-main>@</div>', '<div id="content" data-main>@</div>', '<div class="post" data-main>@</div>', '<div class="entry-content" data-main>@</div>', '<section class="story" data-main>@</section>', '<div id="main"><div class="article-body" data-main>@</div></div>', "<div data-main>@</div>", '<article class="post" data-main><div class="text">@</div></article>').replace("@", body)
        parts = [some(0.5, self.header), some(0.75, self.menu), some(0.25, self.notice), some(0.45, self.advert), some(0.2, self.sidebar), main, some(0.15, self.share), some(0.25, self.advert), some(0.3, self.comments), some(0.3, self.sidebar), some(0.2, self.form), some(0.15, self.notice), some(0.8, self.footer)]
        wrap = self.pick("@", "@", "@", '<div class="wrapper">@</div>', '<div id="page"><div class="container">@</div></div>')
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{wrap.replace('@', ''.join(parts))}</body></html>"


def labelled_pages(n: int = 700, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]
