"""Labelled pages to learn main-text extraction from, written by a seeded generator.

Layouts, containers and names vary; a part of the pages has no names at all, and names that speak of
parts a page has or lacks stand on containers of the content too. Words are made of syllables, so only
phrases that boilerplate uses differ between content and the rest, and content now and then holds them.
"""

from __future__ import annotations

import random

SYLLABLES = "ba de fi go hu ka le mi no pu ra se ti vo wu za ler min tor vas ven dro plo gri sta tion ent ar is om".split()
#: Names that content and boilerplate bear on many sites.
CONTENT = "content article post entry story article-body post-content entry-content main-content story-body articleBody page-content text body-text prose markdown-body".split()
TITLES = "article-header entry-header post-header headline page-title entry-title post-title title article-title".split()
METAS = "byline meta story-meta post-meta entry-meta article-meta author date entry-date dateline".split()
STATES = "no-sidebar has-sidebar has-social-share with-comments no-js has-footer page wrapper container home single site layout row col grid inner outer section box".split()
NAMES = {
    "menu": "nav navbar menu main-menu navigation breadcrumb breadcrumbs site-nav top-menu toc pagination tabs".split(),
    "head": "header site-header masthead banner topbar top-bar branding logo page-head".split(),
    "foot": "footer site-footer page-footer copyright legal colophon contentinfo bottom footer-links".split(),
    "side": "sidebar side-bar aside related related-posts recommended widget widgets side-column rail trending most-read popular complementary".split(),
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert popup modal newsletter subscribe newsletter-signup paywall disclaimer".split(),
    "ad": "ad ads advert advertisement ad-slot ad-banner sponsored sponsor promo promoted adsbygoogle ad-container".split(),
    "form": "form search search-form searchbox login login-form signup contact-form".split(),
    "comments": "comments comment comment-list comments-area discussion replies reader-comments disqus respond comment-body".split(),
    "share": "share sharing social social-share share-buttons follow-us addtoany".split(),
}
ELEMENTS = {"menu": ("nav",), "head": ("header",), "foot": ("footer",), "side": ("aside",), "form": ("form",), "notice": ("dialog",)}
PHRASES = {
    "menu": "Home|News|About us|Contact|World|Sport|Politics|Archive|Login|Next|Previous|Startseite|Kontakt|Accueil|Inicio|Help|Sitemap|Terms|Privacy".split("|"),
    "head": "The daily {w}|All the news of the day|{w} online|Search|Menu|Welcome to {w}".split("|"),
    "foot": "© 2024 {w}. All rights reserved.|Copyright 2023 all rights reserved by {w}|© {w} · {s}|Alle Rechte vorbehalten. Impressum|Tous droits réservés. Mentions légales|Todos los derechos reservados {w}|Terms of use and privacy policy|Powered by {w}".split("|"),
    "side": "Related|Most read|You may also like|Recommended for you|Popular posts|Tags|{s}|Read more".split("|"),
    "notice": "We use cookies to improve this site|This site uses cookies. Accept all cookies|Subscribe to our newsletter|Sign up for our newsletter to get {w}|Please enable JavaScript|Accept".split("|"),
    "ad": "Advertisement|Sponsored|Buy now and save 20% on {w}|Special offer: {w} for free, order today|{s}|Anzeige|Publicité".split("|"),
    "form": "Your e-mail address|Send|Search this site|Your name|Password|Username|Submit|Log in".split("|"),
    "comments": "Comments|3 comments|Reply|Leave a reply|Posted by {w} at 10:31|{s}|{s}|{s}".split("|"),
    "share": "Share this page with your friends|Share on|Tweet|Follow us|Print this page|E-mail this to a friend".split("|"),
}
#: Lines that end articles as well as pages.
LEGAL = "All rights reserved.|Used by permission.|This work is in the public domain.|Licensed under the terms of an open licence.|Copyright by the author.".split("|")
LOOSE = "copyright rights cookies comments reply share search related privacy subscribe advertisement news contact".split()


#: Function words of four languages and plain words that content and boilerplate share.
COMMON = (
    "the of to and in is it this that all your by for with on at as was are be from or an have not you we our he she they but can will their more when who what about into than then now only over such time year people day way new first "
    "der die das und ist in den von zu mit auf le la les des et en du un une est que pour dans el los las y que por una con del se "
    "name read log menu site accept send save order today free address friend list print sign next home buy use get help page top last"
).split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int = 4, most: int = 24) -> str:
        draw = self.r.random
        words = [self.r.choice(COMMON) if draw() < 0.45 else self.r.choice(LOOSE) if draw() < 0.02 else self.word() for _ in range(self.r.randint(least, most))]
        return " ".join(words).capitalize() + self.r.choice("....!?")

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 4, 6))))

    def phrase(self, kind: str) -> str:
        return self.r.choice(PHRASES[kind]).replace("{w}", self.word()).replace("{s}", self.sentence())

    def named(self, names: list[str]) -> str:
        attribute = self.r.choice(("class", "class", "class", "id"))
        more = [self.r.choice(STATES)] if self.r.random() < 0.3 else []
        value = " ".join(self.r.sample([self.r.choice(names), *more], 1 + len(more)))
        return f' {attribute}="{value}"'

    def boilerplate(self, kind: str, bare: bool) -> str:
        """A part of the page that is no content; without names and telling elements if ``bare``."""
        r = self.r
        count = {"menu": 6, "side": 8, "comments": 5, "foot": 2, "form": 3, "share": 2, "ad": 3, "notice": 3}.get(kind, 1)
        own = 1.0 if bare else 0.25  # where names tell, the text often does not
        items = [self.phrase(kind) if r.random() < own else self.sentence(2, 20) for _ in range(r.randint(1, count))]
        if kind in ("menu", "side", "share") and r.random() < (0.8 if bare or kind == "menu" else 0.5):
            items = [f'<a href="/{i}">{t}</a>' for i, t in enumerate(items)]
        style = r.choice(("li", "p", "div", "flat"))
        inner = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>" if style == "li" else " ".join(items) if style == "flat" else "".join(f"<{style}>{t}</{style}>" for t in items)
        if kind == "form":
            inner = f'{inner}<input name="q">'
        if bare:
            return f"<div>{inner}</div>"
        if kind in ELEMENTS and r.random() < 0.6:
            tag = r.choice(ELEMENTS[kind])
            return f"<{tag}>{inner}</{tag}>"
        tag = r.choice(("div", "div", "section", "ul" if style == "li" else "div"))
        return f"<{tag}{self.named(NAMES[kind])}>{inner}</{tag}>"

    def content(self, bare: bool) -> tuple[list[str], list[str]]:
        """Pieces of markup and the lines they hold."""
        r = self.r
        title = self.sentence(2, 8).rstrip(".!?")
        pieces, lines = [], [title]
        how = r.random()
        head = f"<h1>{title}</h1>" if how < 0.6 else f"<h2>{title}</h2>"
        if how > 0.75:  # no heading, or none that is marked as one
            head, lines = (f"<p>{title}</p>", lines) if how > 0.9 else ("", [])
        elif not bare and r.random() < 0.3:
            head = f"<header>{head}</header>" if r.random() < 0.4 else f"<div{self.named(TITLES)}>{head}</div>"
        pieces.append(head or "<hr>")
        if r.random() < 0.3:
            lines.append(r.choice(("By {w}", "by {w} {w}", "May 2", "{w} 12, 2024", "{w}")).replace("{w}", self.word()))
            pieces.append(f"<{(tag := r.choice(('div', 'p')))}{'' if bare else self.named(METAS)}>{lines[-1]}</{tag}>")
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            if kind < 0.7:
                line = self.paragraph() if r.random() < 0.75 else self.sentence(1, 3) if r.random() < 0.6 else self.word()
                if not bare and r.random() < 0.1:  # articles have such lines of their own
                    line = r.choice(LEGAL) if r.random() < 0.5 else self.phrase(r.choice(("foot", "share", "notice", "side")))
                if r.random() < 0.25:
                    line = line.rstrip(".!?") + r.choice(("", ",", " |", "##", "..."))
                form = r.random()
                if form < 0.15:
                    pieces.append(f"<div>{line}</div>")
                elif form < 0.3:
                    pieces.append(f"{line}<hr>")
                elif form < 0.45:
                    pieces.append(f'<p>{line} <a href="/x">{(more := self.sentence(1, 4))}</a></p>')
                    line = f"{line} {more}"
                else:
                    pieces.append(f"<p{self.named(CONTENT) if not bare and r.random() < 0.1 else ''}>{line}</p>")
                lines.append(line)
            elif kind < 0.8:
                lines.append(self.sentence(2, 6).rstrip(".!?"))
                pieces.append(f"<h{(n := r.randint(2, 4))}>{lines[-1]}</h{n}>")
            elif kind < 0.9:
                items = [self.sentence(1, 10) for _ in range(r.randint(2, 5))]
                lines += items
                pieces.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            elif kind < 0.95:
                lines.append(self.sentence())
                pieces.append(f"<blockquote>{lines[-1]}</blockquote>")
            else:
                cells = [self.sentence(1, 3).rstrip(".!?") for _ in range(4)]
                lines += cells
                pieces.append(f"<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>")
        return pieces, lines

    def page(self) -> tuple[str, str]:
        r = self.r
        bare = r.random() < 0.25
        pieces, lines = self.content(bare)
        for kind in ("ad", "share", "side", "form", "notice"):  # inside the article
            if not bare and r.random() < 0.15:
                pieces.insert(r.randint(1, len(pieces)), self.boilerplate(kind, False))
        if not bare and r.random() < 0.3:
            pieces.append(self.boilerplate("comments", False))
        inner = "".join(pieces)
        state = f' class="{" ".join(r.sample(STATES, r.randint(1, 2)))}"' if r.random() < 0.5 else ""
        how = r.random()
        if bare:
            body = r.choice((f"<div>{inner}</div>", inner, f"<table><tr><td>{inner}</td></tr></table>"))
        elif how < 0.35:
            body = f"<article{state}>{inner}</article>"
        elif how < 0.5:
            body = f"<main{state}>{inner}</main>"
        elif how < 0.75:
            body = f"<div{self.named(CONTENT)}>{inner}</div>"
        else:
            body = r.choice((f"<div{state}>{inner}</div>", inner, f"<section{state}>{inner}</section>", f"<table><tr><td>{inner}</td></tr></table>"))
        before = [self.boilerplate(k, bare) for k in ("head", "menu", "notice", "ad", "form") if r.random() < 0.5]
        after = [self.boilerplate(k, bare) for k in ("share", "side", "ad", "comments", "form") if not (bare and k == "comments") and r.random() < 0.3]
        if r.random() < 0.8:
            after.append(self.boilerplate("foot", bare))
        whole = "".join([*before, body, *after])
        if r.random() < 0.2:
            whole = f"<form id=\"aspnet\">{whole}</form>" if r.random() < 0.5 else f"<div{state}>{whole}</div>"
        top = f' class="{" ".join(r.sample(STATES, 2))}"' if r.random() < 0.5 else ""
        return f"<html><head><title>{lines[0]}</title><style>p{{}}</style></head><body{top}>{whole}</body></html>", "\n".join(lines)


def plain_pages() -> list[tuple[str, str]]:
    """Small labelled pages written for this purpose: common layouts with and without marked containers."""
    story = ["A short heading", "The first paragraph tells what happened and where it did, at some length.", "Another one adds the reasons, and a few numbers such as 12 or 40.", "The last says what may follow."]
    body = f"<h1>{story[0]}</h1>" + "".join(f"<p>{p}</p>" for p in story[1:])
    menu = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav>'
    plain_menu = '<div class="navbar"><a href="/a">Home</a> <a href="/b">World news</a> <a href="/c">Contact</a></div>'
    advert = '<div class="ad">Buy two of these and save more than ever before.</div>'
    notice = '<div class="cookie-notice">We use cookies to improve this site and for statistics.</div>'
    side = '<aside><h3>Related</h3><ul><li><a href="/r">Another story that you may like</a></li></ul></aside>'
    side_box = '<div class="sidebar"><p>Most read today is listed in this box.</p></div>'
    form = '<form action="/s"><label>Your address</label><input name="q"><button>Send it</button></form>'
    remarks = '<section id="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all, sorry.</p></div></section>'
    share = '<div class="share">Share this page with your friends</div>'
    header = "<header><div>The Daily Page</div><p>All the news of the day</p></header>"
    footer = "<footer>&copy; The Daily Page &middot; all rights reserved in every country.</footer>"
    text = "\n".join(story)
    pages = [
        (f"<html><body>{header}{menu}{advert}<article>{body}</article>{footer}</body></html>", text),
        (f"<html><body>{plain_menu}{notice}<main>{body}{remarks}</main>{side}{footer}</body></html>", text),
        (f"<html><body>{menu}<div id='content'>{body}{share}{form}</div>{side_box}{footer}</body></html>", text),
        (f"<html><body>{header}<div>{body}</div>{form}{advert}{footer}</body></html>", text),
        (f"<html><body>{plain_menu}<table><tr><td>{body}</td></tr></table>{side}{remarks}</body></html>", text),
        (f"<html><body><div class='post'>{body}<ul><li>One point</li><li>Another point</li></ul><blockquote>Said by one.</blockquote></div>{notice}{footer}</body></html>", text + "\nOne point\nAnother point\nSaid by one."),
        (f"<html><body><p>{story[1]}<p>{story[2]}{footer}</body></html>", "\n".join(story[1:3])),
    ]
    return pages


def labelled_pages(n: int = 1600, seed: int = 11) -> list[tuple[str, str]]:
    """(page, its main text) of the plain pages and ``n`` generated ones."""
    writer = Writer(seed)
    return [*plain_pages() * 3, *(writer.page() for _ in range(n))]
