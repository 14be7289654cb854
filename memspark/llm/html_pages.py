"""Labelled pages for the extractor's potentials: layouts with invented words, drawn by a fixed seed.

There is no table of labelled pages, so these are composed here: each has a shell, boilerplate blocks around and inside
the content, and a content block. Labels stand beside the HTML, by the place of the start tag of a labelled element.
"""

from __future__ import annotations

import random
import re

SEED, PAGES = 17, 400
_SYLLABLES = "ba con der en fi gra hol in jo kal lu mi nor os pre qui ra sen tu ver".split()
#: (tag, class names) of boilerplate blocks, and how they are filled.
_AROUND = (
    ("nav", "", "links"), ("ul", "menu", "links"), ("div", "navbar", "links"), ("div", "breadcrumb", "links"), ("div", "pagination", "links"),
    ("header", "", "short"), ("div", "site-header", "short"), ("header", "masthead", "links"), ("div", "topbar", "short"),
    ("footer", "", "legal"), ("div", "footer", "legal"), ("div", "copyright", "legal"), ("footer", "site-footer", "long"), ("div", "", "legal"),
    ("aside", "", "long"), ("div", "sidebar", "links"), ("div", "widget", "short"), ("aside", "related", "links"), ("div", "popular", "links"),
    ("div", "ad", "long"), ("div", "ads banner", "long"), ("section", "sponsored", "long"), ("div", "advertisement", "short"), ("div", "promo", "short"),
    ("div", "cookie-notice", "notice"), ("div", "newsletter", "notice"), ("div", "popup", "notice"), ("div", "", "notice"),
    ("form", "", "form"), ("form", "search", "form"), ("div", "login", "form"), ("div", "share", "links"), ("div", "social", "links"), ("ul", "", "links"),
    ("div", "comments", "comments"), ("section", "comment-list", "comments"), ("div", "discussion", "comments"), ("div", "respond", "form"),
    ("div", "", "talk"), ("section", "", "talk"), ("ol", "commentlist", "items"), ("div", "", "links"), ("table", "", "linktable"),
)
_CONTENT = (("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post"), ("div", ""), ("section", "story"), ("div", ""))


_LABEL = re.compile("\x00([01])")


def _apart(marked: str) -> tuple[str, dict[int, int]]:
    """HTML and labels of a page whose labelled start tags have U+0000 and the label before them."""
    labels, parts, at = {}, [], 0
    for i, m in enumerate(_LABEL.finditer(marked)):
        parts.append(marked[at : m.start()])
        at = m.end()
        labels[m.start() - 2 * i] = int(m[1])
    return "".join([*parts, marked[at:]]), labels


def labelled_pages(seed: int = SEED, pages: int = PAGES) -> list[tuple[str, dict[int, int]]]:
    """(HTML, labels) of each page; the same for the same arguments."""
    rnd = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rnd.choices(_SYLLABLES, k=rnd.randint(1, 4))) for _ in range(rnd.randint(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        return words(lo, hi).capitalize() + rnd.choice("....?!")

    def filled(how: str) -> str:
        if how == "links":
            return "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(rnd.randint(2, 8)))
        if how == "linktable":
            return "<tr>" + "".join(f"<td><a href='/x'>{words(1, 3)}</a></td>" for _ in range(rnd.randint(2, 6))) + "</tr>"
        if how == "items":
            return "".join(f"<li>{sentence(5, 30)}</li>" for _ in range(rnd.randint(1, 4)))
        if how == "short":
            return rnd.choice((f"<h1>{words(1, 3)}</h1>", words(1, 4), f"<p>{words(2, 6)}</p>", f"<a href='/'>{words(1, 2)}</a>"))
        if how == "legal":
            return f"&copy; {words(1, 3)} " + rnd.choice((sentence(1, 20), "All rights reserved.", words(1, 3)))
        if how == "notice":
            return f"<p>{rnd.choice(('We use cookies', 'Subscribe', 'Sign up', 'Log in'))} {words(3, 20)}.</p><button>{words(1, 2)}</button>"
        if how == "form":
            return f"<label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button>"
        if how == "talk":  # comments whose elements have no telling name
            said = "".join(f"<div><span>{words(1, 2)}</span><p>{sentence(4, 40)}</p></div>" for _ in range(rnd.randint(1, 6)))
            return f"<h3>{rnd.choice(('Comments', f'{rnd.randint(1, 90)} comments', 'Replies', 'Leave a reply', 'Join the conversation', 'Discussion'))}</h3>" + said
        if how == "comments":
            return f"<h3>{words(1, 2)}</h3>" + "".join(f"<div class='comment'><span>{words(1, 2)}</span><p>{sentence(4, 40)}</p></div>" for _ in range(rnd.randint(1, 4)))
        return f"<p>{sentence(8, 30)}</p>" if rnd.random() < 0.5 else sentence(5, 40)

    def around(n: int) -> str:
        return "".join(f"\x000<{tag} class='{name}'>{filled(how)}</{tag}>" for tag, name, how in rnd.choices(_AROUND, k=n))

    def content() -> str:
        out = [f"<h1>{words(2, 9)}</h1>"] if rnd.random() < 0.8 else []
        for _ in range(rnd.choice((1, 2, 3, 5, 8, 12))):
            r = rnd.random()
            if r < 0.66:
                out.append(f"<p>{' '.join(sentence(1, 25) for _ in range(rnd.randint(1, 6)))}</p>")
            elif r < 0.72:
                out.append(f"<p>{sentence(6, 20)} <a href='/y'>{words(1, 3)}</a> {sentence(6, 20)}</p>")
            elif r < 0.78:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif r < 0.83:
                out.append("<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif r < 0.86:
                out.append(f"<blockquote><p>{sentence(5, 30)}</p></blockquote>")
            elif r < 0.89:
                out.append("<table><tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(rnd.randint(2, 4))) + "</tr></table>")
            elif r < 0.92:
                out.append(f"<p>{words(1, 3).capitalize()}.</p>")
            elif r < 0.95:
                out.append(f"<p>{rnd.choice(('All rights reserved.', 'Released under a licence.', f'{sentence(3, 20)} Read more about cookies.'))}</p>")
            else:
                out.append(around(1))
        if rnd.random() < 0.08:  # a list of links without a list around it, in one piece or spread
            items = [f"\x000<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(rnd.choice((5, 20, 60, 150, 400)))]
            if rnd.random() < 0.7:
                at = rnd.randint(0, len(out))
                out[at:at] = items
            else:
                for item in items:
                    out.insert(rnd.randint(0, len(out)), item)
        if rnd.random() < 0.15:
            out.insert(0, f"<header><h1>{words(2, 8)}</h1></header>")
        tag, name = rnd.choice(_CONTENT)
        return f"\x001<{tag} class='{name}'>{''.join(out)}</{tag}>"

    found = []
    for _ in range(pages):
        middle = around(rnd.randint(0, 2)) + content() + around(rnd.randint(0, 2))
        if rnd.random() < 0.4:
            middle = f"\x000<div class='{rnd.choice(('page', 'wrapper', 'container', ''))}'>{middle}</div>"
        found.append(_apart(f"\x000<html><body>{around(rnd.randint(1, 3))}{middle}{around(rnd.randint(1, 3))}</body></html>"))
    return found
