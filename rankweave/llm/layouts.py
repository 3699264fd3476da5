"""Made-up web pages in many layouts, with every text marked as main or other: the training data of the labeller."""

from __future__ import annotations

import numpy as np

_SYLLABLES = (
    "an re ti on er th he in st ou le ne ar ed es ing tion ment able ly al or".split(),
    "ein ung keit sch ver ge be lich heit der und zu ich auf tz ö ü ä".split(),
    "que eau ment tion ai ou les des é è ê ux oi vre elle".split(),
    "ción mente ado ida os as que ez ar ll ñ ó í la el".split(),
)
_MENU = "menu nav navbar navigation topnav links breadcrumb breadcrumbs tabs".split()
_HEAD = "header masthead site-header top topbar branding banner".split()
_FOOT = "footer site-footer bottom copyright colophon legal foot".split()
_SIDE = "sidebar side aside widget widgets related related-posts recommended popular trending more-stories rail".split()
_NOTE = "cookie cookie-notice notice alert consent gdpr popup modal overlay message warning banner-notice".split()
_AD = "ad ads advert advertisement sponsored promo promotion ad-slot banner-ad ad-container sponsor adsbox".split()
_COMMENT = "comments comment comment-list reader-comments responses discussion comments-area replies".split()
_FORM = "form search search-form newsletter subscribe signup login contact-form".split()
_SHARE = "share social sharing social-links tags meta toolbar".split()
_MAIN = "article post entry entry-content article-body story content post-content main-content text body-text article-content".split()
_WRAP = "wrapper container page site layout row col outer inner box block".split()


def layout(rng: np.random.Generator, main: str, other: str) -> str:
    """One page: its parts in a random order of the usual ones, some left out, some tags left open, some pages cut off."""
    pick = lambda items: items[int(rng.integers(len(items)))]
    coin = lambda p: rng.random() < p
    syllables, foreign = pick(_SYLLABLES), pick(_SYLLABLES)
    junk = pick(["", "", "", "", "***", "!!", "###", "&amp;&amp;&amp;", "%%%", " |"])
    shout = junk == "!!" or coin(0.05)

    def words(n: int, source=None) -> str:
        out = []
        for _ in range(n):
            w = "".join(pick(source or syllables) for _ in range(int(rng.integers(1, 5))))
            w = w.upper() if shout and source is None else w
            out.append(w + (junk if source is None and junk and coin(0.7) else pick(["", "", "", "", ",", "."])))
        return " ".join(out)

    def say(mark: str, least: int, most: int) -> str:
        n = int(rng.integers(least, most + 1))
        text = words(n, foreign if mark == other and coin(0.6) else None)
        return mark + (text[:1].upper() + text[1:]) + pick(["", ".", ".", "&nbsp;", " &copy;"] if mark == other else ["", ".", "."])

    def called(tag: str, names: list[str], body: str) -> str:
        kind = pick(["class", "class", "class", "id"])
        more = pick(["", "", "", f" {pick(_WRAP)}", f" {pick(_WRAP)}-{int(rng.integers(9))}"]) if kind == "class" else ""
        return f'<{tag} {kind}="{pick(names)}{more}">{body}</{tag}>'

    def menu() -> str:
        links = [f'<a href="/{i}">{say(other, 1, 3)}</a>' for i in range(int(rng.integers(2, 9)))]
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if coin(0.75) else "".join(f"<div>{x}</div>" if coin(0.5) else f"<p>{x}</p>" for x in links)
        return f"<nav>{body}</nav>" if coin(0.6) else called(pick(["div", "ul", "nav"]), _MENU, body)

    def heading(mark: str, level: int) -> str:
        return f"<h{level}>{say(mark, 1, 10)}</h{level}>"

    def head() -> str:
        body = pick([heading(other, 1), heading(other, 2), f"<p>{say(other, 1, 6)}</p>", f'<a href="/">{say(other, 1, 3)}</a>']) + (f"<p>{say(other, 2, 12)}</p>" if coin(0.5) else "") + (form() if coin(0.2) else "") + (menu() if coin(0.3) else "")
        return f"<header>{body}</header>" if coin(0.6) else called("div", _HEAD, body)

    def foot() -> str:
        body = "".join(pick([f"<p>{say(other, 2, 25)}</p>", f"&copy; {say(other, 2, 15)}", f'<div><a href="#">{say(other, 1, 3)}</a></div>']) for _ in range(int(rng.integers(1, 4))))
        return f"<footer>{body}</footer>" if coin(0.65) else called("div", _FOOT, body)

    def advert() -> str:
        body = pick([say(other, 1, 30), f"<p>{say(other, 2, 40)}</p>", f'<a href="#">{say(other, 2, 12)}</a>', f"{heading(other, 3)}<p>{say(other, 3, 25)}</p>"])
        return f"<!-- ad {int(rng.integers(999))} -->" * coin(0.3) + called(pick(["div", "div", "div", "aside", "section", "ins"]), _AD, body)

    def notice() -> str:
        body = f"<p>{say(other, 3, 30)}</p>" + (f"<button>{say(other, 1, 2)}</button>" if coin(0.6) else "")
        return f'<div role="{pick(["alert", "dialog", "alertdialog"])}">{body}</div>' if coin(0.25) else called(pick(["div", "section", "aside"]), _NOTE, body)

    def side() -> str:
        body = "".join(pick([heading(other, 3), f"<p>{say(other, 3, 40)}</p>", "<ul>" + "".join(f'<li><a href="#">{say(other, 2, 9)}</a></li>' for _ in range(int(rng.integers(2, 6)))) + "</ul>"]) for _ in range(int(rng.integers(1, 5))))
        return f"<aside>{body}</aside>" if coin(0.5) else called(pick(["div", "aside", "section"]), _SIDE, body)

    def form() -> str:
        body = "".join(pick([f"<label>{say(other, 1, 4)}</label><input>", f"<p>{say(other, 2, 15)}</p>", f"<button>{say(other, 1, 2)}</button>", f"<select><option>{say(other, 1, 2)}<option>{say(other, 1, 2)}</select>", f"<div>{say(other, 1, 6)}</div>"]) for _ in range(int(rng.integers(1, 5))))
        return f"<form>{body}</form>" if coin(0.6) else f"<form {pick(['class', 'id'])}=\"{pick(_FORM)}\">{body}</form>"

    def comments() -> str:
        one = lambda: (f"<b>{say(other, 1, 2)}</b>" if coin(0.4) else heading(other, 4) if coin(0.3) else "") + f"<p>{say(other, 3, 70)}</p>"
        n = int(rng.integers(1, 6))
        body = heading(other, pick([2, 3])) * coin(0.6)
        body += "<ol>" + "".join(f'<li class="comment">{one()}</li>' for _ in range(n)) + "</ol>" if coin(0.4) else "".join(called(pick(["div", "article", "section"]), ["comment", "reply", "comment-body"], one()) if coin(0.7) else one() for _ in range(n))
        return called(pick(["div", "section", "section", "aside"]), _COMMENT, body + (form() if coin(0.3) else ""))

    def hidden() -> str:
        return f"<div {pick(['hidden', 'style=\"display:none\"', 'aria-hidden=\"true\"'])}><p>{say(other, 2, 20)}</p></div>"

    def paragraph() -> str:
        text = say(main, 1, pick([3, 30, 90]))
        kind = rng.random()
        if kind < 0.5:
            return f"<p>{text}</p>"
        if kind < 0.62:
            return f"<p><b>{text}<br>"  # left open
        if kind < 0.70:
            return f"<p>{text}"
        if kind < 0.76:
            return f"<p>{text} <a href='#'>{words(3)}</a> <em>{words(2)}</em></p>"
        if kind < 0.82:
            return heading(main, pick([2, 3]))
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{say(main, 1, 20)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.94:
            return f"<table><tr><td>{say(main, 1, 5)}</td><td>{say(main, 1, 5)}</td></tr></table>"
        if kind < 0.97:
            return f"<div>{text}</div>"
        return f"<pre>{text}</pre>"

    def article() -> str:
        body = heading(main, 1) * coin(0.85)
        for _ in range(int(rng.integers(1, pick([3, 9, 25])))):
            body += paragraph()
            if coin(0.06):
                body += pick([advert, side, form, notice, hidden])()
            if coin(0.02):
                body += called("div", _SHARE, "".join(f'<a href="#">{say(other, 1, 2)}</a> ' for _ in range(3)))
        if coin(0.12):
            body += comments()
        kind = rng.random()
        if kind < 0.55:
            body = f"<article>{body}</article>"
        elif kind < 0.62:
            body = f"<article>{called('div', _MAIN, body)}</article>"
        elif kind < 0.8:
            body = called(pick(["div", "section", "div", "article"]), _MAIN, body)
        elif kind < 0.92:
            body = f"<main>{body}</main>"
        return f"<main>{body}</main>" if kind < 0.8 and coin(0.3) else body

    before = [f() for f, p in ((head, 0.5), (menu, 0.75), (notice, 0.3), (advert, 0.5), (side, 0.2), (form, 0.15), (hidden, 0.05)) if coin(p)]
    after = [f() for f, p in ((comments, 0.4), (side, 0.4), (advert, 0.3), (form, 0.2), (notice, 0.1), (foot, 0.85)) if coin(p)]
    body = "".join(before) + article() + "".join(after)
    if coin(0.3):
        body = called("div", _WRAP, body)
    page = f"<!DOCTYPE html><html><head><title>{other}x</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
    return page[: int(rng.integers(len(page) // 2, len(page)))] if coin(0.1) else page
