"""HTML cut into leaf blocks, and made-up pages with known labels."""

from __future__ import annotations

import html
import random
import re

SPLIT = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template textarea title svg iframe head select".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: What may stand in a head; anything else ends it, as its end tag and <body> may be left out.
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
#: An open element on the left ends where one on the right begins.
CLOSES = {"p": SPLIT - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
#: A quote opens a value only after "="; without a closing one it is an ordinary character.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*(?:"[^"]*"|'[^']*')|=)*+)>|<[!?][^>]*>""", re.S)
BARE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
NAMES = frozenset("class id role itemprop".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
LABEL = re.compile(r"[a-z]+")


def _attributes(text: str) -> tuple[str, bool]:
    """(words of class, id and the like; whether the element is hidden), by names, whatever other values say."""
    words, hidden = [], False
    for name, *values in ATTRIBUTE.findall(text):
        name, value = name.lower(), "".join(values)
        if name in NAMES:
            words += LABEL.findall(value.lower())
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            hidden = True
    return " ".join(words), hidden


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(text, path, code points inside links) of each leaf block with text.

    The path has the names, classes and ids of the open elements, outermost
    first.  Scripts, styles, hidden parts and the head carry no text.
    """
    out: list[tuple[str, str, int]] = []
    open_: list[tuple[str, str, bool]] = []  # (tag, label, skipped)
    text: list[str] = []
    linked = skipping = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, " ".join(x[1] for x in open_ if x[0] in SPLIT or x[1] != x[0]), linked))
        text.clear()
        linked = 0

    def close(n: int) -> None:
        nonlocal skipping, anchors
        while len(open_) > n:
            tag, _, skipped = open_.pop()
            skipping -= skipped
            anchors -= tag == "a"

    def data(piece: str) -> None:
        nonlocal linked
        if skipping and open_[-1][0] == "head" and piece.strip():
            close(len(open_) - 1)
        if piece and not skipping:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if anchors:
                linked += len(piece.strip())

    last, token = page.rfind(">"), TOKEN
    while at < len(page):
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith("<!--", start):
            data(page[at:])
            break
        m = token.match(page, start)
        if not m and token is TOKEN and page[start + 1 : start + 2].isalpha():
            token = BARE  # a tag whose quotes swallow every ">" that is left: from here on quotes mean nothing
            m = token.match(page, start)
        data(page[at : start + (not m)])
        at = m.end() if m else start + 1
        if not m:
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in SPLIT:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[1]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    close(k)
                    break
            continue
        if tag not in IN_HEAD and open_ and open_[-1][0] == "head":
            close(len(open_) - 1)
        if tag in SPLIT or tag in CLOSES:
            while open_ and tag in CLOSES.get(open_[-1][0], ()):
                close(len(open_) - 1)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        names, hidden = _attributes(m[3]) if m[3] else ("", False)
        skipped = tag in SKIP or hidden
        open_.append((tag, f"{tag} {names}".strip(), skipped))
        skipping += skipped
        anchors += tag == "a"
    flush()
    return out


SYLLABLES = "an ber che da en for ge ha in jo ka la men no or per qu re sta ti un ver wi za ing tion ble ment ci rr sch heit eau oi".split()
#: Kinds of boilerplate: opening and closing markup, and the usual wording.
CLUTTER = [
    ("nav", ["<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="navigation">', '<div class="breadcrumbs">', '<div role="navigation">'], "links"),
    ("header", ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<div class="topbar">'], "short"),
    ("aside", ["<aside>", '<div class="sidebar">', '<div id="side">', '<div class="widget">', '<div class="related">', '<section class="recommended">', '<div class="trending">'], "mixed"),
    ("notice", ['<div class="cookie">', '<div class="cookie-notice">', '<div id="consent">', '<div class="banner">', '<div class="notice">', '<div class="alert">', '<div class="popup">', '<div class="modal">'], "notice"),
    ("ad", ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<section class="ad-slot">', '<aside class="ad">'], "short"),
    ("form", ["<form>", '<form class="search">', '<form class="newsletter">', '<div class="subscribe">', '<div class="login">'], "form"),
    ("comments", ['<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="comment-list">', '<div class="replies">', '<div class="disqus">', '<section id="responses">'], "prose"),
    ("share", ['<div class="share">', '<div class="social">', '<ul class="sharing">', '<div class="tags">'], "links"),
    ("footer", ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<div class="legal">'], "footer"),
]
PLACES = ["<article>", "<main>", '<div class="content">', '<div id="main">', '<div class="post">', '<div class="article-body">', '<div class="entry-content">', "<main><article>", '<div class="story">', '<section class="article">', "<div>"]


def made_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and, for each of its blocks in order, 1 for article and 0 for clutter."""
    labels: list[int] = []

    def words(lo: int, hi: int) -> str:
        ws = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        for k in range(0, len(ws), rng.randint(6, 14)):
            ws[k] = ws[k].capitalize()
        return " ".join(ws) + rng.choice([".", ".", "", "!"])

    def shut(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))

    def clutter() -> str:
        _, openings, style = rng.choice(CLUTTER)
        o, inner = rng.choice(openings), []
        for _ in range(rng.randint(1, 6) if style != "short" else rng.randint(1, 2)):
            labels.append(0)
            if style == "links" or style == "mixed" and rng.random() < 0.6:
                inner.append(f'<li><a href="/x">{words(1, 4)}</a></li>')
            elif style == "footer":
                inner.append(f"<p>&copy; {rng.randint(1999, 2030)} {words(1, 12)}</p>")
            elif style == "form":
                inner.append(f"<label>{words(1, 4)}</label><input name=q><p></p>")
            elif style == "prose":
                inner.append(rng.choice(["<p>{}</p>", "<li>{}</li>", "<blockquote>{}</blockquote>"]).format(words(4, 60)))
            else:
                inner.append(rng.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>"]).format(words(2, 25)))
        return o + "".join(inner) + shut(o)

    def bare_clutter() -> str:
        _, openings, _ = rng.choice(CLUTTER)
        o = rng.choice(openings)
        labels.append(0)
        return f"{o}{rng.choice(['', '&copy; ', ''])}{words(1, 30)}{shut(o)}"

    parts = [rng.choice([clutter, bare_clutter])() for _ in range(rng.randint(0, 4))]
    o = rng.choice(PLACES)
    parts.append(o)
    if rng.random() < 0.85:
        labels.append(1)
        parts.append(f"<h1>{words(1, 14)}</h1>")
    for _ in range(rng.randint(1, 12)):
        r = rng.random()
        if r < 0.12:
            parts.append(rng.choice([clutter, bare_clutter])())
        elif r < 0.2:
            labels.append(1)
            parts.append(f"<h2>{words(1, 8)}</h2>")
        elif r < 0.28:
            n = rng.randint(2, 5)
            labels.extend([1] * n)
            parts.append("<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(n)) + "</ul>")
        elif r < 0.32:
            n = rng.randint(2, 4)
            labels.extend([1] * (2 * n))
            parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(n)) + "</table>")
        elif r < 0.38:
            labels.append(1)
            parts.append(f"<blockquote>{words(4, 40)}</blockquote>")
        else:
            labels.append(1)
            link = f' <a href="/y">{words(1, 3)}</a> ' if rng.random() < 0.3 else ""
            parts.append(rng.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>"]).format(words(1, 90) + link))
    parts.append(shut(o))
    parts += [rng.choice([clutter, bare_clutter])() for _ in range(rng.randint(0, 4))]
    return "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>", labels
