"""Labelled pages for the main-text tagger: page skeletons whose blocks are known to be main text or not.

A page is a row of parts: HTML with text slots, labelled ``+`` (main text) or ``-`` (anything else);
the names by which other elements go are drawn from ``KINDS``. ``pages`` fills the slots with words from a seeded generator and returns each page
with the labels of its blocks in page order.
"""

from __future__ import annotations

import random

#: Main-text parts. Slots: $T short title, $S sentence, $P paragraph, $L link words, $W one to three words.
MAIN = [
    "<p>$P</p>", "<p>$P</p>", "<p>$P</p>", "<p>$S</p>", "<p>$W.</p>", "<p>$S<p>$P", "<p><b>$S</b></p>", "<p>$S <a href='/x'>$W</a> $S</p>", "<h2>$T</h2>", "<h3>$W</h3>", "<blockquote><p>$S</p></blockquote>",
    "<ul><li>$S</li><li>$S</li></ul>", "<ol><li>$W</li><li>$S</li></ol>", "<table><tr><td>$W</td><td>$W</td></tr></table>", "<pre>$S</pre>", "<figure><img src='a'><figcaption>$S</figcaption></figure>", "<div class='paragraph'>$P</div>",
    "<div>$P</div>", "<section><h2>$T</h2><p>$P</p></section>", "<dl><dt>$W</dt><dd>$S</dd></dl>", "$P<br>$S", "<div><p>$P</p></div>", "<header><h1>$T</h1></header>",
]
#: Names that elements of other kinds go by, as tag, role or word of a class or id.
KINDS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc toolbar topbar sitemap",
    "header": "header masthead banner logo branding top",
    "footer": "footer foot colophon copyright legal bottom contentinfo",
    "side": "aside sidebar side widget rail related recommended popular trending also teaser",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "notice": "notice cookie cookies consent gdpr privacy alert popup modal overlay dialog newsletter subscribe signup paywall disclaimer",
    "form": "form search login contact register feedback poll",
    "comment": "comments comment commentlist reply replies respond discussion disqus reviews responses",
    "share": "share sharing social tags pagination pager print tools follow",
}
REAL_TAGS = frozenset("nav menu header footer aside form dialog".split())
BODIES = ["$S", "$P", "<p>$S</p>", "<p>$P</p>", "<p>$P</p><p>$S</p>", "<h3>$W</h3><p>$S</p>", "<h4>$W</h4><p>$P</p><p>$P</p>", "<ul><li>$S</li><li>$P</li></ul>", "<span>$W</span> <a href='/a'>$W</a>", "<ul><li><a href='/a'>$W</a></li><li><a href='/b'>$L</a></li></ul>", "<a href='/a'>$W</a> <a href='/b'>$W</a>", "<h3>$T</h3><p><a href='/r'>$L</a></p><p>$S</p>"]
#: Bodies that some kinds have besides.
MORE_BODIES = {
    "footer": ["&copy; $W. $S", "<p>Copyright $W</p><p>$P</p>", "&copy; 2020 $S &middot; $S"],
    "form": ["<label>$W</label><input><p>$S</p><button>$W</button>", "<input name='q'><select><option>$W</option><option>$W</option></select><textarea>$S</textarea>"],
    "comment": ["<div class='item'><p>$P</p></div><div class='item'><p>$S</p></div>", "<ol><li><p>$P</p></li><li><p>$P</p></li></ol>", "<article><p>$P</p></article>"],
    "notice": ["<p>$S</p><button>$W</button>", "<p>$P</p><button>$W</button>"],
    "header": ["<h1>$W</h1><p>$S</p>"],
}
SUFFIXES = ["", "", "", "-section", "-list", "-area", "-box", "-wrapper", "-block", "-container", " clearfix", "-item"]
#: Where main parts may stand.
WRAPS = ["<article>@</article>", "<article>@</article>", "<main>@</main>", "<div class='content'>@</div>", "<div id='main'><div class='post'>@</div></div>", "<section class='entry-content'>@</section>", "<main><article class='story'>@</article></main>", "<div class='article-body'>@</div>", "<div class='page text'>@</div>", "<div>@</div>", "<table><tr><td>@</td></tr></table>", "@"]
MAIN_NAMES = "content main article post entry story body text news blog".split()
_WORDS = "lorem ipsum dolor sit amet elit sed do tempor ut labore magna aliqua enim minim veniam quis nostrud ullamco nisi aute irure velit esse fugiat nulla sint culpa mollit anim".split()


def _text(rng: random.Random, low: int, high: int, end: str) -> str:
    words = [rng.choice(_WORDS) for _ in range(rng.randint(low, high))]
    if rng.random() < 0.15:  # texts of odd shape are text all the same
        words = [w + rng.choice(["!!", "%%%", " |", "***", ","]) for w in words]
    return " ".join(words).capitalize() + end


def _fill(rng: random.Random, html: str) -> str:
    slots = {"$T": (2, 9, ""), "$S": (4, 22, "."), "$P": (15, 140, "."), "$L": (2, 8, ""), "$W": (1, 3, "")}
    out = []
    for piece in html.replace("$", "\0$").split("\0"):
        out.append(_text(rng, *slots[piece[:2]]) + piece[2:] if piece[:2] in slots else piece)
    return "".join(out)


def _other(rng: random.Random) -> str:
    """A part that isn't main text, under one of the names of its kind."""
    kind = rng.choice(list(KINDS))
    name = rng.choice(KINDS[kind].split())
    body = rng.choice(BODIES + 3 * MORE_BODIES.get(kind, []))
    if name in REAL_TAGS and rng.random() < 0.6:
        return f"<{name}>{body}</{name}>"
    tag = rng.choice(["div", "div", "section", "ul" if body.startswith("<li") else "div"])
    attr = rng.choice(["class='{}'", "class='{}'", "id='{}'", "class='site-{}'", "role='{}'"]).format(name + rng.choice(SUFFIXES))
    return f"<{tag} {attr}>{body}</{tag}>"


def pages(n: int = 800, seed: int = 11) -> list[list[tuple[str, str]]]:
    """``n`` pages as lists of (HTML, label): label "+" or "-", or "" for mark-up without text."""
    rng = random.Random(seed)
    others = lambda low, high: [(_fill(rng, _other(rng)), "-") for _ in range(rng.randint(low, high))]
    made = []
    for _ in range(n):
        inner = [(_fill(rng, "<h1>$T</h1>"), "+")] if rng.random() < 0.7 else []
        for _ in range(rng.randint(1, 7)):
            inner += [(_fill(rng, rng.choice(MAIN)), "+") for _ in range(rng.randint(1, 2))]
            if rng.random() < 0.25:
                inner += others(1, 1)
        if rng.random() < 0.08:  # text alone
            made.append([p for p in inner if p[1] == "+"] if rng.random() < 0.5 else [(_fill(rng, rng.choice(["$P", "$W", "$S", "$S<br>$S", "<p>$S", "<p>$W"])), "+")])
            continue
        before, after = rng.choice(WRAPS).split("@")
        if rng.random() < 0.5:
            before, after = f"<div class='{rng.choice(MAIN_NAMES) + rng.choice(SUFFIXES)}'>" + before, after + "</div>"
        outer = f"<div id='{rng.choice(['page', 'site', 'all', 'outer'])}{rng.choice(SUFFIXES)}'>" if rng.random() < 0.4 else ""
        made.append([("<body>" + outer, ""), *others(0, 4), (before, ""), *inner, (after, ""), *others(0, 4)])
    return made
