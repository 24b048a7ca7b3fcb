"""The small labelled table that the block classifier learns from: pages whose blocks begin with + (article text) or -
(anything else).  ``PAGES`` are written by hand; ``made`` lays out more by rule, so that neither the elements nor the
class names of a page tell all: many have none, some mislead."""

from __future__ import annotations

import random

PAGES = [
    '<body><nav><ul><li><a href="/">-Home</a></li><li><a href="/n">-News</a></li><li><a href="/w">-World and weather</a></li></ul></nav>'
    '<div class="ad">-Buy two pairs of shoes today and we will send you a third one free of charge, this week only.</div>'
    "<article><h1>+A river returns</h1><p>+The river had been dry for years when the rains of April came back over the hills and filled it within a week.</p>"
    "<p>+Fish followed.</p><p>+Now the town has to decide whether the old bridge can stay, and who will pay for the new one.</p></article>"
    "<footer>-&copy; river.example.com &middot; All rights are reserved by the owners of these pages and their partners.</footer></body>",
    '<body><header><h1>-The Daily Plain</h1><p>-Independent since 1901, and read in every village of the plain from one market day to the next.</p></header>'
    '<div id="main-content"><h2>+Harvest</h2><p>+Farmers brought in wheat and barley under a clear sky, with half of the fields cut before noon on Friday.</p>'
    '<p>+It was early.</p><ul><li>+Wheat: four tons a hectare.</li><li>+Barley: three and a half.</li></ul></div>'
    '<div class="comments"><h3>-Comments</h3><p>-I remember a harvest like this in my youth, when we all went out at dawn and sang on the way back in the dark.</p></div>'
    "<p>-<a href='/imprint'>-Imprint</a> <a href='/privacy'>-Privacy</a></p></body>",
    '<body><div class="menu"><a href="/a">-Start</a> <a href="/b">-Shop</a></div><div class="cookie-notice"><p>-We use cookies to make these pages work and to see how many people read them; you can say no.</p></div>'
    "<main><p>+Nobody expected the museum to open again after the fire, least of all the people who had worked there for decades.</p>"
    '<aside><p>-Also read: ten museums that you should visit before the summer ends and the crowds come back.</p></aside>'
    '<p>+Yet it did, <a href="/1910">+as in 1910</a>, and the queue went around the corner of the street.</p><p>+Tickets cost nine.</p></main>'
    '<form action="/s"><p>-Subscribe to our letter and get the best of the week into your mail box every Sunday morning.</p></form></body>',
    "<body><table><tr><td><a href='/x'>-Index</a></td><td><a href='/y'>-Archive of older pages</a></td></tr></table>"
    "<p>+This page has no layout to speak of, as it was written by hand a long time ago and has never been changed since then.</p>"
    "<p>+Still, it tells how to tune a bell, which needs a lathe, an ear, and more patience than most people have in these days.</p>"
    "<p>+Start with the hum note and work upwards from there, taking off metal from the inside only, a little at a time.</p>"
    "<p>-<a href='/p'>-Previous</a> | <a href='/q'>-Next</a></p></body>",
    '<body><div class="sidebar"><h4>-Popular</h4><ul><li><a href="/1">-Five ways to cook a marrow without losing its taste</a></li><li><a href="/2">-Why cats sleep</a></li></ul></div>'
    '<div class="post"><h2>+On marrows</h2><p>+They grow while you look the other way.</p><p>+Cut them young, and cook them whole in butter with a little salt and a leaf of sage.</p></div>'
    '<div class="related"><p>-More on gardens: how to plan a border that flowers from March until the first frost of the year.</p></div>'
    '<div id="footer"><p>-Contact us by mail or by phone on any working day.</p></div></body>',
    '<body><section class="article-body"><header><h1>+Night trains</h1></header><p>+Sleepers run again between the two capitals, three times a week at first and daily from the summer on.</p>'
    '<div class="share"><a href="/f">-Share</a> <a href="/m">-Mail</a></div><blockquote>+I slept like a stone.</blockquote><p>+Few trains have been so late.</p>'
    '<div class="promo"><p>-Get half off your first year with us if you sign up before the end of this month.</p></div></section>'
    '<section id="comment-list"><article><p>-My train stood still for three hours and nobody told us why, so I would rather fly the next time.</p></article></section></body>',
    "<html><body><article><h1>+Salt</h1><p>+The pans by the sea gave white salt in a dry year, and grey salt in all others.</p><p>+Both were sold.</p></article></body></html>",
    "<p>+A single paragraph, sent without any frame, as a feed reader would store it after the page around it was gone.</p>",
    '<div class="text"><p>+Short.</p><p>+And another line that ends the page without a footer.</p></div>',
    '<body><div class="menu"><a href="/">-Home</a></div><p>+Two lines make up this note.</p><p>+This is the second of them, and it is <a href="/z">+the last</a>.</p></body>',
    '<body><p>-<a href="/u">-Up</a></p><div><p>+The gate was open all night, and in the morning the sheep stood in the road as if they had an appointment.</p></div></body>',
    '<body class="page"><div class="wrap overflow-hidden"><main style="overflow:hidden"><h1>+Ferries</h1><p>+The last boat left at nine, with two cars and a dog on board and nobody at the rail.</p>'
    '<p>+It was on time.</p></main></div><div style="display:none"><p>-This line is for machines only, and says in many words what the page above has said in few of them.</p></div></body>',
    '<body><div class="layout sidebar-right"><article><h1>+Looms</h1><p>+Two looms stood in the shed, and a third one lay in parts along the wall for most of the winter.</p><p>+All three work now.</p></article>'
    '<div class="sidebar"><p>-More about the sheds of the valley, and how to get there by bus, on foot or by a hired boat.</p></div></div></body>',
]

_WORDS = (
    "river town market harvest winter bridge ferry bell mountain garden letter train road village summer people water light stone house years old new long small great many few"
    " went came found built kept grew told held over under after before with from into and the a of in to for was were had is are that which when while where still never often"
).split()
#: Class names of the places of a page, names that say nothing or mislead, and none.
_CHROME = {
    "menu": ["menu", "nav-main", "navigation", "topnav", "breadcrumbs", "", "x1", "row"],
    "ad": ["ad", "advert", "sponsored-box", "promo-box", "teaser", "", "box", "col-3"],
    "notice": ["cookie-notice", "consent", "notice", "banner-top", "", "info", "msg"],
    "side": ["sidebar", "widget", "related", "recommended-list", "teaser", "", "col-2", "right"],
    "comments": ["comments", "comment-list", "discussion", "replies", "kommentare", "reader-comments"],
    "footer": ["footer", "colophon", "imprint", "bottom-bar", "legal", "", "end"],
    "share": ["share", "social-bar", "", "tools"],
}
_TEXT = ["content", "post", "entry-body", "story", "article-text", "", "", "x2", "main-column", "content popular-science", "page promo-history", "text widget-world", "layout sidebar-right", "share-prices report"]


def made(n: int = 90, seed: int = 3) -> list[str]:
    """``n`` pages in three layouts by turns: with elements that name the places, of divisions, and flat."""
    pick = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join(pick.choice(_WORDS) for _ in range(pick.randint(low, high))).capitalize()

    def named(place: str) -> str:
        name = pick.choice(_CHROME[place] if place in _CHROME else _TEXT)
        return f' {pick.choice(["class", "class", "id"])}="{name}"' if name else ""

    def link(sign: str, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{pick.randint(1, 999)}">{sign}{words(low, high)}</a>'

    def prose(low: int = 1, high: int = 5) -> str:
        text = [words(6, 24) + "." for _ in range(pick.randint(low, high))]
        if pick.random() < 0.25:
            text.insert(pick.randint(0, len(text)), f'<a href="/{pick.randint(1, 999)}">{words(1, 4)}</a>')
        return " ".join(text)

    def links(n: int) -> str:
        form = pick.random()
        if form < 0.5:
            return "<ul>" + "".join(f"<li>{link('-')}</li>" for _ in range(n)) + "</ul>"
        if form < 0.8:
            return "<p>-" + " | ".join(link("") for _ in range(n)) + "</p>"
        return "<table><tr>" + "".join(f"<td>{link('-')}</td>" for _ in range(n)) + "</tr></table>"

    def article() -> str:
        parts = [f"<h1>+{words(2, 8)}</h1>"] if pick.random() < 0.8 else []
        for _ in range(pick.randint(2, 7)):
            kind = pick.random()
            if kind < 0.6:
                parts.append(f"<p>+{prose()}</p>")
            elif kind < 0.72:
                parts.append(f"<p>+{words(2, 7)}.</p><p>+{prose()}</p>")
            elif kind < 0.8:
                parts.append(f"<h2>+{words(1, 5)}</h2><p>+{prose()}</p>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>+{words(3, 12)}</li>" for _ in range(pick.randint(2, 4))) + f"</ul><p>+{prose()}</p>")
            elif kind < 0.92:
                parts.append(f"<p>+{prose()}</p><p>{link('+', 3, 9)}</p><p>+{prose(2)}</p>")
            elif kind < 0.96:
                parts.append(f"<blockquote>+{words(3, 20)}.</blockquote><p>+{prose()}</p>")
            else:
                parts.append(f"<p>+{prose()}</p><div{named('share')}>-{' '.join(link('', 1, 2) for _ in range(3))}</div><p>+{prose()}</p>")
        return "".join(parts)

    def aside(tag: str) -> str:
        text = f"<h4>-{words(1, 3)}</h4>" + (links(pick.randint(2, 5)) if pick.random() < 0.6 else f"<p>-{prose(1, 3)}</p>")
        return f"<{tag}{named('side')}>{text}</{tag}>"

    def comments(tag: str, inner: str) -> str:
        one = lambda: f"<{inner}><p>-{words(1, 2)}</p><p>-{prose(1, 3)}</p></{inner}>"
        return f"<{tag}{named('comments')}>" + (f"<h3>-{words(1, 2)}</h3>" if pick.random() < 0.5 else "") + "".join(one() for _ in range(pick.randint(1, 4))) + f"</{tag}>"

    def footer(tag: str) -> str:
        text = f"-&copy; {words(2, 14)}." if pick.random() < 0.5 else f"<p>-{words(4, 12)}</p>{links(3)}"
        return f"<{tag}{named('footer') if tag != 'footer' else ''}>{text}</{tag}>"

    out = []
    for i in range(n):
        some = lambda part, odds: part if pick.random() < odds else ""
        if i % 3 == 0:
            core = pick.choice(["article", "main"])
            extra = some(f'<div{named("ad")}><p>-{prose(1, 2)}</p></div>', 0.5) + some(aside("aside"), 0.5)
            body = [some(f"<header><h2>-{words(1, 4)}</h2><p>-{words(4, 16)}</p></header>", 0.5), f"<nav>{links(4)}</nav>", some(f'<div{named("notice")}>-{prose(1, 2)}</div>', 0.5), extra]
            inside = some(f"<form>-{words(4, 14)}</form>", 0.2) + some(comments("section", "article"), 0.2 * (core == "main"))
            body += [f"<{core}{named('text')}>{article()}{inside}</{core}>", some(comments(pick.choice(["section", "div"]), "div"), 0.5), some(aside("div"), 0.4), footer(pick.choice(["footer", "div"]))]
        elif i % 3 == 1:
            body = [f"<div{named('menu')}>{links(4)}</div>", some(f'<div{named("notice")}>-{prose(1, 1)}</div>', 0.5), some(f'<div{named("ad")}>-{prose(1, 1)}</div>', 0.5)]
            inside = some(comments("div", "div"), 0.3) + some(f'<div class="{pick.choice(["related", "newsletter", "promo"])}"><p>-{prose(1, 2)}</p></div>', 0.3)
            body += [f"<div{named('text')}>{article()}{article()}{inside}</div>", some(aside("div"), 0.5), footer("div")]
        else:
            body = [some(links(pick.randint(2, 5)), 0.8), some(f"<p>-{words(1, 3)}</p>{links(3)}", 0.3), article(), some(links(3), 0.3) and "", some(comments("div", "div"), 0.2), links(3), some(f"<p>-{words(2, 6)}</p>{links(2)}", 0.5)]
        out.append("<body>" + "".join(body) + "</body>")
    return out


def ended(n: int = 60, seed: int = 8) -> list[str]:
    """``n`` pages with a line on who owns them: at the end of the page, unnamed, on flat pages and beside two columns (no
    article text), or as the article's own last or middle line."""
    pick = random.Random(seed)
    words = lambda low, high: " ".join(pick.choice(_WORDS) for _ in range(pick.randint(low, high))).capitalize()
    out = []
    for i in range(n):
        prose = [f"<p>+{' '.join(words(6, 24) + '.' for _ in range(pick.randint(1, 5)))}</p>" for _ in range(pick.randint(2, 6))]
        line = pick.choice(["&copy; 2020 {}. All rights reserved.", "Copyright {} 2019", "&copy; {}", "(c) 2021 {}, all rights reserved", "All rights reserved.", "Copyright 2018 {}. All rights reserved by the owners."]).format(words(1, 4))
        nav = f"<ul>{''.join(f'<li><a href=/{k}>-{words(1, 3)}</a></li>' for k in range(pick.randint(2, 5)))}</ul>"
        title = f"<h1>+{words(2, 7)}</h1>" if pick.random() < 0.8 else ""
        tag, last = pick.choice(["p", "div", "td"]), pick.choice(["", f"<p><a href=/i>-{words(1, 2)}</a></p>"])
        end = f"<{tag}>-{line}</{tag}>" if tag != "td" else f"<table><tr><td>-{line}</td></tr></table>"
        if i % 4 == 0:
            out.append(f"<body>{nav}{title}{''.join(prose)}{end}{last}</body>")
        elif i % 4 == 1:
            out.append(f"<body><div>{nav}</div><div><div>{title}{''.join(prose)}</div><div><h4>-{words(1, 3)}</h4><p>-{words(4, 18)}</p></div></div>{end}{last}</body>")
        elif i % 4 == 2:
            k = pick.randint(1, len(prose))
            inside = "".join([*prose[:k], f"<p>+{line}</p>", *prose[k:]])
            out.append(f"<body><nav>{nav}</nav><article>{title}{inside}</article>" + pick.choice(["", f"<footer>-{line}</footer>"]) + "</body>")
        else:
            prose.insert(1, f"<p>+{line}</p>")
            out.append(f"<body>{nav}<div>{title}{''.join(prose)}</div><p><a href=/i>-{words(1, 2)}</a></p></body>")
    return out
