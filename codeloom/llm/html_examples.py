"""Example pages with labelled blocks: main blocks begin with the mark §.

Templates of common page layouts; ``{n}`` stands for n words, ``{n.}`` for a
sentence of n words, ``{a-b}`` and ``{a-b.}`` for a number of words drawn from the
range. Every template is filled several times from a fixed seed.
"""

from __future__ import annotations

import random
import re

_WORDS = (
    "time house water year people small river under garden letter often morning road paper between winter green table market story "
    "hand light old village music never bridge stone answer watch").split()

_MENU = "<nav><ul><li><a href='/a'>{1-2}</a></li><li><a href='/b'>{1}</a></li><li><a href='/c'>{1-3}</a></li><li><a href='/d'>{1}</a></li></ul></nav>"
_PARAGRAPHS = "<p>§{1-3.}</p><p>§{20-80.}</p><p>§{5-12.} <a href='/x'>{1-3}</a> {4-30.}</p><p>§{1.}</p><p>§{30-90.} {10-20.}</p>"
_PARAGRAPHS += "<p>§<a href='/y'>{1-9}</a></p><p>§<a href='/z'>{1-5}</a> {1-3}</p><h3>§<a href='/w'>{1-6}</a></h3><p>§{1-3}</p><p>§<a href='/v'>{2-20.}</a></p><p>§{1-2}</p>"

TEMPLATES = [
    # Article element between menu, advert and footer.
    f"<html><body>{_MENU}<div class='ad'>{{3-12.}} {{2-9.}}</div><article><h1>§{{2-8}}</h1>{_PARAGRAPHS}</article>"
    "<footer>&copy; {1} &middot; {3-12.} {2-9.}</footer></body></html>",
    # Main element, header, notice, sidebar, comments.
    f"<body><header><h1>{{1-3}}</h1><p>{{3-8}}</p></header>{_MENU}<div id='cookie-notice'><p>{{8-25.}}</p></div><main><h2>§{{2-9}}</h2>{_PARAGRAPHS}"
    "<ul><li>§{1-9}</li><li>§{3-12}</li><li>§{2-20.}</li></ul></main><aside><h3>{1-3}</h3><p>{5-30.}</p><ul><li><a href='/'>{2-6}</a></li></ul></aside>"
    "<section class='comments'><h3>{1-2}</h3><div class='comment'><p>{5-60.}</p></div><div class='comment'><p>{1-20.}</p></div></section>"
    "<footer><p>{4-20.}</p></footer></body>",
    # Class names instead of elements.
    f"<body><div class='header'><a href='/'>{{1-2}}</a><p>{{2-6}}</p></div><div id='menu'><a href='/1'>{{1}}</a> <a href='/2'>{{1}}</a></div>"
    f"<div class='post-content'><h1>§{{2-8}}</h1>{_PARAGRAPHS}<blockquote>§{{6-40.}}</blockquote><div class='advert'><p>{{4-30.}}</p></div><p>§{{4-60.}}</p></div>"
    "<div class='sidebar'><h4>{1-3}</h4><p>{6-40.}</p></div><div class='related'><a href='/r'>{3-9}</a></div><div id='footer'><p>{3-15.}</p></div></body>",
    # No landmarks at all: long paragraphs between short, linked ones.
    "<body><div><a href='/'>{1}</a> | <a href='/a'>{1}</a> | <a href='/b'>{1-2}</a></div><div><h1>§{2-8}</h1><p>§{20-80.}</p><p>§{15-60.}</p><p>§{25-90.}</p>"
    "<p>§{12-60.} <a href='/l'>{1-2}</a> {3-9.}</p></div><div><a href='/c'>{2-3}</a> <a href='/d'>{1-3}</a></div><div>{1-4}</div></body>",
    # Headings and short paragraphs inside an article, with furniture inside it too.
    f"<body><article><header><h1>§{{2-8}}</h1></header><p>§{{1}}</p><p>§{{2-4}}</p><div class='share'><a href='/f'>{{1}}</a> <a href='/t'>{{1}}</a></div>"
    "<h2>§{1-5}</h2><p>§{1-9.}</p><form><label>{1-4}</label><p>{3-12.}</p></form><h3>§{1-4}</h3><p>§{8-50.}</p><aside><p>{5-40.}</p></aside><p>§{2-40.}</p>"
    "<nav><a href='/p'>{1-2}</a><a href='/n'>{1-2}</a></nav><footer><p>{2-9.}</p></footer></article><div class='newsletter'><p>{6-20.}</p></div></body>",
    # Sidebar with teasers that are articles, table and definition lists in the content.
    "<body><div class='widget sidebar'><article><h2>{2-6}</h2><p>{8-40.}</p></article></div><div id='content'><h1>§{2-7}</h1><table><tr><td>§{1-4}</td><td>§{2-9}</td></tr></table>"
    f"{_PARAGRAPHS}<dl><dt>§{{1-2}}</dt><dd>§{{3-20.}}</dd></dl><pre>§{{4-30}}</pre></div><div class='popup'><h2>{{2-5}}</h2><p>{{5-30.}}</p></div>"
    "<div class='legal'><p>{10-50.}</p></div></body>",
    # Names that hold furniture words without being furniture: on the article, around it, and on its parts.
    f"<body class='has-sidebar'>{_MENU}<article class='post has-comments'><div class='entry-header'><h1>§{{2-8}}</h1></div>{_PARAGRAPHS}</article>"
    "<div class='comments'><p>{4-50.}</p></div></body>",
    f"<body><div id='content' class='sidebar-right'><h1>§{{2-8}}</h1>{_PARAGRAPHS}</div><div class='sidebar'><p>{{5-40.}}</p><a href='/a'>{{2-5}}</a></div></body>",
    f"<body><form id='mainform'>{_MENU}<article><h1>§{{2-8}}</h1>{_PARAGRAPHS}</article><div class='newsletter-signup'><p>{{4-30.}}</p></div></form></body>",
    f"<body><main class='page with-sidebar'><h2>§{{2-8}}</h2>{_PARAGRAPHS}</main><aside><p>{{4-50.}}</p></aside></body>",
    f"<body><div class='article-share-enabled'><h1>§{{2-8}}</h1><p>§{{20-80.}}</p><p>§{{8-60.}}</p></div><div class='share-buttons'><a href='/s'>{{1}}</a></div></body>",
    f"<body><div id='search-results-page'>{_MENU}<h1>§{{2-8}}</h1><p>§{{20-80.}}</p><p>§{{15-60.}}</p><p>§{{9-50.}}</p></div><div>{{1-4}}</div></body>",
    "<body><form action='/s'><input name='q'><p>{2-8}</p><label>{1-3}</label></form><div class='c1'><h1>§{2-8}</h1><p>§{20-80.}</p><p>§{12-60.}</p></div></body>",
    # No landmarks: the layout is told by lengths, links and neighbours alone.
    "<body><div class='r1'><a href='/'>{1-2}</a></div><div class='r2'><ul><li><a href='/1'>{1-2}</a></li><li><a href='/2'>{1-3}</a></li><li><a href='/3'>{1}</a></li></ul></div>"
    "<div class='r3'><h1>§{3-9}</h1><p>§{20-90.}</p><p>§{10-40.} <a href='/x'>{1-3}</a> {6-30.}</p><h2>§{1-5}</h2><p>§{25-70.}</p></div>"
    "<div class='r4'><p><a href='/n'>{3-8}</a></p><p><a href='/m'>{3-8}</a></p></div><div class='r5'>{2-5}</div></body>",
    "<table><tr><td><a href='/'>{1}</a><br><a href='/b'>{1-2}</a></td><td><h2>§{2-7}</h2><p>§{18-60.}</p><p>§{18-90.}</p></td></tr><tr><td>{1-3}</td><td>{2-4}</td></tr></table>",
    "<div><span>{1-2}</span></div><div><p>§{15-60.}</p><p>§{3-9.}</p><p>§{20-60.}</p><p>§{12-50.}</p></div><div><a href='/1'>{1}</a> <a href='/2'>{1}</a> <a href='/3'>{1-2}</a></div>",
    "<div><h3>{1-3}</h3><ul><li><a href='/1'>{2-9.}</a></li><li><a href='/2'>{3-9.}</a></li><li><a href='/3'>{2-8}</a></li></ul></div>"
    "<div><h1>§{3-9}</h1><p>§{20-80}</p><p>§{2-9}</p><p>§{15-60.}</p><p>§{1-4.}</p><p>§{30-60.}</p></div><div><h3>{1-4}</h3><p><a href='/4'>{8-20.}</a></p><p><a href='/5'>{8-25.}</a></p></div>",
    "<div><a href='/'>{1-3}</a></div><div><h2>§{2-8}</h2><p>§{12-40.} <a href='/q'>{1-4}</a> {2-9}</p><p>§{10-70.}</p></div><div><h2>{1-4}</h2><p><a href='/t'>{4-12.}</a> {1-3}</p>"
    "<h2>{1-4}</h2><p><a href='/u'>{4-12.}</a></p></div><p>{1-3} <a href='/w'>{1-2}</a></p>",
    f"<body>{_MENU}<div class='entry-header'><h1>§{{1-6}}</h1></div><div class='entry-content'>{_PARAGRAPHS}</div><div class='site-footer'>{{2-9.}}</div></body>",
    "<div><h1>§{1-3}</h1><p>§{15-60.}</p><h3>§{1-2}</h3><p>§{15-90.}</p><h3>§{1-3}</h3><p>§{10-50.}</p></div><div><a href='/a'>{1-2}</a></div>",
    "<div class='post-header'><h2>§{1-4}</h2></div><div><p>§{15-60.}</p><p>§{12-50.}</p></div>",
    # Hardly any page at all.
    "§{1-9}", "§{3-14.}", "§{20-200.}", "<h1>§{1-6}</h1><p>§{3-14.}</p>", "<p>§{3-30.}</p><p>§{3-30.}</p>", "<div>§{4-40.}</div>",
    "<h2>§{2-8}</h2><p>§{8-40.}</p><p>§{1-9.}</p>",
    "<a href='/'>{1-2}</a><p>§{6-30.}</p><p>§{10-50.}</p>",
]

_SLOT = re.compile(r"\{(\d+)(?:-(\d+))?(\.?)\}")


def example_pages(copies: int = 8, seed: int = 3) -> list[str]:
    rng = random.Random(seed)

    def fill(slot: re.Match) -> str:
        low, high = int(slot[1]), int(slot[2] or slot[1])
        text = " ".join(rng.choices(_WORDS, k=rng.randint(low, high)))
        return text.capitalize() + "." if slot[3] else text

    return [_SLOT.sub(fill, t) for t in TEMPLATES for _ in range(copies)]
