"""Pages by hand, in layouts that no generator of the library writes: what comes out is stated line by line."""

import re
import time

import pytest

from rotorlens.llm import common, html_extract

LONG = [
    "The harbour was quiet when the first boats came in, and nobody on the quay had slept much that night.",
    "By noon the council had met twice. It agreed on little, though the mayor spoke for almost an hour about the bridge.",
    "Work is to begin in spring, if the weather allows it; until then, the old ferry goes on every half hour.",
]
P = "".join(f"<p>{x}</p>" for x in LONG)
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/w'>World</a></li><li><a href='/s'>Sport</a></li><li><a href='/c'>Contact</a></li></ul>"
LAYOUTS = {
    "utility names": (f'<body class="page ads-enabled"><nav>{MENU}</nav><article class="post sharing-enabled"><h1>A bridge at last</h1>{P}</article><footer>&copy; 2021 The Post</footer></body>', ["A bridge at last", *LONG]),
    "header in the article": (f"<body><header><a href='/'>The Post</a></header><article><header><h1>A bridge at last</h1></header>{P}</article><footer>&copy; 2021 The Post</footer></body>", ["A bridge at last", *LONG]),
    "story header": (f'<body><div class="navbar">{MENU}</div><div class="story"><div class="story-header"><h1>A bridge at last</h1></div>{P}</div><div class="footer">Copyright 2021 The Post</div></body>', ["A bridge at last", *LONG]),
    "linked items": (f"<body><nav>{MENU}</nav><article><h1>A bridge at last</h1>{P}<ul><li><a href='/a'>The plan of the engineers</a></li><li><a href='/b'>What the ferry costs</a></li></ul></article></body>", ["A bridge at last", *LONG, "The plan of the engineers", "What the ferry costs"]),
    "table": (f"<body><nav>{MENU}</nav><main><h1>A bridge at last</h1>{P}<table><tr><th>Year</th><th>Boats</th></tr><tr><td>1999</td><td>12</td></tr></table></main><footer>&copy; 2021 The Post</footer></body>", ["A bridge at last", *LONG, "Year", "Boats", "1999", "12"]),
    "divs without names": (f"<body><div><a href='/'>Home</a> | <a href='/w'>World</a> | <a href='/s'>Sport</a></div><div><h1>A bridge at last</h1>{P}</div><div>&copy; 2021 The Post. All rights reserved.</div></body>", ["A bridge at last", *LONG]),
    "dialog": (f'<body><div role="dialog"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><nav>{MENU}</nav><article><h1>A bridge at last</h1>{P}</article></body>', ["A bridge at last", *LONG]),
    "comments": (f'<body><article><h1>A bridge at last</h1>{P}</article><section id="comments"><h3>2 comments</h3><div class="comment"><p>About time that somebody did it.</p></div><div class="comment"><p>Who pays for all of this?</p></div></section></body>', ["A bridge at last", *LONG]),
    "adverts inside": (f'<body><div id="content"><h1>A bridge at last</h1><p>{LONG[0]}</p><div class="ad-slot">Cheap boats, now in every colour.</div><p>{LONG[1]}</p><p>{LONG[2]}</p></div><div class="sidebar"><h3>Most read</h3>{MENU}</div></body>', ["A bridge at last", *LONG]),
    "forms": (f'<body><nav>{MENU}</nav><article><h1>A bridge at last</h1>{P}</article><form class="newsletter"><p>Get our letter every morning.</p><input></form><footer>&copy; 2021 The Post</footer></body>', ["A bridge at last", *LONG]),
    "bare": (f"<h1>A bridge at last</h1>{P}", ["A bridge at last", *LONG]),
    "quote": (f"<body><nav>{MENU}</nav><main><article><h2>A bridge at last</h2>{P}<blockquote><p>We have waited for this long enough, said the ferryman.</p></blockquote></article></main><aside>{MENU}</aside></body>", ["A bridge at last", *LONG, "We have waited for this long enough, said the ferryman."]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts(name):
    html, lines = LAYOUTS[name]
    assert html_extract.main_texts([f"<html><head><title>t</title></head>{html}</html>"], html_extract.trained())[0].split("\n") == lines


def _article_by_brute_force(html: str) -> str:
    """The blocks of the page's one article element: what stands between any two tags that aren't inline."""
    import html as entities

    inner = re.search(r"<article\b[^>]*>(.*?)</article>", html, re.S).group(1)
    inner = re.sub(r"</?(?:" + "|".join(sorted(html_extract.INLINE - {"br"})) + r")\b[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", inner))
    blocks = [" ".join(entities.unescape(x).split()) for x in re.split(r"<[^>]*>", inner)]
    return "\n".join(x for x in blocks if x)


def test_pages_table_by_brute_force(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_extract.extract(pages).collect()
    assert len(rows) == len(html) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [r["page_id"] for r in rows if r["text"] != _article_by_brute_force(html[r["page_id"]])] == []


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>A line of text that stands alone.</p>", "x"), (3, "u", "<p>A line of text that stands alone.</p>", "x"), (3, "u", "<p>A line of text that stands alone.</p>", "x"), (4, "u", "<div>" * 300, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_extract.extract(frame).collect())
    line = "A line of text that stands alone."
    assert got == [(0, "u", line, 33), (1, "u", "", 0), (2, "", "", 0), (3, "u", line, 33), (3, "u", line, 33), (4, "u", "", 0)]
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_stray_tags_and_long_pages_take_linear_time():
    began = time.process_time()
    page = html_extract.Page("<div>" * 20000 + "</section></b><li>x" * 20000)
    assert len(page.text) > 40000
    html_extract.features(page, {})
    html_extract.Page("<b>" * 50000 + "x <i>y" * 20000)
    assert time.process_time() - began < 20
