import html
import re

import numpy as np

from prefmill.llm import mainhtml
from prefmill.llm.base import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div id=content>
<p>First long paragraph of the real   text&nbsp;goes here and here.<p>Second &amp; last &#233;one.<ul><li>one<li>two</ul>
<div class="ad">buy</div><script>var x = "<p>no</p>";</script></div><div class=sidebar>side</div>
<section id=comments><article class=comment><p>I disagree with all of this, very much indeed</p></article></section>
<form>mail <input><button>go</button></form><footer>&copy; me</footer></body></html>"""


def test_menus_and_the_like_are_left_out():
    assert mainhtml.main_text(PAGE) == "First long paragraph of the real text goes here and here.\nSecond & last éone.\none\ntwo"


def test_article_is_kept_whole():
    page = ("<body><nav>a b c</nav><main><h2>Latest news and other things to read</h2><article><header><h1>Title</h1></header>"
            "<p>" + "long text " * 40 + "</p><p>Short.</p><aside>See also</aside><p hidden>gone</p><p>End <b>bold</b>er<br>line</p>"
            "</article></main><footer>f</footer></body>")
    assert mainhtml.main_text(page) == "Title\n" + ("long text " * 40).strip() + "\nShort.\nEnd bolder line"


def test_odd_pages():
    assert [mainhtml.main_text(p) for p in ("", "<p>", "<p>a", "just text", "a &lt; b<br>c", "<article></article><p>x</p>", "<b><p>u<p>v")] == \
        ["", "", "a", "just text", "a < b c", "x", "u\nv"]
    assert mainhtml.main_text("<p>one</p><![weird<p>two</p>").startswith("one")
    assert mainhtml.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert len(mainhtml.main_text("<p>" + "word " * 200_000)) == 999_999


LONG = "This is a long sentence of the real article text, with many words in it. " * 4
P = f"<p>{LONG}</p>"


def short(page):
    return mainhtml.main_text(page).replace(LONG.strip(), "L").split("\n")


def test_wrappers_and_unclosed_elements_lose_nothing():
    assert short(f'<body><form id="aspnetForm"><div id=menu><a href=x>Home</a></div><article><h1>T</h1>{P}<p>Short end.</p></article></form>') == ["T", "L", "Short end."]
    assert short(f'<form id=f><div><a href=x>Home</a></div><div id=c><h1>T</h1>{P}{P}<p>Short.</p></div><div>Copyright 2020 Example Ltd.</div></form>') == \
        ["T", "L", "L", "Short."]
    for wrong in ("nav", "aside", "footer"):
        assert short(f"<body><{wrong}><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><article><h1>T</h1>{P}</article>") == ["T", "L"]
        assert short(f"<body><{wrong}><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><div><h1>T</h1>{P}{P}</div>") == ["T", "L", "L"]


def test_boilerplate_without_an_article_element():
    notice = "<div>We use cookies to improve your visit. <button>OK</button></div>"
    page = (f"<body><div>Home</div><div>Terms of use</div>{notice}<div><h1>Title of it</h1><div>Posted by admin</div>{P}<h2>Sub</h2>{P}"
            f"<ul><li>one<li>two</ul>{P}</div><div>Copyright 2020 Example Ltd.</div><div>Terms of use</div></body>")
    assert short(page) == ["Title of it", "L", "Sub", "L", "one", "two", "L"]
    flat = f"<body><p>Home</p><h1>Title of it</h1><p>Posted by admin</p>{P}{P}<p>The end.</p><p>Copyright 2020 Example Ltd.</p><p>Terms of use</p></body>"
    assert short(flat) == ["Title of it", "L", "L", "The end."]


def test_comments_teasers_and_several_articles():
    said = "<p>I disagree with all of this text here, said the reader of it.</p>"
    assert short(f'<body><article><h1>T</h1>{P}</article><section id="discussion">{said}</section></body>') == ["T", "L"]
    assert short(f"<body><article><p>Small teaser.</p></article><div>{P}{P}{P}</div></body>") == ["Small teaser.", "L", "L", "L"]
    assert short(f"<body><main><article>{P}</article><article><p>Short other one.</p></article></main><p>Imprint</p></body>") == ["L", "Short other one."]


def test_the_threshold_decides(monkeypatch):
    page = f"<body><div>{'<p>Entry with a few plain words</p>' * 12}</div><div>{P}{P}</div></body>"
    assert short(page) == ["L", "L"]
    monkeypatch.setattr(mainhtml, "threshold", lambda values, weights: float("-inf"))
    assert short(page) != ["L", "L"]
    monkeypatch.undo()
    monkeypatch.setattr(mainhtml, "threshold", lambda values, weights: float("inf"))
    assert short(page) != ["L", "L"]


def test_ratios_smoothing_and_cut_equal_plain_loops():
    import math
    import random
    rng = random.Random(9)
    for _ in range(30):
        rows = [mainhtml.Line("x" * rng.randint(0, 400), rng.randint(0, 6), rng.randint(0, 20), (), 0, False, rng.random() < 0.2) for _ in range(rng.randint(1, 40))]
        want = [math.log(1 + max(len(r.text) - r.linked, 0) / (1 + r.tags)) * (mainhtml.NAMED if r.lowered else 1) for r in rows]
        got = mainhtml.ratios(rows)
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9
        weights = {k: math.exp(-k * k / (2 * mainhtml.SPREAD ** 2)) for k in range(-4, 5)}
        plain = [sum(weights[k] * want[i + k] for k in weights if 0 <= i + k < len(want)) / sum(weights[k] for k in weights if 0 <= i + k < len(want)) for i in range(len(want))]
        assert max(abs(a - b) for a, b in zip(mainhtml.smoothed(got), plain)) < 1e-9
        sizes = [len(r.text) for r in rows]
        if not sum(sizes):
            continue
        cut = mainhtml.threshold(mainhtml.smoothed(got), np.array(sizes, float))
        means = []
        for side in (True, False):
            part = [(v, n) for v, n in zip(plain, sizes) if n and (v >= cut - 1e-9) == side]
            means.append(sum(v * n for v, n in part) / sum(n for _, n in part) if part else None)
        assert means[1] is None or abs(cut - sum(means) / 2) < 1e-6 and means[0] - means[1] >= mainhtml.APART


def test_ratio_helpers():
    assert abs(mainhtml.smoothed(np.ones(50))[20] - 1) < 1e-9 and mainhtml.smoothed(np.array([1.0])).shape == (1,)
    assert 1 < mainhtml.threshold(np.array([0, 1, 0, 9, 10, 11.0])) < 9 and mainhtml.threshold(np.array([3.0])) == 3


def test_given_pages(spark, folder):
    pages = table(spark, folder, "pages")
    got = {r["page_id"]: r for r in mainhtml.extracted(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_table_cases(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>é</p>", "x"), (None, None, "t", "x")],
                                  "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in mainhtml.extracted(pages).collect()))
    assert got == [(0, "t", 1), (1, "", 0), (2, "", 0), (2, "é", 1)]
    assert mainhtml.extracted(pages.limit(0)).count() == 0
