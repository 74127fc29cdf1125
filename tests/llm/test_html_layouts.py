"""Operator 1 on common layouts, with 1 to 100 pages a host, and the style tree against brute force."""

import math
from collections import Counter, defaultdict

import pytest

from logweave.llm import html_text


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, blocks int")
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


def blog(i):
    return (f"<body class='comments-open'><header><a href='/'>Blog</a></header><main id='main'><article class='post has-comments'><h1>Post {i}</h1>"
            f"<div class='entry'><p>Story {i} begins.</p><h2>Why</h2><p>Because of {i}.</p></div></article>"
            "<div id='comments' class='comments-area'><h2 class='comments-title'>Thoughts</h2><ol class='comment-list'>"
            + "".join(f"<li id='comment-{i}{k}' class='comment'><article class='comment-body'><cite>Ann {k}</cite> <time>May {k}</time><p>Nice one {i} {k}</p></article></li>" for k in range(2))
            + "</ol></div></main><footer>F</footer></body>")


def shop(i):
    return (f"<main><div class='product'><h1>Lamp {i}</h1><p>It shines {i} hours.</p><div class='cookie-banner'>We use cookies</div><p class='notice'>Sale until {i}</p>"
            f"<p>Made of tin number {i}.</p></div><section class='user-comments'><p>Great lamp {i}</p><p>Too dark {i}</p></section></main>")


def news(i):
    return (f"<article><h1>News {i}</h1><h2>Ingredients</h2><p>Flour {i} and salt.</p><h2>Method</h2><p>Bake {i} minutes.</p>"
            f"<div class='reader-comments-list'><p>Reader says {i}</p><div id='comment-12'>Me too {i}</div></div></article>")


def portal(i):
    return f"<body><div class='wmde'><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></div><div><p>Portal text number {i} is here.</p></div></body>"


@pytest.mark.parametrize("pages", [1, 4, 5, 100])
def test_layouts(spark, pages):
    made = {"blog": blog, "shop": shop, "news": news, "portal": portal}
    rows = [(1000 * k + i, f"https://{name}.org/{i}", make(i)) for k, (name, make) in enumerate(made.items()) for i in range(pages)]
    got = texts(spark, rows)
    for i in range(pages):
        assert got[i] == f"Post {i} Story {i} begins. Why Because of {i}."
        assert got[1000 + i] == f"Lamp {i} It shines {i} hours. Made of tin number {i}."
        assert got[2000 + i] == f"News {i} Ingredients Flour {i} and salt. Method Bake {i} minutes."
        assert got[3000 + i] == f"Portal text number {i} is here."


def test_a_long_notice_shared_by_all_pages_goes(spark):
    notice = "This long notice is on every page of the host and is longer than anything else that any of its pages has to say."
    rows = [(i, "http://n.org/", f"<body><div><p>{notice}</p></div><section><p>Short {i}.</p></section></body>") for i in range(10)]
    assert texts(spark, rows) == {i: f"Short {i}." for i in range(10)}


def test_articles_that_only_look_like_comments_stay(spark):
    rows = [(1, "http://a.org/", "<article class='comment'><h1>On comments</h1><p>The comment is the article.</p></article>"),
            (2, "http://b.org/", "<main><h1>T</h1><div class='comments-open entry'><p>All of it</p></div></main>"),
            (3, "http://c.org/", "<div id='comments'><article><p>Only this</p></article></div>"),
            (4, "http://d.org/", "<article><p>Words</p><div class='notice'>" + "A notice that is the article itself. " * 5 + "</div></article>"),
            (5, "http://e.org/", None), (6, None, "<p>" + "long " * 100_000 + "</p>")]
    got = texts(spark, rows)
    assert got[1] == "On comments The comment is the article." and got[2] == "T All of it" and got[3] == "Only this"
    assert got[4].startswith("Words A notice") and got[5] == "" and len(got[6]) == 499_999


def test_importance_against_brute_force(spark):
    pages = [(i, f"http://h{i % 3}.org/", f"<body><div class='top'>Same for all</div><div class='promo'>{'Buy' if i % 4 else f'Buy {i}'}</div>"
              f"<div><p>Own {i // 2}</p>{'<ul><li>x</li></ul>' if i % 5 == 0 else ''}</div></body>") for i in range(30)]
    seen = defaultdict(list)
    for _, url, html in pages:
        page = html_text.Page(html)
        for branch in page.nodes().values():
            seen[url.split("/")[2], branch["node"]].append((html_text._code(*page.blocks), branch))
    parsed = spark.createDataFrame(pages, "page_id long, url string, html string").mapInArrow(html_text._parse_pages, html_text._PARSED)
    got = {(r.host, r.node): r for r in html_text.importance(parsed).collect()}
    assert got.keys() == seen.keys()
    for key, rows in seen.items():
        n = len({c for c, _ in rows})
        content = [len({b[f] for _, b in rows}) / len({(c, b[f]) for c, b in rows}) for f in ("feature",)][0]
        shapes = Counter(s for _, s in {(c, b["shape"]) for c, b in rows})
        total = sum(shapes.values())
        entropy = -sum(k / total * math.log(k / total) for k in shapes.values())
        presentation = min(1.0, entropy / math.log(min(max(n, 2), html_text.BASE_PAGES)))
        prior = 0.0 if any(b["suspect"] for _, b in rows) else 1.0
        shrunk = [(html_text.PRIOR_PAGES * prior + n * x) / (html_text.PRIOR_PAGES + n) for x in (content, max(content, presentation))]
        assert got[key].pages == n and abs(got[key].content - shrunk[0]) < 1e-9 and abs(got[key].importance - shrunk[1]) < 1e-9
