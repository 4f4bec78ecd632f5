import pytest

from gridcube.llm import pages as P

CASES = {
    "<p>&amp;lt; a&nbsp;b &#x41;<p>x": "&lt; a b A\nx",
    '<div class="page has-sidebar"><div class="sidebar">menu</div><article>Text of it</article></div>': "Text of it",
    '<div id="comments"><article>c</article></div><article><header><h1>T</h1></header><p>Body long enough</p>'
    '<div class="share">x</div></article>': "T\nBody long enough",
    "<aside><article>teaser</article></aside><main><p>Main text here</p></main>": "Main text here",
    "<nav><a>x</a><article>Open nav</article>": "Open nav",
    "<article>a<script>if (a < b) '</p>'</script><form>f</form><!-- c --> b<br>c</article><footer>f</footer>": "a\nb\nc",
    "<article>Cut off <!-- and": "Cut off",
    "<nav>only a menu</nav>": "", "": "", "plain": "plain",
}


@pytest.mark.parametrize("html", CASES)
def test_main_text(html):
    assert P.main_text(html) == CASES[html]


def test_dense_lines_win_without_an_article():
    links = "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(20))
    body = "".join(f"<p>{'a sentence of the story. ' * 12}</p>" for _ in range(4))
    got = P.main_text(f"<body><div><ul>{links}</ul></div><section>{body}</section><div>{links}</div></body>")
    assert got.count("\n") == 3 and "go" not in got


def test_awkward_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "own"), (None, "", "own"), (2, "<p>x" * 20_000, "own"), (2, "<b>t", "own")],
                               "page_id int, html string, text string")
    rows = P.extract_text(df).collect()
    assert [(r.page_id, r.text[:3]) for r in rows] == [(1, ""), (None, ""), (2, "x\nx"), (2, "t")]
    assert P.extract_text(df.limit(0)).count() == 0


STORY = "A sentence of the story that is long enough to be one. " * 5

WHOLE = {
    f'<article><h2 id="related-work">Related work</h2><p>{STORY}</p><h3 id="social-impact">Impact</h3><p class="legal">By law.</p>'
    f'<section id="discussion"><h2>Discussion</h2><p>{STORY}</p></section><div class="share-buttons">Share</div></article>':
        ["Related work", STORY, "Impact", "By law.", "Discussion", STORY],
    f'<body><form id="aspnetForm"><div>{STORY}</div><form class="login">Name</form></form></body>': [STORY],
    f'<form><main><p>{STORY}</p></main></form>': [STORY],
    f'<body><div><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="story"><div><h1>Title</h1></div>'
    f'<div><p>{STORY}</p></div><div><p>So it is.</p></div><div><p>{STORY}</p></div></div></body>': ["Title", STORY, "So it is.", STORY],
}


@pytest.mark.parametrize("html", WHOLE)
def test_text_is_not_dropped_by_name_form_or_region(html):
    got = P.main_text(html).replace("\nName", "")
    assert got == "\n".join(x.strip() for x in WHOLE[html])


def test_deep_nesting_takes_no_quadratic_work():
    assert P.main_text("<div>" * 20_000 + "<p>x") == "x"


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


P1, P2 = "The river rose in the night and took the old bridge. " * 2, "Nobody was hurt, said the mayor at noon. " * 2
LONG_NOTICE = "We and our partners store cookies on your device to measure the use of this site. " * 3
NOTICES = {
    page(f'<div class="cookie-notice">{LONG_NOTICE}</div><div id="content"><p>{P1}</p><p>{P2}</p></div>'): [P1, P2],
    page(f'<article><p>{P1}</p><div class="cookie-notice">{LONG_NOTICE}</div><div class="newsletter-box">{LONG_NOTICE}</div>'
         f'<div class="advert">{LONG_NOTICE}</div><p>{P2}</p></article>'): [P1, P2],
    page(f'<article><p>{P1}</p></article><div class="user-reviews">{LONG_NOTICE * 4}</div>'): [P1],
    page(f"<article><p>{P1 * 4}</p></article><article><p>Short one.</p></article>"): [P1 * 4, "Short one."],
    page(f"<header><h1>Site</h1></header><h1>The bridge</h1><article><p>{P1}</p></article>"): ["The bridge", P1],
    page(f"<h1>Site</h1><article><h1>The bridge</h1><p>{P1}</p></article>"): ["The bridge", P1],
    page(f'<article><p>{P1}</p><div class="legal">He went to law.</div><div class="social">They met often.</div></article>'):
        [P1, "He went to law.", "They met often."],
    page(f'<main><p>{P1}</p><div class="related"><a href="/a">More of it</a> <a href="/b">And more</a></div></main>'): [P1],
    page(f'<article><p>{P1}</p><form>Write to us and we answer soon.</form></article>'): [P1],
    page(f'<article><p>{P1}</p></article><div class="related"><article><p>{P2}</p></article></div>'): [P1],
}


@pytest.mark.parametrize("html", NOTICES)
def test_boilerplate_goes_at_any_length_and_articles_win(html):
    assert P.main_text(html) == "\n".join(" ".join(x.split()) for x in NOTICES[html])


def test_unmatched_end_tags_take_no_quadratic_work():
    import time
    took = []
    for n in (20_000, 80_000):
        at = time.process_time()
        assert P.main_text("<span>" * n + "x" + "</b>" * n) == "x"
        took.append(time.process_time() - at)
    assert took[1] < 10 * took[0]
