import html
import re

import pyarrow.parquet as pq

from voltide.llm import html_text as h

P = "The quick story of the day and what it was for all of them is told here. "


def test_given_pages_equal_their_articles():
    """On the synthetic pages the article element holds the whole text."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        article = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert h.main_text(page) == "\n\n".join(x for x in parts if x)


def test_unmarked_pages_use_density():
    page = f"""<body><div><a href=1>Home</a> <a href=2>News</a></div><h1>Title here</h1><div>{P * 4}</div>
    <p>Short one.</p><div>{P * 3}</div><div><a href=3>{P}</a></div><div>Buy now cheap widgets deals offers prices discount clearance sale bargains</div></body>"""
    assert h.main_text(page).split("\n\n") == ["Title here", (P * 4).strip(), "Short one.", (P * 3).strip()]


def test_parts_that_are_no_article():
    page = f"""<html><head><title>x</title><script>if (a<b) "</p>"</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><div id="cookieNotice">{P}</div><main><article><header><h1>Story</h1></header><p>{P}
    <p>Be.<ul><li>one<li>two</ul><div class="ad-slot">{P}</div><form>{P}</form><aside>{P}</aside><p hidden>{P}</p>
    <p>Last &amp; <i>in</i>line&nbsp;&#233;</p><footer>{P}</footer></article><section id="comments"><article class="comment">{P}</article></section></main>
    <div class="sidebar">{P}</div><footer>&copy;</footer><!-- c --> <style>p{{}}</style>"""
    assert h.main_text(page).split("\n\n") == ["Story", P.strip(), "Be.", "one", "two", "Last & inline é"]


def test_broken_markup():
    assert h.main_text("<article><p>a < b <b>c</article>") == "a < b c"
    assert h.main_text('<p title="x>only text <i>here') == "only text here"
    assert h.main_text("<p>cut <!-- never closed <p>x") == "cut"
    assert h.main_text("<script>never closed") == ""
    assert h.main_text("plain words") == "plain words"
    assert h.main_text("<p>" + "<" * 3000 + "a='" * 2000 + "the end of it") is not None  # ends soon


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (None, None, None, 2), (3, "v", "", 3), (4, "w", "<p>" + "é" * 200_000, 4)], "page_id long, url string, html string, Text int")
    out = h.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, 1), (1, 1), (3, 0), (4, 200_000)]
    assert h.extract(df.limit(0)).count() == 0


def test_hints_around_the_whole_page():
    """An article stays one in a wrapper that is named after its sidebar, or in a form."""
    for wrapper in ('div class="container has-sidebar"', 'div class="no-ads"', 'div class="pageWidget"', 'form id="f"', "form"):
        tag = wrapper.split()[0]
        for inner in ("article", "main"):
            page = f'<body><{wrapper}><div class="menu">{P}</div><{inner}><h1>Story</h1><p>{P}</p><div class="ad-slot">{P}</div></{inner}><div>{P}</div></{tag}></body>'
            assert h.main_text(page).split("\n\n") == ["Story", P.strip()], (wrapper, inner)
    for wrapper in ("div class=comments", "div class=related", "div hidden", "aside", "footer"):
        page = f"<main><p>{P}</p></main><{wrapper}><article><p>Other.</p></article></{wrapper.split()[0]}>"
        assert h.main_text(page) == P.strip()


def test_given_pages_are_decided_by_both_passes():
    """Without their article elements the pages' long blocks are found by
    density and the short ones by their neighbours."""
    lost = kept = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()[:100]:
        want, got = h.main_text(page).split("\n\n"), h.main_text(re.sub(r"</?article>", "", page)).split("\n\n")
        lost += sum(x not in got for x in want if len(x) > h.SHORT)
        kept += sum(x in want for x in got)
    assert kept > 500 and lost < 0.05 * kept


def brute_second(first, side, heading):
    """For each open block, all decided ones by distance."""
    out = []
    for i, x in enumerate(first):
        if x:
            out.append(x)
            continue
        near = [(abs(i - j), j) for j, y in enumerate(first) if y and side[j] == side[i]]
        if not near and not side[i]:
            near = [(abs(i - j), j) for j, y in enumerate(first) if y]
        if not near:
            out.append("good")
            continue
        best = min(near)[0]
        at = [j for d, j in near if d == best]
        labels = {first[j] for j in at}
        out.append(labels.pop() if len(labels) == 1 else "good" if side[i] or (heading[i] and first[max(at)] == "good") else "bad")
    return out


def test_second_pass_equals_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(2000):
        n = rng.randrange(12)
        first = [rng.choice(["", "", "good", "bad"]) for _ in range(n)]
        a, b = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
        side, heading = [a <= i < b for i in range(n)], [rng.random() < 0.3 for _ in range(n)]
        assert h.second_pass(first, side, heading) == brute_second(first, side, heading)


def test_first_pass_moves_with_the_place():
    def label(text, limits, linked=0):
        return h.first_pass(h.Block(text, linked, False, -1, False, False, stop=h.stop_density(text)), limits)

    plain = "Buy cheap widgets deals offers prices discount clearance sale bargains today everyone"
    assert [label(plain, x) for x in (h.INSIDE, h.OUTSIDE, h.ANYWHERE)] == ["good", "bad", "bad"]
    assert [label(P * 4, x) for x in (h.INSIDE, h.OUTSIDE, h.ANYWHERE)] == ["good", "bad", "good"]
    assert [label("Short one.", x) for x in (h.INSIDE, h.OUTSIDE, h.ANYWHERE)] == ["", "bad", ""]
    assert [label(P * 4, x, 250) for x in (h.INSIDE, h.OUTSIDE, h.ANYWHERE)] == ["", "bad", "bad"]


def test_no_hint_empties_a_page():
    for wrapper in ("class='news-share-article'", "id='layout-right-sidebar'", "class=no-ads", "class='with-comments-widget'"):
        for inner in (f"<article><h1>Story</h1><p>{P * 3}</p></article>", f"<h1>Story</h1><p>{P * 3}</p>"):
            assert "quick story" in h.main_text(f"<body><div {wrapper.replace('with-comments-', '')}>{inner}<div class=sidebar>{P}</div></div></body>"), wrapper
    page = f"<body><div class=sidebar>{P}</div><div><p>{P * 5}</p></div><div class='share widget'>{P}</div></body>"
    assert h.main_text(page) == (P * 5).strip()


def test_other_languages_and_scripts():
    chinese = "这是一个关于春天的故事，人们在河边散步，孩子们在树下玩耍，老人们坐在长椅上聊天。" * 4
    assert h.main_text(f"<body><p>{chinese}</p><div>{P}</div><a href=1>Home</a></body>").startswith(chinese)
    polish = "Wiosenne opowiadanie zaczyna się nad rzeką, gdzie dzieci bawią się wesoło pod starymi drzewami, słuchając śpiewu ptaków. " * 3
    assert h.main_text(f"<body><ul><li><a href=1>Dom</a></ul><p>{polish}</p></body>") == polish.strip()


def test_time_grows_with_length():
    import time

    def seconds(n):
        page = "<div>" * n + "</em>" * n + "<div class=ad>" * n + P
        began = time.perf_counter()
        h.main_text(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(0.01, seconds(4000))
