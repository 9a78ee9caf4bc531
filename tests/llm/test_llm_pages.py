import re
from html import unescape

import pytest

from clicktide.llm import pages


def article(html):
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, small):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = pages.op8_html(spark, small).collect()
    assert {r.page_id: r.text for r in rows} == {i: article(h) for i, h in html.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c</p>", "a\nb c"),
        ("<ul><li>x<li>y</ul>z", "x\ny\nz"),
        ("<nav><p>menu</p></nav><p>text</p><footer>f</footer>", "text"),
        ("<header>h</header><article><header><h1>t</h1></header><p>b</p></article><p>out</p>", "t\nb"),
        ("<article><p>a</p><div class='comments'><article>c</article></div></article>", "a"),
        ("<article><p>a &lt;b&gt;</p><script>if (a<b) '<p>x</p>'</script><style>p{}</style></article>", "a <b>"),
        ("<div class=\"post ad-free\"><p>a</p></div>", "a"),
        ("<div role=navigation>x</div><div hidden>y</div><div style='display: none'>z</div>w", "w"),
        ("<b>bold<p>next</b> more", "bold\nnext more"),
        ("<!-- <p>no</p> --><p>yes", "yes"),
        ("<p title='a > b'>q</p>", "q"),
        ("<form><p>f</p></form><main><p>m</p></main>", "m"),
        ("a<hr>b", "a\nb"),
        ("<p>unclosed <i>one</p><p>two", "unclosed one\ntwo"),
    ],
)
def test_blocks(html, text):
    assert pages.main_text(pages.parse(html), frozenset()) == text


def test_site_templates_go_and_copied_articles_stay(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://Site.example/{i}", f"<div><p>Follow us on our site</p></div><p>Story {i} {'long ' * i}</p>"))
    for i in range(12, 20):
        rows.append((i, f"http://copy.example/{i}", "<div><p>The very same story</p><p>in two parts</p></div>"))
    rows += [(20, None, "<p>no host</p>"), (21, "http://site.example/n", None), (21, "http://site.example/n", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in pages.extract(df).collect()]
    texts = dict(got)
    assert len(got) == len(rows)
    assert all(texts[i] == " ".join(f"Story {i} {'long ' * i}".split()) for i in range(12))
    assert all(texts[i] == "The very same story\nin two parts" for i in range(12, 20))
    assert texts[20] == "no host" and texts[21] == ""
    assert pages.extract(df.limit(0)).count() == 0


def test_clashing_columns_and_long_pages(spark):
    html = "<p>x</p>" * 20_000
    df = spark.createDataFrame([(1, "//h/", html, "t", "a", "b")], "page_id long, url string, html string, text string, _host string, extra string")
    (row,) = pages.extract(df).collect()
    assert row.text.count("\n") == 19_999 and row.extra == "b"


def test_deeply_nested_page_ends():
    html = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert pages.main_text(pages.parse(html), frozenset()) == "deep"


def site(spark, bodies):
    rows = [(i, f"http://site.example/{i}", body) for i, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [text for _, text in sorted((r.page_id, r.text) for r in pages.extract(df).collect())]


def test_templates_longer_than_the_articles_go(spark):
    legal, about = "<div><p>Legal " + "terms " * 40 + "</p></div>", "<section><p>About " + "us " * 80 + "</p></section>"
    stories = [f"Story number {i}" for i in range(12)]
    assert site(spark, [f"{legal}<p>{s}</p>" for s in stories]) == stories
    assert site(spark, [f"{legal}<p>{s}</p>{about}" for s in stories]) == stories


def test_few_rotating_blocks_do_not_make_headings_templates(spark):
    rotating = [f"<div><p>Quote {k} {'of the day ' * 20}</p></div>" for k in range(5)]
    texts = site(spark, [f"{rotating[i % 5]}{'<h2>Method</h2>' if i < 5 else ''}<p>Story {i}</p>" for i in range(60)])
    assert all("Method" in text for text in texts[:5])


def test_template_of_one_section_goes(spark):
    sections = ["<div><p>Sport desk</p></div>", "<div><p>Culture desk</p></div>", "<div><p>Science desk</p></div>"]
    stories = [f"Story number {i}" for i in range(60)]
    assert site(spark, [f"{sections[i % 3]}<p>{s}</p>" for i, s in enumerate(stories)]) == stories


def test_lines_that_articles_share_stay(spark):
    bodies = [f"<article><p>{'A common phrase' if i % 6 == 0 else f'Opening {i}'}</p><p>Story {i}</p></article>" for i in range(60)]
    texts = site(spark, bodies)
    assert texts[0] == "A common phrase\nStory 0" and texts[1] == "Opening 1\nStory 1"


def test_template_of_some_pages_goes(spark):
    bodies = [f"{'<p>Sport desk</p>' if i % 5 < 2 else ''}<p>Story {i}</p>" for i in range(60)]
    assert site(spark, bodies) == [f"Story {i}" for i in range(60)]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<main class='content with-sidebar'><p>a</p></main>", "a"),
        ("<article class='post has-comments'><p>a</p></article>", "a"),
        ("<article class='post ad-free'><p>a</p></article>", "a"),
        ("<p class='no-share'>a</p><div class='content-sidebar-wrap'>b</div>", "a\nb"),
        ("<article class='promo'>a</article><p>b</p>", "a"),
        ("<div class='sidebar'><div class='related'><main>a</main></div><nav>n</nav></div>", "a"),
        ("<article>a</article><div id='comments' class='comments-area'><article>c</article></div>", "a"),
        ("<div class='main-nav'>x</div><ul class='social-links'><li>y</ul><div class='site-header'>z</div>w", "w"),
    ],
)
def test_classes_that_name_furniture(html, text):
    assert pages.main_text(pages.parse(html), frozenset()) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<h1>Title</h1><p>by line</p><article><p>The body of it</p></article>", "Title\nThe body of it"),
        ("<p>x</p><h2>Title</h2><article><p>The body of it</p></article>", "Title\nThe body of it"),
        ("<div><p>A long body of the page</p></div><article>Teaser</article>", "A long body of the page\nTeaser"),
    ],
)
def test_text_outside_the_article(html, text):
    assert pages.main_text(pages.parse(html), frozenset()) == text


def test_promo_card_as_article_is_no_main_text(spark):
    card = "<article><p>Join our club of readers today</p></article>"
    assert site(spark, [f"{card}<div>Story {i}</div>" for i in range(12)]) == [f"Story {i}" for i in range(12)]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p title=\"A hidden gem\">Body text</p><p class=\"lead hidden md\">more</p>", "Body text\nmore"),
        ("<p data-x=hidden>a</p><p hidden>b</p><p HIDDEN=until-found>c</p><p style=display:none>d</p>", "a"),
        ("<p><a title=it's>link text</a> more</p><p>don't</p>", "link text more\ndon't"),
        ("<p title = \"a > b\" alt='it\"s >'>q</p><p title=\"open>r", "q\nr"),
        ("<p a=1 b='2' c=\"3\" d e='\"' f=\"'\">x</p>", "x"),
    ],
)
def test_attributes(html, text):
    assert pages.main_text(pages.parse(html), frozenset()) == text


def test_broken_attributes_take_no_time():
    html = "<p " + "a='x' " * 3000 + "\"" * 3000
    assert pages.parse(html).blocks
    assert pages.attributes_of(" a=1 A=2 b = 'x y' c d=\"&amp;\" e=f=g ") == {"a": "1", "b": "x y", "c": "", "d": "&", "e": "f=g"}


@pytest.mark.parametrize("name", ["wine-menu", "bar-chart-widget", "product-search", "job-alert", "community-notice", "free-software-social"])
def test_names_of_other_things_drop_nothing(name):
    html = f"<main><div class='{name}'><p>All of the text</p></div></main><div class='{name}'>and this</div>"
    assert "All of the text" in pages.main_text(pages.parse(html), frozenset())
    assert pages.main_text(pages.parse(f"<div class='{name}'>and this</div>"), frozenset()) == "and this"


def test_no_name_drops_most_of_a_page():
    body = "<div class='widget'><p>" + "many words of a story " * 20 + "</p></div>"
    assert pages.main_text(pages.parse(f"<p>Intro</p>{body}"), frozenset()).count("story") == 20
    # A menu of links stays furniture, and so do comments that are longer than the text.
    menu = "<div class='navigation'>" + "<a href=x>far too many links</a> " * 30 + "</div>"
    assert pages.main_text(pages.parse(f"<p>A short text here</p>{menu}"), frozenset()) == "A short text here"
    comments = "<div id=comments>" + "<p>what a reader thinks of it</p>" * 30 + "</div>"
    assert pages.main_text(pages.parse(f"<article><p>Short text</p>{comments}</article>"), frozenset()) == "Short text"
    nested = f"<div class='promo'><div class='sidebar'><p>{'deep words ' * 30}</p></div></div><p>x</p>"
    assert pages.main_text(pages.parse(nested), frozenset()).startswith("deep words")


def test_recipes_keep_their_ingredients(spark):
    things = ["1 tsp salt", "1 cup flour", "2 eggs", "butter", "milk", "sugar"]
    lists = [[things[(i + k) % 6] for k in range(3)] for i in range(40)]
    news = "<div class=x><p>Get our letter with new recipes every week in your inbox</p></div>"
    bodies = [
        f"<article><h1>Dish {i}</h1><ul>{''.join(f'<li>{x}</li>' for x in own)}</ul><p>Mix {i} times.</p>{news}</article>"
        for i, own in enumerate(lists)
    ]
    texts = site(spark, bodies)
    assert texts == ["\n".join([f"Dish {i}", *own, f"Mix {i} times."]) for i, own in enumerate(lists)]


def brute(rows, least=pages.LEAST_PAGES):
    """Template removal of small hosts: pairwise comparison of pages and elements, no hashes counted."""
    hosts = {}
    for url, html in rows:
        hosts.setdefault(re.sub(r"^.*?//([^/]*).*$", r"\1", url).lower(), []).append(pages.parse(html))
    gone = {}
    for name, parsed in hosts.items():
        def kept(p, skip=None):
            return tuple(b for i, b in enumerate(p.blocks) if p.kept[i] and not (skip and skip.first <= i < skip.last))
        seen, places = {}, {}
        for p in parsed:
            for e in p.elements:
                if not e.dropped and e.name in pages.BLOCKS - {"html", "body"} and e.last > e.first and kept(p, e):
                    seen.setdefault(e.digest, set()).add(tuple(sorted(kept(p, e))))
                    long = pages.words(p, range(e.first, e.last)) >= pages.LONG_WORDS
                    place = (not e.main, long, e.place % pages.LONG)
                    places[e.digest] = min(places.get(e.digest, place), place)
        total = len({tuple(sorted(kept(p))) for p in parsed})
        gone[name] = set()
        for digest, contexts in seen.items():
            outside, long, _ = places[digest]
            there = [len(seen[d]) for d in seen if places[d] == places[digest]]
            again = sum(n for n in there if n >= least)
            share = pages.ELSEWHERE if outside else pages.SHARE if long else pages.EVERYWHERE
            n = len(contexts)
            if n >= least and n * n >= total and (outside and 2 * again >= sum(there) or n >= share * total):
                gone[name].add(digest)
    return gone


def test_templates_equal_a_count_by_hand(spark):
    import random

    rng = random.Random(12)
    rows = []
    for h in range(4):
        lines = [f"<p>Line {k} of host {h}{' with many more words than others have' * (k % 2)}</p>" for k in range(6)]
        for i in range(rng.randint(6, 30)):
            parts = [x for x in lines if rng.random() < 0.4] + [f"<p>Own text {i}</p>"]
            rng.shuffle(parts)
            inner = "".join(parts)
            html = f"<div class=c{rng.randint(0, 1)}>{inner}</div>" if rng.random() < 0.5 else f"<article>{inner}</article>"
            rows.append((f"http://H{h}.org/{i}", html))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.host: set(r.hashes) for r in pages.templates(df).collect()}
    expected = {k: v for k, v in brute(rows).items() if v}
    assert got == expected and expected
    a, b = (sorted(map(repr, pages.extract(df, most_sent=n).collect())) for n in (0, 10**6))
    assert a == b
