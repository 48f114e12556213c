import html
import random
import re
import time

import pytest

from resonant.llm import html_text
from resonant.llm.html_text import extract, main_text

PROSE = "A first sentence of the story, with some weight. Then a second one; it goes on, as stories do."


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "chrome",
    [
        "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>More, and more.</a></li></ul></nav>",
        "<header><h1>The Site</h1><p>Its long motto, which says a lot. Yes, it does.</p></header>",
        "<footer>&copy; us. All of it, everywhere, always.</footer>",
        "<aside><p>On the side, there is a lot to read. Do read it, please.</p></aside>",
        '<div class="ad">Buy this, it is good. Buy that, it is better.</div>',
        '<div id="cookie-notice"><p>We use cookies, of course. Do you agree, or not?</p></div>',
        "<form><p>Write to us, please. We answer, always.</p><input><button>Send</button></form>",
        "<script>var a = '<p>no, never. </p>';</script><style>p{a:b}</style><!-- a, b. -->",
        f'<section class="comments"><article><p>{PROSE}</p></article></section>',
    ],
)
def test_chrome_is_left_out(chrome):
    article = f"<article><h1>The Title</h1><p>{PROSE}</p><p>Short end.</p></article>"
    want = f"The Title\n{PROSE}\nShort end."
    assert main_text(page(chrome + article)) == want
    assert main_text(page(article + chrome)) == want


def test_without_an_article_the_ratios_decide():
    body = f'<div class="m"><a href=/>One</a> <a href=/>Two</a></div><div class="t"><p>{PROSE}</p><p>{PROSE} And more.</p><p>{PROSE}</p></div><div class="f"><span>Terms</span></div>'
    assert main_text(page(body)) == f"{PROSE}\n{PROSE} And more.\n{PROSE}"


@pytest.mark.parametrize("times", [8, 20, 200])
@pytest.mark.parametrize(
    ("region", "line"),
    [
        ("<ul>{}</ul>", "<li>An item of some thirty letters</li>"),
        ("<ol>{}</ol>", "<li><b>Bold</b> and <a href=/x>linked</a> item</li>"),
        ("<table>{}</table>", "<tr><td>12</td><td>cell</td></tr>"),
        ("<div class='listing'>{}</div>", "<pre>x = f(y)</pre>"),
        ("<dl>{}</dl>", "<dt>term</dt><dd>what it is</dd>"),
    ],
)
def test_an_article_keeps_its_short_blocks(region, line, times):
    long = " ".join([PROSE] * 6)
    got = main_text(page(f"<article><h1>T</h1><p>{long}</p>{region.format(line * times)}<p>{long}</p><ul><li><a href=/x>Another page</a></li></ul></article>")).split("\n")
    each = [re.sub("<.*?>", "", x) for x in re.split("(?<=</td>)|(?<=</dt>)", line)]
    assert got == ["T", long, *[x for x in each if x] * times, long]


@pytest.mark.parametrize("name", ["class='content has-sidebar'", "id='page-with-sidebar'", "class='post tags-x'"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_part_of_a_name_does_not_remove_the_article(name, tag):
    body = f"<p>{PROSE}</p><p>{PROSE} And more.</p>"
    want = f"{PROSE}\n{PROSE} And more."
    aside = '<div class="left-sidebar"><p>On the side, yes.</p></div>'
    assert main_text(page(f"<{tag} {name}>{body}{aside}</{tag}>{aside}")) == want
    assert main_text(page(f"<{tag} {name}><article>{body}</article></{tag}>{aside}")) == want


def test_comments_longer_than_the_article():
    assert main_text(page(f'<article><p>{PROSE}</p></article><div class="comments-area"><p>{PROSE}</p><p>{PROSE}</p></div>')) == PROSE


def test_a_teaser_is_not_the_article():
    body = "".join(f"<p>{PROSE} {k}.</p>" for k in range(6))
    teaser = "<article><h2>Read on</h2><p>A card.</p></article>"
    want = "\n".join(f"{PROSE} {k}." for k in range(6))
    assert main_text(page(f"<div id=main>{body}</div>{teaser}")) == want
    assert main_text(page(f"{teaser}<div id=main>{body}</div>")) == want


def test_references_spaces_and_breaks():
    assert main_text(page("<article><p>a &amp; b&nbsp;&eacute;\n\t c<br>d <b>e</b>f</p></article>")) == "a & b é c d ef"


def test_broken_markup():
    assert main_text("<article><h1>T</h1><p><b>one, two.<br><p>three, four.") == "T\none, two.\nthree, four."
    assert main_text("<article><p>kept, yes.</p><script>lost") == "kept, yes."
    assert main_text("a < b, and <i c") != ""


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{PROSE}</p></article>"), "x"), (None, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p>" + "long, text. " * 50_000, "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(PROSE)), (None, 0), (2, 0), (2, 0), (3, len("long, text. " * 50_000) - 1)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LONG = " ".join([PROSE] * 4)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><p title='A hidden gem'>{PROSE}</p></article>", PROSE),
        (f"<article><p data-x='hidden'>{PROSE}</p><p hidden>Unseen, all of it.</p><p style='display: none'>Unseen.</p></article>", PROSE),
        (f"<div class='page with-sidebar'><p>{PROSE}</p></div>", PROSE),
        (f"<div class='article-body share-enabled'><p>{PROSE}</p><div class='share'>Share this, please.</div></div>", PROSE),
        (f"<article><div class='section-header'><h2>Part one</h2></div><p>{LONG}</p></article>", f"Part one\n{LONG}"),
        (f"<article><p>{LONG}</p><table><tr><td>1</td><td>a</td></tr></table><blockquote>So be it</blockquote></article>", f"{LONG}\n1\na\nSo be it"),
        ("<article><p><a href=/x>The whole paragraph is a link, as it were.</a></p></article>", "The whole paragraph is a link, as it were."),
        (f"<article><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", f"{PROSE} x=1 holds."),
        (f'<div class="widget"><p>{PROSE}</p><p>{PROSE}</p></div>', f"{PROSE}\n{PROSE}"),
        (f"<h1>The Title</h1><div><p>{PROSE}</p></div>", f"The Title\n{PROSE}"),
        (f"<table><tr><td>News<br>Sport</td><td><p>{LONG}</p><p>Short end.</p><table><tr><td>1</td><td>a</td></tr></table></td><td>More news</td></tr></table>", f"{LONG}\nShort end.\n1\na"),
    ],
)
def test_article_text_is_whole(body, want):
    assert main_text(page(body)) == want


def without_names(seed):
    """A page whose names and tags say nothing, and its text."""
    rng = random.Random(seed)
    sentence = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n)).capitalize() + rng.choice(".!?")
    prose = lambda: " ".join(sentence(rng.randint(6, 18)).replace(" ", ", ", 1) for _ in range(rng.randint(2, 9)))
    menu = lambda: "<div><ul>" + "".join(f"<li><a href=/x>w{rng.randrange(99)}</a></li>" for _ in range(rng.randint(3, 12))) + "</ul></div>"
    bits = lambda: "<div>" + "".join(f"<span>w{rng.randrange(99)}</span><br>" for _ in range(rng.randint(1, 4))) + "</div>"
    parts, want = [], []
    for k in range(rng.randint(4, 12)):
        kind = rng.random() if k else 0
        if kind < 0.7:
            text = prose()
            parts.append(f"<p>{text}</p>")
            want.append(text)
        elif kind < 0.85:
            items = [f"w{rng.randrange(99)}" for _ in range(rng.randint(2, 20))]
            parts.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            want += items
        else:
            parts.append(f"<h2>w{k}</h2>")
            want.append(f"w{k}")
    return page(menu() + bits() + "<div><div>" + "".join(parts) + "</div></div>" + menu() + bits()), "\n".join(want)


def test_ratios_find_the_text_of_pages_without_names():
    pages = [without_names(k) for k in range(200)]
    assert [main_text(p) for p, _ in pages] == [w for _, w in pages]


def test_ratios_select(monkeypatch):
    named = page(f'<nav><a href=/>x</a></nav><div class="ad">Buy this, yes.</div><article><p>{PROSE}</p></article>')
    pages = [named, *(without_names(k)[0] for k in range(50))]
    found = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "path_scores", lambda paths, config: dict.fromkeys(paths, 1.0))
    assert all(main_text(p) != f for p, f in zip(pages, found))
    # with the prior alone, pages that name nothing are not told apart
    monkeypatch.setattr(html_text, "path_scores", lambda paths, config: {k: p.prior for k, p in paths.items()})
    assert all(main_text(p) != f for p, f in zip(pages[1:], found[1:]))


@pytest.mark.parametrize("piece", ["<!-- ", "<a b ", '<a b="x ', '<a b="x>', "<div>", "<i><b>x</i>", "</section><p>", "<", "&lt;<script "])
def test_broken_pages_take_linear_time(piece):
    began = time.perf_counter()
    main_text(f"<p>{PROSE}" + piece * 100_000)
    assert time.perf_counter() - began < 5
    began = time.perf_counter()
    text = main_text("<p>a, b." + "<!-- " * 100_000)
    assert time.perf_counter() - began < 1 and text.startswith("a, b.<!--")


def test_query_covers_the_table(spark):
    data = "/root/testdata/sf0.001"
    given = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = html_text.op1_main_text(spark, data).collect()
    assert sorted(r.page_id for r in got) == sorted(given)
    for r in got:
        assert r.url == given[r.page_id].url and r.text == main_text(given[r.page_id].html) and r.n_chars == len(r.text)
        # these pages hold their text in an article: all of it, and nothing else, in its order
        inner = re.search("<article>(.*)</article>", given[r.page_id].html, re.S)[1]
        assert re.sub(r"\s", "", html.unescape(re.sub("<[^>]*>", "", inner))) == re.sub(r"\s", "", r.text)
