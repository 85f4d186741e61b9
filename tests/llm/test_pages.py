"""Main text of pages: parsing, decoding, and layouts that were not learnt from."""

import random

import numpy as np
import pytest

from curatrix.llm import extraction, page_samples
from curatrix.llm.dom import parse


@pytest.fixture(scope="module")
def model():
    return extraction.fit()


def gold(html):
    dom = parse(html)
    marked = [page_samples.MARK in a or (t == "#text" and p >= 0 and page_samples.MARK in dom.attributes[p]) for a, t, p in zip(dom.attributes, dom.tag, dom.parent, strict=True)]
    return " ".join(t for t, m in zip(dom.text, marked, strict=True) if m and t)


def test_pages_of_other_layouts(model):
    exact = [extraction.main_text(h, model) == gold(h) for h in page_samples.sample(150, seed=1234)]
    assert np.mean(exact) > 0.9


def test_an_article_among_everything_else(model):
    p = "Some sentence of the story, which goes on for a while. " * 6
    page = f"""<!doctype html><HTML><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><body>
    <div id="cookie-banner">We use cookies. <button>OK</button></div><header class=masthead><a href=/>Site</a></header>
    <nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><main><article><h1>The &amp; title</h1><p>{p}<p>Second&nbsp;one: {p}</p>
    <div class="advert">Buy this now.</div><ul><li>first point of it</li><li>second point of it</li></ul></article>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I like this story a lot, thanks.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=x>Another story</a></li></ul></aside>
    <form class=newsletter><label>Mail</label><input><p>Subscribe to our letter.</p></form><footer>&copy; 2024 Site. All rights reserved.</footer></body>"""
    one = " ".join(p.split())
    assert extraction.main_text(page, model) == f"The & title {one} Second one: {one} first point of it second point of it"


def test_parser_never_fails():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<div class='a", "\"", "<", ">", "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "&#x41;", "<li>", "<ul>", "<td>", "<br>", "</div>", "<a href=x>", "<select>", "<body>", "\x00"]
    for _ in range(500):
        html = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        dom = parse(html)
        n = len(dom.parent)
        assert all(dom.parent[i] < i < dom.end[i] <= n for i in range(n))
    assert parse("").text == [""]
    assert parse("<p>a&amp;b  c<p>d<script>x</script>e").text == ["", "a&b c", "d e"]


ARTICLE = "<article><h1>A story</h1><p>It goes like this.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        '<svg class="i" viewBox="0 0 1 1"/>',
        "<p>x<math/></p>",
        "<svg><style/><title/><path d='M0'/></svg>",
        "<div><button>Menu</div>",
        "<div><object data=x><param name=y></div>",
        "<form><select><option>A<option>B</form>",
        "<div><noscript><div>no</div><img src=x></div>",
        "<p><a href=x><svg><path d='M0'></a></p>",
        "<svg><path d='M0'><p>",
        "<button>One<button>Two</button>",
        "<select><option>A<select>",
        "<table><tr><td><button>B<td>c</table>",
        "<head><title>T</title><meta charset=x><noscript><link href=y></noscript>",
        "<html><head><script>a</script>",
    ],
)
def test_what_is_dropped_ends_before_the_article(before):
    text = " ".join(t for t in parse(before + ARTICLE).text if t)
    assert text.endswith("A story It goes like this.") and "no" not in text and "Menu" not in text and "One" not in text


def test_what_is_dropped_stays_dropped():
    for html in ("<div><noscript><div>no</div> no</noscript></div>", "<div><button><div><span>no</span></div>no</button></div>", "<div><svg><g/><text>no</text><foreignObject><p>no</p></foreignObject>no</svg></div>", "<a href=x><button><a>no</a>no</button></a>"):
        assert [t for t in parse(f"<p>a</p>{html}<p>b</p>").text if t] == ["a", "b"]
    assert [t for t in parse("<head><title>no</title><body><p>b").text if t] == ["b"]
    assert [t for t in parse("<head><title>no</title> words <p>b").text if t] == ["words", "b"]


def test_decoding_is_hierarchical(model):
    rng = np.random.default_rng(0)
    for html in page_samples.sample(20, seed=5):
        dom = parse(html)
        kept = extraction.decode(dom, rng.normal(0, 3, len(dom.parent)))
        for i, p in enumerate(dom.parent):
            if kept[i]:
                assert p < 0 or kept[p]
                assert dom.text[i] or any(kept[j] for j in range(i + 1, dom.end[i]) if dom.parent[j] == i)


def test_extraction_of_odd_rows(spark, model):
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>A story</h1><p>" + "It goes like this, and then on. " * 20 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", page, 3), (1, "u", page, 3), (2, None, None, 1), (None, "u", "", 2), (4, "v", "plain words only", 1), (5, "w", "<p>x " * 3000, 1)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): r for r in extraction.extract(pages, model).collect()}
    assert extraction.extract(pages, model).count() == 6
    assert got[1, "u"].text.startswith("A story It goes") and got[1, "u"].n_chars == len(got[1, "u"].text)
    assert got[2, None].text == "" and got[2, None].n_chars == 0 and got[None, "u"].text == ""
    assert extraction.extract(pages.limit(0), model).count() == 0


SENTENCES = {
    "de": "Am Morgen zog der Nebel über die Felder, und niemand im Dorf ahnte, was der Tag noch bringen würde. ",
    "fr": "Le matin, la brume couvrait les champs, et personne au village ne devinait ce que le jour apporterait. ",
    "es": "Por la mañana la niebla cubría los campos, y nadie en el pueblo sabía lo que traería el día. ",
    "en": "In the morning fog lay on the fields, and nobody in the village knew what the day would bring. ",
}


@pytest.mark.parametrize(
    ("language", "page"),
    [
        ("de", '<body><div class="kopfbereich"><a href=/>Zeitung</a></div><ul class="hauptnavigation"><li><a href=a>Politik</a><li><a href=b>Sport</a></ul><div class="artikel"><h1>Nebel</h1><p>{0}</p><p>{0}</p></div><div class="werbung">Jetzt kaufen!</div><div class="kommentare"><p>Schöner Text, danke dafür.</p></div><div class="fusszeile"><a href=i>Impressum</a></div></body>'),
        ("fr", '<body><div class="bandeau-cookies">Nous utilisons des cookies.</div><div class="menu-principal"><a href=a>Accueil</a> <a href=b>Sport</a></div><main><h1>Brume</h1><p>{0}</p><p>{0}</p></main><div class="commentaires"><p>Merci pour ce beau texte.</p></div><div class="pied-de-page"><a href=m>Mentions légales</a></div></body>'),
        ("es", '<body><div class="cabecera"><a href=/>Diario</a></div><div class="contenido"><h1>Niebla</h1><p>{0}</p><p>{0}</p></div><div class="publicidad">Compre ahora.</div><div class="pie">Todos los derechos reservados.</div></body>'),
        ("en", "<body><div><a href=/a>Home</a> <a href=/b>News</a></div><div><h1>Fog</h1><p>{0}</p><p>{0}</p></div><div>Copyright 2024</div></body>"),
        ("en", "<body><table><tr><td>Site</td></tr><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><h1>Fog</h1><p>{0}</p><p>{0}</p></td></tr><tr><td>&copy; 2024</td></tr></table></body>"),
    ],
)
def test_hand_written_pages(model, language, page):
    text = SENTENCES[language] * 3
    got = extraction.main_text(page.replace("{0}", text), model)
    title = {"de": "Nebel", "fr": "Brume", "es": "Niebla", "en": "Fog"}[language]
    one = " ".join(text.split())
    assert got == f"{title} {one} {one}"


def test_deep_and_long_pages_take_linear_time(model):
    import time

    n = 200_000
    for html in ("<div>" * n + "x", "<b>" * n + "x", "<svg>" * n + "x", "<p>" * n, "<select><option>" * n):
        began = time.perf_counter()
        parse(html)
        assert time.perf_counter() - began < 10
    article = "<article><h1>A story</h1>" + "<p>It goes like this, and then on. </p>" * 40_000 + "</article>"
    assert len(article) > 1 << 20
    assert extraction.main_text(article, model).count("It goes like this") == 40_000


def test_the_pages_table_keeps_articles_and_drops_the_rest(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = extraction.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        start = r.html.find("<article")
        if start >= 0:
            inside = " ".join(t for t in parse(r.html[start : r.html.find("</article>", start)]).text if t)
            assert {*r.text.split()} <= {*inside.split()} and len(r.text) > 0.5 * len(inside)
