import random

import numpy as np
import pytest

from attestra.llm import quality, toxicity
from attestra.llm.html_text import html_text, main_text

from .conftest import words


def test_grammar_weighs_context():
    g = toxicity.Grammar({"=fool": 3.0, "idio": 4.0})
    plain, negated, reported, aimed = (g.measures(t)[1] for t in ("a fool here", "not a fool here", "he said a fool came", "you fool"))
    assert negated < plain < aimed and reported < plain
    assert g.measures("the idiots")[1] == 4.0 and g.measures("idio")[1] == 0.0 and g.measures("")[1] == 0.0
    assert g.measures("they burn it")[1] > 0 == g.measures("logs burn well")[1]  # a threat needs a target


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(500):
        toxic, grade = i % 4 == 0, i % 3
        text = words(rng, 60)
        if toxic:
            text += f". you are {rng.choice(['zorg', 'plonk', 'grolt'])} and zorgish"
        text = {0: text.upper() + "!! $$$", 1: text + " | | ###" * 3, 2: text}[grade]
        docs.append((i, text, "lang"))
        labels.append((i, grade, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, label string"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns(ws, labelled):
    docs, labels = labelled
    grammar = toxicity.fit(ws, docs, labels)
    rows = toxicity.toxicity(docs, grammar).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == toxicity.held_out(r.doc_id) for r in rows)
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_labels_are_not_used(ws, labelled, spark):
    from pyspark.sql import functions as F

    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    from attestra.llm.common import Workspace

    a, b = toxicity.fit(ws, docs, labels), toxicity.fit(Workspace(spark, "other"), docs, flipped)
    assert a.insults == b.insults and a.coefficients == b.coefficients


def test_models_without_labels(ws, odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    g = toxicity.fit(ws, odd, labels)
    rows = toxicity.toxicity(odd, g).collect()
    assert len(rows) == odd.count() and all(r.predicted == 0 for r in rows) and toxicity.toxicity(none, g).collect() == []
    m = quality.fit(ws, odd, labels)
    assert all(r.selected for r in quality.quality(odd, m).collect()) and quality.quality(none, m).collect() == []
    assert quality.selected_rows(odd, m).count() == odd.count()


def test_ordinal_regression_orders_grades(ws, labelled, odd):
    docs, labels = labelled
    model = quality.fit(ws, docs, labels)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    rows = [r for r in quality.quality(docs, model).collect() if toxicity.held_out(r.doc_id)]
    assert np.mean([abs(r.expected_grade - r.doc_id % 3) for r in rows]) < 0.5
    assert np.mean([r.selected == (r.doc_id % 3 == 2) for r in rows]) > 0.9
    got = quality.quality(odd, model).collect()
    assert len(got) == odd.count()
    kept = quality.selected_rows(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.selected for r in got)


def test_ordinal_gradient_matches_differences():
    rng = np.random.default_rng(0)
    rows = [(np.array([0, 1, 2]), rng.normal(size=3)) for _ in range(300)]
    y = [int(np.clip(round(r[1][0] * 1.5 + rng.logistic() * 0.3 + 1.5), 0, 3)) for r in rows]
    m = quality.fit_ordinal(rows, y, dimensions=4, steps=400, ridge=0, rate=0.1)
    assert m.weights[0] > 1 and abs(m.weights[1]) < 0.5 * m.weights[0] and (np.diff(m.thresholds) > 0).all()


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies for all that and more, do you agree with that?</div>%s<aside>Side</aside><form>Search<input></form>
<div id="comments"><p>A reader writes a long comment about all this, which is not the article.</p></div><footer>&copy; us</footer><script>var a="</p>"</script></body></html>"""
ARTICLE = "<h1>Head &amp; line</h1><p>First   long paragraph &eacute; of the\n article, with <b>bold</b> and <a href=y>linked</a> words.</p><p>Short.<p>Last one<br>after a break, long enough to count as text.</p>"
WANT = "Head & line\n\nFirst long paragraph é of the article, with bold and linked words.\n\nShort.\n\nLast one after a break, long enough to count as text."


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main><div class=ad>Buy now</div><div>%s</div></main>", "<div class=content><div>%s</div></div>", "%s"])
def test_main_text(around):
    assert main_text(PAGE % (around % ARTICLE)) == WANT


LONG = "<h2>Head</h2>" + "".join(f"<p>Paragraph {k} of an article that goes on and on with many words until it ends here.</p>" for k in range(3))


@pytest.mark.parametrize("page", [
    '<div class="search-results">%s</div>', '<div class="article-comments-enabled">%s</div>', '<div class="page related-page">%s</div>', '<div class="post share-story">%s</div>',
    '<div class="notice-board story">%s</div>', '<section id="banner-story">%s</section>', "<table><tr><td class=sidebar>Menu<td>%s</table>", "<ul><li class=related>x<li>%s</ul>",
    "<nav><a href=x>Menu</a>%s", "<form>%s</form>",
])
def test_names_do_not_hide_an_article(page):
    text = main_text(f"<html><body>{page % LONG}</body></html>")
    assert all(f"Paragraph {k} of an article" in text for k in range(3)) and "Head" in text


def test_clustering_decides():
    menu = "".join(f"<p><a href={k}><b>Go</b> <i>{k}</i></a></p>" for k in range(12))
    page = f"<html><body>{menu}{LONG}{menu}</body></html>"
    assert main_text(page) == "\n\n".join(["Head", *(f"Paragraph {k} of an article that goes on and on with many words until it ends here." for k in range(3))])


def test_text_beside_the_region_stays():
    a, b = ("".join(f"<p>{w} {k} is a paragraph of some length with words that say something about it all.</p>" for k in range(n)) for w, n in (("First", 30), ("Last", 1)))
    assert "Last 0" in main_text(f"<html><body><nav><a>x</a></nav><div><div>{a}</div><div>{b}</div></div><footer>us</footer></body></html>")


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    assert main_text("<div>some text" * 350_000).count("some text") == 350_000  # 5 MB
    assert time.time() - began < 60


@pytest.mark.parametrize("html", ["", " ", "<", "<p", "&amp", "<![CDATA[ x", "<div class=ad>only</div>", "<script>x", "</p></div>", "<p>" * 3000])
def test_any_markup_is_read(html):
    assert isinstance(main_text(html), str)


def test_html_rows(spark):
    rows = [(1, "u", PAGE % ARTICLE), (2, None, None), (None, "v", ""), (1, "u", PAGE % ARTICLE), (3, "w", "<p>" + "word " * 200_000)]
    got = html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == WANT for r in got) == 2
    assert next(r for r in got if r.page_id == 3).n_chars == 999_999
    assert html_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
