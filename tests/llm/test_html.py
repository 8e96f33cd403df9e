import html as entities
import os
import re

import pytest

from quillframe.llm import html


@pytest.fixture(scope="module")
def model(spark, data):
    return html.fit(spark.read.parquet(f"{data}/pages.parquet"))


def test_pages_of_the_benchmark(spark, data, model):
    """There, the main text is the article's paragraphs and headings."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    out = {r.page_id: r for r in html.main_text(pages, model).collect()}
    for r in pages.collect():
        a, b = r.html.find("<article>"), r.html.find("</article>")
        body = r.html[a + 9 : b if b >= 0 else len(r.html)] if a >= 0 else ""
        parts = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub(r"</?b>|<[^>]*$", "", body))
        want = " ".join(x for x in (re.sub(r"\s+", " ", entities.unescape(p)).strip() for p in parts) if x)
        assert out[r.page_id].text == want and out[r.page_id].n_chars == len(want) and out[r.page_id].url == r.url


PARAGRAPH = "This is a long paragraph of the main text, with many words in it, and one more thing to say. "


@pytest.mark.parametrize(
    ("page", "kept", "dropped"),
    [
        (f"<body><nav><a href=/>Home</a></nav><main><h1>Title</h1><p>{PARAGRAPH * 3}</p></main><footer>Foot</footer>", ["Title", "long paragraph"], ["Home", "Foot"]),
        (f'<body><div id="menu"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id="content"><h1>Title</h1><p>{PARAGRAPH * 2}</p><p>{PARAGRAPH}</p></div><div class="ads">Buy</div>', ["Title", "long"], ["One", "Buy"]),
        (f'<article><p>{PARAGRAPH * 2}</p><ul><li>First point of it</li><li>Second point of it</li></ul><section class="comments"><p>Nice post, thanks!</p></section><form><p>Mail</p><input><button>Send</button></form></article>', ["long", "First point", "Second point"], ["Nice post", "Mail", "Send"]),
        (f"<article><p>{PARAGRAPH * 2}</p><aside><p>Another story.</p></aside><blockquote>{PARAGRAPH}</blockquote></article><div class='cookie-notice'>We use cookies.</div>", ["long"], ["Another story", "cookies"]),
    ],
)
def test_page_kinds(model, page, kept, dropped):
    text = html.extract(page, model)
    assert all(k in text for k in kept) and not any(d in text for d in dropped), text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9; d\n\t e</p><p>x<b>y</b>z<br>w</p></article>", "a&b <c> ééé d e xyz w"),
        ("<article><p>one<p>two<script>var a='</p>'</script><style>p{}</style><!-- no --> three</article>", "one two three"),
        ("<article><p>open <b>bold <i>text", "open bold text"),
        ("<article><p>cut off <a href='x", "cut off"),
        ("<article><p>a</p></div></span><p>b</p></article>", "a b"),
        ("<ARTICLE><P TITLE='a>b'>upper</P></ARTICLE>", "upper"),
    ],
)
def test_markup(model, page, text):
    nodes, blocks = html.parse(page)
    assert " ".join(t for _, t in blocks) == text


def test_decoding_never_contradicts_itself(model):
    import numpy as np

    r = np.random.default_rng(2)
    nodes, _ = html.parse("<div>" + "<div><p>a</p><section><p>b</p><div><p>c</p></div></section></div>" * 20 + "</div>")
    for _ in range(50):
        kept = html.decode(nodes, r.normal(0, 3, len(nodes)))
        assert all(n.parent is None or id(n.parent) in kept for n in nodes if id(n) in kept)


def test_odd_pages(spark, model):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 4), (2, "v", "no markup at all", 5), (None, "w", "<" * 50_000, 6), (5, "x", "<div>" * 20_000 + "deep", 7), (6, "y", "<a href=\"" * 3000, 8)], "page_id long, url string, html string, text int")
    rows = html.main_text(pages, model).collect()
    assert len(rows) == 6 and rows[0].text == "" and rows[0].n_chars == 0
    assert html.main_text(pages.limit(0), html.fit(pages.limit(0))).count() == 0
    assert os.path.exists(html.__file__)


def test_samples_keep_their_size_however_many_rows_there_are(spark):
    from pyspark.sql import functions as F

    from quillframe.llm.common import sampled

    rows = spark.range(400_000)
    for n in (10**9, 10**13):
        # Of 400,000 rows of a table of n, the share of a sample that n/400,000 such tables would make.
        got = rows.filter(sampled(F.xxhash64("id"), n, n // 1000)).count()
        assert 330 < got < 470
    assert rows.filter(sampled(F.xxhash64("id"), 10**9, 400)).count() <= 5
    assert rows.filter(sampled(F.xxhash64("id"), 100, 400)).count() == 400_000


def test_structure_alone_finds_the_articles(spark, data, monkeypatch):
    """Without the features that come from word and tag lists, the trees still find the text by shape and place."""
    whole = html.features

    def shape(nodes):
        out = whole(nodes)
        out[:, [0, 1, 2, 3, 4, 5, 6, 24, 25]] = 0
        return out

    monkeypatch.setattr(html, "features", shape)
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect()]
    import numpy as np

    rows = [np.column_stack([shape(html.parse(f)[0]), html.teach(html.parse(f)[0])]) for i, p in enumerate(pages[::2]) for f in html.variants(p, i * 7919)]
    rows = np.concatenate(rows)
    model = html.BoostedTrees(trees=50, depth=4, rate=0.25).fit(rows[:, :-1], rows[:, -1])
    right = 0
    for page in pages[1::2]:
        nodes, blocks = html.parse(page)
        inside = {id(n) for n in nodes if n.tag == "article"}
        for n in nodes:
            if n.parent is not None and id(n.parent) in inside:
                inside.add(id(n))
        right += html.extract(page, model) == " ".join(t for n, t in blocks if id(n) in inside)
    assert right >= 0.9 * len(pages[1::2])
