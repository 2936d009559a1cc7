import numpy as np
import pytest

from wavecut.llm import html_extract as H
from wavecut.llm import queries

SF = "/root/testdata/sf0.001"


def by_article(source):
    """Text of the article element, by a plain reading of these pages."""
    import html
    import re

    inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    blocks = re.split(r"</?(?:p|h1|article|footer|body|html)\b[^>]*>", inner[1])
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def trees(spark):
    return H.fit(spark.read.parquet(f"{SF}/pages.parquet"), max_pages=120)


def test_op1_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op1_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != by_article(pages[r.page_id].html)]
    assert len(wrong) <= 0.02 * len(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


LONG = "The old harbour was quiet in the morning, and the boats had not yet left. People walked along the quay and talked of the weather. "
UNSEEN = """<html><head><title>T</title><script>if (a < b) { x("</p>") }</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-banner"><p>We use cookies on this site.</p></div>
<article><h1>A &amp; B</h1><p>{0}</p><p>Second&nbsp;part:
   {0}</p><div class="advert">Buy now!</div><ul><li>{0}<li>{0}</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">One more story</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked it. {0}</p></div></section>
<form action="/s"><label>Search</label><input name="q"></form>
<footer><p>&copy; 2024 Site</p></footer></body></html>""".replace("{0}", LONG)
DIVS = UNSEEN.replace("<article>", '<div class="post-content">').replace("</article>", "</div>").replace("<nav>", '<div id="menu">').replace("</nav>", "</div>")


@pytest.mark.parametrize("source", [UNSEEN, DIVS])
def test_unseen_layouts(trees, source):
    line = LONG.strip()
    assert H.main_text([source], trees)[0] == "\n".join(["A & B", line, f"Second part: {line}", line, line])


def test_parser():
    page = H.parse("<p>a<b>b</b> &lt;c<br>d<p>e<!-- <p>no --><ul><li>f<li>g</ul>tail<script>x<p></script><div>h<p>i")
    assert [t for _, t, _ in page.blocks] == ["ab <c d", "e", "f", "g", "tail", "h", "i"]
    assert [t for _, t, _ in H.parse("").blocks] == []
    assert [t for _, t, _ in H.parse("a < b &am &amp c").blocks] == ["a < b &am & c"]
    assert [t for _, t, _ in H.parse("<div class=\"x>y</div>z").blocks][-1:] != []
    deep = H.parse("<div>" * 3000 + "x" + "</div>" * 3000)
    assert len(deep.tag) == 3001 and H.features(deep).shape[0] == 3001 and H.decode(deep.parent, np.ones(3001)).all()


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = 8
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        p = rng.random(n)
        best, want = -np.inf, None
        for bits in range(1 << (n - 1)):
            keep = np.array([True, *((bits >> i) & 1 == 1 for i in range(n - 1))])
            if all(keep[parent[i]] or not keep[i] for i in range(1, n)):
                score = np.log(np.where(keep, p, 1 - p))[1:].sum()
                if score > best:
                    best, want = score, keep
        assert (H.decode(parent, p) == want).all()


def test_trees_read_as_fitted(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] < 0.3)).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x.tolist(), y)], ["label", "features"])
    model = GBTClassifier(maxIter=6, maxDepth=4, seed=1).fit(df)
    want = [r.probability[1] for r in model.transform(df).collect()]
    assert np.allclose(H.read_trees(model).probability(x), want)


def test_odd_rows(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "u", UNSEEN), (3, "u", UNSEEN), (3, "u", UNSEEN), (4, "u", "<p>" * 20000 + "x"), (5, "u", "no markup")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract(pages, trees).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2)} == {1: "", 2: ""}
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract(pages.where("false"), trees).count() == 0
    assert H.fit(pages.where("page_id = 5")) is None
    assert H.extract(pages.where("page_id = 5"), None).first().text == "no markup"


@pytest.mark.parametrize("tag", ["button", "noscript", "select", "svg", "iframe"])
def test_unclosed_elements_do_not_swallow_the_page(tag):
    page = H.parse(f"<body><p>a para</p><{tag}>x<p>the rest of the page</p><p>and its end</p></body>")
    said = [t for _, t, _ in page.blocks]
    assert said[0] == "a para" and said[-2:] == ["the rest of the page", "and its end"]
    closed = H.parse(f"<body><p>a para</p><{tag}>x<p>inside</p></{tag}><p>after</p></body>")
    assert [t for _, t, _ in closed.blocks] == ["a para", "after"]
    assert [t for _, t, _ in H.parse("<p>a</p><script>if (x) { <p>b</p>").blocks] == ["a"]


def test_text_directly_in_the_body(trees):
    line = LONG.strip()
    menu = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
    foot = "<footer><p>&copy; 2024 Site</p></footer>"
    page = f"<html><body>{menu}{line}<p>{line} Two.</p>{line}<br><br><b>{line}</b> Three.{foot}</body></html>"
    assert H.main_text([page], trees) == ["\n".join([line, f"{line} Two.", f"{line} {line} Three."])]
    assert H.main_text([f"{line}<br>{line}"], trees) == [f"{line} {line}"]
    # beside an article, text in the body belongs to the surroundings
    assert H.main_text([UNSEEN.replace("<header>", "You are here<header>")], trees) == H.main_text([UNSEEN], trees)


@pytest.mark.parametrize("mark", ['class="advert"', "hidden", 'style="display: none"', 'class="ad-box"'])
def test_inline_elements_that_do_not_belong(trees, mark):
    line = LONG.strip()
    page = f'<article><p>{line} <span {mark}>Buy <span>this</span> now</span> And <b class="strong">so</b> on &amp;c.</p><p>{line}</p></article>'
    assert H.main_text([page], trees) == [f"{line} And so on &c.\n{line}"]
    unclosed = f"<article><p>{line} <span {mark}>Buy this</p><p>{line}</p></article>"
    assert H.main_text([unclosed], trees) == [f"{line}\n{line}"]
    around = f"<article><p>{line}</p><a {mark}><div>Buy this</div></a><p>{line}</p></article>"
    assert H.main_text([around], trees) == [f"{line}\n{line}"]


def test_inline_nodes_lose_no_text():
    """Without trees, the text equals that of the same page without inline marks."""
    rng = np.random.default_rng(8)
    parts = ["a ", "b", "<p>", "</p>", "<div>", "</div>", "<span M>", "<i M>", "<span>", "</span>", "</i>", "<br>", "&am", "p;", "<a M>", "</a>", "<ul><li>", "</ul>"]
    for _ in range(400):
        page = "".join(parts[i] for i in rng.integers(0, len(parts), 40))
        marked, plain = page.replace("M", "hidden"), page.replace("M", "")
        assert H.main_text([marked], None) == H.main_text([plain], None)
        tree = H.parse(marked)
        assert all(p < i for i, p in enumerate(tree.parent))
