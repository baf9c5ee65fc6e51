"""Templates against a plain twin, the parser, and both ways of removal."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.llm import plain_html
from vellumspark.llm import html_templates as ht


def page(k, nav="<nav><ul><li>Home</li><li>News</li></ul></nav>", foot="<footer>&copy; us</footer>"):
    return f"<html><head><title>t{k}</title></head><body>{nav}<p>Own text {k} <b>bold {k}</b></p>{foot}</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://A.example/{k}", page(k)) for k in range(20)] + [(100 + k, f"https://user@b.example:8080/x{k}", page(k, foot=f"<footer>{k}</footer>")) for k in range(5)]
    rows += [(200, None, page(1)), (201, "nonsense", page(1)), (202, "http://a.example/z", None), (203, "http://a.example/z", ""), (None, "http://a.example/n", page(300)), (0, "http://a.example/0", page(0))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return sorted((str(r.page_id), r.host, r.text, r.n_removed) for r in df.collect())


def test_templates_go_and_content_stays(pages):
    got = {r.page_id: r for r in ht.extract(pages, min_pages=8).collect()}
    assert got[3].text == "Own text 3 bold 3" and got[3].n_removed == 2 and got[3].host == "a.example"
    assert got[102].text == "Home\nNews\nOwn text 2 bold 2\n2" and got[102].n_removed == 0
    assert got[200].text.startswith("Home") and got[201].host == ""
    assert got[202].text == got[203].text == "" and got[None].text == "Own text 300 bold 300"
    few = {r.page_id: r for r in ht.extract(pages, min_pages=4).collect()}
    assert few[102].text == "Own text 2 bold 2\n2"
    # a share that no subtree reaches keeps all
    assert {r.n_removed for r in ht.extract(pages, min_pages=2, min_share=1.01).collect()} == {0}


def test_both_ways_agree(pages):
    assert texts(ht.extract(pages, min_pages=4)) == texts(ht.extract(pages, min_pages=4, broadcast_templates=0))


@pytest.mark.parametrize(("min_pages", "min_share"), [(3, 0.1), (2, 0.0), (5, 0.3)])
def test_pages_are_the_plain_twin(spark, pages, min_pages, min_share):
    for df in (pages, spark.read.parquet("/root/testdata/sf0.01/pages.parquet")):
        want = plain_html.slow_extract([tuple(r) for r in df.select("page_id", "url", "html").collect()], min_pages, min_share)
        assert texts(ht.extract(df, min_pages, min_share)) == want


def fuzz(rng):
    tags = "p div b a ul li table tr td script br hr span nav h1 dl dt dd button textarea head".split()
    odd = ["x", "word ", " &amp; ", "<!-- c -->", "<", "<!-- open", "<![CDATA[q]]>", '"', "<a href='x", "\n", "\0"]
    out = ""
    for _ in range(rng.randint(1, 25)):
        k, t = rng.random(), rng.choice(tags)
        out += f"<{t}>" if k < 0.45 else f"</{t}>" if k < 0.75 else rng.choice(odd)
    return out


def test_broken_pages_are_the_plain_twin():
    import numpy as np

    rng = random.Random(3)
    for _ in range(1500):
        page = fuzz(rng)
        root, _ = plain_html.parse(page)
        nodes, todo = [], [root]
        while todo:
            node = todo.pop()
            nodes.append(node)
            todo += [x for x in reversed(node.parts[1:]) if isinstance(x, plain_html.Node)]
        made = ht.parse(page)
        assert made.tag == [n.tag for n in nodes]
        gone = np.array([False, *(rng.random() < 0.3 for _ in nodes[1:])])
        text, n = ht.text_of(ht.unpacked(*ht.packed(made)), gone)
        slow, m = plain_html.text_of(root, {id(x) for x, g in zip(nodes, gone, strict=True) if g})
        assert (text, n) == (slow.replace("\0", "\ufffd"), m), page
        same = {}
        for node, digest in zip(nodes[1:], made.digest[1:], strict=True):
            assert same.setdefault(digest, node.same) == node.same


def test_parsing_takes_time_in_proportion():
    def took(page):
        began = time.thread_time()
        ht.text_of(ht.parse(page))
        return time.thread_time() - began

    for shape in ("<div>", "<p><button><div></b>", "<a ", "<!x ", "<table><tr><td><p>", "</div>x", "<script>", "<ul><li>", '<a ">'):
        one, four = (min(took(shape * n) for _ in range(3)) for n in (10_000, 40_000))
        assert four < 9 * max(one, 0.005), shape


def test_a_page_crawled_again_is_one_page(spark):
    """Rows of one payload, and of one url with changes, on a host that has nothing else in common."""
    article = "<body><h1>Head</h1><p>The whole article.</p>{}</body>"
    rows = [(k, "http://g.example/one", article.format("")) for k in range(8)]
    rows += [(100 + k, f"http://h.example/{k}", article.format("")) for k in range(8)]
    rows += [(200 + k, "http://i.example/one", article.format(f"<i>seen {k} times</i>")) for k in range(8)]
    got = {r.page_id: r for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(r.text.startswith("Head\nThe whole article.") and not r.n_removed for r in got.values()) and len(got) == 24


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("a<br>b<!-- x > y -->c", "a\nbc"),
        ("<script>var t='</p>';</script>x<style>p{}</style>", "x"),
        ("&lt;b&gt; &amp;amp; &eacute;", "<b> &amp; é"),
        ('<a title="x>y">z</a>', "z"),
        ("<p>open <b>never", "open never"),
        ("</div></p>stray", "stray"),
        ("a < b and 3<4", "a < b and 3<4"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<script>unclosed", ""),
        ("<![CDATA[raw]]> <?php x ?>y", "raw y"),
        ("", ""),
    ],
)
def test_text(html, text):
    assert ht.text_of(ht.parse(html))[0] == text


def test_deep_pages():
    page = ht.parse("<div>" * 20_000 + "x")
    assert len(page.tag) == 20_001 and ht.text_of(page)[0] == "x"


def test_hash_sees_structure():
    h = lambda s: ht.parse(s).digest[1]
    assert h("<p>a  b</p>") == h("<p>a\nb</p>") and h("<p>a</p>") != h("<div>a</div>")
    assert h("<p>a<b>c</b></p>") != h("<p>ac</p>") and h("<p class=x>a</p>") != h("<p>a</p>")


def test_empty_and_crowded(pages):
    assert ht.extract(pages.where("false")).count() == 0
    wide = pages.withColumns({c: F.lit("z") for c in ("host", "key", "row", "n", "text")})
    wide = wide.toDF(*[*wide.columns[:-1], "Html"])
    assert texts(ht.extract(wide)) == texts(ht.extract(pages))


def test_copies_running_text_and_small_hosts(spark):
    link = '<a href="/x">word</a>'
    rows = [(k, f"http://c.example/{k}", f"<body><nav>{link}</nav><p>First {k}<br>it is {link} <b>not</b> so {k}</p></body>") for k in range(10)]
    rows += [(100 + k, f"http://d.example/{k}", "<body><p>One article.</p></body>") for k in range(20)]
    rows += [(200 + k, f"http://e.example/{k}", f"<body><nav>Home</nav><p>Text {k}</p></body>") for k in range(3)]
    rows += [(300 + k, f"http://f.example/{k}", f"<body><p>{'Told on some' if k < 8 else f'Own {k}'}</p><p>Text {k}</p></body>") for k in range(400)]
    got = {r.page_id: r for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4].text == "First 4\nit is word not so 4" and got[4].n_removed == 1
    assert got[105].text == "One article." and got[201].text == "Text 1"
    assert got[302].text == "Told on some\nText 2"
