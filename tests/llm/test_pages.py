"""Main texts of pages: a plain reading of the tables' markup, site style trees, broken pages."""

import html
import re

import duckdb
import pytest

from spendloom.llm import op12_html as op


def plain(page):
    """The article of a page whose articles hold h1, p, b and br alone."""
    article = re.search(r"(?s)<article>(.*?)(</article>|$)", page).group(1)
    blocks = (html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))) for x in re.split("</?(?:p|h1)>", article))
    return "\n\n".join(filter(None, (re.sub(r"\s+", " ", b).strip() for b in blocks)))


def test_whole_table(spark, sf_dir):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op.op12_html(spark, sf_dir).collect()}
    want = duckdb.sql(f"SELECT page_id, url, html FROM '{sf_dir}/pages.parquet'").fetchall()
    assert got == {i: (url, plain(page), len(plain(page))) for i, url, page in want}


def site(spark, pages, host="site.example"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_style_tree_cuts_what_a_host_repeats(spark):
    pages = [
        f"<body><div class=x1>Welcome to our site</div><div class=x2><p>Story {i} tells of {i * 7}.</p><p>It <i>ends</i> after {i + 3} days.</p></div><div class=x3>All about us <a href=/>home</a></div></body>"
        for i in range(12)
    ]
    # Copies of one page say nothing of the others, and a host of few pages is not judged.
    docs = site(spark, pages + pages[:1] * 40).union(site(spark, pages[:3], "small.example"))
    got = {(r.url.split("/")[2], r.page_id): r.text for r in op.extract(docs).collect()}
    assert all(got["site.example", i] == f"Story {i} tells of {i * 7}.\n\nIt ends after {i + 3} days." for i in range(12))
    assert got["site.example", 30] == got["site.example", 0]
    assert got["small.example", 1] == "Welcome to our site\n\nStory 1 tells of 7.\n\nIt ends after 4 days.\n\nAll about us home"
    tree = {r.label: r for r in op.style_tree(docs).where("host = 'site.example'").collect()}
    assert tree["p"].pages == 12 and tree["p"].importance == pytest.approx(0.9 + 0.1 * tree["p"].presentation)
    assert tree["div.x1"].importance == 0 and tree["div.x1"].parent == tree["body"].node


def test_entropy_of_presentations(spark):
    pages = [f"<body><p>{'<i>a</i>' if i % 2 else '<b>b</b>'} {i}</p></body>" for i in range(16)]
    (p,) = op.style_tree(site(spark, pages)).where("label = 'p'").collect()
    # Two presentations of eight pages each: log(2) / log(16).
    assert p.presentation == pytest.approx(0.25) and p.content == 1


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><header><h1>T</h1></header><p>a&nbsp;b &lt;x&gt;<p>c<br>d<div class=ad>no</div><ul><li>one<li>two</ul><section id=comments><article><p>bad</p></article></section></article><footer>f</footer>", "T\n\na b <x>\n\nc d\n\none\n\ntwo"),
        ("<body class=has-sidebar><header>h</header><div class=siteSidebar>s</div><main><h1>T</h1><p>text <b>bold</b><form>f</form></main></body>", "T\n\ntext bold"),
        ("<div role=navigation>n</div><div class='entry-content'>e</div><div>other</div>", "e"),
        ("plain text &amp; more", "plain text & more"),
        ("<article><p>a</p>between<p>b</p><table><tr><td>1<td>2<tr><td>3</table></article>", "a\n\nbetween\n\nb\n\n1\n\n2\n\n3"),
        ("<article>cut &am", "cut &am"), ("<p>x</p><!-- y", "x"), ('<p>x</p><a href="b', "x"), ("<p>x</p></di", "x"), ("<p>a < b && c</p>", "a < b && c"), ("<script>abc", ""), ("", ""),
        ("<nav>a</nav>", ""), ("<p>&#128512;é</p>", "\U0001f600é"),
    ],
)
def test_pages(page, text):
    assert op.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<" * 50_000, "<p>x" * 50_000, "<b>" * 50_000 + "x" + "</i>" * 50_000, "<article>" + "<p>word &amp; word</p>\n" * 40_000])
def test_long_pages(page):
    assert op.main_text(page)


def test_edges(spark):
    rows = [(None, None, None), (1, None, "<article>a</article>"), (1, "no host", "<p>b</p>"), (2, "http://h.example/", None), (2, "http://h.example/", ""), (3, "http://h.example/", "<p>c</p>"), (3, "http://h.example/", "<p>c</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS host", "'mine' AS text", "'mine' AS low", "'mine' AS salt", "'mine' AS id", "'mine' AS node")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in op.extract(docs).collect())
    assert got == sorted([("None", "None", "", 0), ("1", "None", "a", 1), ("1", "no host", "b", 1), ("2", "http://h.example/", "", 0), ("2", "http://h.example/", "", 0), ("3", "http://h.example/", "c", 1), ("3", "http://h.example/", "c", 1)])
    assert op.extract(docs.limit(0)).collect() == []


def test_entropy_cuts_inside_an_article_too(spark):
    page = "<article><h1>Title {0}</h1><p>Text of page {0}.</p><div class=\"legal\">All rights reserved.</div></article>"
    pages = spark.createDataFrame([(i, f"http://one.example/{i}", page.format(i)) for i in range(6)] + [(9, "http://two.example/", page.format(9))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in op.extract(pages).collect()}
    assert got == {i: f"Title {i}\n\nText of page {i}." for i in range(6)} | {9: "Title 9\n\nText of page 9.\n\nAll rights reserved."}
