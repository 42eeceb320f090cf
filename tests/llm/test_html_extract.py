import html
import re

import duckdb
import pytest
from framewright.llm import html_extract as he

PAGE = (
    "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><div id='menu'><a href=x>Home</a> <a>More</a></div>"
    "<div class='wrap'><h1>The  heading</h1><p>First paragraph, with commas, &eacute; and so on.</p><ul><li>one<li>two</ul>"
    "<div class='ad-box'>buy this now</div><form><p>Sign up, please, for the letter</p></form>"
    "<p>Second paragraph, which is<br>also long enough, really.</p></div>"
    "<div class='comments'><p>Great post, I like it, thank you very much for that.</p></div><footer>foot</footer></body></html>"
)


@pytest.mark.parametrize("page, text", [
    (PAGE, "The heading\nFirst paragraph, with commas, é and so on.\none\ntwo\nSecond paragraph, which is also long enough, really."),
    (None, ""), ("", ""), ("   ", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>one<p>two", "one\ntwo"), ("<p>cut <a hre", "cut"), ("text <!-- cut", "text"),
    ("a < b and c > d", "a < b and c > d"), ("<script>x</script>", ""), ("<table><tr><td>a<td>b</table>", "a\nb"), ("<p title='a>b'>q</p>", "q"),
    ("<nav>" * 3 + "<p>lost</p>", ""), ("<b>x</b>y", "xy"), ("&am", "&am"),
    ("<article><header><h1>Head</h1></header><p>Body.</p><section class='comments'><p>no</p></section><aside>no</aside></article><aside>no</aside>", "Head\nBody."),
])
def test_pages(page, text):
    assert he.main_text(page) == text


def test_deep_and_long_pages():
    assert he.main_text("<div>" * 20_000 + "deep") == "deep"
    long = "".join(f"<p>paragraph {i}, with, commas</p>" for i in range(20_000))
    assert he.main_text(long).count("\n") == 19_999


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in he.extract(pages).collect()}
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, page in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[page_id]["text"], got[page_id]["n_chars"]) == (want, len(want))


def test_frame_edges(spark):
    rows = [(1, "u", None, "t"), (None, None, "<p>x\U0001f600</p>", "t"), (2, "u", "", "t"), (2, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, text STRING")
    got = sorted((tuple(r) for r in he.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (None, None, "x\U0001f600", 2), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert he.extract(pages.where("false")).count() == 0


LONG = "This is a long paragraph, with commas, and it goes on for quite a while. " * 4
SHORT = "A second one, shorter, but real text all the same."


def test_pages_without_article():
    """Branches of other containers, bare text, inline elements and short paragraphs beside the best one stay; link lists go."""
    long = LONG.strip()
    got = he.main_text(f"<body><div><div><p>{LONG}</p></div></div><div><div><p>{SHORT}</p></div></div></body>")
    assert got == f"{long}\n{SHORT}"
    page = (
        f"<body><nav>top</nav><div><div id=b><p>{LONG}</p><p>{LONG}</p></div>bare text <b>bold</b><div><p>short</p></div>"
        "<div><a href=x>one</a> <a>two</a></div></div><div class=footer>foot</div></body>"
    )
    assert he.main_text(page) == f"{long}\n{long}\nbare text bold\nshort"
    page = f"<html><body><ul><li><a href=1>Home page of the site</a></li><li><a>Another long link text</a></li></ul><div><p>{LONG}</p></div><div><p>{SHORT}</p></div></body></html>"
    assert he.main_text(page) == f"{long}\n{SHORT}"
    deep = "<div>" * 50_000 + f"<p>{LONG}</p>" + "</div>" * 50_000 + f"<div><p>{SHORT}</p></div>" * 500
    assert he.main_text(deep).count("\n") == 500
