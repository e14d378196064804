"""Line-block extraction: what the windows choose by themselves, and odd markup."""

import re
import time
from collections import Counter

import pytest

from textscreen.llm import extract, queries as registered

SF = "/root/testdata/sf0.01"
PARAGRAPHS = [f"Paragraph {i} of the article is long enough to make the windows surge, whatever the markup around it may say of it." for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(PARAGRAPHS)
NAV = "<nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>All our news of the day</a></li></ul></nav>"
NOTE = "<div class=\"cookie-banner\">We use cookies to make this page better for you and for all of our many kind partners and friends, of course.</div>"
REPLY = "<div class=comments><p>This is a reader's comment that is quite as long as the article's paragraphs are, and it has a lot to say, too.</p></div>"


def article_lines(page):
    """The blocks of the page's article, one by one, by its plain structure."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    found = [" ".join(__import__("html").unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li|br|div)\b[^>]*>", inner)]
    return [x for x in found if x]


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r["html"]]


def test_windows_alone_find_the_article(pages):
    same = wrong = 0
    for page in pages:
        got, want = extract.main_text(page, marked=False).split("\n"), article_lines(page)
        same += 2 * sum((Counter(got) & Counter(want)).values())
        wrong += len(got) + len(want)
    assert same / wrong >= 0.9


def test_query_gives_the_article(spark, pages):
    rows = registered.QUERIES["op3_line_block_text"](spark, SF).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows:
        want = "\n".join(article_lines(html[r["page_id"]])) if html[r["page_id"]] else ""
        assert r["text"] == want and r["n_chars"] == len(want)
    assert len(rows) == len(html)


@pytest.mark.parametrize("before,after", [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class='layout no-sidebar'>", "</div>"),
    ("<div class='post comments-open'>", "</div>"), ("<div class=content>", "</div>"),
])
def test_wrappers(before, after):
    assert extract.main_text(f"<html><body>{NAV}{NOTE}{before}{BODY}{after}<footer>Imprint and contact</footer></body></html>") == TEXT


@pytest.mark.parametrize("before,after", [("<div class=sidebar>", "</div>"), ("<section id=comments>", "</section>")])
def test_a_name_that_holds_all_text_says_nothing(before, after):
    assert extract.main_text(f"<html><body>{NAV}{before}{BODY}{after}<footer>Imprint and contact</footer></body></html>") == TEXT


def test_comments_and_notices_go():
    assert extract.main_text(f"{NAV}{NOTE}<article><h1>A title</h1>{BODY}</article>{REPLY}") == f"A title\n{TEXT}"
    assert extract.main_text(f"{NAV}{NOTE}<div><h1>A title</h1>{BODY}</div>{REPLY}<footer>x</footer>") == f"A title\n{TEXT}"
    assert extract.main_text(f"<article><p>Short.</p></article>{REPLY}") == "Short."
    assert extract.main_text(f"<article><header class=entry-header><h1>A title</h1></header>{BODY}{REPLY}<p>End.</p></article>") == f"A title\n{TEXT}\nEnd."


@pytest.mark.parametrize("odd", [
    "<svg/>", "<svg><path d='M0'/></svg>", "<svg><text>Label</text></svg>", "<datalist id=x><option>one<option>two</datalist>", "<select><option>a</option></select>",
    "<script>if (a < b) { '</p>' }</script>", "<style>p { margin: 0 }</style>", "<!-- <p>no</p> -->", "<template><p>no</p></template>", "</p></div></section>", "<br><hr><img src=x alt='a > b'>",
])
def test_odd_markup_swallows_nothing(odd):
    half = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:2]), "".join(f"<p>{p}</p>" for p in PARAGRAPHS[2:])
    assert extract.main_text(f"<article>{half[0]}{odd}{half[1]}</article>") == TEXT


def test_references_and_white_space():
    assert extract.main_text("<article><p>A &amp;\n\t b&nbsp;&lt;c&gt; &#233;&#x1F600;</p></article>") == "A & b <c> é😀"


def test_no_text():
    for page in (None, "", "  \n ", "<p", "<article></article>", "<nav><a href=x>Home</a></nav>", "<script>x"):
        assert extract.main_text(page) == ""
    assert extract.main_text("just text") == "just text"


def test_deep_and_very_long_pages():
    start = time.time()
    deep = "<div>" * 20_000 + BODY + "</span></div>" * 20_000
    assert extract.main_text(deep) == TEXT
    assert extract.main_text("<b>" * 20_000 + BODY + "</i>" * 20_000) == TEXT
    assert extract.main_text(BODY * 5_000) == "\n".join([TEXT] * 5_000)
    assert extract.main_text("<svg>" * 20_000 + BODY) == ""
    assert time.time() - start < 20


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(1, f"<article>{BODY}</article>", "x", 5), (1, f"<article>{BODY}</article>", "x", 5), (2, None, None, None)], "page_id int, html string, text string, MAIN int")
    got = extract.extract(df)
    assert [c.lower() for c in got.columns] == ["page_id", "html", "text", "main"]
    assert sorted((r["page_id"], r["main"]["text"], r["text"]) for r in got.collect()) == [(1, TEXT, "x")] * 2 + [(2, "", None)]
    assert extract.extract(df.limit(0)).count() == 0
