import pytest
from texts import passage

from tabloom.llm import html_text


def page(article, before="", after="", tag="article", head=""):
    return (
        f"<!DOCTYPE html><html><head><title>T words here</title><style>p{{x:y}}</style><script>var t='</p>';</script>{head}</head><body>"
        f"<nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>News</a></li></ul></nav>{before}<{tag}>{article}</{tag}>{after}"
        f"<footer>&copy; someone &middot; {passage(2, 9)}</footer></body></html>"
    )


@pytest.fixture(scope="module")
def weights(spark):
    rows = [(i, page(f"<h1>{passage(i, 5)}</h1>" + "".join(f"<p>{passage(10 * i + k, 30)}</p>" for k in range(3)), f"<div class='ad'>{passage(i, 8)}</div>")) for i in range(40)]
    return html_text.learn(spark.createDataFrame(rows, "page_id long, html string"))


CASES = [
    ("<h1>Title of it</h1><p>One  two\n three.</p><p>Four &amp; five &lt;six&gt;</p>", "Title of it\nOne two three.\nFour & five <six>"),
    ("<h1>Open tags</h1><p><b>one two<br><p>three four<p>five", "Open tags\none two\nthree four\nfive"),
    ("<h1>Title of it</h1><p>A <i>nice</i> <a href=x>link</a>ed text of words.</p><aside>not this at all</aside><p>More of the text.</p>", "Title of it\nA nice linked text of words.\nMore of the text."),
    ("<h1>Title of it</h1><form>name <input></form><p>Words of the text are here.</p><div class='comments'>reader says no</div>", "Title of it\nWords of the text are here."),
    ("<header class='entry-header'><h1>Title of it</h1></header><ul>" + "<li>one item of it</li>" * 40 + "</ul><p>The end of it all.</p>", "Title of it" + "\none item of it" * 40 + "\nThe end of it all."),
    ("<h1>日本語 título</h1><p>größe &eacute;lan&nbsp;señor 🙂</p><script>not(this)</script>", "日本語 título\ngröße élan señor 🙂"),
]


@pytest.mark.parametrize("article, text", CASES)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_regions(weights, article, text, tag):
    for before in ("", "<div class=ad>buy this now for little money</div>", "<header>Site name of it</header><!-- <p>no</p> -->", "<div id=site-header>Name of the site</div>"):
        if tag != "article" and "<header" in article:
            continue  # a header outside of an article is the site's
        assert html_text.extract(page(article, before, tag=tag), weights) == text


def test_without_labelled_pages(spark):
    plain = html_text.learn(spark.createDataFrame([], "page_id long, html string"))
    article, text = CASES[0]
    assert html_text.extract(page(article), plain) == text


def test_edge_pages(spark, weights):
    cut = page(CASES[0][0])[:-30]
    rows = [(1, None, "u"), (2, "", "u"), (3, "   ", None), (4, "<nav>only a menu</nav>", "u"), (5, "<p", "u"), (6, "plain words without tags", "u"), (7, "<" * 500, "u"), (9, "<p title=it's>one two three</p><p>four five", "u"), (8, cut, "u"), (8, cut, "u"), (None, page("<p>" + passage(3, 40000)), "u")]
    df = html_text.main_text(spark.createDataFrame(rows, "page_id long, html string, url string"), weights)
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    got = df.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert [by[i] for i in (1, 2, 3, 4)] == [""] * 4
    assert by[9] == "one two three\nfour five"
    assert by[6] == "plain words without tags" and by[8] == CASES[0][1] and by[None] == passage(3, 40000)
    assert html_text.main_text(spark.createDataFrame([], "page_id long, html string"), weights).collect() == []
    with pytest.raises(ValueError, match="names of results"):
        html_text.main_text(spark.createDataFrame([], "page_id long, html string, text string"), weights)


BODY = f"<h1>Title of it</h1><p>{passage(71, 60)}</p><p>{passage(72, 50)}</p>"
TEXT = f"Title of it\n{passage(71, 60)}\n{passage(72, 50)}"
AROUND = [
    "div class='content with-sidebar'", "div class='layout has-sidebar'", "div class='content-area no-sidebar'", "div class='post no-comments'", "div class='post comments-open'",
    "div class='article-body ad-free'", "div class=page-menu-open", "div class=sidebar-layout", "div class=widget", "form id=aspnetForm", "aside", "div class='page fixed-header'", "div class=header-wrap",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_of_what_is_around_the_article(weights, around, tag):
    if around == "aside" and tag == "div":
        return  # nothing tells it from an aside
    html = page(BODY, f"<{around}>", f"</{around.split()[0]}><div class=comments><p>{passage(73, 20)}</p></div><div class=related-posts><p>{passage(74, 15)}</p></div>", tag=tag)
    assert html_text.extract(html, weights) == TEXT


@pytest.mark.parametrize("inner", ["section id=related-work", "section id=navigation", "div id=tags", "p class=notice", "h2 id=navigation", "xmp", "math"])
def test_names_inside_of_an_article(weights, inner):
    html = page(f"{BODY}<{inner}>{passage(75, 12)}</{inner.split()[0]}><p>{passage(76, 30)}</p>")
    assert html_text.extract(html, weights).replace("\n", " ") == f"{TEXT}\n{passage(75, 12)} {passage(76, 30)}".replace("\n", " ")


def test_comments_longer_than_the_article(weights):
    comments = "<div class=comments>" + "".join(f"<p>{passage(80 + i, 60)}</p>" for i in range(6)) + "</div>"
    assert html_text.extract(page(BODY, after=comments), weights) == TEXT


def test_raw_text_of_xmp(weights):
    assert html_text.extract(page(f"{BODY}<xmp>a <b>bold</b> &amp; word</xmp><p>{passage(76, 30)}</p>"), weights) == f"{TEXT}\na <b>bold</b> &amp; word\n{passage(76, 30)}"


def test_unclosed_tags_take_linear_time():
    """100,000 tags that nothing closes, as deep as they are many."""
    import time

    for page in ("<div>" * 100_000 + "words", "<p>" + "<span>word <b>x " * 50_000):
        started = time.perf_counter()
        assert len(html_text.tokens(page)) > 100_000
        assert time.perf_counter() - started < 20
