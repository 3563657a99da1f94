"""Stored-HTML jobs on literal pages: selector cascade, listings."""

from postlens.operators import pages as PG


def accept(n):
    return lambda t: sum(c.isascii() and c.isalpha() for c in t) >= n


LONG = "words enough for the rule to take this text as the main one of the page"


def test_first_accepted_selector_wins():
    html = f"<body><main>short</main><div class='x content'>{LONG}</div><article>tiny</article></body>"
    assert PG.main_text(html, "general", accept(50)) == ("div.content", LONG)


def test_body_is_the_last_resort_where_the_class_has_one():
    html = f"<body>{LONG}</body>"
    assert PG.main_text(html, "general", accept(50)) == ("body", LONG)
    assert PG.main_text(html, "naver_cafe", accept(50)) == ("body", LONG)
    assert PG.main_text(html, "naver_news", accept(50)) == (None, None)


def test_id_selectors_and_left_out_links():
    html = f"<div id=dic_area>{LONG}<a class='link_news'>more <b>news</b></a><script>x()</script> end</div>"
    assert PG.main_text(html, "naver_news", accept(50)) == ("div#dic_area", LONG + " end")


def test_unclosed_elements_and_empty_pages():
    html = f"<body><article><p><b>{LONG}<br><p>two<p>three</article>tail</body>"
    assert PG.main_text(html, "general", accept(50)) == ("article", LONG + " two three")
    for empty in (None, "", "<html></html>", "<article>", "</div></p>"):
        assert PG.main_text(empty, "general", accept(1)) == (None, None)


def test_listing_rows():
    html = ("<ul><li><a class='sch_tit' href='/no'>not in the list</a></li></ul>"
            "<ul class='sch_result_list'>"
            "<li><a class='sch_tit' href='/1'>One <b>&amp;</b> more</a><span class='user_nick'>ann</span><i class='date'>2024.01.02</i>"
            "<li><a class='sch_tit' href='/2'>Two</a><ul><li>inner</li></ul></li>"
            "<li><a href='/3'>no title class</a></li>"
            "<li><a class='sch_tit'>no link</a></li>"
            "<li><table><tr><td class='notice'>!<td></tr></table><a class='sch_tit' href='/5'>notice</a></li>"
            "<li><a class='sch_tit' href='/6'>Six</a><span class='x user_nick'> </span></ul>"
            "<a class='sch_tit' href='/7'>outside</a>")
    assert PG.listing_rows(html, PG.BOARD_RESULTS) == [
        ("One & more", "/1", "ann", "2024.01.02"), ("Two", "/2", "Unknown", None), ("Six", "/6", "", None)]
    assert PG.listing_rows(None, PG.BOARD_RESULTS) == []


def test_jobs(spark):
    p = spark.createDataFrame([(1, f"<article>{LONG}</article>", "general"), (2, None, "naver_blog")],
                              "page_id long, html string, site_class string")
    got = {r["page_id"]: (r["selector"], r["text"]) for r in PG.parsed_main_text(p).collect()}
    assert got == {1: ("article", LONG), 2: (None, None)}
    assert PG.listing(p, PG.BOARD_RESULTS).collect() == []
