"""Pages whose story stands in several parts."""

import time

from motionlake.llm import html_extraction


def test_all_article_parts_are_kept():
    page = "<body><nav>menu</nav><article><h1>Title</h1><p>First part</p></article><div>between</div><article><p>Second and longer part</p></article><aside>s</aside></body>"
    assert html_extraction.extract(page) == "Title\n\nFirst part\n\nSecond and longer part"
    body = "<body><h2>Menu</h2><div itemprop=articleBody>one</div><div itemprop=articleBody>two, longer</div></body>"
    assert html_extraction.extract(body) == "one\n\ntwo, longer"


def test_main_keeps_title_and_lead_beside_its_article():
    page = "<body><main><h1>Title</h1><p>Lead</p><article><p>The story itself</p></article><nav>menu</nav></main><footer>f</footer></body>"
    assert html_extraction.extract(page) == "Title\n\nLead\n\nThe story itself"


WORDS = "amber basin cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean pine quarry ridge shore tidal upland valley".split()


def story(k: int, n: int) -> str:
    return " ".join(WORDS[(k * 7 + i * i) % len(WORDS)] for i in range(n))


def meaningless(k: int) -> str:
    """No article, no main, no telling names: constant blocks around what varies."""
    body = f"<h1>{story(k, 4)} {k}</h1><p>{story(k + 1, 40)}</p><p>Read on below</p><h2>{story(k + 2, 3)}</h2><p>{story(k + 3, 30)}</p>"
    return f"<body><div class=a><div>Home</div><div>About us</div></div><div class=b><div class=q>{body}</div><div class=r>Buy our things now</div></div><div class=c><p>All rights reserved</p></div></body>"


def expected(k: int) -> str:
    return "\n\n".join([f"{story(k, 4)} {k}", story(k + 1, 40), story(k + 2, 3), story(k + 3, 30)])


def test_the_wrapper_decides_without_names(spark):
    """More pages of a host than any sample of six, dealt over tasks; a host of one page is read whole."""
    rows = [(k, f"http://plain.example/{k}", meaningless(k)) for k in range(40)] + [(99, "http://single.example/", meaningless(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html_extraction.extract_pages(pages).collect()}
    assert all(got[k] == expected(k) for k in range(40))
    assert "About us" in got[99] and "All rights reserved" in got[99]


def test_the_wrapper_outranks_a_teaser_article(spark):
    """Every page has an article element, but it is a constant teaser; the story stands in a plain element."""
    rows = [(k, f"http://t.example/{k}", meaningless(k).replace("Buy our things now", "<article><p>Buy our things now, they are very good</p></article>")) for k in range(12)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == expected(k) for k in range(12))


def test_blocks_of_the_tables_are_clean(spark, small_dir):
    """Blocks are trimmed, hold single spaces and are joined by one empty line."""
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    texts = [r.text for r in html_extraction.extract_pages(pages).collect()]
    assert all("\n\n\n" not in t and t == t.strip() and "  " not in t for t in texts)


def test_deep_articles_and_unclosed_elements():
    deep = "<body><article>" + "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "</article></body>"
    assert html_extraction.extract(deep) == "deep" and html_extraction.extract(deep, "body>article") == "deep"
    began = time.perf_counter()
    for tag in ("b", "i"):
        assert html_extraction.extract("<b>" * 40_000 + "text" + f"</p></{tag}>" * 40_000) == "text"
    assert time.perf_counter() - began < 10


def test_names_count_as_a_whole():
    """Words of the lists inside other names keep their text; whole names of them go."""
    page = '<body><article><h1>T</h1><section class="related-work"><p>Earlier work</p></section><div id="search-engines"><p>Engines</p></div><div class="relatedLinks"><p>no</p></div><div class="x comments-area"><p>no</p></div><p>End</p></article></body>'
    assert html_extraction.extract(page) == "T\n\nEarlier work\n\nEngines\n\nEnd"
