import html
import re

from recollect.llm import maintext as M


def test_held_out_pages():
    """Text pieces of generated pages with another seed."""
    trees, g = M.trained(), M.Generator(99)
    hit = wrong = total = 0
    for _ in range(60):
        page = g.page()
        text = M.main_texts([page], trees)[0]
        hit, wrong, total = hit + text.count(M._YES), wrong + text.count(M._NO), total + page.count(M._YES)
    assert hit / total > 0.97 and wrong / hit < 0.04


def test_no_contradictions():
    trees, g = M.trained(60, trees=10), M.Generator(3)
    for _ in range(20):
        page = M.Page(g.page())
        x, own = M.features(page, [t for _, t, _ in page.texts])
        keep = M.kept(page, trees(x), own)
        for k in range(1, len(keep)):
            p = page.parent[k]
            if keep[k] and page.tag[k] not in ("html", "body"):
                assert keep[p] or page.tag[p] in ("#", "html", "body")


def test_query_gives_the_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = M.op2_main_text(spark, sf).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]+>", " ", article)).split())
        assert r.n_chars == len(r.text)


def test_parts_that_are_left_out():
    article = "".join(f"<p>Here is a sentence of some length, number {i}, that belongs to the article.</p>" for i in range(6))
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><nav class=menu><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>
      <article><h1>A title</h1>{article}<div class="ad">Buy now &amp; save</div><script>x = "</p>"</script></article>
      <section id="comments"><h3>Comments</h3><div class=comment><p>First to comment here!</p></div></section>
      <form><label>Search</label><input></form><footer>&copy; all of us</footer></body></html>"""
    text = M.main_texts([page], M.trained())[0]
    assert "number 5" in text and "A title" in text
    for word in ("Home", "Buy", "First to comment", "Search", "all of us", "x ="):
        assert word not in text


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (3, "u", "<div><p>a<b>b</div></p></x>"), (4, "u", "<" * 50), (5, "u", '<a title="never closed'), (None, "u", "<p>&amp;&#x41;")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = M.extract(df).collect()
    assert len(out) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert M.extract(df.limit(0)).count() == 0


SHAPES = {
    "open tags": lambda n: "<a " * (n // 3), "open quotes": lambda n: '<a href="x ' * (n // 11), "end tags of another kind": lambda n: "<b>" * (n // 7) + "</x>" * (n // 7),
    "end tags without a beginning": lambda n: "<div>" * (n // 9) + "</p>" * (n // 9), "links around all": lambda n: "<a>" + "<div>" * (n // 5), "quotes across tags": lambda n: "<a \"b' >" * (n // 9),
    "ends below a boundary": lambda n: "<b><div>" + "<i>" * (n // 7) + "</b>" * (n // 7), "declarations": lambda n: "<!" * (n // 2), "comments": lambda n: "<!--" * (n // 4), "bodies": lambda n: "<head><body>" * (n // 12),
    "one quote at the end": lambda n: '<a ">' * (n // 5) + '"', "list items": lambda n: "<li>" * (n // 4), "text": lambda n: "word < word " * (n // 12),
}


def test_broken_markup_takes_time_in_proportion():
    """A megabyte of each shape, against an eighth of it; and no shape takes long."""
    import time

    for name, shape in SHAPES.items():
        took = []
        for n in (1 << 17, 1 << 20):
            text = shape(n)
            began = time.process_time()
            M.Page(text)
            took.append(time.process_time() - began)
        assert took[1] < 8 * 4 * max(took[0], 0.02) and took[1] < 15, (name, took)


def test_elements_end_where_they_should():
    p = M.Page("<div><p>a<p>b<b>c</div><p>d</i></p>e</div>")
    assert [(p.tag[k], t) for k, t, _ in p.texts if t.strip()] == [("p", "a"), ("p", "b"), ("p", "c"), ("p", "d"), ("#", "e")]
    p = M.Page('<ul><li>a<ul><li>b</ul><li>c</ul><a href="x>y">z</a> t')
    assert [(p.depth[k], t, link) for k, t, link in p.texts if t.strip()] == [(2, "a", False), (4, "b", False), (2, "c", False), (0, "z", True), (0, " t", False)]


def test_a_long_page(spark):
    body = "".join(f"<p>Here is sentence number {i}, of some length, which belongs to the article.</p>" for i in range(20_000))
    page = f"<html><body><nav><a href=/>Home</a></nav><article>{body}</article><footer>of all</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = M.extract(df).first().text
    assert text.startswith("Here is sentence number 0,") and "number 19999," in text and "of all" not in text
