from corpusloom.operators import html


def test_all_blocks_of_a_page_with_an_article(spark):
    """Short paragraphs, headings, list items and everything after the 80th; without an article, the first 80 long paragraphs."""
    long = "".join(f"<p>{'long text ' * 5}{i}</p>" for i in range(90))
    page = f"<html><body><article><h2 class='a'>Short <b>head</b></h2><p>Tiny.</p><p> </p><ul><li>one<li><p>two</p></li></ul><link rel='x'><pre>no</pre>{long}</article><p>After</p></body></html>"
    pages = spark.createDataFrame([(1, page), (2, f"<body><p>Tiny.</p>{long}</body>"), (3, "<article>bare</article><p>x</p>"), (4, "<article></article>")], "page_id int, html string")
    got = {r.page_id: r.text.split("\n") for r in html.articles(pages).collect()}
    paragraphs = [f"{'long text ' * 5}{i}" for i in range(90)]
    assert got == {1: ["Short head", "Tiny.", "one", "two", *paragraphs, "After"], 2: paragraphs[:80], 3: ["x"], 4: [""]}


def test_links_have_no_cap(spark):
    pages = spark.createDataFrame([(1, "".join(f"<a href='/x{i}'>x</a>" for i in range(350)))], "page_id int, html string")
    assert [r.href for r in html.links(pages, "page_id").orderBy("pos").collect()] == [f"/x{i}" for i in range(350)]
