import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sitetree, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title {k}</h1></header><p>First  paragraph\n {k} with &amp; and &eacute;<br>break</p><aside>Related</aside><p>Second <b>bold{k}</b> text<form><input name="q"><button>Go</button></form></p>
<div class="comments"><p>A reader says no</p></div></article><div class="sidebar"><p>Links</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text_without_declared_noise():
    assert sitetree.main_text(PAGE.format(k=1), None) == "Title 1\n\nFirst paragraph 1 with & and é break\n\nSecond bold1 text"
    assert sitetree.main_text(None, None) == sitetree.main_text("", ["/x"]) == ""
    assert sitetree.main_text("<p>a<p>b < c<!-- x --><script>y</script", None).startswith("a\n\nb < c")
    assert sitetree.main_text("plain text", None) == "plain text"
    assert len(sitetree.main_text("<p>" + "word " * 200000, None)) == 999999


def test_shared_branches_are_removed_by_entropy(spark):
    page = "<html><body><div class='x1'><p>Same words on every page</p></div><div class='y'><p>Own text {k}</p><p>More {k}</p></div></body></html>"
    rows = [(k, f"http://h{k % 2}.org/{k}", page.format(k=k)) for k in range(20)] + [(90, None, None), (91, "http://h0.org/e", ""), (92, "http://one.org/", page.format(k=92))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, host string, low int")
    got = {r.page_id: r.text for r in sitetree.extract(pages).collect()}
    assert got == {k: f"Own text {k}\n\nMore {k}" for k in range(20)} | {90: "", 91: "", 92: "Same words on every page\n\nOwn text 92\n\nMore 92"}


def test_hosts(spark):
    urls = ["https://User@WWW.Example.org:80/x", "//a.b/c", "no url", None, "ftp://h#f"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(sitetree.host_of("url").alias("h")).collect()
    assert [r.h for r in rows] == ["example.org", "a.b", "", "", "h"]


def page_rows():
    rng = random.Random(1)
    big, other = "".join(chr(rng.randrange(97, 123)) for _ in range(1000)), "é" * 600
    html = [None, "", "small", "small", big, big, big, other, other, "x" * 300000]
    return [(i, f"http://h/{i}" if i != 3 else None, h) for i, h in enumerate(html)] + [(5, "http://again/", big), (None, "http://null/ ü", big)]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id bigint, url string, html string, digest string")
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=500)).collect()
    key = lambda x: str(x)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        ids = [j for j, _, g in rows if g == h and j is not None]
        revisit = len(raw) >= 1000 and ids and (i is None or i < max(ids))
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None, u, None if revisit else raw))
    assert sorted((tuple(r[:6]) + (None if r.payload is None else bytes(r.payload),) for r in got), key=key) == sorted(want, key=key)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://h/", f"<p>{i}</p>" * 50) for i in range(40)], "page_id bigint, url string, html string")
    assert warc.save_archives(warc.write_archives(pages), f"file://{tmp_path}").count() >= 1
    back = warc.read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(str(tmp_path)))
    assert back.agg(F.count("payload"), F.sum("page_id")).first()[:] == (40, 780)


def test_broken_archives_are_refused():
    record = warc.make_record(1, "http://h/", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    dictionary = warc.train_dictionary([bytes(str(i) * 100, "ascii") + b"common words in each sample" * 5 for i in range(200)], 2048)
    good = warc.dictionary_frame(dictionary) + warc.compressor(dictionary).compress(record) * 2
    assert [r["page_id"] for r in warc.read_archive(good)] == [1, 1]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(good[:-3]))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(warc.dictionary_frame(b"") + warc.compressor(b"").compress(record.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"))))
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(record[:-4])


def site(k, own):
    """Pages of one host: furniture without any name that says so, and an article without its element."""
    return f"<html><body><div class='x{k}'><p>Home News Contact</p></div><div class='box'><p>Ad number {k % 3}</p></div><div class='y'><p>{own}</p></div><div class='z'>Our terms</div></body></html>"


def test_the_tree_decides_without_names(spark):
    """Menu and footer go since all pages share them; the same pages on hosts of one page each keep everything."""
    rows = [(k, f"http://shared.org/{k}", site(k, f"Story {k} of its own")) for k in range(30)] + [(100 + k, f"http://h{k}.org/", site(k, f"Story {k} of its own")) for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in sitetree.extract(pages).collect()}
    assert all("Home News Contact" not in got[k] and "Our terms" not in got[k] and f"Story {k} of its own" in got[k] for k in range(30))
    assert all("Home News Contact" in got[100 + k] and "Our terms" in got[100 + k] for k in range(3))


def test_what_declares_itself_goes_whatever_its_words(spark):
    """Menus and sidebars go on hosts that repeat them, on hosts where each page has its own, and on hosts of one page."""
    page = "<html><body><nav><a>Menu {}</a></nav><div class='sidebar'><p>{}</p></div><article><p>Text {}</p></article><div class='teaser'><p>Read this too</p></div></body></html>"
    rows = [(k, f"http://own.org/{k}", page.format(k, f"Unlike any other {k}", k)) for k in range(20)] + [(50 + k, f"http://same.org/{k}", page.format(0, "Ad", k)) for k in range(20)] + [(90, "http://one.org/", page.format(1, "x", 90))]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"Text {k}" and got[50 + k] == f"Text {k}" for k in range(20)) and got[90] == "Text 90"


def test_entropy_against_a_plain_count():
    """Importance of the nodes of a hand-made host; a branch with one important node stays."""
    nodes = {"": (8, 1, 0.0, None), "/a": (8, 1, 0.0, 0.0), "/b": (8, 1, 0.0, None), "/b/c": (8, 1, 0.0, 1.0), "/b/d": (8, 1, 0.0, 0.1), "/nav": (8, 1, 0.0, 0.05), "/nav/li": (8, 1, 0.0, 0.14)}
    x = sitetree.importance(nodes)
    assert x["/a"] == 0 and x["/b/c"] == 1 and abs(x["/b"] - 0.9 * 0.55) < 1e-9
    assert sitetree.low_paths(nodes) == ["/a", "/b/d", "/nav"]
    assert sitetree.low_paths(nodes, least=9) == []


def test_long_class_names_stay_apart():
    a, b = "c" * 60 + "left", "c" * 60 + "right"
    assert sitetree.label("div", f" class='{a}'", False)[0] != sitetree.label("div", f" class='{b}'", False)[0]


def test_urls_are_read_as_they_were_written(spark):
    urls = ["http://h/a%20b?q=%2F", "http://h/ä b", "http://h/%", " http://h/\r\nX: y "]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: r.url for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert [got[i] for i in range(3)] == urls[:3] and got[3] == "%20http://h/%0D%0AX: y%20"
