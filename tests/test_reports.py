"""Operators that no row is lost in, and those of plans/reports.py, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import spans as S
from corpusloom.functions import text as X
from corpusloom.operators import academic, corpus, evaluation, prefix, quality, records, statistics, windows


def test_rows_without_a_group_are_one_group(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"g{i % 9}") for i in range(60)], "id int, g string")
    out = records.group_split(rows, "g")
    assert out.count() == 60 and out.columns == ["id", "g", "split"]
    assert out.filter("g IS NULL").select("split").distinct().count() == 1


def test_reindex_numbers_every_row_from_one(spark):
    values = [5, None, -7, 10**18, 3, None, -(10**18), 4]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v bigint")
    got = {r.k: r.id for r in corpus.reindex(rows, "v").collect()}
    assert [got[k] for k in (6, 2, 4, 7, 0, 3)] == [1, 2, 3, 4, 5, 6] and {got[1], got[5]} == {7, 8}
    assert corpus.reindex(rows.limit(0), "v").count() == 0


def test_ranges_follow_the_rows_and_not_the_width(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("x")).union(spark.createDataFrame([(1e300,)], "x double"))
    at = prefix.cuts(rows, "x", 8)
    sizes = rows.groupBy(prefix.range_of(F.col("x"), at).alias("r")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 200
    sums = prefix.running_sums(rows.withColumn("one", F.lit(1)), "x", {"upto": "one"})
    assert sums.filter("x = 1e300").first().upto == 1001 and sums.filter("x = 10").first().upto == 11


def test_rows_without_a_url_have_no_rank(spark):
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "http://A/"), (4, "http://a"), (5, None)], "id int, url string")
    assert {r.id: r.url_rank for r in corpus.url_ranked(rows, "url", "id").collect()} == {1: None, 2: None, 3: 1, 4: 2, 5: None}


def test_copies_are_counted_without_a_window(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "id int, text string")
    assert {r.id: (r.copies, r.is_duplicate) for r in records.flag_duplicates(rows).collect()} == {1: (2, True), 2: (2, True), 3: (1, False), 4: (2, True), 5: (2, True)}


def test_neighbours_meet_across_ranges(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(600)], "i int, g int, v array<double>")
    got = {r.i: r.cosine for r in statistics.adjacent_cosine(rows, "i", "v", "g").collect()}
    cosine = lambda a, b: (1 + a * b) / ((1 + a * a) ** 0.5 * (1 + b * b) ** 0.5)
    assert len(got) == 598 and all(abs(got[i] - cosine(i, i + 2)) < 1e-5 for i in range(598))


def test_strategies_beyond_the_broadcast_bound(spark):
    chunks, strategies = spark.range(3).select(F.col("id").alias("chunk_id")), spark.createDataFrame([("a",), ("b",), ("c",)], "strategy string")
    done = spark.createDataFrame([("1__b",)], "task_id string")
    for most in (1000, 2):
        assert corpus.tasks_left(chunks, strategies, done, most=most).count() == 8


def test_needles_are_in_every_match():
    assert X.needle(r"(?iU)\byou\s+are\s+a\s+professional\s+translator\b") == "professional"
    assert X.needle(r"(?iU)\[system\]|\[user\]") == "" and X.needle(r"(?iu)Как\s+цитировать\s+(?:статью|работу)\s*:[^\n]{0,800}\n?") == "цитировать"
    assert X.needle(r"abc{0,5}(?:de)?f*") == "ab"


def test_strip_takes_every_white_space(spark):
    row = spark.createDataFrame([("   a　b \x85 \n",)], "t string").select(X.strip(F.col("t")).alias("s")).first()
    assert row.s == "a　b"


def test_russian_front_matter_is_seen(spark):
    lines = ["Главный редактор Иванов", "ISSN 1234-5678", "© Издатель", "УДК 123.4", "РЕФЕРАТИВНЫЙ  ЖУРНАЛ", "Обычная строка текста о реке и лесе", "DOI 10.1234/abc", "Ключевые слова:"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    assert [r.m for r in rows.orderBy("i").select(quality.is_meta_line(F.col("x")).alias("m")).collect()] == [True, True, True, True, True, False, True, True]


PAGE = """<html><head><meta name="keywords" content="река, лес"></head><body><i>Название статьи</i>
<h2 class="right-title"><span>Журнал — Иванов И., Петров П.</span></h2>
<div class="labels"><time>2021</time><div class="label rsci">x</div><div class="label vak">x</div></div>
<a class="link" href="/j">Журнал наук</a><div class="abstract"><p>Кратко</p><p>о главном</p></div>
<div class="ocr">{}</div></body></html>"""


def test_fields_of_an_academic_page(spark):
    text = "слово " * 60
    pages = spark.createDataFrame([("https://x/article/n/slug-1/", PAGE.format(text)), ("u", PAGE.format("мало")), ("n", None), ("p", "<p>Ключевые слова: один, два</p>")], "url string, html string")
    got = {r.article_id: r for r in academic.academic_pages(pages).collect()}
    r = got["slug-1"]
    assert (r.title, r.authors, r.authors_count, r.year, r.journal, r.annotation) == ("Название статьи", "Иванов И., Петров П.", 2, 2021, "Журнал наук", "Кратко о главном")
    assert (r.keywords, r.keywords_count, r.rsci, r.vak, r.scopus, r.text, r.text_source) == ("река, лес", 2, True, True, False, text.strip(), "html_ocr")
    assert got["u"].text == "" and got["u"].text_source == "" and got["n"].title == "" and got["n"].year is None
    assert got["p"].keywords == "один, два" and got["p"].keywords_count == 2


def test_prepared_chunks_fail_on_an_empty_split(spark):
    row = lambda i: (f"c{i}", f"a{i % 2}", f"o{i}", f"a text that is long enough to be kept, number {i} of these", 0, "[]", None, None, 0.0, "false", "original", "human", None, None, None)
    schema = "chunk_id string, article_id string, original_chunk_id string, text string, label int, ai_spans_json string, ai_span_start_char int, ai_span_end_char int, ai_fraction double, has_mixed_content string, strategy string, source_model string, judge_avg double, char_count int, word_count int"
    chunks = spark.createDataFrame([row(i) for i in range(4)], schema)
    with pytest.raises(records.EmptySplit):
        records.prepare(chunks)
    assert records.prepare(chunks, check=False).count() == 4


def test_splits_without_labels_are_named(spark):
    rows = spark.createDataFrame([("train", [0, 1, 2]), ("test", [0, 1, -100])], "split string, labels array<int>")
    with pytest.raises(ValueError, match="test"):
        windows.require_labels(rows, "split")
    assert windows.require_labels(rows.filter("split = 'train'"), "split").count() == 1


def test_spans_without_confidence_come_last(spark):
    row = spark.sql("SELECT array(named_struct('start', 5, 'end', 6, 'confidence', 0.5D), named_struct('start', 1, 'end', 2, 'confidence', null), named_struct('start', 3, 'end', 4, 'confidence', 0.5D)) AS s")
    assert [x.start for x in row.select(S.top(F.col("s"), 3).alias("t")).first().t] == [3, 5, 1]


def test_experiment_files_are_ordered(spark, tmp_path):
    for name, f1 in (("a", 0.5), ("b", 0.9), ("c", 0.7)):
        (tmp_path / f"{name}.json").write_text(f'{{"f1": {f1},\n "run": "{name}"}}')
    assert [r.file for r in evaluation.experiments(spark, str(tmp_path), "f1").collect()] == ["b.json", "c.json", "a.json"]
