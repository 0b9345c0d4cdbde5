"""Properties of cleaners, spans, records, splits, chunkers, sources and streams on small own inputs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import spans as S
from corpusloom.functions import text as X
from corpusloom.operators import boundaries, chunks, cleaner, corpus, evaluation, html, quality, records, scoring, windows
from corpusloom.sources import io
from corpusloom.streaming import streams


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def cleaned(spark, text, **flags):
    return one(spark, cleaner.clean(F.col("t"), cleaner.Flags(**flags)), t=text)


BODY = "Это основной текст статьи, в котором достаточно слов и предложений для проверки правил очистки."


@pytest.mark.parametrize(
    "text,flags,gone,kept",
    [
        ("Пишите на user.name@mail.example.ru или https://site.example/page?id=1 сейчас", {}, ["mail.example", "site.example"], ["Пишите"]),
        (BODY * 3 + "\n\nСписок литературы\n1. Книга", {}, ["Список литературы", "Книга"], ["основной текст"]),
        ("Сло-\nво и дело", {}, ["-\n"], ["Слово"]),
        ("Сборник трудов кафедры физики\n" * 5 + BODY, {"repeated_lines": True}, ["Сборник"], ["основной"]),
        (f"12\n{BODY}\n13\n", {"page_numbers": True}, ["12", "13"], ["основной"]),
        ("Не можете найти то, что вам нужно? Попробуйте сервис\n" + BODY, {"prompts": True}, ["найти то"], ["основной"]),
        (f"Адрес статьи: www.x.ru\nИсточник: журнал\nISSN 1234-5678\n{BODY}", {"front_matter": True}, ["Адрес статьи", "Источник", "ISSN"], ["основной"]),
        (f"Фото: агентство\n{BODY}", {"captions": True}, ["Фото"], ["основной"]),
        (f"УДК 123.45\n{BODY}", {}, ["УДК"], ["основной"]),
        (f"{BODY} DOI 10.1234/abc.def конец", {}, ["10.1234"], ["конец"]),
        ("Цена — 5 «рублей»", {}, ["—\t", "«"], ['"рублей"']),
        ("Ключевые слова: а, б, в\n" + BODY, {"keywords": True}, ["Ключевые"], ["основной"]),
        ("Вывод [1, 2] верен (3)", {"inline_refs": True}, ["[1", "(3)"], ["верен"]),
        ("<p>Абзац</p><b>текст</b>", {}, ["<p>"], ["Абзац текст"]),
        ("мягкий­перенос и \x07 знак", {}, ["­", "\x07"], ["мягкийперенос"]),
    ],
)
def test_cleaning_steps(spark, text, flags, gone, kept):
    out = cleaned(spark, text, **flags)
    assert not [g for g in gone if g in out] and all(k in out for k in kept)


def test_cleaning_leaves_clean_texts_and_nothing_alone(spark):
    assert cleaned(spark, BODY) == BODY and cleaned(spark, cleaned(spark, BODY)) == BODY
    assert cleaned(spark, "") == "" and cleaned(spark, None) is None
    assert one(spark, cleaner.clean_prose(F.col("t")), t="short") == ""
    assert one(spark, cleaner.fix_homoglyphs(F.col("t")), t="мoлoко и cat") == "молоко и cat"


def test_adversarial_text_is_fast(spark):
    import time

    start = time.time()
    cleaned(spark, ("a/b-" * 900 + "@ ") * 4 + "Режим доступа" * 100)
    assert time.time() - start < 10


def test_profiles(spark):
    rows = spark.createDataFrame([("cyberleninka", ""), ("newsapi", "pikabu.ru"), ("newsapi", "www.pravda.com.ua"), ("own", "")], "source string, outlet string")
    assert [r[0] for r in rows.select(cleaner.profile_name(F.col("source"), F.col("outlet"))).collect()] == ["cyberleninka_html_ocr", "newsapi_pikabu", "newsapi_pravda_ua", ""]
    full = cleaner.clean_frame(rows.withColumn("text", F.lit(f"17\n{BODY}")), by_profile=True, outlet="outlet")
    assert {r.clean_profile: "17" in r.text_clean for r in full.collect()} == {"cyberleninka_html_ocr": False, "newsapi_pikabu": True, "newsapi_pravda_ua": True, "": True}
    assert cleaner.clean_report(rows.select(F.monotonically_increasing_id().alias("id"), F.lit(BODY).alias("text")), "id").count() == 4


def test_meta_lines_and_scores(spark):
    for line, want in (("ISSN 1234-5678", True), ("Аннотация", True), ("© Автор", True), (BODY, False), ("", False)):
        assert one(spark, quality.is_meta_line(F.col("t")), t=line) is want
    assert one(spark, quality.body_line_score(F.col("t")), t=BODY * 2) > 0.5
    assert one(spark, quality.body_line_score(F.col("t")), t="short") == 0


def test_quality_quarantines_noise(spark):
    noisy = "2QQ3 2QQ4 2QQ5 2QQ6 2QQ7 2QQ8 2QQ9 2QQ1 2QQ2 2QQQ 2QQA 2QQB 2QQC\n" * 4 + "\n".join(f"Колонтитул журнала номер {k % 10}" for k in range(80)) + "\n12\n13\n14\n"
    rows = spark.createDataFrame([(1, noisy), (2, (BODY + " ") * 40), (3, None), (4, "")], "id int, text string")
    got = {r.id: r for r in quality.quality(rows).collect()}
    assert got[1].quarantine_candidate and not got[2].quarantine_candidate
    assert got[2].quality_score > got[1].quality_score and got[3].quality_score == got[4].quality_score == 100


def slow_merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_span_properties(spark):
    rng = random.Random(1)
    rows = [(k, 200, [(a, a + rng.randrange(1, 30)) for a in (rng.randrange(0, 170) for _ in range(rng.randrange(0, 7)))]) for k in range(200)]
    df = spark.createDataFrame(rows, f"k int, n int, spans array<{schemas.SPAN}>")
    df = df.withColumn("m", S.merge(F.col("spans"))).withColumn("t", S.tile(F.col("m"), F.col("n")))
    for r in df.withColumn("ok", S.tiles_exactly(F.col("t"), F.col("n"))).withColumn("again", S.merge(F.col("m"))).withColumn("f", S.fraction(F.col("m"), F.col("n"))).collect():
        assert [tuple(x) for x in r.m] == slow_merge([tuple(x) for x in r.spans]) == [tuple(x) for x in r.again]
        assert r.ok and abs(r.f - sum(b - a for a, b in slow_merge([tuple(x) for x in r.spans])) / 200) < 1e-12


def test_span_parsing_and_display(spark):
    parse = lambda t: one(spark, S.parse_spans(F.col("t")), t=t)
    assert parse("[[0, 5], [7, 9]]").spans[1].end == 9 and parse("").spans == [] and parse(None).error is None
    assert parse("nope").error == "ai_spans_json_invalid" and parse("[[1]]").error == "ai_spans_json_not_pairs"
    df = spark.createDataFrame([("héllo wörld", [(0, 5, 0.9), (6, 11, 0.2)])], "t string, s array<struct<start:int,end:int,confidence:double>>")
    assert [tuple(x) for x in df.select(S.segments(F.col("s"), F.col("t"))).first()[0]] == [("AI", "héllo"), ("NONE", " "), ("HUMAN", "wörld")]
    tail = spark.createDataFrame([("x" * 100, [(0, 60)]), ("x" * 100, [(0, 10)]), ("x" * 60 + "    ", [(0, 60)])], f"t string, s array<{schemas.SPAN}>")
    assert [r[0][0].end for r in tail.select(S.repair_tail(F.col("s"), F.col("t"))).collect()] == [100, 10, 60]


def test_bio_restarts_after_special_tokens(spark):
    df = spark.createDataFrame([([[0, 0], [0, 3], [4, 7], [0, 0], [8, 9], [10, 12]], [(2, 9)])], f"o array<array<int>>, s array<{schemas.SPAN}>")
    df = df.withColumn("l", S.bio(F.col("o"), F.col("s")))
    assert df.first().l == [-100, 1, 2, -100, 1, 0]
    assert tuple(df.select(S.window_bounds(F.col("o"), F.col("l"))).first()[0]) == (0, 12)
    assert df.select(windows.label_pattern(F.col("l"))).first()[0] == "mixed_O_B_I"


def test_greedy_iou(spark):
    df = spark.createDataFrame([([(0, 10), (0, 9)], [(0, 10), (50, 60)]), ([], [])], f"p array<{schemas.SPAN}>, t array<{schemas.SPAN}>")
    r = evaluation.span_metrics(df, "p", "t").first()
    assert (r.micro_precision, r.micro_recall, r.macro_f1) == (0.5, 0.5, 0.75)


def test_audit_drops_and_quarantines(spark):
    base = {"article_id": "a", "original_chunk_id": "o", "ai_span_start_char": None, "ai_span_end_char": None, "ai_fraction": None, "source_model": "human", "strategy": "original", "judge_avg": None, "has_mixed_content": "false"}
    texts = [("c0", BODY, 0, "[]"), ("c1", "", 0, "[]"), ("c2", BODY, 9, "[]"), ("c3", BODY, 2, "[[0, 5000]]"), ("c4", BODY, 2, "bad"), ("c5", "I can't help with that, sorry about it, truly and really I am.", 1, "[]"), ("c6", "мало", 0, "[]"), ("c7", "Конечно, вот текст. " + BODY, 1, "[]")]
    rows = spark.createDataFrame([{**base, "chunk_id": c, "text": t, "label": k, "ai_spans_json": s, "char_count": len(t), "word_count": len(t.split())} for c, t, k, s in texts], schemas.struct("chunk_id string, article_id string, original_chunk_id string, text string, label int, ai_spans_json string, ai_span_start_char int, ai_span_end_char int, ai_fraction double, has_mixed_content string, strategy string, source_model string, judge_avg double, char_count int, word_count int"))
    got = {r.chunk_id: r for r in records.audit(rows).collect()}
    assert {k: r.status for k, r in got.items()} == {"c0": "clean", "c1": "drop", "c2": "drop", "c3": "drop", "c4": "drop", "c5": "drop", "c6": "quarantine", "c7": "quarantine"}
    assert "span_out_of_bounds" in got["c3"].fatal_issues and "prompt_leak_pattern" in got["c7"].issues
    kept = records.records(records.audit(rows))
    assert kept.filter(~S.tiles_exactly(F.col("spans"), F.length("text"))).count() == 0
    reviewed = {r.id: r.reviewed_status for r in records.review(kept.withColumn("flags", F.col("quality.flags"))).collect()}
    assert reviewed["c6"] == "quarantine" and reviewed["c0"] == "clean"


def test_split_never_divides_a_group(spark):
    df = spark.range(500).select((F.col("id") % 60).alias("g"), "id")
    split = records.group_split(df, "g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r.split: r.n_groups for r in records.split_summary(split, "g", "id").collect()} == {"test": 6, "validation": 6, "train": 48}


def test_ledger_and_kept_are_the_input(spark):
    df = spark.createDataFrame([(1, "http://a/", "t"), (2, "HTTP://A", "t"), (3, None, "t"), (4, "http://b", "")], "i int, url string, title string").withColumn("html", F.lit("x"))
    kept, gone = corpus.split_ledger(corpus.with_reason(corpus.url_ranked(df, "url", "i"), corpus.page_rules()))
    assert {r.i for r in kept.collect()} == {1} and {r.i: r.remove_reason for r in gone.collect()} == {2: "duplicate_url", 3: "empty_url", 4: "empty_title"}


def test_reindex_crosses_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("k"))
    assert [r.id for r in corpus.reindex(df, "k", bucket=50).orderBy("k").collect()] == list(range(1, 1001))


@pytest.mark.parametrize("bucket", [1, 7, 5000])
def test_reindex_buckets_keep_every_row(spark, bucket):
    df = spark.createDataFrame([(float(k % 50),) for k in range(300)] + [(None,)] * 3 + [(float("nan"),), (float("inf"),)], "k double")
    rows = corpus.reindex(df, "k", bucket=bucket).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 306)) and [r.k for r in rows[:300]] == sorted(float(k % 50) for k in range(300))
    assert rows[300].k == float("inf") and all(r.k is None for r in rows[302:])
    assert corpus.reindex(df.limit(0), "k", bucket=bucket).collect() == []


def test_normalized_rows(spark):
    df = spark.createDataFrame([("a, b", None, "abc", "posted 2021-02-03")], "author string, year long, text string, published_at string")
    r = corpus.normalize_rows(df).first()
    assert (r.authors_count, r.year, r.text_length, r.title) == (2, 2021, 3, "")
    with pytest.raises(schemas.MissingColumns):
        schemas.require(df, ["nope"])


def test_calibration_chain(spark):
    doc = "doc_id bigint, "
    docs = spark.createDataFrame([(1, "one two three"), (2, "x")], doc + "text string")
    out = scoring.calibrate(docs, spark.createDataFrame([(1, "AI", 1.0)], doc + "verdict string, confidence double"), spark.createDataFrame([(1, 0, 7, 0.8)], doc + "start_char int, end_char int, avg_confidence double"), spark.createDataFrame([(1, 30.0)], doc + "curvature double"), spark.createDataFrame([(1, True, None)], doc + "audit_passed boolean, audit_verdict string"), spark.createDataFrame([], doc + "defense_possible boolean, defense_verdict string"))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].final_prob == 1.0 and got[1].risk_level == "high" and not got[1].needs_review and got[1].doc_score_raw == 1.0
    assert abs(got[2].base_prob - 0.4) < 1e-9 and got[2].needs_review


def test_curvature_edges(spark):
    rows = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0), (1, 2, -4.0), (2, 0, -1.0), (2, 1, -3.0), (3, 0, -1.0)], "doc_id bigint, perturbation int, log_prob double")
    got = {r.doc_id: (r.curvature, r.std_perturbed) for r in scoring.curvature(rows).collect()}
    assert got[1] == (2.0, 1.0) and got[2] == (2.0, 1.0)


def test_chunkers(spark):
    df = spark.createDataFrame([([10, 10, 10, 50, 5], [0.9, 0.1, 0.9, 0.9])], "w array<int>, s array<double>")
    assert df.select(chunks.semantic_cuts(F.col("w"), F.col("s"), 0.5, 15, 60)).first()[0] == [2, 2, 1]
    # target 42.5 of 85 words: costs .564, .207 and .411 for boundaries 1, 2 and 3
    assert df.select(chunks.equal_cuts(F.col("w"), F.col("s"), F.lit(2))).first()[0] == [2]
    whole = spark.createDataFrame([(["a.", "b.", "c."], [1])], "p array<string>, c array<int>")
    assert whole.select(chunks.pieces(F.col("p"), F.col("c"))).first()[0] == ["a.", "b. c."]
    made = spark.createDataFrame([("abcdef", "XY", 2, 4, m) for m in ("replace_full", "replace_fragment", "append")], "o string, g string, s int, e int, m string")
    got = [tuple(r[0]) for r in made.select(chunks.assemble(*(F.col(c) for c in "ogsem"))).collect()]
    assert got == [("XY", 0, 2, 1.0), ("abXYef", 2, 4, 0.333), ("abcdef XY", 7, 9, 0.222)]


def test_windows_cover_all_tokens(spark):
    rows = spark.createDataFrame([(k, list(range(k))) for k in (1, 5, 128, 129, 300)], "k int, t array<int>")
    got = windows.token_windows(rows, "k", "t", 128, windows.vote_step())
    assert {r.k: set(x for w in r.ws for x in w) for r in got.groupBy("k").agg(F.collect_list("window").alias("ws")).collect()} == {k: set(range(k)) for k in (1, 5, 128, 129, 300)}
    assert windows.vote_step(128, 0.8) == 25 and windows.vote_step(252, 0.5) == 126


def test_masks(spark):
    df = spark.range(3).select("id", windows.mask_starts(F.col("id"), F.lit(50), F.lit(4), 2).alias("s"))
    assert all(len(r.s) <= 4 and max(r.s) < 48 for r in df.collect())
    assert spark.createDataFrame([("a <extra_id_0> b <extra_id_1> c <extra_id_2>", ["X", "Y"])], "t string, f array<string>").select(windows.fill_masks(F.col("t"), F.col("f"))).first()[0] == "a X b Y c "


def test_pages(spark):
    page = """<html><head><meta property="og:title" content="OG"><script type="application/ld+json">{"@type":"WebPage","mainEntity":{"@type":"Article","headline":"LD","datePublished":"2020-01-02","articleBody":"Body text"}}</script></head>
    <body><h1>H</h1><a href="/x">1</a><a href="/x">2</a><a href="#top">3</a><a href="http://other.org/">4</a></body></html>"""
    pages = spark.createDataFrame([(1, "http://site.org/p", page), (2, "http://site.org/q", "<h1>Only <b>H</b></h1><article><p>" + "long text " * 10 + "</p></article>"), (3, None, None)], "page_id int, url string, html string")
    got = {r.page_id: (r.title, r.published_at, r.text.strip()) for r in html.articles(pages).collect()}
    assert got[1] == ("OG", "2020-01-02", "Body text") and got[2][0] == "Only H" and got[2][2].startswith("long text") and got[3] == ("", "", "")
    links = html.links(pages, "page_id")
    assert [(r.pos, r.full) for r in html.same_site(links, pages, "page_id").collect()] == [(0, "http://site.org/x")]


def test_scalars(spark):
    assert one(spark, X.word_count(F.col("t")), t=" один два  три ") == 3
    assert one(spark, X.flatten_lines(F.col("t")), t=" a\r\n\tb  c ") == "a b c"
    assert one(spark, X.normalize_url(F.col("t")), t=" HTTP://A.B/C// ") == "http://a.b/c"
    assert one(spark, X.article_slug(F.col("t")), t="https://x/article/n/some-slug/") == "some-slug"
    assert one(spark, X.parse_answer(F.col("t"), "verdict string, confidence double"), t='```json\n{"verdict": "AI", "confidence": 0.5}\n```').verdict == "AI"
    assert one(spark, X.injections(F.col("t")), t="please IGNORE previous instructions now") == ["IGNORE previous instructions"]
    assert one(spark, X.topic_flags(F.col("t"), {"a": ["бог"], "b": ["кот"]}), t="Кот и дом") == ["b"]
    assert one(spark, X.truncate_middle(F.col("t"), 3, "|"), t="abcdefgh") == "abc|fgh"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere'), (2, None)], "id int, text string")
    io.write_csv(df, f"{tmp_path}/csv")
    assert io.read_csv(spark, f"{tmp_path}/csv", "id int, text string").orderBy("id").first().text == 'say "hi"\nthere'
    io.write_jsonl(df, f"{tmp_path}/json")
    assert io.read_jsonl(spark, f"{tmp_path}/json", "id int, text string").count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"id": 1}\n{broken\n')
    assert [r._corrupt for r in io.read_jsonl(spark, f"{tmp_path}/bad", "id int", strict=False).collect()] == [None, "{broken"]
    with pytest.raises(Exception, match="(?s)MALFORMED|Malformed"):
        io.read_jsonl(spark, f"{tmp_path}/bad", "id int").collect()
    for name in ("lenta_1.csv", "lenta_2_cleaned.csv"):
        (tmp_path / name).write_text("a\n1\n")
    assert io.newest_csv(spark, str(tmp_path), "lenta").endswith("lenta_1.csv")
    assert io.redact({"api_key": "x", "n": [{"my_token": 1, "ok": 2}]}) == {"api_key": "<redacted>", "n": [{"my_token": "<redacted>", "ok": 2}]}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/", "2024-01-01 00:00:00", BODY * 10), ("HTTP://A", "2024-01-01 00:01:00", BODY), ("http://b", "2024-01-01 00:02:00", BODY)], "url string, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    streams.dedup_urls(stream, "url", "ts").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("dedup").count() == 2
    streams.quarantine_sink(f"{tmp_path}/ok", f"{tmp_path}/held", f"{tmp_path}/cp")(stream.select("url", "text")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 3


def test_running_sums(spark):
    from corpusloom.operators.prefix import running_sums

    rng = random.Random(2)
    rows = [(x, rng.randrange(5)) for x in {round(rng.expovariate(1) - 0.3, 4) for _ in range(3000)}]
    df = spark.createDataFrame(rows, "x double, n long")
    for down in (False, True):
        total, want = 0, {}
        for x, n in sorted(rows, reverse=down):
            total += n
            want[x] = total
        assert {r.x: r.s for r in running_sums(df, "x", {"s": "n"}, down).collect()} == want
    assert running_sums(df.limit(0), "x", {"s": "n"}).count() == 0
    assert running_sums(df.limit(1), "x", {"s": "n"}).count() == 1


def test_article_boundaries(spark):
    prose = "Во второй части работы подробно рассматриваются методы измерения и полученные результаты, а также их обсуждение в сравнении с прежними."
    english = "Abstract\nThis paper deals with methods of measurement and their results in a broad comparison with earlier work.\n\n"
    tail = "\n".join([prose] * 30 + ["Список литературы", "1. Книга", "УДК 123.4", "ISSN 1234-5678"])
    assert one(spark, boundaries.article_end(F.col("t")), t=tail)[:] == (30, 0.78)
    assert one(spark, boundaries.trim_tail(F.col("t")), t=tail) == "\n".join([prose] * 30)
    assert one(spark, boundaries.next_article_bleed(F.col("t")), t=tail) is True and one(spark, boundaries.next_article_bleed(F.col("t")), t=prose) is False
    early = "\n".join(["Литература"] + [prose] * 30)
    assert one(spark, boundaries.trim_tail(F.col("t")), t=early) == early
    head = "\n".join(["12", "короткая строка", "ещё"] * 5 + [prose] * 10)
    assert one(spark, boundaries.article_start(F.col("t"))["pos"], t=head) == 15
    assert one(spark, boundaries.trim_start(F.col("t")), t=head) == "\n".join([prose] * 10)
    mixed = f"{prose}\n{english}{prose}"
    out = one(spark, boundaries.strip_english(F.col("t")), t=mixed)
    assert "This paper" not in out and out.count(prose) == 2
    assert one(spark, boundaries.strip_english(F.col("t")), t=prose) == prose
    tailed = f"{prose * 4}\n{english.strip()}"
    assert one(spark, boundaries.strip_english_tail(F.col("t")), t=tailed) == prose * 4
    assert one(spark, boundaries.drop_title_prefix(F.col("t"), F.col("p")), t="Название статьи\nТекст", p="название статьи") == "Текст"


def test_portal_chrome(spark):
    body = "\n".join([BODY] * 6)
    wall = "IT · Юмор · Наука · Бизнес · Моё"
    for variant, junk in (("pravda", "Реклама на сайте"), ("pravda_ua", "Новости Публикации Колонки"), ("pikabu", wall), ("mail_ru", "Почта Mail")):
        text = f"{junk}\n{body}\n{junk}"
        assert one(spark, boundaries.drop_portal(F.col("t"), variant), t=text) == body
        assert one(spark, boundaries.portal_hits(F.col("t"), variant), t=text) == 2
    assert one(spark, boundaries.drop_rbc_footer(F.col("t")), t=f"{body}\nОставайтесь на связи с РБК в Max") == body
    assert one(spark, boundaries.trim_pikabu_tail(F.col("t")), t="\n".join([BODY] * 12 + ["", wall, "Теги:"])) == "\n".join([BODY] * 12)
    assert one(spark, boundaries.trim_pikabu_tail(F.col("t")), t=body) == body


def test_portal_walls_are_quarantined(spark):
    wall = "\n".join(f"IT · Юмор · Наука · Бизнес · раздел {k}" for k in range(16))
    rows = spark.createDataFrame([(1, wall + "\n" + BODY), (2, (BODY + " ") * 40)], "id int, text string")
    got = {r.id: r for r in boundaries.quality(rows).collect()}
    assert got[1].probable_document_type == "portal_noise_heavy" and got[1].quarantine_candidate
    assert got[2].portal_chrome_hits == 0 and not got[2].quarantine_candidate


def test_sql_functions_agree_with_columns(spark):
    from corpusloom.functions import sql

    assert len(sql.register(spark)) == 8
    spark.createDataFrame([(" HTTP://A/b// ", "a  b\n\tc <p>x</p>", 80.0), (None, None, None)], "u string, t string, s double").createOrReplaceTempView("sql_rows")
    got = spark.sql("SELECT normalize_url(u) AS a, word_count(t) AS b, strip_tags(t) AS c, flatten_lines(t) AS d, ui_bucket(s) AS e, risk_level(0.5D) AS f, verdict_probability('AI', 0.5D) AS g FROM sql_rows").collect()
    want = spark.table("sql_rows").select(X.normalize_url(F.col("u")), X.word_count(F.col("t")), X.strip_tags(F.col("t")), X.flatten_lines(F.col("t")), X.ui_bucket(F.col("s")), F.lit("medium"), F.lit(0.75)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert [r.line for r in spark.sql("SELECT * FROM text_lines('a\\nb')").collect()] == ["a", "b"]
