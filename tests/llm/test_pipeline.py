import corpus_pipeline
from corpusloom.llm import queries
from corpusloom.llm.common import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs.count()
    assert len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SMALL), f"test-{name}")
        n = docs.count()
        assert 0 < n <= before
        before = n
        assert docs.columns[: len(names)] == names and (k == 4 or docs.columns == names)
    assert docs.filter("copies < 1 OR rate < 0").count() == 0


def test_every_query_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def folder(spark, tmp_path):
    """Small tables whose texts meet every stage: toxic words, near copies, repeated passages, benchmark passages."""
    import random

    rng = random.Random(21)
    word = lambda: rng.choice(["river", "stone", "tree", "light", "walk"]) + str(rng.randrange(4000))
    texts = [[word() for _ in range(rng.randrange(50, 120))] for _ in range(90)]
    passage, item = [word() for _ in range(50)], [word() for _ in range(14)]
    for i in range(0, 90, 9):
        texts[i] += ["vilest", "scorn", "vilest"]
    for i in range(1, 90, 9):
        texts[i][10:10] = passage
    for i in range(2, 90, 9):
        texts[i][20:20] = item
    near = list(texts[5])
    near[3] = "other"
    texts += [texts[4], texts[4], near, list(passage), list(item)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, " \n"), (None, " ".join(texts[6]))]
    spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, hits int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 > 0), int(i % 9 == 0)) for i in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (None, "river river")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.hits) for r in df.collect()), key=str)


def test_each_stage_against_a_plain_loop(spark, tmp_path):
    """Every stage on what the one before it kept, beside slow versions of the same decisions."""
    import re

    import numpy as np
    from test_near_copies import groups_of
    from test_substring_and_decontamination import slow_hits, slow_removed

    from corpusloom.llm import toxicity
    from corpusloom.llm.common import table

    path, _ = folder(spark, tmp_path)
    docs = table(spark, path, "documents")
    (_, toxic), (_, near), (_, repeats), (_, leaks), (_, mixing) = corpus_pipeline.STAGES

    net = toxicity.scorer(docs, table(spark, path, "labels")).value
    want = [r for r in rows_of(docs) if net.scores([r[1] or ""])[0] < 0.5]
    docs = materialize(toxic(spark, docs, path), "t1")
    assert rows_of(docs) == want and len(want) < 99 - 5

    given = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    low = groups_of([r[1] for r in given])
    docs = materialize(near(spark, docs, path), "t2")
    assert sorted(r[0] is None or r[0] for r in rows_of(docs)) == sorted(given[k][0] is None or given[k][0] for k in sorted(set(low))) and len(set(low)) < len(given) - 3

    given = rows_of(docs)
    gone = {r[2]: x for r, x in zip(given, slow_removed([r[:2] for r in given]), strict=True)}
    docs = materialize(repeats(spark, docs, path), "t3")
    got = {r[2]: r for r in rows_of(docs)}
    for i, text, key in given:
        _, n, removed, digest = gone[key]
        assert (key in got) == (removed < n or not n)
        if key in got:
            import hashlib

            assert got[key][1] == text if not removed else hashlib.sha256(got[key][1].encode()).hexdigest() == digest
    assert sum(x[2] > 0 for x in gone.values()) > 5

    given, items = rows_of(docs), [(1, r.text) for r in table(spark, path, "benchmark").collect()]
    docs = materialize(leaks(spark, docs, path), "t4")
    got = {r[2]: r for r in rows_of(docs)}
    hit = 0
    for _, text, key in given:
        n, covered, _ = slow_hits(text, items)
        assert (key in got) == (covered < n or not n)
        if key in got and covered:
            hit += 1
            assert slow_hits(got[key][1], items)[1] == 0 and len(re.findall(r"\w+", got[key][1])) == n - covered
        elif key in got:
            assert got[key][1] == text
    assert hit > 5

    out = mixing(spark, docs, path).toPandas()
    total = out.n_tokens.sum()
    assert (out.copies >= 1).all() and (out.rate >= 0).all() and set(out.hits) <= set(got)
    assert np.allclose(out[["p_prose", "p_rough"]].sum(axis=1), 1) and total > 0


def test_stages_take_empty_tables(spark, tmp_path):
    path, _ = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
