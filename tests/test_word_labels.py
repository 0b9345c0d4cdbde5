"""Labels of the words of whole texts, against the oracles and plain Python."""

import random
import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import spans as S
from corpusloom.functions import text as X
from corpusloom.operators import evaluation, windows
from corpusloom.plans import catalogue

#: White space of all kinds, of which the oracles' `\s` matches five; characters beyond the first plane.
TEXTS = ["", " ", "\n\t", "one", " a  b\x0bc d e\x85f g ", "é𝒳 𝒴\r\n\fz\x1cq", None, "x" * 300, " y" * 300, "\U0001f600 " * 40, *(f"word{k} and　so  on\n" * (k + 1) for k in range(20))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame([(k + 3, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def both(spark, folder, name):
    """Rows of a query and of its oracle."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, folder)
    return sorted(map(tuple, df.collect())), sorted(con.sql(catalogue.ORACLE[name]).select(*(f'"{c}"' for c in df.columns)).fetchall())


def python_nodes(df):
    return re.findall(r"\w*(?:Arrow|Python|Pandas)\w*", df._jdf.queryExecution().executedPlan().toString())


def test_word_runs_are_those_of_offsets(spark):
    rng, rows = random.Random(5), []
    for k in range(200):
        text = "".join(rng.choice("ab \n 𝒳") for _ in range(rng.randrange(40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.choice([0, 2, 4]))  // 2 * 2))
        rows.append((k, text, [[0, 0], *(list(m.span()) for m in re.finditer(r"[^\t\n\f\r ]+", text)), [0, 0]], list(zip(cuts[::2], cuts[1::2], strict=True))))
    df = spark.createDataFrame(rows, f"k int, text string, offsets array<array<int>>, spans array<{schemas.SPAN}>")
    runs = S.word_runs(F.col("text"), S.merge(F.col("spans")))
    got = df.select(S.run_labels(runs, X.sql_word_count(F.col("text"))).alias("own"), S.bio(F.col("offsets"), S.merge(F.col("spans"))).alias("bio")).collect()
    assert all(r.own == [x for x in r.bio if x != -100] for r in got) and any(2 in r.own for r in got)


def test_bio_labels_hold_no_offsets(spark, tables):
    got, want = both(spark, tables, "bio_labels")
    assert got == want and len(got) > 900
    assert not python_nodes(catalogue.QUERIES["bio_labels"](spark, tables))


def test_class_weights_hold_no_offsets(spark, tables):
    got, want = both(spark, tables, "class_weights")
    assert got == want and len(got) == 3
    assert both(spark, tables, "window_patterns")[0] == both(spark, tables, "window_patterns")[1]
    assert not python_nodes(catalogue.QUERIES["class_weights"](spark, tables))


def test_class_weights_make_no_labels(spark, tables, tmp_path):
    plan = catalogue.QUERIES["class_weights"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "explode(" not in plan and "array_repeat(" not in plan
    df = spark.read.parquet(f"{tables}/documents.parquet").withColumn("spans", F.expr(f"cast(array((0, 1), (3, 9), (8, 20)) as array<{schemas.SPAN}>)"))
    runs, n = S.word_runs(F.col("text"), S.merge(F.col("spans"))), X.sql_word_count(F.col("text"))
    made = windows.label_frequency(df.select(S.run_labels(runs, n).alias("labels")))
    counted = windows.run_frequency(df.select(S.run_counts(runs, n).alias("counts")))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, made.collect())) and counted.count() == 3
    assert counted.dtypes == made.dtypes
    for k, texts in enumerate([[], [None, " "], ["one"]]):  # of three labels, those that occur
        spark.createDataFrame([(3, t) for t in texts], "doc_id bigint, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got, want = both(spark, f"{tmp_path}/{k}", "class_weights")
        assert got == want and len(got) == (k == 2)


def test_entities_meet_within_their_row(spark, tables):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0, 1, 2]) for _ in range(k % 30)], [rng.choice([0, 1, 2]) for _ in range(k % 30)]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, t array<int>, p array<int>")
    tokens = df.select("k", F.inline(F.arrays_zip("t", "p"))).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy(F.monotonically_increasing_id())))
    got = evaluation.array_entity_metrics(df, "t", "p").first()
    assert got.hit > 50 and got == evaluation.entity_metrics(tokens, "k", "i", "t", "p").first()
    none = evaluation.array_entity_metrics(df.limit(0), "t", "p").first()
    assert tuple(none)[:3] == (0, 0, 0) and tuple(none)[3:] == (0.0, 0.0, 0.0)
    got, want = both(spark, tables, "entity_f1")
    assert got == want
    plan = catalogue.QUERIES["entity_f1"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Python" not in plan and "Arrow" not in plan
