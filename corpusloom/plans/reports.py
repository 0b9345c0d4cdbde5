"""More registered queries: scalar functions, spans, scoring fallbacks, record reports and models.

As in the catalogue, signals that the driver's tables lack are derived by integer arithmetic that both engines share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..operators import academic as AC
from ..operators import boundaries as B
from ..operators import chunks as K
from ..operators import cleaner as CL
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import records as R
from ..operators import scoring as G
from ..operators import statistics as A
from ..operators import windows as V
from ..session import load
from .catalogue import AUDIT_SQL, CHUNK_SQL, CORR, FLAGS_SQL, SIGNAL_SQL, STOP, chunk_rows, features, labelled_texts, query, r6, signals

WS = r"'^\s+|\s+$'"


def texts(spark, d, **columns):
    return load(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in columns.items()))


# ---- scalar functions over texts --------------------------------------------------------------------


@query("SELECT doc_id, md5(CASE WHEN length(text) > 8000 THEN left(text, 4000) || chr(10) || '...' || chr(10) || right(text, 4000) ELSE text END) AS digest FROM documents")
def truncate_middle(spark, d):
    return texts(spark, d, digest=F.md5(X.truncate_middle(F.col("text"))))


@query("SELECT doc_id, md5(replace(substring(text, 1, 500), chr(10), ' ')) AS digest FROM documents")
def preview_text(spark, d):
    return texts(spark, d, digest=F.md5(X.preview(F.col("text"))))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\[\d+(?:,\s*\d+)*\]', '', 'g'), '\s+', ' ', 'g'), {WS}, '', 'g')) AS digest FROM documents")
def drop_bracket_refs(spark, d):
    return texts(spark, d, digest=F.md5(X.drop_bracket_refs(F.col("text"))))


@query(r"SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s.,!?;:\-]', '', 'g'))) AS digest FROM documents")
def feature_clean(spark, d):
    return texts(spark, d, digest=F.md5(X.feature_clean(F.col("text"))))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), {WS}, '', 'g')) AS digest FROM documents")
def whitespace_squeeze(spark, d):
    return texts(spark, d, digest=F.md5(X.squeeze(F.col("text"))))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'slug-' || page_id ELSE url END AS slug FROM pages")
def article_slug(spark, d):
    """Every other page gets an article path behind its URL, every fourth with a slash at the end."""
    i = F.col("page_id")
    path = F.when(i % 2 == 0, F.concat(F.col("url"), F.lit("/article/n/slug-"), i.cast("string"), F.when(i % 4 == 0, "/").otherwise(""))).otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", X.article_slug(path).alias("slug"))


@query("SELECT doc_id, len(list_filter(string_split(text, ','), lambda x: trim(x) <> '')) AS parts FROM documents")
def comma_counts(spark, d):
    return texts(spark, d, parts=X.comma_count(F.col("text")))


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\d{4})', 1), '') AS INTEGER) AS year FROM documents")
def year_of_string(spark, d):
    return texts(spark, d, year=X.year_of(F.col("text")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 4 = 0 OR doc_id % 3 = 2 THEN 1 ELSE 2 END AS class FROM documents")
def true_class(spark, d):
    i = F.col("doc_id")
    return load(spark, d, "documents").select("doc_id", G.true_class(i % 3, i % 4 == 0).alias("class"))


VERDICTS = ("human", " Human", "человек", "mixed", "смешанный", "AI", "ИИ", "unclear")


@query("SELECT doc_id, CASE WHEN doc_id % 8 < 3 THEN 0 WHEN doc_id % 8 < 5 THEN 1 WHEN doc_id % 8 < 7 THEN 2 ELSE -1 END AS class FROM documents")
def verdict_class(spark, d):
    name = F.element_at(F.array(*map(F.lit, VERDICTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", G.verdict_class(name).alias("class"))


@query("SELECT event_id, CASE WHEN value > 30 THEN 'High' WHEN value > 15 THEN 'Medium' ELSE 'Low' END AS level FROM events")
def confidence_level(spark, d):
    return load(spark, d, "events").select("event_id", X.confidence_level(F.col("value")).alias("level"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 < 3 END AS flag FROM documents")
def bool_parse(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("true", " TRUE ", "1", "no"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", X.to_bool(F.when(F.col("doc_id") % 5 < 4, word)).alias("flag"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS number FROM documents")
def safe_numbers(spark, d):
    i = F.col("doc_id")
    return load(spark, d, "documents").select("doc_id", X.safe_long(F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, "n/a")).alias("number"))


@query(r"SELECT doc_id, round(coalesce(len(regexp_extract_all(text, '[a-zA-Z]')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 0), 6) AS share FROM documents")
def latin_share(spark, d):
    return texts(spark, d, share=r6(B.latin_ratio(F.col("text"))))


@query(rf"WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\s+', '') AS body, regexp_replace(left(text, CAST(5 + doc_id % 20 AS INTEGER)), {WS}, '', 'g') AS head FROM documents) SELECT doc_id, md5(CASE WHEN length(head) >= 12 AND starts_with(lower(body), lower(head)) THEN regexp_replace(substring(body, length(head) + 1), '^\s+', '') ELSE text END) AS digest FROM t")
def title_prefix(spark, d):
    """Texts without a title that is their own beginning, of 5 to 24 characters."""
    title = F.left(F.col("text"), (F.col("doc_id") % 20 + 5).cast("int"))
    return texts(spark, d, digest=F.md5(B.drop_title_prefix(F.col("text"), title)))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'AI' WHEN doc_id % 3 = 0 THEN 'HUMAN' END AS verdict, CASE WHEN doc_id % 3 <> 2 THEN doc_id END AS score FROM documents")
def answer_parse(spark, d):
    """Answers of a judge in fences, with words around them, or without any JSON."""
    i = F.col("doc_id")
    body = F.concat(F.lit('{"verdict": "'), F.when(i % 3 == 0, "HUMAN").otherwise("AI"), F.lit('", "score": '), i.cast("string"), F.lit("}"))
    answer = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" as asked"))).otherwise("no answer")
    found = X.parse_answer(answer, "verdict string, score bigint")
    return load(spark, d, "documents").select("doc_id", found["verdict"].alias("verdict"), found["score"].alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'rest ' || doc_id END AS rest FROM documents")
def refusal_removed(spark, d):
    """Texts with a service's refusal in capitals, alone or in front of a rest."""
    from ..functions import patterns as P

    i = F.col("doc_id")
    text = F.concat(F.lit(P.SERVICE_REFUSAL.upper() + " "), F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("rest "), i.cast("string"))))
    return load(spark, d, "documents").select("doc_id", X.drop_refusal(text).alias("rest"))


@query("SELECT word FROM (VALUES ('a'), ('the'), ('der'), ('le')) v(word)")
def stop_union(spark, d):
    return spark.createDataFrame([(w,) for w in C.stop_words(["the", "a"], ["der", "the"], ["le", "a"])], "word string")


# ---- spans, windows, masks --------------------------------------------------------------------------


@query("WITH s AS (SELECT doc_id, text, length(text) AS n, least(length(text), 10 + doc_id % 50) AS e, CASE WHEN doc_id % 10 > 5 THEN 'AI' ELSE 'HUMAN' END AS label FROM documents) SELECT doc_id, CAST(0 AS INTEGER) AS part, label, md5(left(text, CAST(e AS INTEGER))) AS digest FROM s UNION ALL SELECT doc_id, 1, 'NONE', md5(substring(text, e + 1)) FROM s WHERE n > e")
def ui_segments(spark, d):
    """One span from the start of each text, shown as parts."""
    i, n = F.col("doc_id"), F.length("text")
    span = F.struct(F.lit(0).alias("start"), F.least(n, (i % 50 + 10).cast("int")).alias("end"), (i % 10 / 10.0).alias("confidence"))
    return load(spark, d, "documents").select("doc_id", F.posexplode(S.segments(F.array(span), F.col("text"))).alias("part", "s")).select("doc_id", "part", "s.label", F.md5("s.text").alias("digest"))


WINDOW_SQL = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 128, 0) / 25) AS BIGINT) + 1)) AS k FROM w)"""


@query(f"WITH {WINDOW_SQL} SELECT doc_id, CAST(k AS INTEGER) AS window_index, CAST(k * 25 AS INTEGER) AS window_start, CAST(least(128, len(w) - k * 25) AS INTEGER) AS n, md5(coalesce(array_to_string(w[k * 25 + 1 : k * 25 + 128], ' '), '')) AS digest FROM st")
def token_windows(spark, d):
    """Windows of 128 words with four fifths of overlap over whole texts."""
    rows = V.token_windows(texts(spark, d, words=X.words(F.col("text"))), "doc_id", "words", 128, V.vote_step(128, 0.8))
    return rows.select("doc_id", "window_index", "window_start", F.size("window").alias("n"), F.md5(F.array_join("window", " ")).alias("digest"))


@query("SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS weight FROM documents")
def sampling_weight(spark, d):
    i = F.col("doc_id")
    labels = F.when(i % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(i % 3 == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    return load(spark, d, "documents").select("doc_id", V.sampling_weight(labels).alias("weight"))


@query(r"WITH m AS (SELECT doc_id, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 0.15)) AS masked FROM documents) SELECT doc_id, CAST(masked AS BIGINT) AS masked, CAST(greatest(1, floor(masked / 2)) AS BIGINT) AS spans FROM m")
def mask_plan(spark, d):
    plan = V.mask_plan(X.word_count(F.col("text")))
    return load(spark, d, "documents").select("doc_id", plan["masked"].cast("bigint").alias("masked"), plan["spans"].cast("bigint").alias("spans"))


@query("WITH s AS (SELECT doc_id, text, length(text) AS n, least(length(text), 20 + doc_id % 60) AS e FROM documents) SELECT doc_id, 0 AS \"start\", CAST(CASE WHEN e < n AND e >= greatest(30, n // 5) AND trim(substring(text, e + 1)) <> '' THEN n ELSE e END AS INTEGER) AS \"end\" FROM s")
def tail_repair(spark, d):
    """One span of 20 to 79 characters from the start of each text."""
    span = F.struct(F.lit(0).alias("start"), F.least(F.length("text"), (F.col("doc_id") % 60 + 20).cast("int")).alias("end"))
    return load(spark, d, "documents").select("doc_id", F.inline(S.repair_tail(F.array(span), F.col("text"))))


@query("""WITH r AS (SELECT doc_id, text, length(text) AS n, unnest([-5 + doc_id % 10, length(text) - 3, length(text) + 2]) AS a, unnest([15 + doc_id % 20, length(text) + 5, length(text) + 9]) AS b FROM documents),
c AS (SELECT doc_id, text, least(greatest(a, 0), n) AS a, least(greatest(b, 0), n) AS b FROM r)
SELECT doc_id, CAST(a AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end", md5(substring(text, a + 1, b - a)) AS digest FROM c WHERE b > a""")
def span_clamp(spark, d):
    """Spans that begin before a text, end behind it, or lie behind it."""
    i, n = F.col("doc_id"), F.length("text")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    rows = load(spark, d, "documents").select("doc_id", F.inline(S.clamp(F.array(span(i % 10 - 5, i % 20 + 15), span(n - 3, n + 5), span(n + 2, n + 9)), F.col("text"))))
    return rows.select("doc_id", "start", "end", F.md5("text").alias("digest"))


@query("SELECT doc_id, doc_id % 3 = 0 AND length(text) > 0 OR length(text) = 0 AND doc_id % 3 = 0 AS tiles FROM documents")
def tiling_check(spark, d):
    """Tilings that are whole, end early, or begin late."""
    i, n = F.col("doc_id"), F.length("text")
    piece = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit("ai").alias("label"))
    spans = F.when(i % 3 == 0, F.array(piece(F.lit(0), n))).when(i % 3 == 1, F.array(piece(F.lit(0), n - 1))).otherwise(F.array(piece(F.lit(1), n)))
    return load(spark, d, "documents").select("doc_id", S.tiles_exactly(spans, n).alias("tiles"))


@query("WITH s AS (SELECT doc_id, k AS a, doc_id * (k + 3) * 37 % 100 / 100.0 AS c FROM documents, range(8) r(k)), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, a) AS place FROM s) SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(a AS INTEGER) AS \"start\", c AS confidence FROM t WHERE place <= 5")
def top_spans(spark, d):
    """The five surest of eight spans a document."""
    i = F.col("doc_id")
    spans = F.array(*(F.struct(F.lit(k).alias("start"), F.lit(k + 1).alias("end"), (i * (k + 3) * 37 % 100 / 100.0).alias("confidence")) for k in range(8)))
    return load(spark, d, "documents").select("doc_id", F.posexplode(S.top(spans)).alias("p", "s")).select("doc_id", (F.col("p") + 1).alias("place"), "s.start", "s.confidence")


@query("""WITH a AS (SELECT doc_id, text, 'made ' || doc_id AS g, length(text) // 4 AS s, length(text) // 2 AS e, doc_id % 3 AS m FROM documents),
b AS (SELECT doc_id, g, CASE m WHEN 0 THEN g WHEN 1 THEN text || ' ' || g ELSE left(text, CAST(s AS INTEGER)) || g || substring(text, e + 1) END AS t, CASE m WHEN 0 THEN 0 WHEN 1 THEN length(text) + 1 ELSE s END AS f FROM a)
SELECT doc_id, md5(t) AS digest, CAST(f AS INTEGER) AS "start", CAST(f + length(g) AS INTEGER) AS "end", round(length(g) / length(t), 3) AS fraction FROM b""")
def synthetic_assembly(spark, d):
    """A made text in place of the whole, behind it, or in place of its second quarter."""
    i, n = F.col("doc_id"), F.length("text")
    mode = F.when(i % 3 == 0, "replace_full").when(i % 3 == 1, "append").otherwise("replace_fragment")
    made = K.assemble(F.col("text"), F.concat(F.lit("made "), i.cast("string")), F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), mode)
    return load(spark, d, "documents").select("doc_id", made.alias("m")).select("doc_id", F.md5("m.text").alias("digest"), "m.start", "m.end", "m.fraction")


# ---- scoring ----------------------------------------------------------------------------------------


@query(f"WITH {SIGNAL_SQL} SELECT doc_id, array_to_string(list_filter([CASE WHEN spans > 0 THEN 'spans: ' || spans END, CASE WHEN curv > 5 THEN 'high curvature' WHEN curv > 2 THEN 'medium curvature' END, CASE WHEN NOT ok THEN 'audit failed' END, CASE WHEN dp THEN 'defense found human marks' END], lambda x: x IS NOT NULL), '; ') AS signals FROM r")
def signal_list(spark, d):
    rows = G.decide(G.judge(G.combine(signals(spark, d))))
    return rows.select("doc_id", F.array_join("signals", "; ").alias("signals"))


FUSED_SQL = r"""SELECT doc_id, CAST(doc_id % 2 AS BIGINT) AS n_spans, round(CASE WHEN doc_id % 2 = 1 THEN doc_id % 10 / 10.0 ELSE 0 END, 6) AS mean_span_confidence,
round(least(1.0, coalesce((doc_id % 2) * least(length(text), 30) / nullif(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 0), 0)), 6) AS doc_score_raw,
round(least(1.0, coalesce((doc_id % 2) * least(length(text), 30) / nullif(length(text), 0), 0)), 6) AS ai_char_ratio, CASE WHEN doc_id % 3 = 0 THEN 'AI' ELSE 'MIXED' END AS verdict FROM documents"""


@query(FUSED_SQL)
def fused_signals(spark, d):
    """All signals joined, with fallbacks: every other document has a span, every third a verdict, none an audit."""
    docs, i = load(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    spans = docs.filter(i % 2 == 1).select("doc_id", (i % 10 / 10.0).alias("avg_confidence"), F.lit(0).alias("start_char"), F.least(F.length("text"), F.lit(30)).alias("end_char"))
    verdicts = docs.filter(i % 3 == 0).select("doc_id", F.lit("AI").alias("verdict"), F.lit(0.9).alias("confidence"))
    none = lambda columns: spark.createDataFrame([], f"doc_id bigint, {columns}")
    rows = G.calibrate(docs, verdicts, spans, none("curvature double"), none("audit_passed boolean, audit_verdict string"), none("defense_possible boolean, defense_verdict string"))
    return rows.select("doc_id", F.col("n_spans").cast("bigint").alias("n_spans"), *(r6(F.col(c)).alias(c) for c in ("mean_span_confidence", "doc_score_raw", "ai_char_ratio")), "verdict")


@query("WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 / 7.0 END AS a, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 11 / 11.0 END AS b FROM documents) SELECT doc_id, round(coalesce(a * 0.65 + b * 0.35, a, b, 0.5), 6) AS score FROM s")
def prototype_score(spark, d):
    i = F.col("doc_id")
    return load(spark, d, "documents").select("doc_id", r6(G.prototype_score(F.when(i % 5 != 0, i % 7 / 7.0), F.when(i % 4 != 0, i % 11 / 11.0))).alias("score"))


@query("WITH s AS (SELECT doc_id, doc_id % 2 AS n, doc_id % 150 AS l, doc_id % 31 AS c FROM documents) SELECT doc_id, CASE WHEN n > 0 THEN CASE WHEN c > 10 OR l > 100 THEN 'AI' ELSE 'MIXED' END WHEN c > 5 THEN 'MIXED' ELSE 'HUMAN' END AS verdict, CAST(CASE WHEN n > 0 THEN CASE WHEN c > 10 OR l > 100 THEN 0.8 ELSE 0.6 END WHEN c > 5 THEN 0.6 ELSE 0.7 END AS DOUBLE) AS confidence FROM s")
def rule_verdict(spark, d):
    i = F.col("doc_id")
    verdict, confidence = G.rule_verdict(i % 2, i % 150, i % 31)
    return load(spark, d, "documents").select("doc_id", verdict.alias("verdict"), confidence.alias("confidence"))


@query("SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag <> 'N') AS n_tokens, round(coalesce(sum(-l_quantity) FILTER (l_returnflag <> 'N'), 0), 6) AS total, round(coalesce(avg(-l_quantity) FILTER (l_returnflag <> 'N'), 0), 6) AS mean FROM lineitem GROUP BY 1")
def sequence_log_probs(spark, d):
    """Order lines as tokens, minus the quantity as log-probability, flag N as padding."""
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (-F.col("l_quantity")).alias("lp"), (F.col("l_returnflag") == "N").alias("pad"))
    return G.sequence_log_probs(rows, "doc_id", "lp", F.col("pad")).select("doc_id", "n_tokens", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"))


# ---- record and corpus reports ----------------------------------------------------------------------


@query("SELECT source, count(*) AS n, round(avg(CAST(n_chars > 1000 AS INTEGER)) * 100, 1) AS pct FROM documents GROUP BY source")
def text_coverage(spark, d):
    return A.coverage_by(load(spark, d, "documents"), "source", F.col("n_chars") > 1000)


FLAGS = {"english": "lang = 'en'", "long": "n_chars > 500", "even": "doc_id % 2 = 0"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS flag, count(*) FILTER ({t}) AS total, round(count(*) FILTER ({t}) * 100.0 / count(*), 1) AS pct FROM documents" for n, t in FLAGS.items()))
def index_flags(spark, d):
    return A.flag_totals(load(spark, d, "documents"), {n: F.expr(t) for n, t in FLAGS.items()})


@query("SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_rows FROM (SELECT doc_id // 4 AS a, count(*) AS n FROM documents GROUP BY 1)")
def chunk_means(spark, d):
    return A.mean_per_group(chunk_rows(spark, d), "article_id")


@query("WITH c AS (SELECT count(*) FILTER (doc_id % 3 = 0) AS h, count(*) FILTER (doc_id % 3 <> 0) AS m FROM documents), r AS (SELECT '__all__' AS strategy, m AS n, h * 2 AS expected FROM c UNION ALL SELECT 'rewrite_full', m, h FROM c UNION ALL SELECT 'continue_tail', 0, h FROM c) SELECT *, expected - n AS missing, round(coalesce(n * 100.0 / nullif(expected, 0), 0), 1) AS pct FROM r")
def generation_coverage(spark, d):
    return C.generation_coverage(chunk_rows(spark, d), ["rewrite_full", "continue_tail"])


@query(f"WITH {AUDIT_SQL}, f AS (SELECT CASE WHEN ch.label = 0 THEN 'original' ELSE 'rewrite_full' END AS strategy, unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['__no_flags__'] END) AS flag FROM fl JOIN ch USING (chunk_id) WHERE NOT dropped), c AS (SELECT strategy, flag, count(*) AS n FROM f GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY strategy ORDER BY n DESC, flag) AS INTEGER) AS place FROM c")
def strategy_flags(spark, d):
    return R.flag_matrix(R.audit(chunk_rows(spark, d)).filter("status <> 'drop'"), "strategy", "flags")


SUMMARY_SQL = f"""WITH {CHUNK_SQL}, x AS (SELECT *, CASE WHEN label = 0 THEN 'original' ELSE 'rewrite_full' END AS strategy, label * n // 2 AS part FROM ch),
s AS (SELECT 'label' AS section, CAST(label AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY label UNION ALL SELECT 'strategy', strategy, count(*) FROM x GROUP BY strategy
UNION ALL SELECT 'dataset', 'rows', count(*) FROM x UNION ALL SELECT 'dataset', 'overall_ratio', round(coalesce(sum(part) / nullif(sum(n), 0), 0), 6) FROM x
""" + " ".join(f"UNION ALL SELECT '{c}_stats', '{name}', round(CAST({f}({c}) AS DOUBLE), 6) FROM x" for c in ("n", "judge_avg") for name, f in (("count", "count"), ("min", "min"), ("mean", "avg"), ("median", "median"), ("max", "max"), ("std", "stddev_pop"))) + ") SELECT * FROM s"


@query(SUMMARY_SQL)
def dataset_report(spark, d):
    rows = chunk_rows(spark, d).select("label", "strategy", "judge_avg", F.length("text").alias("n"), F.floor(F.col("label") * F.length("text") / 2).alias("part"))
    return R.dataset_summary(rows, ["label", "strategy"], ["n", "judge_avg"], "part", "n")


def labelled_windows(spark, d):
    """Windows of 128 words, half overlapping, with labels by place: B at every 200th word, I at the nine after it. The split is doc_id mod 3."""
    words = F.size(X.words(F.col("text")))
    rows = load(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("split"), words.alias("total"))
    rows = rows.select("doc_id", "split", "total", F.explode(V.window_starts(F.col("total"), 128, 64)).alias("a"))
    size = F.least(F.lit(128), F.col("total") - F.col("a"))
    places = F.when(size > 0, F.sequence(F.col("a"), F.col("a") + size - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select("split", "doc_id", F.transform(places, lambda t: F.when(t % 200 == 0, 1).when(t % 200 < 10, 2).otherwise(0)).alias("labels"))


LABELLED_SQL = r"""w AS (SELECT doc_id, doc_id % 3 AS split, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS total FROM documents),
k AS (SELECT doc_id, split, total, unnest(range(0, CAST(ceil(greatest(total - 128, 0) / 64) AS BIGINT) + 1)) * 64 AS a FROM w),
l AS (SELECT doc_id, split, list_transform(range(a, least(a + 128, total)), lambda t: CASE WHEN t % 200 = 0 THEN 1 WHEN t % 200 < 10 THEN 2 ELSE 0 END) AS labels FROM k),
m AS (SELECT *, len(list_filter(labels, lambda x: x = 0)) AS o, len(list_filter(labels, lambda x: x = 1)) AS b, len(list_filter(labels, lambda x: x = 2)) AS i FROM l),
g AS (SELECT split, doc_id, count(*) AS n, max(CAST(b + i > 0 AS INTEGER)) AS ai, sum(CAST(b + i > 0 AS INTEGER)) AS wa, sum(CAST(b > 0 AS INTEGER)) AS wb, sum(o) AS o, sum(b) AS b, sum(i) AS i FROM m GROUP BY split, doc_id)"""


@query(f"WITH {LABELLED_SQL} SELECT split, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_windows, round(avg(n), 6) AS avg_windows, max(n) AS max_windows, count(*) FILTER (n > 1) AS multi_window_documents, CAST(sum(ai) AS BIGINT) AS docs_with_ai, CAST(sum(wa) AS BIGINT) AS windows_with_ai, CAST(sum(wb) AS BIGINT) AS windows_with_b_ai, CAST(sum(o) AS BIGINT) AS tokens_o, CAST(sum(b) AS BIGINT) AS tokens_b, CAST(sum(i) AS BIGINT) AS tokens_i, CAST(0 AS BIGINT) AS tokens_ignored FROM g GROUP BY split")
def window_summary(spark, d):
    return V.window_summary(labelled_windows(spark, d), "split", "doc_id")


@query(f"WITH {LABELLED_SQL} SELECT split, bool_or(b > 0) AS has_b, bool_or(i > 0) AS has_i FROM g GROUP BY split")
def split_labels(spark, d):
    return V.split_labels(labelled_windows(spark, d), "split")


PREPARED_SQL = f"""WITH {AUDIT_SQL}, cl AS (SELECT rv.chunk_id FROM rv WHERE len(remaining) = 0),
rk AS (SELECT ch.*, row_number() OVER (PARTITION BY text ORDER BY coalesce(judge_avg, -1) DESC, CASE label WHEN 2 THEN 2 WHEN 0 THEN 1 ELSE 0 END DESC, chunk_id) AS place FROM ch JOIN cl USING (chunk_id)),
kept AS (SELECT * FROM rk WHERE place = 1),
g AS (SELECT article_id, row_number() OVER (ORDER BY md5(article_id || '|42')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT article_id FROM kept)),
sizes AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round(n * 0.1)) ELSE round(n * 0.1) END AS size FROM g)
SELECT chunk_id, CASE WHEN r <= size THEN 'test' WHEN r <= 2 * size THEN 'validation' ELSE 'train' END AS split FROM kept JOIN sizes USING (article_id)"""


@query(PREPARED_SQL)
def prepared_records(spark, d):
    """Derived chunks through audit, review, best of equal texts and split, in one go."""
    return R.prepare(chunk_rows(spark, d), check=False).select("chunk_id", "split")


@query(f"{FLAGS_SQL} SELECT issue, count(*) AS count FROM (SELECT unnest(list_concat(issues, fatal)) AS issue FROM v) GROUP BY issue")
def issue_counts(spark, d):
    """How often each issue of the audit occurs."""
    return R.issue_counts(R.audit(chunk_rows(spark, d)))


@query()
def prose_audit(spark, d):
    """Diagnostics of every text before the second cleaner."""
    return load(spark, d, "documents").select("doc_id", *(v.alias(k) for k, v in CL.audit_prose(F.col("text")).items()))


@query()
def academic_fields(spark, d):
    """Fields of an article page of an academic portal; these tables have the article element only."""
    return AC.academic_pages(load(spark, d, "pages"))


# ---- models -----------------------------------------------------------------------------------------


@query()
def feature_importance(spark, d):
    """Numeric features in a random forest on quality."""
    rows = features(spark, d).join(load(spark, d, "labels"), "doc_id")
    return E.forest_importance(rows, CORR, "quality")


@query()
def cross_validation(spark, d):
    """Accuracy of the text model in each of five folds."""
    return E.cross_validated_text(labelled_texts(spark, d), "doc_id", numbers=tuple(CORR), stop=STOP)


@query()
def term_weights(spark, d):
    """Words and pairs of the text model by the size of their weights."""
    rows = labelled_texts(spark, d)
    return E.term_weights(E.text_model(rows, numbers=tuple(CORR), stop=STOP), rows)
