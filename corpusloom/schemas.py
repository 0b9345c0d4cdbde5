"""Schemas of the records that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


#: Columns of the unified article table and their types.
ARTICLE_FIELDS = [("id", "bigint"), ("source", "string"), ("source_name", "string"), ("title", "string"), ("authors", "string"), ("authors_count", "bigint"), ("year", "bigint"), ("url", "string"), ("description", "string"), ("text", "string"), ("text_length", "bigint"), ("text_source", "string"), ("query", "string"), ("language", "string")]
ARTICLE_COLUMNS = [c for c, _ in ARTICLE_FIELDS]
ARTICLE = ", ".join(f"{c} {t}" for c, t in ARTICLE_FIELDS)
ACADEMIC = "id int, article_id string, url string, title string, authors string, authors_count int, year int, journal string, annotation string, keywords string, keywords_count int, rsci boolean, vak boolean, scopus boolean, text string, text_length int, text_source string, topic string"
FEED_ITEM = "id string, source string, title string, url string, published_at string, content string"
PAGE = "url string, source_name string, title string, published_at string, text string, error string"
SPAN = "struct<start:int,end:int>"
LABELLED_SPAN = "struct<start:int,end:int,label:string>"
CHUNK = "article_id string, chunk_id string, text string, label int, ai_spans_json string, ai_span_start_char int, ai_span_end_char int, ai_span_start_word int, ai_span_end_word int, ai_fraction double, has_mixed_content string, strategy string, source_model string, judge_semantic_score double, judge_complexity_score double, judge_avg double, word_count int, char_count int, chunk_index int, total_chunks int, original_chunk_id string, created_at string"
RECORD = f"id string, group_id string, source_id string, text string, spans array<{LABELLED_SPAN}>, quality struct<status:string,flags:array<string>>, split string"
ISSUE = "chunk_id string, article_id string, status string, fatal_issues array<string>, issues array<string>"
WINDOW = "id string, group_id string, source_id string, split string, window_id string, window_index int, labels array<int>, offset_mapping array<array<int>>, window_char_start int, window_char_end int, ai_spans array<array<int>>"
VOTE = "doc_id bigint, window_start int, token_idx int, start_char int, end_char int, label string, prob double"
DETECTED_SPAN = "struct<start_char:int,end_char:int,text:string,num_tokens:int,avg_confidence:double,min_confidence:double,max_confidence:double>"
CURVATURE = "struct<log_prob:double,mean_perturbed:double,std_perturbed:double,curvature:double,n:bigint>"
VERDICT = "doc_id bigint, verdict string, probability double, confidence double"
AUDIT = "doc_id bigint, passed boolean, adjusted_verdict string"
DEFENSE = "doc_id bigint, would_overturn boolean, probability double, defended_verdict string"
RESULT = f"doc_id bigint, final_probability double, confidence double, risk_level string, needs_review boolean, explanation string, signals array<string>, spans array<{DETECTED_SPAN}>"
REVIEW_ROW = "movie_name string, date date, content string, prompt_type string, model string, is_generated boolean"
FAILURE = "chunk_id string, article_id string, strategy string, reason string, attempts_made int, best_avg_score double, original_text_preview string, created_at string"
#: Label alphabet of the token classifier.
TOKEN_LABELS = {"O": 0, "B-AI": 1, "I-AI": 2}
IGNORE = -100


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, columns) -> DataFrame:
    """The frame itself; raises when a required column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def token_label_ids(name):
    """Number of a token label name, IGNORE for anything else."""
    out = F.lit(IGNORE)
    for k, v in TOKEN_LABELS.items():
        out = F.when(name == k, v).otherwise(out)
    return out
