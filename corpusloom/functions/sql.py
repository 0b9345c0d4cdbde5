r"""The functions most used in SQL, as temporary SQL functions: Catalyst inlines them, nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "normalize_url(u STRING) RETURNS STRING": r"regexp_replace(lower(trim(coalesce(u, ''))), '/+$', '')",
    "word_count(t STRING) RETURNS BIGINT": r"cast(regexp_count(coalesce(t, ''), '(?U)\\S+') AS BIGINT)",
    "strip_tags(h STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(coalesce(h, ''), '<[^>]+>', ' '), '(?U)\\s+', ' '), '^ | $', '')",
    "flatten_lines(t STRING) RETURNS STRING": r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '[\\r\\n]+', ' '), '\\t+', ' '), ' {2,}', ' '))",
    "ui_bucket(s DOUBLE) RETURNS STRING": "CASE WHEN s IS NULL OR s = 0 THEN 'none' WHEN s > 75 THEN 'ai' WHEN s > 35 THEN 'mixed' ELSE 'human' END",
    "risk_level(p DOUBLE) RETURNS STRING": "CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'medium' ELSE 'high' END",
    "verdict_probability(v STRING, c DOUBLE) RETURNS DOUBLE": "0.5 + (CASE v WHEN 'HUMAN' THEN 0.0 WHEN 'AI' THEN 1.0 ELSE 0.5 END - 0.5) * c",
}
#: A table function: the lines of a text with their places.
TABLES = {"text_lines(t STRING) RETURNS TABLE (pos INT, line STRING)": r"SELECT pos, line FROM (SELECT posexplode(split(coalesce(t, ''), '\n')) AS (pos, line))"}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in a session; returns their names."""
    for head, body in (FUNCTIONS | TABLES).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in (*FUNCTIONS, *TABLES)]
