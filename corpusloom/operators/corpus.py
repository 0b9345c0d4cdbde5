"""Corpus hygiene: one schema, removal with reasons, deduplication that names its survivor, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import ARTICLE_COLUMNS, ARTICLE_FIELDS
from .prefix import RANGES, cuts, range_of

#: Columns of older files and their present names.
RENAMES = {"annotation": "description", "topic": "query", "author": "authors"}
QUOTE_PAGES = r"(?i)/(?:quote|quotes|ticker|currency)(?:/|$)"


def union_all(*frames: DataFrame, mark: str = "source_ord") -> DataFrame:
    """All rows, each with the number of the frame that it came from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn(mark, F.lit(k)) for k, f in enumerate(frames)))


def align(df: DataFrame) -> DataFrame:
    """Older names to present ones; missing article columns filled with 0 or an empty string; other columns stay at the end."""
    for old, new in RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    own = [(F.col(c) if c in df.columns else F.lit(0 if t == "bigint" else "")).cast(t).alias(c) for c, t in ARTICLE_FIELDS]
    return df.select(*own, *(c for c in df.columns if c not in ARTICLE_COLUMNS))


def normalize_rows(df: DataFrame) -> DataFrame:
    """Article rows with empty strings for nulls; year, author count and length derived where they are missing."""
    df = align(df)
    text = X.blank(F.col("text"))
    fixed = {"year": F.coalesce(F.when(F.col("year") != 0, F.col("year")), X.year_of(F.col("published_at")).cast("bigint") if "published_at" in df.columns else F.lit(0), F.lit(0)), "authors_count": F.when(F.coalesce(F.col("authors_count"), F.lit(0)) != 0, F.col("authors_count")).otherwise(X.comma_count(F.col("authors"))), "text_length": F.when(F.coalesce(F.col("text_length"), F.lit(0)) != 0, F.col("text_length")).otherwise(F.length(text).cast("bigint"))}
    return df.withColumns({c: X.blank(F.col(c)) for c, t in ARTICLE_FIELDS if t == "string"} | fixed)


def keep_first(df: DataFrame, key, order) -> DataFrame:
    """One row for each key: the first by `order`, which must tell rows apart."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, key: str, stamp: str, order: str) -> DataFrame:
    """The newest row of each key; rows without a time count as oldest."""
    return keep_first(df, key, [F.col(stamp).desc_nulls_last(), F.col(order).desc()])


def reindex(df: DataFrame, order: str, name: str = "id", ranges: int = RANGES, bucket: int | None = None) -> DataFrame:
    """Numbers 1..n in the order of a numeric column, without one task for all rows; rows without a value come last.

    Rows are numbered within ranges of the column, cut at its quantiles; the ranges' sizes are added up from a
    table of one row a range. With `bucket`, a range has about so many rows, two to `ranges` ranges in all.
    """
    if bucket is not None:
        ranges = max(2, min(ranges, -(-df.count() // bucket)))
    ranged = df.withColumn("_range", range_of(F.col(order).cast("double"), cuts(df, order, ranges)))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(order)))
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], name: str = "remove_reason") -> DataFrame:
    """Adds the name of the first rule that removes a row, null where none does."""
    reason = F.lit(None).cast("string")
    for label, test in reversed(rules):
        reason = F.when(F.coalesce(test, F.lit(False)), label).otherwise(reason)
    return df.withColumn(name, reason)


def split_ledger(df: DataFrame, name: str = "remove_reason") -> tuple[DataFrame, DataFrame]:
    """Kept rows, and the ledger of removed ones."""
    return df.filter(F.col(name).isNull()).drop(name), df.filter(F.col(name).isNotNull())


def page_rules(url: str = "url", html: str = "html", title: str = "title") -> list[tuple[str, Column]]:
    """Rules of a crawl in their order: no URL, not the first of its URL, no title, markup only."""
    return [("empty_url", F.trim(X.blank(F.col(url))) == ""), ("duplicate_url", F.col("url_rank") > 1), ("empty_title", F.trim(X.blank(F.col(title))) == ""), ("html_only", X.html_only(F.col(html)))]


def url_ranked(df: DataFrame, url: str, order: str) -> DataFrame:
    """Adds norm_url and url_rank, 1 for the first row of a URL; rows without a URL have no rank and are not sorted together."""
    df = df.withColumn("norm_url", X.normalize_url(F.col(url)))
    alone = F.when(F.col("norm_url") == "", F.xxhash64(order))
    return df.withColumn("url_rank", F.when(F.col("norm_url") != "", F.row_number().over(Window.partitionBy("norm_url", alone).orderBy(order))))


def export_rules(least: int = 300, shell: str | None = None) -> list[tuple[str, Column]]:
    """Rules of an export: quote pages, blank texts, short texts, rows of one source without title and text."""
    empty = F.trim(X.blank(F.col("text"))) == ""
    rules = [("quote_page", X.blank(F.col("url")).rlike(QUOTE_PAGES)), ("empty_text", empty), ("short_text", F.length(X.blank(F.col("text"))) < least)]
    return rules + ([("shell_row", (F.col("source") == shell) & empty & (F.trim(X.blank(F.col("title"))) == ""))] if shell else [])


def tasks_left(chunks: DataFrame, strategies: DataFrame, done: DataFrame, key: str = "chunk_id", most: int = 1000) -> DataFrame:
    """Chunk and strategy pairs whose derived id isn't done: a broadcast of up to `most` strategies, a distributed product beyond."""
    few = strategies.limit(most + 1).count() <= most
    pairs = chunks.crossJoin(F.broadcast(strategies) if few else strategies).withColumn("task_id", F.concat_ws("__", F.col(key).cast("string"), F.col("strategy")))
    return pairs.join(done.select("task_id"), "task_id", "left_anti")


def common_keys(a: DataFrame, b: DataFrame, key: str, least_a: int, exactly_b: int) -> DataFrame:
    """Keys with at least `least_a` rows in one frame and exactly `exactly_b` in the other."""
    count = lambda df, test: df.groupBy(key).count().filter(test).select(key)
    return count(a, F.col("count") >= least_a).intersect(count(b, F.col("count") == exactly_b))


def feed_items(items: DataFrame, most: int) -> DataFrame:
    """Of already fetched feed items: the first of each URL in a source, feeds in order, at most so many a source."""
    first = keep_first(items, ["source", "url"], [F.col("feed_ord"), F.col("pos")])
    rank = F.row_number().over(Window.partitionBy("source").orderBy("feed_ord", "pos"))
    return first.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def russian_rows(df: DataFrame, title: str = "title", language: str = "language") -> DataFrame:
    return df.filter((F.col(language) == "ru") | X.blank(F.col(title)).rlike("[А-Яа-яЁё]"))


def prefer_full_text(short, full) -> Column:
    """The full text where it is long and isn't a browser notice."""
    return F.when((F.length(full) > 200) & ~F.lower(F.substring(full, 1, 200)).contains("browser"), full).otherwise(short)


def requests(df: DataFrame, kind: str = "content_type", body: str = "text") -> tuple[DataFrame, DataFrame]:
    """Valid requests with stripped texts, and rejected ones with a reason."""
    df = df.withColumn(body, X.strip(F.col(body)))
    return split_ledger(with_reason(df, [("not_pdf", (F.col(kind) != "text") & (F.col(kind) != "application/pdf")), ("empty_text", X.blank(F.col(body)) == "")]))


def generation_coverage(df: DataFrame, strategies: list[str], key: str = "chunk_id", label: str = "label", strategy: str = "strategy") -> DataFrame:
    """(strategy, n, expected, missing, pct) for each strategy and `__all__`: generated chunks (label 1 or 2) against one for each human chunk (label 0)."""
    made = F.col(label).isin(1, 2)
    aggs = [F.count_distinct(F.when(F.col(label) == 0, F.col(key))).alias("_human"), F.count(F.when(made, 1)).alias("_all"), *(F.count(F.when(made & (F.col(strategy) == s), 1)).alias(f"_s{k}") for k, s in enumerate(strategies))]
    row = lambda name, n, want: F.struct(F.lit(name).alias("strategy"), n.alias("n"), want.alias("expected"), (want - n).alias("missing"), F.round(F.coalesce(F.try_divide(n * 100.0, want), F.lit(0.0)), 1).alias("pct"))
    rows = [row("__all__", F.col("_all"), F.col("_human") * len(strategies)), *(row(s, F.col(f"_s{k}"), F.col("_human") * 1) for k, s in enumerate(strategies))]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def stop_words(*lists: list[str]) -> list[str]:
    """The words of all lists, each once, in order of first occurrence."""
    return list(dict.fromkeys(w for words in lists for w in words))
