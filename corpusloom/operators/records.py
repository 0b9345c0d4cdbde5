"""Labelled chunks: audit, review policy, exact duplicates, leakage-free split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions import text as X

#: Flags that quarantine a record, and those that only mean wrong metadata.
QUARANTINE = ("low_judge_avg", "prompt_leak_pattern", "missing_judge_avg_for_synthetic", "reported_char_count_mismatch", "reported_word_count_mismatch", "ai_fraction_mismatch", "too_short_text")
METADATA = ("reported_char_count_mismatch", "reported_word_count_mismatch")
SOFT = (*METADATA, "ai_fraction_mismatch", "missing_judge_avg_for_synthetic", "too_short_text", "exact_duplicate_text")


@dataclass(frozen=True)
class Policy:
    """Which flags a review may resolve."""

    ignore_metadata: bool = True
    allow_topics: bool = True
    allow_fraction: bool = True
    allow_missing_judge: bool = True
    relaxed_judge: float = 2.0
    short_but_kept: int = 180
    confirm_leaks: bool = True
    deduplicate: bool = True
    allow_remaining_soft: bool = False


def listed(*pairs) -> Column:
    """Sorted names of the tests that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(test, name) for name, test in pairs)))))


def audit(df: DataFrame, low_judge: float = 3.0) -> DataFrame:
    """Adds spans, ai_fraction_derived, issues, fatal_issues and status (clean, quarantine, drop) to chunks."""
    c, text = F.col, X.blank(F.col("text"))
    df = df.withColumn("_p", S.parse_spans(F.col("ai_spans_json")))
    n, given = F.length(text), F.col("_p.spans")
    full = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    bounds = F.array(F.struct(c("ai_span_start_char").alias("start"), c("ai_span_end_char").alias("end")))
    restorable = c("ai_span_start_char").isNotNull() & c("ai_span_end_char").isNotNull()
    none = F.expr(S.EMPTY)
    raw = F.when(c("label") == 0, none).when(c("label") == 1, full).when(c("label") == 2, F.when(F.size(given) > 0, given).when(given.isNotNull() & restorable, bounds))
    df = df.withColumn("_raw", raw).withColumn("_bad", F.coalesce(S.invalid(F.col("_raw"), n), F.array().cast("array<string>")))
    usable = F.col("_raw").isNotNull() & (F.size("_bad") == 0)
    df = df.withColumn("spans", F.when(usable, S.merge(F.col("_raw")))).withColumn("ai_fraction_derived", S.fraction(F.col("spans"), n))
    fatal = F.concat(
        listed(("empty_text", text == ""), ("invalid_label", ~F.coalesce(c("label").isin(0, 1, 2), F.lit(False))), ("label_1_with_empty_text", (c("label") == 1) & (n == 0)), ("label_2_but_ai_spans_unavailable", (c("label") == 2) & given.isNull()), ("label_2_without_ai_spans", (c("label") == 2) & (F.size(given) == 0) & ~restorable), ("suspected_refusal_text", X.has_refusal(c("text")))),
        F.array_compact(F.array(c("_p.error"))), c("_bad"),
    )
    mixed = F.lower(F.coalesce(c("has_mixed_content").cast("string"), F.lit(""))).isin("true", "1")
    synthetic = ~((X.blank(c("strategy")) == "original") & (F.lower(X.blank(c("source_model"))) == "human")) | c("label").isin(1, 2)
    touch = S.overlaps(F.col("_raw"))
    issues = F.concat(
        listed(
            ("reported_char_count_mismatch", c("char_count") != n), ("reported_word_count_mismatch", F.abs(c("word_count") - X.word_count(c("text"))) > 3),
            ("label_0_but_ai_spans_present", (c("label") == 0) & (F.size(given) > 0)), ("label_1_but_ai_spans_not_full_text", (c("label") == 1) & (F.size(given) > 0) & (given != full)),
            ("label_2_ai_span_restored_from_start_end_char", (c("label") == 2) & (F.size(given) == 0) & restorable), ("ai_fraction_mismatch", usable & (F.abs(c("ai_fraction") - c("ai_fraction_derived")) > 0.08)),
            ("label_2_but_has_mixed_content_not_true", (c("label") == 2) & ~mixed), ("non_mixed_label_but_has_mixed_content_true", c("label").isin(0, 1) & mixed),
            ("overlapping_spans_merged", usable & touch["overlap"]), ("adjacent_spans_merged", usable & touch["adjacent"]),
            ("prompt_leak_pattern", X.has_prompt_leak(c("text"))), ("missing_judge_avg_for_synthetic", synthetic & c("judge_avg").isNull()), ("low_judge_avg", synthetic & (c("judge_avg") < low_judge)), ("too_short_text", n < 50),
        ),
        F.transform(X.topic_flags(c("text"), P.TOPICS), lambda t: F.concat(F.lit("topic_flag_"), t)),
    )
    df = df.withColumn("fatal_issues", F.array_sort(F.array_distinct(fatal))).withColumn("issues", F.array_sort(issues))
    flags = F.filter("issues", lambda x: x.isin(*QUARANTINE) | x.startswith("topic_flag_"))
    status = F.when(F.size("fatal_issues") > 0, "drop").when(F.size(flags) > 0, "quarantine").otherwise("clean")
    return df.withColumn("flags", flags).withColumn("status", status).drop("_p", "_raw", "_bad")


def records(audited: DataFrame) -> DataFrame:
    """Canonical records of chunks that weren't dropped, with spans that tile the text."""
    source = F.when(X.blank(F.col("original_chunk_id")) != "", F.col("original_chunk_id")).otherwise(F.col("chunk_id"))
    group = F.when(X.blank(F.col("article_id")) != "", F.col("article_id")).otherwise(source)
    kept = audited.filter(F.col("status") != "drop")
    return kept.select(F.col("chunk_id").alias("id"), group.alias("group_id"), source.alias("source_id"), "text", S.tile(F.col("spans"), F.length("text")).alias("spans"), "label", "strategy", "judge_avg", F.length("text").alias("char_count"), F.struct("status", "flags").alias("quality"))


def flag_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds text_hash, copies and is_duplicate: exact texts, counted over the whole frame.

    Hashes are counted, partly before they travel, and only those with copies are joined back: no task holds all rows of a text.
    """
    hashed = df.withColumn("text_hash", F.sha2(X.blank(F.col(text)), 256))
    counts = hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return hashed.join(counts, "text_hash", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint"))).withColumn("is_duplicate", F.col("copies") > 1)


def is_soft(flag) -> Column:
    return flag.isin(*SOFT) | flag.startswith("topic_flag_")


def review(df: DataFrame, policy: Policy = Policy(), flags: str = "flags") -> DataFrame:  # noqa: B008
    """Adds resolved_flags, remaining_flags and the reviewed status of records with flags, judge_avg, char_count and text."""
    own, df = F.col(flags), df.withColumn("_leak", X.has_prompt_leak(F.col("text")) if policy.confirm_leaks else F.lit(True))
    tests = [
        lambda x: x.isin(*METADATA) & policy.ignore_metadata,
        lambda x: x.startswith("topic_flag_") & policy.allow_topics,
        lambda x: (x == "ai_fraction_mismatch") & policy.allow_fraction,
        lambda x: (x == "missing_judge_avg_for_synthetic") & policy.allow_missing_judge,
        lambda x: (x == "low_judge_avg") & F.coalesce(F.col("judge_avg") >= policy.relaxed_judge, F.lit(False)),
        lambda x: (x == "too_short_text") & (F.col("char_count") >= policy.short_but_kept),
        lambda x: (x == "prompt_leak_pattern") & ~F.col("_leak"),
        lambda x: (x == "exact_duplicate_text") & policy.deduplicate,
    ]

    def resolved(x):
        out = F.lit(False)
        for test in tests:
            out = out | test(x)
        return out

    df = df.withColumn("resolved_flags", F.array_sort(F.filter(own, resolved))).withColumn("remaining_flags", F.array_sort(F.filter(own, lambda x: ~resolved(x))))
    clean = F.size("remaining_flags") == 0
    if policy.allow_remaining_soft:
        clean = clean | F.forall("remaining_flags", is_soft)
    return df.withColumn("reviewed_status", F.when(clean, "clean").otherwise("quarantine")).drop("_leak")


def best_of_duplicates(df: DataFrame, order: str, status: str = "status") -> DataFrame:
    """Adds dup_rank within equal texts: clean first, then judge score, mixed over human over AI, length, and order."""
    label = F.when(F.col("label") == 2, 2).when(F.col("label") == 0, 1).otherwise(0)
    w = Window.partitionBy("text_hash").orderBy((F.col(status) == "clean").cast("int").desc(), F.coalesce("judge_avg", F.lit(-1.0)).desc(), label.desc(), F.length("text").desc(), F.col(order))
    return df.withColumn("dup_rank", F.row_number().over(w))


def duplicate_report(ranked: DataFrame, key: str) -> DataFrame:
    """For each text with copies: their number, the kept id, labels, and whether labels differ. Ids of a group stay in the table."""
    return ranked.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("dup_rank") == 1, F.col(key))).alias("kept_id"), F.array_sort(F.collect_set("label")).alias("labels"), (F.count_distinct("label") > 1).alias("label_conflict")).filter("n > 1")


def group_split(df: DataFrame, group: str, test: float = 0.1, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split so that a group is never divided: groups are ranked by a hash, and the first ones are test, the next validation.

    The rank is counted by prefix of the hash, so no single task sorts all groups. Rows without a group are one group.
    """
    groups = df.select(group).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = groups.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    ranked = groups.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h"))).join(F.broadcast(before.drop("_n")), "_b").withColumn("_rank", F.col("_before") + F.col("_r"))
    size = lambda share: F.when(F.col("_all") >= 3, F.greatest(F.lit(1), F.round(F.col("_all") * share))).otherwise(F.round(F.col("_all") * share)) if share else F.lit(0)
    n_test, n_val = size(test), size(validation)
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "validation").otherwise("train")
    return df.join(ranked.select(F.col(group).alias("_group"), split.alias("split")), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def leakage(df: DataFrame, source: str, split: str = "split") -> DataFrame:
    """Sources that occur in more than one split."""
    return df.groupBy(source).agg(F.count_distinct(split).alias("n_splits"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).filter("n_splits > 1")


def split_summary(df: DataFrame, group: str, source: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("n_groups"), F.count_distinct(source).alias("n_sources"))


def flag_rows(df: DataFrame, key: str, flags: str) -> DataFrame:
    """One row for each flag of a record, `__no_flags__` for none."""
    return df.select(key, F.explode_outer(flags).alias("flag")).withColumn("flag", F.coalesce("flag", F.lit("__no_flags__")))


def issue_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.concat("issues", "fatal_issues")).alias("issue")).groupBy("issue").count()


def flag_matrix(df: DataFrame, key: str, flags: str) -> DataFrame:
    """Rows of each key and flag, keys rising, flags of a key by frequency: (key, flag, n, place)."""
    counts = df.select(key, F.explode_outer(flags).alias("flag")).groupBy(key, F.coalesce("flag", F.lit("__no_flags__")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "flag")))


def dataset_summary(df: DataFrame, distributions: list[str], numbers: list[str], part: str, whole: str) -> DataFrame:
    """(section, name, value): rows, counts of each value of some columns, six statistics of others, and sum(part) over sum(whole).

    Two passes over the rows: one grouping by (column, value), one row of statistics.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("name")) for c in distributions)))
    counted = df.select(pairs.alias("x")).groupBy("x.section", "x.name").agg(F.count(F.lit(1)).cast("double").alias("value"))
    stats = {"count": F.count, "min": F.min, "mean": F.avg, "median": lambda x: F.percentile(x, 0.5), "max": F.max, "std": F.stddev_pop}
    cells = [("dataset", "rows", F.count(F.lit(1))), ("dataset", "overall_ratio", F.round(F.coalesce(F.try_divide(F.sum(F.col(part).cast("double")), F.sum(whole)), F.lit(0.0)), 6))]
    cells += [(f"{c}_stats", n, F.round(f(F.col(c).cast("double")).cast("double"), 6)) for c in numbers for n, f in stats.items()]
    one = df.agg(*(v.alias(f"c{k}") for k, (_, _, v) in enumerate(cells)))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"c{k}").cast("double").alias("value")) for k, (s, n, _) in enumerate(cells))))
    return counted.unionByName(one.select(rows.alias("x")).select("x.*"))


class EmptySplit(ValueError):
    """A split without rows."""


def prepare(chunks: DataFrame, policy: Policy = Policy(), group: str = "article_id", order: str = "chunk_id", check: bool = True) -> DataFrame:  # noqa: B008
    """Chunks to training records: audit, copies flagged, flags reviewed, the best of equal texts kept, groups split.

    Rows that the audit drops or the review leaves in quarantine go. With `check`, a split without rows is an error.
    The audited rows are persisted, since counting copies and splitting groups read them several times.
    """
    kept = flag_duplicates(audit(chunks).filter(F.col("status") != "drop").persist())
    copy = F.when(F.col("is_duplicate"), F.array(F.lit("exact_duplicate_text"))).otherwise(F.array().cast("array<string>"))
    clean = review(kept.withColumn("flags", F.array_union("flags", copy)), policy).filter(F.col("reviewed_status") == "clean")
    best = best_of_duplicates(clean, order, "reviewed_status").filter("dup_rank = 1").persist()
    out = group_split(best, group)
    if check:
        found = {r[0] for r in out.select("split").distinct().collect()}
        missing = sorted({"train", "validation", "test"} - found)
        if missing:
            raise EmptySplit(", ".join(missing))
    return out
