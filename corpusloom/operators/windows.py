"""Token windows, votes and detector spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

WORD = re.compile(r"\S+")


def window_starts(total, size: int, step: int) -> Column:
    """Starts of windows of `size` tokens every `step`, until one reaches the end."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.greatest(total - size, F.lit(0)) / step).cast("int")) * step, F.lit(step))


def vote_step(size: int = 128, overlap: float = 0.8) -> int:
    return max(1, int(size * (1 - overlap)))


def token_windows(df: DataFrame, key: str, tokens: str, size: int, step: int) -> DataFrame:
    """(key, window_index, window_start, tokens of the window)."""
    starts = window_starts(F.size(tokens), size, step)
    return df.select(key, tokens, F.posexplode(starts).alias("window_index", "window_start")).select(key, "window_index", "window_start", F.slice(tokens, F.col("window_start") + 1, size).alias("window"))


def tally(votes: DataFrame, least: float = 0.5) -> DataFrame:
    """Votes of all windows for a token: it is AI when more than half of them say so with probability `least` or more."""
    ai = F.col("label").isin("B-AI", "I-AI") & (F.col("prob") >= least)
    real = votes.filter(~((F.col("start_char") == 0) & (F.col("end_char") == 0)))
    return (
        real.groupBy("doc_id", "token_idx")
        .agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count(F.lit(1)).alias("votes"), F.count(F.when(ai, 1)).alias("votes_ai"), F.sum(F.when(ai, F.col("prob")).otherwise(0.0)).alias("ai_mass"))
        .withColumn("is_ai", F.col("votes_ai") * 2 > F.col("votes"))
        .withColumn("confidence", F.col("ai_mass") / F.col("votes"))
        .drop("ai_mass")
    )


def islands(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Adds `island`: consecutive indices of one key share it."""
    return rows.withColumn("island", F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index)))


def vote_spans(tallied: DataFrame, least_tokens: int = 3) -> DataFrame:
    """Runs of AI tokens as spans with their confidences."""
    runs = islands(tallied.filter("is_ai"), "doc_id", "token_idx")
    spans = runs.groupBy("doc_id", "island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count(F.lit(1)).alias("num_tokens"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))
    return spans.filter(F.col("num_tokens") >= least_tokens).drop("island")


def span_texts(spans: DataFrame, docs: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    """Spans with their text; those of fewer than `least` characters without outer white space go."""
    joined = spans.join(docs.select("doc_id", text), "doc_id")
    cut = F.substring(F.col(text), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return joined.withColumn("span_text", cut).filter(F.length(F.trim("span_text")) >= least).drop(text)


def label_pattern(labels) -> Column:
    """Which labels a window has, special tokens aside."""
    own = F.array_sort(F.array_distinct(F.filter(labels, lambda x: x != -100)))
    name = lambda x: F.array_join(F.transform(x, lambda k: F.when(k == 0, "O").when(k == 1, "B").otherwise("I")), "_")
    return let(own, lambda x: F.when(F.size(x) == 0, "all_ignored").when(F.size(x) == 1, F.concat(F.lit("only_"), name(x))).otherwise(F.concat(F.lit("mixed_"), name(x))))


def label_frequency(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.select(F.explode(labels).alias("label")).filter("label <> -100").groupBy("label").count()


def run_frequency(df: DataFrame, counts: str = "counts") -> DataFrame:
    """label_frequency of rows that hold struct(o, b, i), the counts of their labels 0, 1 and 2: no row a label is made; labels that never occur have no row."""
    sums = df.agg(*(F.sum(f"{counts}.{x}").alias(x) for x in "obi"))
    rows = F.array(*(F.struct(F.lit(k).alias("label"), F.col(x).alias("count")) for k, x in enumerate("obi")))
    return sums.select(F.inline(rows)).filter("count > 0")


def class_weights(counts: DataFrame, beta: float = 0.9999, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Effective-number weights of labels, scaled to mean 1 and clipped."""
    raw = counts.withColumn("w", (1 - beta) / (1 - F.pow(F.lit(beta), F.col("count"))))
    return raw.withColumn("weight", F.least(F.lit(high), F.greatest(F.lit(low), F.col("w") / F.avg("w").over(Window.partitionBy())))).drop("w")


def sampling_weight(labels) -> Column:
    return F.when(F.exists(labels, lambda x: x == 1), 4.0).when(F.exists(labels, lambda x: x == 2), 1.5).otherwise(1.0)


def mask_plan(n, rate: float = 0.15, length: int = 2) -> Column:
    """struct(masked, spans): how many tokens of n to mask, in how many spans."""
    masked = F.greatest(F.lit(1), F.floor(n * rate))
    return F.struct(masked.alias("masked"), F.greatest(F.lit(1), F.floor(masked / length)).alias("spans"))


def mask_starts(key, n, spans, length: int, seed: int = 0) -> Column:
    """Starts of masked spans from hashes of key and number: sorted and distinct."""
    room = F.greatest(n - length, F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), spans.cast("int")), lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed)), room).cast("int"))))


def fill_masks(text, fills) -> Column:
    """Sentinels <extra_id_k> replaced by the k-th filling, left over ones removed."""
    filled = F.aggregate(F.transform(fills, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), text, lambda a, f: F.replace(a, F.concat(F.lit("<extra_id_"), f["i"].cast("string"), F.lit(">")), f["x"]))
    return F.regexp_replace(filled, "<extra_id_[0-9]+>", "")


def window_summary(windows: DataFrame, split: str, key: str, labels: str = "labels") -> DataFrame:
    """Of each split: documents, windows, their mean and largest number a document, documents with several windows, windows and documents with AI tokens, and tokens by label."""
    own = windows.withColumn("_ai", F.exists(labels, lambda x: (x == 1) | (x == 2))).withColumn("_b", F.exists(labels, lambda x: x == 1))
    tokens = lambda k: F.size(F.filter(labels, lambda x: x == k))
    own = own.withColumns({"_t0": tokens(0), "_t1": tokens(1), "_t2": tokens(2), "_t3": tokens(-100)})
    docs = own.groupBy(split, key).agg(F.count(F.lit(1)).alias("w"), F.max(F.col("_ai").cast("int")).alias("ai"), F.sum(F.col("_ai").cast("int")).alias("wa"), F.sum(F.col("_b").cast("int")).alias("wb"), *(F.sum(f"_t{k}").alias(f"t{k}") for k in range(4)))
    return docs.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("w").alias("n_windows"), F.round(F.avg("w"), 6).alias("avg_windows"), F.max("w").alias("max_windows"), F.count(F.when(F.col("w") > 1, 1)).alias("multi_window_documents"),
        F.sum("ai").alias("docs_with_ai"), F.sum("wa").alias("windows_with_ai"), F.sum("wb").alias("windows_with_b_ai"), *(F.sum(f"t{k}").alias(n) for k, n in enumerate(("tokens_o", "tokens_b", "tokens_i", "tokens_ignored"))),
    )


def split_labels(windows: DataFrame, split: str, labels: str = "labels") -> DataFrame:
    """(split, has_b, has_i): whether a split has tokens that begin and tokens that go on."""
    has = lambda k: F.max(F.exists(labels, lambda x: x == k).cast("int")) == 1
    return windows.groupBy(split).agg(has(1).alias("has_b"), has(2).alias("has_i"))


def require_labels(windows: DataFrame, split: str, labels: str = "labels") -> DataFrame:
    """The windows, if every split has both kinds of tokens; an error that names the others."""
    poor = [r[0] for r in split_labels(windows, split, labels).filter("NOT (has_b AND has_i)").select(split).collect()]
    if poor:
        raise ValueError(f"no B or no I tokens in: {', '.join(sorted(map(str, poor)))}")
    return windows


def word_offsets(text) -> Column:
    """[start, end] of each run of characters that aren't white space, over the whole text, as an Arrow UDF: Spark has no function that tells where a pattern matches."""

    @F.pandas_udf("array<array<int>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[list(m.span()) for m in WORD.finditer(t or "")] for t in texts])

    return find(text)
