"""Aggregates, contrasts and samples."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .prefix import cuts, range_of, running_sums


def share(df: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """Count of each key and its percentage of all rows; the total is a sum over the counts, not the rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), digits))


def numeric_stats(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """count, min, mean, median, max and population deviation, to six places."""
    x = F.col(column).cast("double")
    r = lambda v: F.round(v, 6)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), r(F.min(x)).alias("min"), r(F.avg(x)).alias("mean"), r(F.percentile(x, 0.5)).alias("median"), r(F.max(x)).alias("max"), r(F.stddev_pop(x)).alias("std"))


def describe(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max."""
    x = F.col(column).cast("double")
    r = lambda v: F.round(v, 6)
    quartiles = [r(F.percentile(x, p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return df.groupBy(*keys).agg(F.count(x).alias("n"), r(F.avg(x)).alias("mean"), r(F.stddev_samp(x)).alias("std"), r(F.min(x)).alias("min"), *quartiles, r(F.max(x)).alias("max"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls of each column, as rows."""
    one = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "nulls")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Share of each row key within each column value."""
    counts = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    total = Window.partitionBy()
    return counts.select(row, *(F.round(F.coalesce(F.try_divide(F.col(str(v)), F.sum(str(v)).over(total)), F.lit(0.0)), 6).alias(f"share_{v}") for v in values))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}__{b}"), 6).alias("r")) for a, b in pairs)))
    return one.select(rows.alias("x")).select("x.*")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Mean rank of ties, from counts of distinct values dealt by range."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_sums(counts, column, {"_upto": "_k"}).select(column, (F.col("_upto") - (F.col("_k") - 1) / 2.0).alias(name))
    return df.join(ranked, column, "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.round(F.corr("_ra", "_rb"), 6).alias("spearman"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("pearson"))


def welch(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Welch's t and its degrees of freedom between label 1 and 0, for each column, in one pass."""
    side = lambda v, k: F.when(F.col(label) == k, F.col(v).cast("double"))
    aggs = [f(side(v, k)).alias(f"{v}_{n}{k}") for v in columns for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    one, rows = df.agg(*aggs), []
    for v in columns:
        m0, m1, v0, v1, n0, n1 = (F.col(f"{v}_{x}") for x in ("m0", "m1", "v0", "v1", "n0", "n1"))
        e0, e1 = F.try_divide(v0, n0), F.try_divide(v1, n1)
        t = F.try_divide(m1 - m0, F.sqrt(e0 + e1))
        dof = F.try_divide((e0 + e1) ** 2, F.try_divide(e0**2, n0 - 1) + F.try_divide(e1**2, n1 - 1))
        rows.append(F.struct(F.lit(v).alias("feature"), F.round(m0, 6).alias("mean_0"), F.round(m1, 6).alias("mean_1"), F.round(t, 6).alias("t"), F.round(dof, 4).alias("dof")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def word_rows(df: DataFrame, *keys: str, text: str = "text", stop=(), least: int = 3) -> DataFrame:
    """One row for each word of letters of `least` characters or more that isn't a stop word."""
    bare = F.filter(words(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\s]", " ")), lambda w: (F.length(w) >= least) & (~w.isin(*stop) if stop else F.lit(True)))
    return df.select(*keys, F.explode(bare).alias("word"))


def top_words(df: DataFrame, n: int, stop=(), text: str = "text") -> DataFrame:
    """The n most frequent words; ties by the word."""
    return word_rows(df, text=text, stop=stop).groupBy("word").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "word").limit(n)


def top_bigrams(df: DataFrame, n: int, text: str = "text", stop=()) -> DataFrame:
    """The n most frequent pairs of neighbouring words, both of three letters or more and no stop word."""
    # words that don't count become null once, so that a pair only looks at two of them
    ok = lambda w: (F.length(w) >= 3) & (~w.isin(*stop) if stop else F.lit(True))
    kept = F.transform(words(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\s]+", " ")), lambda w: F.when(ok(w), w))
    own, size = F.col("_w"), F.greatest(F.size("_w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice(own, 1, size), F.slice(own, 2, size), lambda a, b: F.concat(a, F.lit(" "), b))
    return df.select(kept.alias("_w")).select(F.explode(F.array_compact(pairs)).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "bigram").limit(n)


def lexical_contrast(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """Frequencies of each word in class 0 and 1 and the share of class 1: one grouping instead of an outer join of two."""
    counts = word_rows(df, label, text=text).groupBy("word").agg(F.count(F.when(F.col(label) == 0, 1)).alias("freq_0"), F.count(F.when(F.col(label) == 1, 1)).alias("freq_1"))
    return counts.withColumn("ratio_1", F.round(F.col("freq_1") / (F.col("freq_0") + F.col("freq_1")), 6))


def class_words(contrast: DataFrame, n: int = 20, ratio: float = 0.7, least: int = 10) -> DataFrame:
    return contrast.filter((F.col("ratio_1") > ratio) & (F.col("freq_0") + F.col("freq_1") > least)).orderBy(F.desc("ratio_1"), F.desc("freq_1"), "word").limit(n)


def diversity(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Types over tokens, and words that occur once over tokens."""
    counts = word_rows(df, *keys, text=text, least=1).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types"), F.round(F.count(F.lit(1)) / F.sum("c"), 6).alias("ttr"), F.round(F.count(F.when(F.col("c") == 1, 1)) / F.sum("c"), 6).alias("hapax_ratio"))


def hash_rank(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, those whose hashed key comes first: a sample that any engine draws alike."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_rank(key, seed), key))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_rank(key, seed), key)


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Rows in half-open bins between the edges."""
    name = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:], strict=False):
        name = F.when((F.col(column) >= a) & (F.col(column) < b), f"[{a:g},{b:g})").otherwise(name)
    return df.withColumn("bin", name).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def adjacent_cosine(df: DataFrame, order: str, vector: str, *keys: str) -> DataFrame:
    """Cosine of each row's vector with the next one's in its group; rows without a vector are passed over.

    Rows are dealt by group and range of `order`, so that a large group isn't one task. The last row of a range
    is followed by the first of the group's next range, which a table of one row a group and range tells.
    """
    df = df.filter(F.col(order).isNotNull())
    df = df.withColumn("_range", range_of(F.col(order).cast("double"), cuts(df, order)))
    heads = df.groupBy(*keys, "_range").agg(F.min_by(F.struct(F.col(vector).alias("v")), order).alias("_head"))
    after = Window.partitionBy(*keys).orderBy("_range")
    heads = heads.select(*keys, "_range", F.lead("_head").over(after)["v"].alias("_head"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_range")]
    df = df.alias("l").join(heads.alias("r"), reduce(lambda a, b: a & b, same), "left").select("l.*", "_head")
    place = Window.partitionBy(*keys, "_range").orderBy(order)
    following = F.when(F.lead(order).over(place).isNull(), F.col("_head")).otherwise(F.lead(vector).over(place))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = df.withColumn("_next", following).filter("_next IS NOT NULL")
    cosine = F.try_divide(dot(F.col(vector), F.col("_next")), F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(F.col("_next"), F.col("_next"))))
    return rows.select(*keys, order, F.round(cosine, 6).alias("cosine"))


def coverage_by(df: DataFrame, key: str, test, digits: int = 1) -> DataFrame:
    """Of each key: rows, and the percentage for which a condition holds."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(test, F.lit(False)).cast("int")) * 100, digits).alias("pct"))


def flag_totals(df: DataFrame, flags: dict[str, Column], digits: int = 1) -> DataFrame:
    """(flag, total, pct): rows for which each condition holds."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.when(test, 1)).alias(name) for name, test in flags.items()))
    pct = lambda name: F.round(F.coalesce(F.try_divide(F.col(name) * 100.0, F.col("_n")), F.lit(0.0)), digits)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("flag"), F.col(n).alias("total"), pct(n).alias("pct")) for n in flags))).alias("x")).select("x.*")


def mean_per_group(df: DataFrame, key: str) -> DataFrame:
    """Groups, and the mean number of rows in one."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("n"), 6).alias("mean_rows"))
