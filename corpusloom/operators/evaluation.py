"""Classification, ranking, span and entity metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import let
from .prefix import running_sums


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row for each true class with a column for each predicted one."""
    counts = df.groupBy(truth).agg(*(F.count(F.when(F.col(predicted) == c, 1)).alias(f"pred_{c}") for c in classes))
    return counts.filter(F.col(truth).isin(*classes))


def class_report(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Precision, recall, F1 and support by class, with macro and weighted means; zero where undefined. One aggregation."""
    t, p = F.col(truth), F.col(predicted)
    aggs = [F.count(F.when(test, 1)).alias(f"{n}_{c}") for c in classes for n, test in (("tp", (t == c) & (p == c)), ("fp", (t != c) & (p == c)), ("fn", (t == c) & (p != c)))]
    one, rows = df.agg(*aggs), []
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    for c in classes:
        tp, fp, fn = (F.col(f"{n}_{c}") for n in ("tp", "fp", "fn"))
        rows.append(F.struct(F.lit(str(c)).alias("class"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2.0 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")))
    own = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    names = ("precision", "recall", "f1")
    macro = own.agg(*(F.avg(n).alias(n) for n in names), F.sum("support").alias("support")).select(F.lit("macro").alias("class"), *names, "support")
    weighted = own.agg(*(F.coalesce(F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(n) for n in names), F.sum("support").alias("support")).select(F.lit("weighted").alias("class"), *names, "support")
    return own.unionByName(macro).unionByName(weighted).select("class", *(F.round(n, 6).alias(n) for n in names), "support")


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n"))


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Points of the ROC curve, one for each distinct score from high to low.

    Rows are counted by score first; the running sums see distinct scores only, dealt by range.
    """
    by = by_score(df, score, label)
    whole = by.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    points = running_sums(by, "threshold", {"tp": "p", "fp": "n"}, descending=True).join(F.broadcast(whole))
    return points.select("threshold", "p", "n", F.try_divide("tp", "_p").alias("tpr"), F.try_divide("fp", "_n").alias("fpr"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve: pairs won plus half of the ties."""
    won = running_sums(by_score(df, score, label), "threshold", {"upto": "n"}).withColumn("won", F.col("p") * (F.col("upto") - F.col("n") / 2.0))
    return won.agg(F.round(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n")), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def youden(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with the largest TPR - FPR; of equals, the highest."""
    points = roc(df, score, label)
    best = F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 9).alias("j"), F.col("threshold"), F.col("tpr"), F.col("fpr")))
    return points.agg(best.alias("b")).select("b.threshold", F.round("b.j", 6).alias("j"), F.round("b.tpr", 6).alias("tpr"), F.round("b.fpr", 6).alias("fpr"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(truth) == F.col(predicted)).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def review_rate(df: DataFrame, review: str, truth: str, predicted: str) -> DataFrame:
    """Share of rows for human review, and accuracy on the others."""
    return df.agg(F.round(F.avg(F.col(review).cast("int")), 6).alias("review_rate"), F.round(F.avg(F.when(~F.col(review), (F.col(truth) == F.col(predicted)).cast("int"))), 6).alias("auto_accuracy"))


def span_metrics(df: DataFrame, predicted: str, truth: str, least: float = 0.5) -> DataFrame:
    """Micro and macro precision, recall and F1 of spans by greedy IoU; two empty sides are a perfect document."""
    n_p, n_t = F.size(predicted), F.size(truth)
    rows = df.select(S.greedy_matches(F.col(predicted), F.col(truth), least).alias("m"), n_p.alias("np"), n_t.alias("nt"))
    one = F.lit(1.0)
    both = (F.col("np") == 0) & (F.col("nt") == 0)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = F.when(both, one).otherwise(zero(F.col("m"), F.col("np"))), F.when(both, one).otherwise(zero(F.col("m"), F.col("nt")))
    rows = rows.withColumn("p", p).withColumn("r", r).withColumn("f", zero(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    m, np_, nt = F.sum("m"), F.sum("np"), F.sum("nt")
    micro_p, micro_r = zero(m, np_), zero(m, nt)
    return rows.agg(*(F.round(x, 6).alias(n) for n, x in (("micro_precision", micro_p), ("micro_recall", micro_r), ("micro_f1", zero(2 * micro_p * micro_r, micro_p + micro_r)), ("macro_precision", F.avg("p")), ("macro_recall", F.avg("r")), ("macro_f1", F.avg("f")))))


def entities(tokens: DataFrame, key: str, index: str, label: str, side: str) -> DataFrame:
    """(key, first, last) of BIO entities: one starts at B, or at I after O, and runs over the I that follow."""
    before = F.lag(label).over(Window.partitionBy(key).orderBy(index))
    begins = (F.col(label) == 1) | ((F.col(label) == 2) & F.coalesce(before == 0, F.lit(True)))
    number = F.sum(begins.cast("int")).over(Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    rows = tokens.withColumn("_e", number).filter(F.col(label).isin(1, 2))
    return rows.groupBy(key, "_e").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_e").withColumn(side, F.lit(1))


def entity_metrics(tokens: DataFrame, key: str, index: str, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of entities that agree exactly."""
    both = entities(tokens, key, index, truth, "_t").join(entities(tokens, key, index, predicted, "_p"), [key, "first", "last"], "full")
    return entity_scores(both.agg(F.count(F.when(F.col("_t").isNotNull() & F.col("_p").isNotNull(), 1)).alias("hit"), F.count("_p").alias("n_pred"), F.count("_t").alias("n_true")))


def entity_scores(sums: DataFrame) -> DataFrame:
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return sums.select("hit", "n_pred", "n_true", zero(F.col("hit"), F.col("n_pred")).alias("precision"), zero(F.col("hit"), F.col("n_true")).alias("recall"), zero(2.0 * F.col("hit"), F.col("n_pred") + F.col("n_true")).alias("f1"))


def label_entities(labels) -> Column:
    """First and last place of each entity of an array of BIO labels, as first * 2^32 + last: one starts at B, or at I after neither, and runs over the I that follow."""

    def of(own):
        inside = lambda x: F.coalesce((x == 1) | (x == 2), F.lit(False))
        begins = lambda x, i: F.when((x == 1) | ((x == 2) & ~inside(F.get(own, i - 1))), i)
        ends = lambda x, i: F.when(inside(x) & F.coalesce(F.get(own, i + 1) != 2, F.lit(True)), i)
        return F.zip_with(F.array_compact(F.transform(own, begins)), F.array_compact(F.transform(own, ends)), lambda a, b: F.shiftleft(a.cast("bigint"), 32) + b)

    return let(labels, of)


def array_entity_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """entity_metrics of rows that hold all labels of their key as arrays: entities meet within their row, nothing is shuffled but sums."""
    own = df.select(label_entities(F.col(truth)).alias("t"), label_entities(F.col(predicted)).alias("p"))
    sizes = own.select(F.size(F.array_intersect("t", "p")).alias("hit"), F.size("p").alias("n_pred"), F.size("t").alias("n_true"))
    return entity_scores(sizes.agg(*(F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in sizes.columns)))


def text_model(train: DataFrame, text: str = "text", label: str = "label", terms: int = 5000, min_df: float = 5.0, max_df: float = 0.9, reg: float = 0.1, numbers: tuple[str, ...] = (), stop: tuple[str, ...] = ()):
    """TF-IDF of words and pairs, without stop words, beside standardised numeric columns, with balanced logistic regression: a fitted pyspark.ml pipeline.

    `terms` words and as many pairs at most; nulls in numeric columns count as 0.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler

    stages = [RegexTokenizer(inputCol=text, outputCol="_a", pattern=r"[^\p{L}\p{N}]+"), StopWordsRemover(inputCol="_a", outputCol="_w", stopWords=list(stop)), NGram(n=2, inputCol="_w", outputCol="_b")]
    for name in ("_w", "_b"):
        stages += [CountVectorizer(inputCol=name, outputCol=f"{name}c", vocabSize=terms, minDF=min_df, maxDF=max_df), IDF(inputCol=f"{name}c", outputCol=f"{name}i")]
    stages += [VectorAssembler(inputCols=["_wi", "_bi"], outputCol="_v"), Normalizer(inputCol="_v", outputCol="_t")]
    if numbers:
        stages += [VectorAssembler(inputCols=list(numbers), outputCol="_n", handleInvalid="skip"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)]
    stages += [VectorAssembler(inputCols=["_t", "_s"] if numbers else ["_t"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label, weightCol="_weight", regParam=reg, maxIter=50)]
    return Pipeline(stages=stages).fit(balanced(train.na.fill(0, list(numbers)) if numbers else train, label))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds _weight: rows over classes times rows of the own class."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    weight, total = F.lit(1.0), sum(sizes.values())
    for k, n in sizes.items():
        weight = F.when(F.col(label) == k, total / (len(sizes) * n)).otherwise(weight)
    return df.withColumn("_weight", weight)


def cross_validated(df: DataFrame, key: str, fit, label: str = "label", folds: int = 5, seed: int = 42) -> DataFrame:
    """(fold, n, accuracy): each fold, drawn by a hash of the key, judged by the model that `fit` makes of the others."""
    own = df.withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")).persist()
    parts = []
    for k in range(folds):
        judged = fit(own.filter(F.col("_fold") != k)).transform(own.filter(F.col("_fold") == k))
        parts.append(judged.select(F.lit(k).alias("fold"), (F.col("prediction") == F.col(label)).cast("int").alias("hit")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


def fold_terms(rows: DataFrame, folds: int, sizes: list[int], terms: int, min_df: float, max_df: float) -> list[dict[str, float]]:
    """Of each fold: the words and pairs that a text_model of the other folds keeps, with their IDF. Of rows (_fold, _terms); equally frequent terms go by name.

    All terms are counted once, by fold; what a fold's model sees is the sum less the fold's own.
    """
    ordered = F.sort_array("_terms")
    marked = let(ordered, lambda own: F.transform(own, lambda x, i: F.struct(x.alias("term"), (~F.get(own, i - 1).eqNullSafe(x)).cast("int").alias("first"))))
    one = rows.select("_fold", F.inline(marked))
    of = [F.col("_fold") == k for k in range(folds)]
    sums = one.groupBy("term").agg(*(F.count(F.when(of[k], 1)).alias(f"t{k}") for k in range(folds)), *(F.coalesce(F.sum(F.when(of[k], F.col("first"))), F.lit(0)).alias(f"d{k}") for k in range(folds)))
    total = lambda x: sum((F.col(f"{x}{j}") for j in range(folds)), F.lit(0))
    known = sums.withColumns({"t": total("t"), "d": total("d")}).filter(F.col("d") >= (min_df if min_df >= 1 else 0)).persist()
    picked = None
    for k in range(folds):
        n = sum(sizes) - sizes[k]
        own = known.select(F.lit(k).alias("k"), "term", (F.col("t") - F.col(f"t{k}")).alias("t"), (F.col("d") - F.col(f"d{k}")).alias("d"))
        own = own.filter((F.col("d") >= (min_df if min_df >= 1 else min_df * n)) & (F.col("d") <= (max_df if max_df >= 1 else max_df * n)) & (F.col("d") > 0))
        for pair in (False, True):
            part = own.filter(F.col("term").contains(" ") == F.lit(pair)).orderBy(F.desc("t"), "term").limit(terms)
            picked = part if picked is None else picked.unionByName(part)
    out: list[dict[str, float]] = [{} for _ in range(folds)]
    for r in picked.collect():
        out[r.k][r.term] = math.log((sum(sizes) - sizes[r.k] + 1) / (r.d + 1))
    known.unpersist()
    return out


def cross_validated_text(df: DataFrame, key: str, text: str = "text", label: str = "label", folds: int = 5, seed: int = 42, terms: int = 5000, min_df: float = 5.0, max_df: float = 0.9, reg: float = 0.1, numbers: tuple[str, ...] = (), stop: tuple[str, ...] = ()) -> DataFrame:
    """cross_validated with text_model, (fold, n, accuracy), where texts are cut and counted once for all folds.

    Rows hold counts of the terms of any fold's vocabulary; a term that a fold's model lacks has weight 0 in it.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
    from pyspark.ml.linalg import Vectors

    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")
    whole = df.select(fold.alias("_fold"), F.col(label).alias("_label"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *numbers)
    whole = (whole.na.fill(0, list(numbers)) if numbers else whole).persist()
    counts = {(r[0], r[1]): r[2] for r in whole.groupBy("_fold", "_label").count().collect()}
    sizes = [sum(n for (k, _), n in counts.items() if k == j) for j in range(folds)]
    cut = PipelineModel([RegexTokenizer(inputCol="_text", outputCol="_a", pattern=r"[^\p{L}\p{N}]+"), StopWordsRemover(inputCol="_a", outputCol="_w", stopWords=list(stop)), NGram(n=2, inputCol="_w", outputCol="_b")])
    rows = cut.transform(whole).withColumn("_terms", F.concat("_w", "_b")).select("_fold", "_label", "_terms", *numbers)
    known = fold_terms(rows, folds, sizes, terms, min_df, max_df)
    every = sorted(set().union(*known))
    counted = CountVectorizerModel.from_vocabulary(every, "_terms", "_c").transform(rows) if every else rows.withColumn("_c", F.lit(None))
    counted = counted.drop("_terms").persist()
    judged = []
    for k in (k for k in range(folds) if sizes[k]):
        own = [(y, n) for (j, y), n in counts.items() if j != k]
        by = {y: sum(n for z, n in own if z == y) for y, _ in own}
        weight = F.lit(1.0)
        for y, n in by.items():
            weight = F.when(F.col("_label") == y, sum(by.values()) / (len(by) * n)).otherwise(weight)
        stages = [ElementwiseProduct(inputCol="_c", outputCol="_v", scalingVec=Vectors.dense([known[k].get(t, 0.0) for t in every])), Normalizer(inputCol="_v", outputCol="_t")]
        if numbers:
            stages += [VectorAssembler(inputCols=list(numbers), outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)]
        stages += [VectorAssembler(inputCols=["_t", "_s"] if numbers else ["_t"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_weight", regParam=reg, maxIter=50)]
        model = Pipeline(stages=stages).fit(counted.filter(F.col("_fold") != k).withColumn("_weight", weight))
        hits = model.transform(counted.filter(F.col("_fold") == k)).agg(F.count(F.lit(1)), F.round(F.avg((F.col("prediction") == F.col("_label")).cast("int")), 6)).first()
        judged.append((k, *hits))
    counted.unpersist()
    whole.unpersist()
    return df.sparkSession.createDataFrame(judged, "fold int, n bigint, accuracy double")


def forest_importance(df: DataFrame, columns: list[str], label: str = "label", trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance, place) of numeric columns in a random forest, the most important first."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df.na.fill(0, columns))
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed).fit(rows)
    return ordered_weights(df, dict(zip(columns, model.featureImportances.toArray().tolist(), strict=True)), "importance")


def ordered_weights(df: DataFrame, weights: dict[str, float], name: str = "weight") -> DataFrame:
    """(feature, weight, place): features by absolute weight, of equals by name."""
    ranked = sorted(weights.items(), key=lambda x: (-abs(x[1]), x[0]))
    return df.sparkSession.createDataFrame([(f, float(w), k) for k, (f, w) in enumerate(ranked, 1)], f"feature string, {name} double, place int")


def term_weights(model, df: DataFrame) -> DataFrame:
    """Weights of the words and pairs of a text_model, by absolute value; numeric columns as `number k`."""
    terms = [t for stage in model.stages if hasattr(stage, "vocabulary") for t in stage.vocabulary]
    values = model.stages[-1].coefficients.toArray().tolist()
    names = terms + [f"number {k}" for k in range(len(values) - len(terms))]
    return ordered_weights(df, dict(zip(names, values, strict=True)))


def experiments(spark, folder: str, metric: str, descending: bool = True) -> DataFrame:
    """One row for each metrics file (JSON) of a folder, best first, with the file's name."""
    rows = spark.read.option("multiLine", "true").json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.orderBy(F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last(), "file")
