"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains. Every document
gets a non-negative rate so that the expected tokens of the domains, summed over documents as
rate x tokens x posterior, match the targets in the least-squares sense. The rates come from distributed
projected-gradient steps: r <- max(0, r - p . u), where u is the domain residual times the inverse of the
domains' second moments over the documents that still count. A step needs sums over documents only, and a
rate is a function of its own posterior and of the few vectors u so far, so there is no state to lose.

Cases: null or empty texts have no tokens, a uniform posterior, and a rate that changes no total; without
labelled rows of two domains every posterior is uniform; a target that no rate can reach is approached;
an empty corpus gives no rows; rows that repeat a doc_id are documents of their own; other columns are
ignored by the query and kept by the pipeline stage, unless they have the name of a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, materialize, table

#: Domains as conditions on the labelled table, and their shares of the tokens.
DOMAINS = {"prose": "quality = 1 AND toxic = 0", "rough": "quality = 0 AND toxic = 0", "toxic": "toxic = 1"}
TARGETS = {"prose": 0.9, "rough": 0.08, "toxic": 0.02}
#: Labelled rows of each domain that the classifier is fitted on, at most.
SAMPLE = 1500
WORDS, STEPS, TOLERANCE = 1024, 25, 1e-6


def describe(text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Tokens, shares of bytes with the share of distinct words, and word buckets of a whole text."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return 0, np.zeros(257, np.float32), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    shape = np.empty(257, np.float32)
    shape[:256] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / np.float32(len(text))
    shape[256] = len(set(words)) / n
    return n, shape, (hashes & np.uint64(WORDS - 1)).astype(np.int64)


class Classifier:
    """Multinomial logistic regression on byte shares and hashed word shares."""

    def __init__(self, domains: int):
        self.domains = domains
        self.scale = np.ones(257, np.float32)
        self.shape, self.words, self.bias = np.zeros((257, domains), np.float32), np.zeros((WORDS, domains), np.float32), np.zeros(domains, np.float32)

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> Classifier:
        seen = [describe(t) for t in texts]
        x = np.zeros((len(texts), 257 + WORDS), np.float32)
        for k, (n, shape, buckets) in enumerate(seen):
            x[k, :257] = shape
            if n:
                x[k, 257:] = np.sqrt(np.bincount(buckets, minlength=WORDS) / n)
        self.scale = 1 / np.maximum(x[:, :257].std(0), 1e-3)
        x[:, :257] *= self.scale
        target = np.eye(self.domains, dtype=np.float32)[y]
        prior = target.mean(0)
        w, b = np.zeros((x.shape[1], self.domains), np.float32), np.log(np.maximum(prior, 1e-6)).astype(np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - target) / len(x) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            b -= 0.5 * (p - target).mean(0)
        self.shape, self.words, self.bias = w[:257] * self.scale[:, None], w[257:], b
        return self

    def posterior(self, text: bytes | None) -> tuple[int, np.ndarray]:
        n, shape, buckets = describe(text)
        if not n:
            return 0, np.full(self.domains, 1 / self.domains)
        z = shape @ self.shape + np.sqrt(np.bincount(buckets, minlength=WORDS) / n).astype(np.float32) @ self.words + self.bias
        p = np.exp((z - z.max()).astype(np.float64))
        return n, p / p.sum()


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str]):
    """A broadcast classifier fitted on at most SAMPLE labelled rows of each domain, those whose doc_id hashes lowest.

    Priors of the sample are set back to those of the whole labelled table.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(" ".join(["CASE", *(f"WHEN {c} THEN {k}" for k, c in enumerate(domains.values())), "END"])).alias("domain"))
    rows = rows.filter("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    chosen = None
    for k in sizes:
        part = rows.filter(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    model = Classifier(len(domains))
    if len(sizes) > 1:
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
        sample = sorted((r[0], r[1], bytes(r[2])) for r in texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).collect())
        y = np.array([s[1] for s in sample], np.int64)
        if len(set(y.tolist())) > 1:
            model.fit([s[2] for s in sample], y)
            drawn = np.bincount(y, minlength=len(domains)) / len(y)
            real = np.array([sizes.get(k, 0) for k in range(len(domains))]) / sum(sizes.values())
            model.bias += np.log(np.maximum(real, 1e-6) / np.maximum(drawn, 1e-6)).astype(np.float32)
    return spark.sparkContext.broadcast(model)


def classified(docs: DataFrame, model, domains: int, text: bool) -> DataFrame:
    """The documents, with their texts or without, with `_tokens` and a posterior `_p0`, `_p1`, ... for each domain."""
    fields = T.StructType([f for f in docs.schema.fields if text or f.name != "text"])

    def run(batches):
        for batch in batches:
            found = [model.value.posterior(t) for t in bytes_of(batch.column(batch.schema.get_field_index("text")))]
            p = np.array([f[1] for f in found], np.float64).reshape(-1, domains)
            yield pa.RecordBatch.from_arrays([*batch.select(fields.names).columns, pa.array([f[0] for f in found], pa.int64()), *(pa.array(p[:, k]) for k in range(domains))], [*fields.names, "_tokens", *(f"_p{k}" for k in range(domains))])

    extra = [T.StructField("_tokens", T.LongType()), *(T.StructField(f"_p{k}", T.DoubleType()) for k in range(domains))]
    return docs.mapInArrow(run, T.StructType([*fields.fields, *extra]))


def rate_of(steps: list[list[float]]) -> Column:
    """The rate as a function of the posterior, after the given steps from 1."""
    rate = F.lit(1.0)
    for u in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"_p{k}") * float(x) for k, x in enumerate(u)), F.lit(0.0)))
    return rate


def solve(mass: DataFrame, targets: np.ndarray, most: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Steps whose rates bring the expected domain tokens to targets x all tokens."""
    n = len(targets)
    pairs = [(j, k) for j in range(n) for k in range(j, n)]
    steps: list[list[float]] = []
    best, best_steps = np.inf, []
    for _ in range(most):
        rate = rate_of(steps)
        p = [F.col(f"_p{k}") for k in range(n)]
        t = F.col("_tokens")
        sums = mass.agg(F.sum(t), *(F.sum(t * rate * p[k]) for k in range(n)), *(F.sum(F.when(rate > 0, t * p[j] * p[k]).otherwise(0.0)) for j, k in pairs)).first()
        total = float(sums[0] or 0)
        if not total:
            return []
        residual = np.array([float(x) for x in sums[1 : n + 1]]) / total - targets
        error = float(np.abs(residual).max())
        if error < best:
            best, best_steps = error, list(steps)
        if error < tolerance:
            break
        moments = np.zeros((n, n))
        for (j, k), x in zip(pairs, sums[n + 1 :], strict=True):
            moments[j, k] = moments[k, j] = float(x) / total
        steps.append(np.linalg.lstsq(moments + 1e-9 * np.eye(n), residual, rcond=1e-10)[0].tolist())
    return best_steps


def mixed(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, targets: dict[str, float] = TARGETS, text: bool = True) -> DataFrame:
    """The documents, with their texts or without, with n_tokens, a posterior p_<domain> for each domain, rate, and copies (the rate, rounded by a draw)."""
    names = list(domains)
    made = {"n_tokens", "rate", "copies", "_tokens", "_rate", "_draw", *(f"p_{d}".lower() for d in names), *(f"_p{k}" for k in range(len(names)))}
    docs = docs.select(*(c for c in docs.columns if c.lower() not in made))
    model = fit_classifier(docs, labels, domains)
    share = np.array([targets[d] for d in names], np.float64)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    # each text is classified once: the steps read the few columns that they need, the result all of them
    found = materialize(classified(docs.withColumn("_draw", draw), model, len(names), text), "mass")
    found = found.withColumn("_rate", rate_of(solve(found, share / share.sum())))
    copies = F.floor(F.col("_rate") + F.col("_draw")).cast("int")
    return found.select(*(c for c in docs.columns if text or c != "text"), F.col("_tokens").alias("n_tokens"), *(F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(names)), F.col("_rate").alias("rate"), copies.alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rate of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mixed(docs, table(spark, sf_dir, "labels"), text=False)
