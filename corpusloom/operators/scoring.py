"""Curvature, calibration of several signals to one probability, verdict rules and response shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the calibration.
WEIGHTS = {"llm": 0.8, "curvature": 0.2}
PENALTY = {"audit": 0.3, "defense": 0.5}
LOW, MEDIUM, CONFLICT, CONFIDENT = 0.3, 0.7, 0.6, 0.5


def curvature(log_probs: DataFrame) -> DataFrame:
    """Of log-probabilities by document and perturbation (0: the original): original less mean, over the population deviation."""
    p = F.when(F.col("perturbation") > 0, F.col("log_prob"))
    sums = log_probs.groupBy("doc_id").agg(F.max(F.when(F.col("perturbation") == 0, F.col("log_prob"))).alias("log_prob"), F.avg(p).alias("mean_perturbed"), F.count(p).alias("n"), F.stddev_pop(p).alias("_s"))
    std = F.when(F.col("n") <= 1, 1.0).otherwise(F.col("_s"))
    score = F.when(F.col("std_perturbed") > 0, (F.col("log_prob") - F.col("mean_perturbed")) / F.col("std_perturbed")).otherwise(0.0)
    return sums.withColumn("std_perturbed", std).withColumn("curvature", score).drop("_s")


def clip(x) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def verdict_probability(verdict, confidence) -> Column:
    base = F.when(verdict == "HUMAN", 0.0).when(verdict == "AI", 1.0).otherwise(0.5)
    return 0.5 + (base - 0.5) * confidence


def combine(df: DataFrame) -> DataFrame:
    """Adds base_prob, base_conf and has_conflict to verdict, confidence, curvature and n_spans."""
    c = F.col
    raw = verdict_probability(c("verdict"), c("confidence"))
    alone = c("n_spans") == 0
    llm = F.when(alone & (c("verdict") == "AI"), F.least(raw, F.lit(0.62))).when(alone & (c("verdict") == "MIXED"), F.least(raw, F.lit(0.58))).otherwise(raw)
    curve = clip(c("curvature") / 20.0) * F.when(alone, 0.42).otherwise(1.0)
    df = df.withColumn("_llm", llm).withColumn("_curve", curve)
    df = df.withColumn("base_prob", c("_llm") * WEIGHTS["llm"] + c("_curve") * WEIGHTS["curvature"]).withColumn("has_conflict", F.abs(c("_llm") - c("_curve")) > CONFLICT)
    return df.withColumn("base_conf", F.abs(c("base_prob") - 0.5) * 2 * F.when(c("has_conflict"), 0.7).otherwise(1.0)).drop("_llm", "_curve")


def judge(df: DataFrame) -> DataFrame:
    """Adds final_prob and final_conf after audit and defense."""
    c = F.col
    passed, defended = F.coalesce(c("audit_passed"), F.lit(True)), F.coalesce(c("defense_possible"), F.lit(False)) & c("defense_verdict").isNotNull()
    conf = F.when(passed, F.least(F.lit(1.0), c("base_conf") * 1.05)).otherwise(c("base_conf") * (1 - PENALTY["audit"]))
    prob = F.when(~passed & (c("audit_verdict") == "HUMAN"), F.greatest(F.lit(0.0), c("base_prob") - 0.3)).when(~passed & (c("audit_verdict") == "AI"), F.least(F.lit(1.0), c("base_prob") + 0.2)).otherwise(c("base_prob"))
    conf = F.when(defended, conf * (1 - PENALTY["defense"] * (1 - c("base_prob")))).otherwise(conf)
    prob = F.when(defended & (c("defense_verdict") == "HUMAN"), F.greatest(F.lit(0.0), prob - 0.4)).when(defended & (c("defense_verdict") == "MIXED"), F.greatest(F.lit(0.0), prob - 0.2)).otherwise(prob)
    return df.withColumn("final_prob", clip(prob)).withColumn("final_conf", clip(conf))


def decide(df: DataFrame) -> DataFrame:
    """Adds risk_level, needs_review, judge_agreement, signals and review_reason."""
    c = F.col
    passed, possible = F.coalesce(c("audit_passed"), F.lit(True)), F.coalesce(c("defense_possible"), F.lit(False))
    strong = possible & F.coalesce(c("defense_verdict").isin("HUMAN", "MIXED"), F.lit(False))
    unsure = c("final_conf") < CONFIDENT
    review = unsure | c("has_conflict") | (~passed & ~strong)
    signals = F.slice(F.array_compact(F.array(F.when(c("n_spans") > 0, F.concat(F.lit("spans: "), c("n_spans").cast("string"))), F.when(c("curvature") > 5, "high curvature").when(c("curvature") > 2, "medium curvature"), F.when(~passed, "audit failed"), F.when(possible, "defense found human marks"))), 1, 4)
    reasons = F.array_compact(F.array(F.when(c("has_conflict"), "conflicting signals"), F.when(~passed, "audit failed"), F.when(review & unsure, "low confidence")))
    return df.withColumns({
        "risk_level": F.when(c("final_prob") < LOW, "low").when(c("final_prob") < MEDIUM, "medium").otherwise("high"),
        "needs_review": review,
        "judge_agreement": (F.when(passed, 1.0).otherwise(0.5) + F.when(possible, 0.5).otherwise(1.0)) / 2,
        "signals": signals,
        "review_reason": F.when(review & (F.size(reasons) == 0), "manual check advised").otherwise(F.array_join(reasons, "; ")),
    })


def calibrate(docs: DataFrame, verdicts: DataFrame, spans: DataFrame, curves: DataFrame, audits: DataFrame, defenses: DataFrame) -> DataFrame:
    """All signals of a document to one result; a missing signal gets its fallback."""
    counts = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.avg("avg_confidence").alias("mean_span_confidence"), F.sum(F.col("end_char") - F.col("start_char")).alias("ai_chars"))
    df = docs.select("doc_id", "text").join(verdicts, "doc_id", "left").join(counts, "doc_id", "left").join(curves.select("doc_id", "curvature"), "doc_id", "left").join(audits, "doc_id", "left").join(defenses, "doc_id", "left")
    fill = {"verdict": F.coalesce("verdict", F.lit("MIXED")), "confidence": F.coalesce("confidence", F.lit(0.5)), "n_spans": F.coalesce("n_spans", F.lit(0)), "curvature": F.coalesce("curvature", F.lit(0.0)), "mean_span_confidence": F.coalesce("mean_span_confidence", F.lit(0.0)), "ai_chars": F.coalesce("ai_chars", F.lit(0))}
    df = decide(judge(combine(df.withColumns(fill))))
    words = F.regexp_count("text", F.lit(r"(?U)\S+"))
    # characters over words is the known unit mix of the raw score; the ratio of characters stands beside it
    return df.withColumns({"doc_score_raw": F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("ai_chars"), words), F.lit(0.0))), "ai_char_ratio": F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("ai_chars"), F.length("text")), F.lit(0.0)))}).drop("text")


def rule_verdict(n_spans, longest, curve) -> tuple[Column, Column]:
    """Verdict and confidence without a model."""
    verdict = F.when(n_spans > 0, F.when((curve > 10) | (longest > 100), "AI").otherwise("MIXED")).when(curve > 5, "MIXED").otherwise("HUMAN")
    confidence = F.when(n_spans > 0, F.when((curve > 10) | (longest > 100), 0.8).otherwise(0.6)).when(curve > 5, 0.6).otherwise(0.7)
    return verdict, confidence


def final_verdict(reasoner, audit_passed, audit_verdict, overturned, defense_verdict) -> Column:
    """Audit's correction first, then a passed audit's own verdict, then the defense, then the reasoner."""
    return F.coalesce(F.when(~audit_passed & audit_verdict.isNotNull(), audit_verdict), F.when(audit_passed, reasoner), F.when(overturned, defense_verdict), reasoner)


def prototype_score(token_score, curve_score) -> Column:
    """The two-signal form: 0.65 and 0.35, each standing in for the other where it is missing."""
    return F.coalesce(token_score * 0.65 + curve_score * 0.35, token_score, curve_score, F.lit(0.5))


def true_class(label, mixed) -> Column:
    return F.when(label == 0, 0).when(mixed | (label == 2), 1).when(label == 1, 2).otherwise(-1)


def verdict_class(verdict) -> Column:
    v = F.lower(F.trim(verdict))
    return F.when(v.isin("human", "человек"), 0).when(v.isin("mixed", "смешанный"), 1).when(v.isin("ai", "ии"), 2).otherwise(-1)


def risk_class(risk) -> Column:
    return F.when(risk == "low", 0).when(risk == "medium", 1).when(risk == "high", 2).otherwise(-1)


def best_attempt(attempts: DataFrame, accept: float = 3.0, last: int = 3) -> DataFrame:
    """Of generation attempts: the first accepted one (above `accept`, or equal at the last try), else the best with its failure reason."""
    refused = F.col("refused")
    ok = ~refused & ((F.col("judge_avg") > accept) | ((F.col("attempt") >= last) & (F.col("judge_avg") >= accept)))
    grouped = attempts.groupBy("chunk_id", "strategy").agg(F.min(F.when(ok, F.col("attempt"))).alias("accepted"), F.max_by("attempt", F.when(~refused, F.col("judge_avg"))).alias("best"), F.max(F.when(~refused, F.col("judge_avg"))).alias("best_avg"), F.count(F.lit(1)).alias("attempts_made"))
    return grouped.withColumn("chosen", F.coalesce("accepted", "best")).withColumn("reason", F.when(F.col("accepted").isNull(), "LOW_SCORE"))


def sequence_log_probs(tokens: DataFrame, key: str, log_prob: str, pad) -> DataFrame:
    """Of each sequence: tokens that aren't padding, the sum and the mean of their log-probabilities (0 where there are none)."""
    real = F.when(~F.coalesce(pad, F.lit(False)), F.col(log_prob))
    sums = tokens.groupBy(key).agg(F.count(real).alias("n_tokens"), F.coalesce(F.sum(real), F.lit(0.0)).alias("total"))
    return sums.withColumn("mean", F.coalesce(F.try_divide("total", "n_tokens"), F.lit(0.0)))
