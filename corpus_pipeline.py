"""Corpus preparation in five stages: toxicity, near-duplicates, repeated passages, benchmark leaks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, mixing, nearcopies, substring, toxicity
from corpusloom.llm.common import WRITTEN, discard, materialize, sweep, table

#: The last stage mixes what is left: prose and rough text.
PIPELINE_DOMAINS = {"prose": "quality = 1", "rough": "quality = 0"}
PIPELINE_TARGETS = {"prose": 0.9, "rough": 0.1}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    Cases: null, empty and letter-less texts stay; rows are judged each for itself, so equal texts share one fate;
    without labelled rows of both classes all stay; an empty table gives none; all columns stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more in five-word shingles, exactly one row: that with the smallest doc_id.

    SimHash's covering family proposes pairs, prefix filtering all others; whole sets decide.
    Cases: null and word-less texts are one group; null doc_ids come last; of repeated rows one stays; two texts under
    one doc_id are judged apart; an empty table gives none; all columns stay.
    """
    return nearcopies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words that repeat anywhere.

    Cases: a document of repeated words alone goes, one without words stays; untouched texts stay byte for byte, others
    are joined by single spaces and n_chars follows; an empty table gives none; all columns stay.
    """
    return substring.remove_repeats(docs)


def cut_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ten words that a benchmark item has.

    Cases: as for repeats; items without item_id or of fewer than ten words count, items without words don't.
    """
    return decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at least once, with posteriors, rate and copies.

    Cases: texts without tokens keep a rate; columns with the name of a result give way to it; equal rows are drawn alike.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), PIPELINE_DOMAINS, PIPELINE_TARGETS).filter("copies > 0")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("leaks", cut_leaks), ("mixing", mix)]

#: Trained models, components and repeated passages are beyond SQL; tests hold each stage against a plain loop over its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage wrote on the way, and its input, go once it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, given = set(WRITTEN), docs
        docs = materialize(stage(spark, given, sf_dir), f"stage-{name}")
        sweep(docs, before)
        discard(given)
    return STAGES[-1][1](spark, docs, sf_dir)
