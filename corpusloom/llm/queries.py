"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licences, lm, minhash, mixing, simhash, sitetree, substring, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_minhash": minhash.op2_minhash,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_licences": licences.op5_licences,
    "op6_html": sitetree.op6_html,
    "op7_warc": warc.op7_warc,
    "op8_substring": substring.op8_substring,
    "op9_mixing": mixing.op9_mixing,
    "op10_decontamination": decontam.op10_decontamination,
}

ORACLE: dict[str, str] = {
    "op7_warc": warc.OP7_SQL,
    "op10_decontamination": decontam.OP10_SQL,
}
