"""Readers and writers of the formats that the corpora come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECRETS = ("token", "secret", "password", "api_key")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quotes doubled, line breaks inside quotes; a byte order mark in the first name is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def newest_csv(spark: SparkSession, folder: str, prefix: str) -> str:
    """Path of the newest file {prefix}_*.csv that isn't a cleaned one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*.csv").load(folder).filter(~F.col("path").contains("_cleaned"))
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    if row is None or row[0] is None:
        raise FileNotFoundError(f"no {prefix}_*.csv in {folder}")
    return row[0]


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines. Strict reading fails on a broken line; else `_corrupt` holds such lines."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Rows added to a table as one batch."""
    df.write.mode("append").format(form).save(path)


def redact(value):
    """A report with the values of secret keys replaced, at any depth."""
    hidden = lambda k: any(k.lower() == s or k.lower().endswith(s) or s in k.lower() for s in SECRETS)
    if isinstance(value, dict):
        return {k: "<redacted>" if hidden(str(k)) else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def project(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*(k for k in keys if k in df.columns))


def read_pdf(spark: SparkSession, path: str, text_of: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text) of PDF files; the extractor is a parameter, pypdf where it is installed."""
    if text_of is None:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("pass text_of: no PDF library is installed") from e

        def text_of(raw: bytes) -> str:
            import io

            return "\n".join(t for p in PdfReader(io.BytesIO(raw)).pages if (t := (p.extract_text() or "").strip()))

    @F.pandas_udf("string")
    def extract(raw):
        return raw.map(lambda x: text_of(bytes(x)))

    return spark.read.format("binaryFile").load(path).select("path", extract("content").alias("text"))
