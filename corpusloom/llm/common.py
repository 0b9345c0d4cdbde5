"""Helpers that the operators of this package share: tables, shared folder, skew-safe joins."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting of Spark: remove the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that this program has written and not deleted.
WRITTEN: list[str] = []
#: Bytes A-Z to a-z; every other byte stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session with a local master may go without that setting: it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context = spark.sparkContext
        if not hasattr(context, "_corpusloom_dir"):
            context._corpusloom_dir = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        base = context._corpusloom_dir
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and its shuffles can go.

    A slim table (a few numbers a row) is written by two tasks a core, not one file for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # the files of this write's shuffles go as soon as it ends; nothing else runs this plan again
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(2 * spark.sparkContext.defaultParallelism) if slim else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    WRITTEN.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later plan reads."""
    for df in frames:
        path = getattr(df, "_corpusloom_path", None)
        if path:
            delete(df.sparkSession, path)


def sweep(kept: DataFrame, before: set[str]) -> None:
    """Delete all tables that materialize() wrote since WRITTEN held `before`, but for one: the rest only served to make it."""
    for path in [p for p in WRITTEN if p not in before and p != kept._corpusloom_path]:
        delete(kept.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that no column of the frame has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bytes_of(column) -> list:
    """The UTF-8 bytes of an Arrow string column, None for nulls, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def hot_keys(df: DataFrame, key: str, parts: int = 64) -> list:
    """Keys that more than one row in `parts` carries: fewer than `parts` of them, by the pigeonhole principle."""
    counts = df.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(1000, total // parts)
    return [r[0] for r in counts.filter((F.col("count") > least) & F.col(key).isNotNull()).select(key).collect()]


def salted_left_join(left: DataFrame, right: DataFrame, key: str, hot: list, salts: int = 32, spread: Column | None = None) -> DataFrame:
    """left.join(right, key, "left"), rows of hot keys dealt over `salts` tasks.

    `right` holds each key once; only its hot keys (under 64 of them) are repeated, `salts` times each.
    """
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(hot)
    dealt = F.pmod(spread if spread is not None else F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = left.withColumn("_salt", F.when(is_hot, dealt).otherwise(F.lit(0)))
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_salt", F.explode(every))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def next_power(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))
