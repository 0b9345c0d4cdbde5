"""Document fingerprints: one-permutation MinHash, optimally densified, low-order bits packed.

A text is the set of its shingles of five lower-cased words (fewer words: the whole sequence). Each
shingle is hashed once; the top bits name its bin, the rest its value, and a bin keeps its smallest
value. An empty bin takes the value of the first filled bin in a random order of its own (the same for
all texts), which keeps the estimate unbiased. The low eight bits of each value are packed. Of two
unequal values 1 in 256 agrees by chance; the likeness corrects for that.

Cases: a null or word-less text has the empty fingerprint, which is like itself (1.0) and unlike any
other (0.0); texts with the same words have equal fingerprints; documents with one doc_id follow each
other by text; null doc_ids come last; a single document is its own next one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, table

SHINGLE, BINS, BITS = 5, 256, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def donors(attempt: int, bins: int = BINS) -> np.ndarray:
    """The bin that each bin asks at an attempt."""
    return (mix(np.arange(bins, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)


_DONORS = np.stack([donors(a) for a in range(128)])


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each run of `size` word hashes, in order."""
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * _ODD + words[i : len(words) - size + 1 + i]
    return mix(total + np.uint64(size))


def fingerprint(text: bytes | None) -> bytes:
    """BINS bytes, or none for a text without words."""
    words = word_hashes(text or b"")
    if not len(words):
        return b""
    hashes = np.sort(shingle_hashes(words))
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    filled = np.zeros(BINS, bool)
    first = np.searchsorted(bins, np.arange(BINS))
    filled[bins] = True
    low = np.zeros(BINS, np.uint8)
    low[filled] = (mix(hashes[first[filled]]) & np.uint64(255)).astype(np.uint8)
    empty = np.flatnonzero(~filled)
    if len(empty):
        if len(empty) == BINS - 1:
            low[:] = low[filled][0]
        else:
            asked = _DONORS[:, empty]
            ok = filled[asked]
            low[empty] = low[asked[ok.argmax(0), np.arange(len(empty))]]
            late, attempt = empty[~ok.any(0)], len(_DONORS)
            while len(late):
                asked = donors(attempt)[late]
                ok = filled[asked]
                low[late[ok]] = low[asked[ok]]
                late, attempt = late[~ok], attempt + 1
    return low.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets of two texts."""
    if not a or not b:
        return float(a == b)
    match = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    chance = 2.0**-BITS
    return max(0.0, (match - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def next_parts(docs: DataFrame) -> DataFrame:
    """Documents as (part, copy, doc_id, text), dealt by part: it holds a range of doc_ids and, as its last row, the first document of the next part.

    Only the largest doc_id of each part comes to the driver, so many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).repartitionByRange(parts, "doc_id")
    heads = sorted((r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.max("doc_id")).select("max(doc_id)").collect()), reverse=True)

    @F.pandas_udf("array<int>")
    def parts_of(ids):
        import pandas as pd

        rising = np.array(heads[::-1], np.int64)
        known = ids.notna().to_numpy()
        at = np.full(len(ids), max(0, len(heads) - 1), np.int64)
        values = ids[known].to_numpy().astype(np.int64)
        at[known] = len(heads) - 1 - np.searchsorted(rising, values)
        head = np.zeros(len(ids), bool)
        head[known] = rising[len(heads) - 1 - at[known]] == values
        return pd.Series([[a, -1 - (a - 1) % len(heads)] if h else [a] for a, h in zip(at.tolist(), head.tolist(), strict=True)])

    rows = docs.select(F.explode(parts_of("doc_id")).alias("p"), "doc_id", "text")
    rows = rows.select(F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("part"), (F.col("p") < 0).alias("copy"), "doc_id", "text")
    return rows.repartitionById(max(1, len(heads)), F.col("part"))


FINGERPRINTS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to that and to the next document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = next_parts(docs)
    order = [F.col("part"), F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("text")]

    def run(batches):
        last, head, names = None, None, [x.split()[0] for x in FINGERPRINTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def row(one, two):
            text = edited(one[3].decode(), two[3].decode()).encode()
            fp, after, other = one[4], two[4], fingerprint(text)
            return one[2], len(one[3].decode()), hashlib.sha256(text).hexdigest(), fp.hex(), other.hex(), likeness(fp, other), likeness(fp, after)

        for batch in batches:
            out = []
            for part, copy, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), bytes_of(batch.column(3)), strict=True):
                now = (part, copy, doc_id, text, fingerprint(text) if not (copy and last and last[1] and last[0] == part) else b"")
                if last and not last[1] and last[0] == part:
                    out.append(row(last, now))
                elif last and not last[1]:
                    raise RuntimeError("a part without the first document of the next one")
                last, head = now, head or now
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)
        if last and not last[1]:  # only where every doc_id is null, so that there is one part: the first document follows the last
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(last, head), types, strict=True)], names)

    return rows.sortWithinPartitions(*order).mapInArrow(run, FINGERPRINTS)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
