"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits: the majority, over all shingles of a text, of the bits of their XXH64. Two
of them are linked when they differ in at most `radius` bits. The covering family gives each bit a
non-zero vector of radius + 1 bits and has a table for each non-zero vector v: its mask holds the bits
whose vectors have odd inner product with v. The vectors of up to `radius` differing bits don't span the
whole space, so some v is orthogonal to all of them and both fingerprints fall into one bucket there:
no link is lost.

Equal fingerprints are one node. Buckets of up to BUCKET nodes are compared within a task, without
emitting pairs: a search from node to node yields one star for each linked group. Larger buckets are cut
into blocks, and each task compares two blocks; beyond WIDE nodes, every node is keyed by itself with
each set of `radius` free bits cleared, and nodes that share a key (all are within the radius) get one
star. Components follow by star contraction.

Cases: a null or word-less text has fingerprint zero and is linked like any other; a text of fewer than
three words is one shingle; rows that repeat a doc_id are rows of that document; an empty table gives no
rows; other columns are ignored by the query and kept by the pipeline stage.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, hot_keys, materialize, salted_left_join, table
from .components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Nodes of a bucket compared in one task, of a block of a larger bucket, and of a bucket that is keyed by cleared bits.
BUCKET, BLOCK, WIDE = 4096, 2048, 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero of none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask for each of the 2^(radius + 1) - 1 tables."""
    vectors = [i % ((2 << radius) - 1) + 1 for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            memo: dict[bytes | None, int] = {}
            out = []
            for text in bytes_of(batch.column(1)):
                fp = memo.get(text)
                if fp is None:
                    memo[text] = fp = signed(fingerprint(text, shingle))
                out.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def stars(fps: np.ndarray, radius: int, other: np.ndarray | None = None) -> tuple[list, list]:
    """Edges (node, representative) that span the groups linked within one set, or between two sets."""
    all_fps = fps if other is None else np.concatenate([fps, other])
    first = np.arange(len(all_fps)) < len(fps)
    left, src, dst = np.arange(len(all_fps)), [], []
    while len(left) > 1:
        root, queue = left[0], [left[0]]
        left = left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(all_fps[left] ^ all_fps[x]) <= radius
            if other is not None:
                near &= first[left] != first[x]
            for y in left[near].tolist():
                queue.append(y)
                src.append(y)
                dst.append(root)
            left = left[~near]
    return all_fps[src].view(np.int64).tolist(), all_fps[dst].view(np.int64).tolist()


EDGES = "src bigint, dst bigint"


def edge_batch(src: list, dst: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def link_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Edges within buckets (t, key) of up to BUCKET nodes; a larger bucket is passed over as it streams by."""

    def run(batches):
        held: list[np.ndarray] = []
        size, current = 0, None

        def close():
            if current is None or size < 2 or size > BUCKET:
                return [], []
            return stars(np.concatenate(held), radius)

        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
            src, dst = [], []
            pairs = (end - begin == 2)[1:-1]  # whole buckets of two, all at once
            a = begin[1:-1][pairs]
            near = a[np.bitwise_count(fp[a] ^ fp[a + 1]) <= radius]
            src += fp[near + 1].view(np.int64).tolist()
            dst += fp[near].view(np.int64).tolist()
            for i in np.flatnonzero((end - begin > 2) | (np.arange(len(begin)) == 0) | (np.arange(len(begin)) == len(begin) - 1)).tolist():
                a, b = int(begin[i]), int(end[i])
                if a == b:
                    continue
                if (t[a], key[a]) != current:
                    s, d = close()
                    src += s
                    dst += d
                    held, size, current = [], 0, (t[a], key[a])
                size += b - a
                held = held + [fp[a:b].copy()] if size <= BUCKET else []
            yield edge_batch(src, dst)
        yield edge_batch(*close())

    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, EDGES)


def link_blocks(rows: DataFrame, radius: int) -> DataFrame:
    """Edges within large buckets (t, key, n, fp): each task compares two blocks of about BLOCK nodes."""
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("t", "key", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).alias("second"), "fp")

    def compare(block: pa.Table) -> pa.Table:
        fp = block.column("fp").to_numpy().view(np.uint64)
        second = block.column("second").to_numpy()
        same = block.column("a")[0].as_py() == block.column("b")[0].as_py()
        src, dst = stars(fp, radius) if same else stars(fp[~second], radius, fp[second])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return rows.groupBy("t", "key", "a", "b").applyInArrow(compare, EDGES)


def link_cleared(rows: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Edges within very large buckets: nodes that agree once `radius` of the free bits are cleared get one star."""

    def run(batches):
        for batch in batches:
            t, fp = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            for x, f in zip(t, fp.tolist(), strict=True):
                free = [1 << i for i in range(64) if not masks[x] >> i & 1]
                keys = [f & ~sum(c) for c in combinations(free, radius)]
                which = range(len(keys))
                yield pa.RecordBatch.from_arrays([pa.array([x * 100000 + w for w in which], pa.int64()), pa.array(list(map(signed, keys)), pa.int64()), pa.array([signed(f)] * len(keys), pa.int64())], ["which", "cleared", "fp"])

    keyed = rows.select("t", "fp").mapInArrow(run, "which bigint, cleared bigint, fp bigint")
    lowest = keyed.groupBy("which", "cleared").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("which", "cleared", "low")
    return keyed.join(lowest, ["which", "cleared"]).select(F.col("fp").alias("src"), F.col("low").alias("dst")).filter("src <> dst")


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) that span every group of nodes(fp) linked at `radius` differing bits or fewer."""
    masks = covering_masks(radius)
    entries = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)))
    rows = nodes.select("fp", F.explode(entries).alias("e")).select("e.t", "e.key", "fp")
    edges = link_buckets(rows, radius)
    large = materialize(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET), "large-buckets", slim=True)
    if large.isEmpty():
        return edges
    rows = rows.join(large, ["t", "key"])
    return edges.unionByName(link_blocks(rows.filter(F.col("n") <= WIDE), radius)).unionByName(link_cleared(rows.filter(F.col("n") > WIDE), radius, masks))


def group_documents(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    prints = materialize(with_fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes", slim=True)
    roots = connected_components(link_fingerprints(nodes, radius))
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("far"))
    lowest = linked.filter("far").groupBy("root").agg(F.min("low").alias("least"))
    groups = materialize(linked.filter("far or n > 1").join(lowest, "root", "left").select("fp", F.coalesce("least", "low").alias("component_id")), "groups", slim=True)
    joined = salted_left_join(prints, groups, "fp", hot_keys(prints, "fp"), spread=F.xxhash64("doc_id"))
    return joined.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents whose doc_id is the smallest of their group; documents without doc_id stay."""
    groups = group_documents(docs, radius)
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = group_documents(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
