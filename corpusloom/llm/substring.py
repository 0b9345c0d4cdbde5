"""Exact substring dedup: repeated runs of words, found by FM-indexes over shards of candidate passages.

A window is LENGTH consecutive words of one document. Every window has an anchor: the run of ANCHOR words
in it whose hash is smallest (the first of equals). Equal windows have equal anchors at equal offsets, so
they meet under one anchor hash. Consecutive windows with one anchor position form a segment.

1. Each document sends its segments (anchor, hash of all words, place) as numbers. A segment whose anchor
   occurs once in the corpus is done: none of its windows can repeat.
2. Of the other anchors, one copy of each distinct segment is fetched; a shard is the set of segments whose
   anchors hash to it. Its FM-index is a suffix order and a wavelet matrix over runs of STRIDE words, so a
   window is a few symbols. All segments of the shard are streamed backwards against the index, which gives
   their matching statistics: how many symbols before each place occur together twice or more. Places that
   reach the length of a window are the ends of reported intervals.
3. Reported windows go back to the documents; words they cover are removed.

Shards grow in number with the candidates. An anchor with more than HOT distinct segments (a passage that
many texts hold, each with other words around it) is not put into one shard: its windows are cut apart and
meet by a hash of their own words, counted before they travel, so that no task holds what one anchor has.
A task holds SHARD segments on average and, by its largest anchor, HOT more. All tables but the texts are
numbers.

Cases: null texts have no words; a text of fewer than LENGTH words keeps all; rows that repeat a doc_id
are told apart by their texts and count as separate documents; an empty table gives no rows; other
columns are ignored by the query and kept by the pipeline stage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, fresh, hot_keys, materialize, salted_left_join, table
from .fmindex import FMIndex
from .minhash import mix

LENGTH, ANCHOR, STRIDE = 35, 8, 5
#: About so many segments go to a shard; the windows of anchors with more distinct segments are cut apart.
SHARD, HOT = 4096, 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    total, n = np.zeros(max(0, len(words) - size + 1), np.uint64), max(0, len(words) - size + 1)
    for i in range(size):
        total = total * _BASE + words[i : n + i]
    return mix(total)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each run of `width`, the first of equals."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def segments(words: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows) of each maximal run of windows with one anchor position."""
    if len(words) < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    grams = runs(words, ANCHOR)
    at = sliding_first_min(grams, length - ANCHOR + 1)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return grams[at[first]], first, np.diff(np.concatenate([first, [len(at)]]))


def content(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run words[first : first + size], from prefix sums of a polynomial: equal runs have equal ones wherever they stand."""
    n = len(words)
    power, back = np.full(n + 1, _BASE), np.full(n + 1, _BACK)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * power[:n])])
    run = total[first + sizes] - total[first]
    return mix(run * back[first] ^ mix(sizes.astype(np.uint64)))


PLACES = "anchor bigint, body bigint, row bigint, first int, windows int"


def places(docs: DataFrame, length: int) -> DataFrame:
    """The segments of docs(row, text)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            which: list[int] = []
            for k, text in enumerate(bytes_of(batch.column(1))):
                if not text or len(text) < 2 * length - 1:
                    continue
                words = word_hashes(text)
                anchor, first, windows = segments(words, length)
                if len(anchor):
                    rows.append((anchor.view(np.int64), content(words, first, windows + length - 1).view(np.int64), first.astype(np.int32), windows.astype(np.int32)))
                    which += [k] * len(anchor)
            if rows:
                anchor, body, first, windows = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(body), ids.take(pa.array(which)), pa.array(first), pa.array(windows)], ["anchor", "body", "row", "first", "windows"])

    return docs.mapInArrow(run, PLACES)


def index_shard(words: list[np.ndarray], copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment (word hashes) of a shard: which of its windows occur twice or more, copies counted.

    The indexed text holds, for each residue modulo STRIDE, the runs of STRIDE words of a segment at that
    residue; a window is length / STRIDE consecutive symbols of one residue. The matching statistic of a
    place is the number of symbols in front of it that occur together twice or more, up to a window's.
    """
    steps = length // STRIDE
    grams = [runs(w, STRIDE) for w in words]
    flat = np.concatenate(grams)
    values, ids = np.unique(flat, return_inverse=True)
    text, origin, windows, where = [], 0, [], []
    for g in grams:
        mine = ids[origin : origin + len(g)] + 1
        for r in range(STRIDE):
            text += [mine[r::STRIDE], np.zeros(1, np.int64)]
        n = len(g) - length + STRIDE
        windows.append(np.stack([mine[i * STRIDE : i * STRIDE + n] for i in range(steps)], 1))
        where.append(n)
        origin += len(g)
    index = FMIndex(np.concatenate(text).astype(np.int32), len(values) + 1)
    reach = index.matching(np.concatenate(windows), 2)
    many = np.repeat(copies > 1, where)
    return np.split((reach >= steps) | many, np.cumsum(where)[:-1])


def pack5(words: np.ndarray) -> bytes:
    """Five low-order bytes of each hash."""
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def masks(hits: list[np.ndarray]) -> list[int]:
    """Flags of windows as numbers, the first window in the lowest bit."""
    return [int(h @ (np.int64(1) << np.arange(len(h)))) for h in hits]


def search_shards(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(anchor, body, mask) for distinct segments: `mask` has a bit for each window, set where it is repeated.

    `wanted` has (anchor, body, copies, row, first, windows, hot): one place for each distinct segment.
    """
    asked = wanted.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("anchor", "body", "copies", "first", "windows", "hot")).alias("asked"))
    texts = docs.select("row", "text").join(asked, F.col("row") == F.col("of")).select("text", "asked")

    def fetch(batches):
        names = ["route", "anchor", "body", "copies", "first", "words"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            wishes = batch.column(1)
            begin, flat = wishes.offsets.to_pylist(), wishes.values
            rows = list(zip(*(flat.field(k).to_pylist() for k in range(6)), strict=True))
            for k, text in enumerate(bytes_of(batch.column(0))):
                words = word_hashes(text)
                for anchor, body, copies, first, windows, hot in rows[begin[k] : begin[k + 1]]:
                    part = words[first : first + windows + length - 1]
                    if not hot:
                        out.append((anchor, anchor, body, copies, 0, pack5(part)))
                        continue
                    own = content(part, np.arange(windows), np.full(windows, length)).view(np.int64)
                    out += [(route, anchor, body, copies, at, None) for at, route in enumerate(own.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

    found = materialize(texts.mapInArrow(fetch, "route bigint, anchor bigint, body bigint, copies bigint, first int, words binary"), "segments")
    whole, single = found.filter("words IS NOT NULL"), found.filter("words IS NULL")
    n = max(1, -(-whole.count() // SHARD))

    def look(block: pa.Table) -> pa.Table:
        words = [unpack5(x) for x in block.column("words").to_pylist()]
        hits = index_shard(words, block.column("copies").to_numpy(), length)
        return pa.table({"anchor": block.column("anchor"), "body": block.column("body"), "mask": pa.array(masks(hits), pa.int64())})

    shard = F.pmod(F.xxhash64("route"), F.lit(n)).cast("int")
    seen = whole.withColumn("shard", shard).groupBy("shard").applyInArrow(look, "anchor bigint, body bigint, mask bigint").filter("mask <> 0")
    if single.isEmpty():
        return seen
    often = single.groupBy("route").agg(F.sum("copies").alias("times")).filter("times > 1")
    again = salted_left_join(single.select("route", "anchor", "body", "first"), often, "route", hot_keys(single, "route", 256), spread=F.col("body")).filter("times IS NOT NULL")
    return seen.unionByName(again.groupBy("anchor", "body").agg(F.bit_or(F.expr("shiftleft(1L, first)")).alias("mask")))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, hits): for each row of docs(row, text) with repeated windows, the list of (first window, mask of windows from there)."""
    if not ANCHOR <= length <= 62 + ANCHOR or length % STRIDE:
        raise ValueError(f"windows have {ANCHOR} to {62 + ANCHOR} words, a multiple of {STRIDE}")
    every = materialize(places(docs, length), "places")
    one = F.min(F.struct("row", "first", "windows")).alias("one")
    distinct = every.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("copies"), one)
    known = distinct.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("kinds")).filter(F.col("all") > 1)
    both = materialize(distinct.join(known, "anchor").select("anchor", "body", "copies", "one.*", "kinds"), "repeated")
    wanted = both.select("anchor", "body", "copies", "row", "first", "windows", (F.col("kinds") > HOT).alias("hot"))
    seen = materialize(search_shards(wanted, docs, length), "masks")
    keyed = lambda df: df.withColumn("segment", F.xxhash64("anchor", "body"))
    left = keyed(every).select("segment", F.col("anchor").alias("a"), F.col("body").alias("b"), "row", "first")
    joined = salted_left_join(left, keyed(seen), "segment", hot_keys(left, "segment", 256), spread=F.col("row"))
    joined = joined.filter("mask IS NOT NULL AND a = anchor AND b = body")
    return joined.groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("hits"))


def covered(n: int, first: np.ndarray, mask: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of n words a repeated window covers."""
    bits = np.arange(length - ANCHOR + 1)
    at = (first[:, None].astype(np.int64) + bits)[(mask[:, None] >> bits & 1).astype(bool)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def with_hits(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """The documents with a column of their repeated windows, and its name, which no other column has.

    Rows are told by a hash of doc_id and text: those that share it are the same row, repeated.
    """
    key, hits = fresh(docs, "row", "hits")
    named = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = repeated_windows(named.select(F.col(key).alias("row"), F.col("text")), length)
    found = found.select(F.col("row").alias(key), F.col("hits").alias(hits))
    return named.join(found, key, "left").drop(key), hits


def split_batch(batch: pa.RecordBatch, name: str, length: int):
    """For each text of a batch: its words and which of them are covered (None: none)."""
    hits = batch.column(batch.schema.get_field_index(name))
    begin, some, flat = hits.offsets.to_numpy(), hits.is_valid().to_pylist(), hits.values
    first, mask = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    for k, text in enumerate(bytes_of(batch.column(batch.schema.get_field_index("text")))):
        words = text.split() if text else []
        part = slice(begin[k], begin[k + 1])
        yield text, words, covered(len(words), first[part], mask[part], length) if some[k] and words else None


def removed_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    docs, name = with_hits(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), length)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for _, words, cover in split_batch(batch, name, length):
                kept = words if cover is None else [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string()], strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without repeated passages; one that consists of them alone goes. Untouched texts stay as they are."""
    fields = docs.schema
    docs, name = with_hits(docs, length)

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            texts, kept = [], []
            new: dict[int, bytes] = {}
            for k, (text, words, cover) in enumerate(split_batch(batch, name, length)):
                texts.append(text)
                if cover is not None and cover.any():
                    if cover.all():
                        continue
                    new[k] = b" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c)
                kept.append(k)
            out = batch.select(fields.names).take(pa.array(kept, pa.int64()))
            if new:
                text = pa.array([new.get(k, texts[k]) for k in kept], pa.binary()).cast(pa.string())
                at = out.schema.get_field_index("text")
                out = out.set_column(at, out.schema.field(at), text.cast(out.schema.field(at).type))
                at = out.schema.get_field_index("n_chars")
                if at >= 0:
                    size = pc.utf8_length(text).cast(out.schema.field(at).type)
                    out = out.set_column(at, out.schema.field(at), pc.if_else(pa.array([k in new for k in kept]), size, out.column(at)))
            yield out

    return docs.mapInArrow(run, fields)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside repeated passages of 35 words."""
    return removed_words(table(spark, sf_dir, "documents"))
