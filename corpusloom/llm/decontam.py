"""Benchmark decontamination: an FM-index for each training shard, searched for the phrases of test items.

Items are cut into windows of ten words (an item of fewer words is one window). A shard is a run of
documents; its text keeps the runs of words that some item uses and that are as long as the shortest
window, since no window can lie elsewhere. The windows are searched backwards through the wavelet
ranks, their occurrences located by sampled suffix positions, and overlapping spans merged.

Items are cut into pieces of bounded size, which overlap by a window, and taken in blocks of them: each block
is broadcast once, meets all documents, and is destroyed before the next one is made.

Cases: null or empty texts have no words and no hits; an item without words has no window; rows that
repeat a doc_id or an item_id are taken each for itself (an item counts once a document); items without
item_id are one item in the query and the cleaner, whose words hit and go like any others: it counts in
n_items, and items_sha256, a hash of names, leaves it out (find_contamination passes them over unless
`nameless` is set); empty tables give no rows or no hits; other columns are ignored by the report and kept by the cleaner.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, fresh, hot_keys, materialize, salted_left_join, table
from .fmindex import FMIndex

WINDOW = 10
#: A block of items holds about so many bytes of text, a piece of an item so many words, a shard of documents so many words.
BLOCK_BYTES, PIECE, SHARD_WORDS = 8 << 20, 4096, 2_000_000
#: A-Z to a-z, every ASCII byte that is neither letter nor digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = "array<struct<first:int,after:int>>"
REPORT = f"row bigint, doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans {SPANS}"


class Phrases:
    """The windows of a block of items over a vocabulary of their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        order = lambda x: (x is None, x or "")
        self.items = sorted({i for i, _ in items}, key=order)
        at, get = {x: k for k, x in enumerate(self.items)}, self.vocabulary.setdefault
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for name, text in items:
            words = text.translate(FOLD).split()
            ids = np.fromiter((get(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
            if not len(ids):
                continue
            if len(ids) < window:
                ids = np.concatenate([ids, np.zeros(window - len(ids), np.int32)])
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owners.append(np.full(len(ids) - window + 1, at[name]))
        self.patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(1)
        self.shortest = int(self.lengths.min(initial=window))
        owned = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], 1), axis=0)
        self.owners = owned[:, 1]
        self.first_owner = np.searchsorted(owned[:, 0], np.arange(len(self.patterns) + 1))

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, list[str], np.ndarray]]:
        """For each text of a shard: words, words hit, items, merged spans of words."""
        parts, sizes, get = [], [], self.vocabulary.get
        for text in texts:
            words = text.translate(FOLD).split() if text else []
            parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            sizes.append(len(words))
        gap = np.zeros(1, np.int32)
        ids = np.concatenate([x for p in parts for x in (gap, p)] + [gap])  # a gap in front of each document
        begin = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])[:-1] + 1
        edge = np.diff((ids > 0).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        wide = ends - starts >= self.shortest
        starts, ends = starts[wide], ends[wide]
        empty = np.zeros((0, 2), np.int64)
        if not len(starts) or not len(self.lengths):
            return [(n, 0, [], empty) for n in sizes]
        lens = ends - starts + 1  # with the gap that follows
        into = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) + np.repeat(starts - into, lens)
        index = FMIndex(ids[place], len(self.vocabulary) + 1)
        low, high = index.search(self.patterns, self.lengths)
        found = np.flatnonzero(high > low)
        many = high[found] - low[found]
        rows = np.arange(int(many.sum())) + np.repeat(low[found] - (np.cumsum(many) - many), many)
        which, at = np.repeat(found, many), place[index.locate(rows)]
        change = np.zeros(len(ids) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.lengths[which], -1)
        hit = np.cumsum(change) > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
        first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of_span = np.searchsorted(begin, first, "right") - 1
        doc = np.searchsorted(begin, at, "right") - 1
        pairs = np.unique(np.stack([doc, which], 1), axis=0)
        n = self.first_owner[pairs[:, 1] + 1] - self.first_owner[pairs[:, 1]]
        owner = self.owners[np.arange(int(n.sum())) + np.repeat(self.first_owner[pairs[:, 1]] - (np.cumsum(n) - n), n)]
        owned = np.unique(np.stack([np.repeat(pairs[:, 0], n), owner], 1), axis=0)
        out = [(n, 0, [], empty) for n in sizes]
        for d in np.unique(of_span).tolist():
            a, b = np.searchsorted(of_span, [d, d + 1])
            spans = np.stack([first[a:b], after[a:b]], 1) - begin[d]
            a, b = np.searchsorted(owned[:, 0], [d, d + 1])
            out[d] = (sizes[d], int((spans[:, 1] - spans[:, 0]).sum()), [self.items[i] for i in owned[a:b, 1]], spans)
        return out


def cut(text: bytes, spans) -> bytes:
    """The text without the given spans of words; what remains is joined by a space."""
    at = [m.span() for m in WORD.finditer(text)]
    parts, pos = [], 0
    for first, after in spans:
        parts.append(text[pos : at[first][0]].rstrip())
        pos = at[after - 1][1]
    parts.append(text[pos:].lstrip())
    return b" ".join(x for x in parts if x)


def shards(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches cut so that a shard stays bounded by words (about six bytes each)."""
    for batch in batches:
        texts, a, size = bytes_of(batch.column(column)), 0, 0
        for k, text in enumerate(texts):
            size += len(text or b"")
            if size >= 6 * SHARD_WORDS or k == len(texts) - 1:
                yield batch.slice(a, k + 1 - a), texts[a : k + 1]
                a, size = k + 1, 0


def pieces(benchmark: DataFrame, window: int, nameless: bool) -> DataFrame:
    """(item_id, text): distinct runs of PIECE words of the items, each with the window that reaches into the next, so that no row is large."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                words = text.translate(FOLD).split()
                out += [(name, b" ".join(words[a : a + PIECE + window - 1])) for a in range(0, max(1, len(words) - window + 1), PIECE) if words]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["item_id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items if nameless else items.filter(F.col("item_id").isNotNull())
    return items.mapInArrow(run, "item_id string, text binary").distinct()


def phrase_blocks(benchmark: DataFrame, window: int, nameless: bool = True) -> tuple[int, Iterator]:
    """How many blocks of items of bounded size there are, and broadcasts of their Phrases, made one after the other."""
    items = pieces(benchmark, window, nameless)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))

    def each():
        for k in range(blocks):
            block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            rows = block.toArrow()
            yield benchmark.sparkSession.sparkContext.broadcast(Phrases(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), window))

    return blocks, each()


def scan(docs: DataFrame, phrases) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items, spans) of docs(row, doc_id, text) for one broadcast block of items."""
    spans = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", spans)])

    def run(batches):
        for batch, texts in shards(batches, "text"):
            rows = phrases.value.scan(texts)
            found = [[{"first": a, "after": b} for a, b in r[3].tolist()] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], schema.field(k + 2).type) for k in range(3)), pa.array(found, spans)], schema=schema)

    return docs.mapInArrow(run, REPORT)


def scan_blocks(docs: DataFrame, blocks: int, phrases: Iterator) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items, spans) for all blocks of items; rows that share `row` are the same row, repeated.

    With several blocks, each one's finds are written and its broadcast destroyed before the next is made.
    """
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if blocks == 1:
        return scan(docs, next(phrases))
    every, others = None, []
    for block in phrases:
        found = scan(docs, block)
        if every is None:
            every = materialize(found, "spans")
        else:
            others.append(materialize(found.filter("n_hit > 0").dropDuplicates(["row"]).select("row", "items", "spans"), "spans", slim=True))
        block.destroy()
    more = others[0]
    for part in others[1:]:
        more = more.unionByName(part)
    more = more.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("more_items"), F.flatten(F.collect_list("spans")).alias("more_spans"))
    both = salted_left_join(every, more, "row", hot_keys(every, "row"))
    # spans of all blocks are sorted and folded into disjoint ones
    fold = """aggregate(array_sort(concat(spans, coalesce(more_spans, array()))), cast(array() as array<struct<first:int,after:int>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).after >= x.first,
           concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'after', greatest(element_at(a, -1).after, x.after)))),
           concat(a, array(x))))"""
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))))
    both = both.select("row", "doc_id", "n_words", items.alias("items"), F.expr(fold).alias("spans"))
    return both.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.after - x.first)")).select("row", "doc_id", "n_words", "n_hit", "items", "spans")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, nameless: bool = False) -> DataFrame:
    """For each document: words, words inside an occurrence of a window, items with occurrences, merged spans."""
    return scan_blocks(docs, *phrase_blocks(benchmark, window, nameless)).drop("row")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the merged spans; one that consists of them alone goes. Columns stay; n_chars follows the text."""
    blocks, phrases = phrase_blocks(benchmark, window)
    fields, given = docs.schema, blocks > 1
    key, cuts, whole = fresh(docs, "row", "spans", "all")
    if given:
        found = scan_blocks(docs, blocks, phrases).filter("n_hit > 0").dropDuplicates(["row"])
        found = materialize(found.select(F.col("row").alias(key), F.col("spans").alias(cuts), (F.col("n_hit") == F.col("n_words")).alias(whole)), "spans")
        named = docs.withColumn(key, F.xxhash64("doc_id", "text"))
        docs = salted_left_join(named, found, key, hot_keys(named.select(key), key)).drop(key)
    else:
        block = next(phrases)

    def clean(batches):
        for batch, texts in shards(batches, "text"):
            if given:
                rows = [(1, int(bool(a)), [], [(x["first"], x["after"]) for x in s or []]) for s, a in zip(batch.column(cuts).to_pylist(), batch.column(whole).to_pylist(), strict=True)]
            else:
                rows = block.value.scan(texts)
            kept = [k for k, r in enumerate(rows) if r[1] < r[0] or not r[0]]
            new = {k: cut(texts[k], rows[k][3]) for k in kept if len(rows[k][3])}
            out = batch.select(fields.names).take(pa.array(kept, pa.int64()))
            if new:
                text = pa.array([new.get(k, texts[k]) for k in kept], pa.binary()).cast(pa.string())
                at = out.schema.get_field_index("text")
                out = out.set_column(at, out.schema.field(at), text.cast(out.schema.field(at).type))
                at = out.schema.get_field_index("n_chars")
                if at >= 0:
                    size = pa.compute.utf8_length(text).cast(out.schema.field(at).type)
                    touched = pa.array([k in new for k in kept])
                    out = out.set_column(at, out.schema.field(at), pa.compute.if_else(touched, size, out.column(at)))
            yield out

    import pyarrow.compute  # noqa: F401  for pa.compute

    return docs.mapInArrow(clean, fields)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by windows of ten words of the benchmark items."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (
  SELECT pos.doc_id, pos.i, sizes.n, win.item_id
  FROM pos JOIN sizes ON pos.i + sizes.n - 1 <= len(pos.w)
  JOIN win ON win.n = sizes.n AND win.p = list_slice(pos.w, pos.i, pos.i + sizes.n - 1)
),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN owned USING (doc_id)
"""
