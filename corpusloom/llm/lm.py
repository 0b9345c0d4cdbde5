"""Language-model scoring by a weighted backoff automaton.

States are the word sequences of up to ORDER - 1 words seen in training; an arc reads a word, a failure
arc leads to the state without its first word. Probabilities are smoothed by a Dirichlet prior on the
next shorter state: P(w | h) = (c(h w) + k P(w | h')) / (c(h) + k), so a failure arc weighs
k / (c(h) + k) and every state is a distribution. Each order's k is estimated from the whole corpus: left out
one at a time, as many tokens must be new to their state, by k / (c(h) - 1 + k), as there are n-grams seen
once. The state of no words gives each known token (c - D) / N and all unknown words together D V / N, with
D = n1 / (n1 + 2 n2).

The corpus is too large for one table of states, so the automaton is built where it is used. Documents
are packed into blocks of bounded size. Each block sends its distinct n-grams and their training counts,
as sorted packed hashes, to shards of the hash range; a shard sums them over all blocks and answers each
block in the order asked. A block then has the states and arcs that its texts can reach, with counts of
the whole corpus. One left-to-right traversal carries a state through each text: it takes the arc that reads
the next word, following failure arcs to the first state that has one, and adds up log-probabilities. Long
texts are walked in lanes of LANE tokens at once, each from the state that the words in front of it lead to.
Every n-gram counts; nothing is pruned or capped.

Cases: null and empty texts are one end token; a text of unknown words alone follows failure arcs to the
unknown class; without training documents every probability is that of the unknown class, 1; rows that
repeat a doc_id are documents of their own; null doc_ids count as training; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, materialize, table
from .minhash import mix
from .toxicity import remainder

ORDER = 3
#: Tokens that a lane of the traversal walks.
LANE = 128
#: Bytes of text in a block; bytes of text of all blocks for each shard of the hash range.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 4 << 20
#: Rounds in which the shards are filled, one part of the hash range after the other: less disk, more reading.
ROUNDS = 2
#: Bits of an n-gram's key that travel. The lowest four tell single tokens (1), the order of others (2, 4, ...) and n-grams that close a text (8); the rest is hash.
KEY_BITS, TOKEN, CLOSED = 56, 1, 8
END, START = np.uint64(1), np.uint64(2)
#: Bins of the counts of states: one for each count below 64, four for each doubling from there.
COUNT_BINS = 224
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the start mark, the lower-cased words and the end."""
    words = text.translate(LOWER).split() if text else []
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = START, END
    out[1:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return out


class Block:
    """The token stream of some texts and its distinct n-grams.

    `ids[n]` has the number of the n-gram that ends at each token (-1: none), `first[n]` a token where each
    one ends. `keys` has all of them, sorted; `learn` how often each is in training texts.
    """

    def __init__(self, texts: list, train: list[bool], order: int = ORDER):
        parts = [tokens(t) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        stream = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.left = np.arange(len(stream)) - np.repeat(self.starts, self.sizes)
        learn = np.repeat(np.array(train, bool), self.sizes)
        closed = np.where(stream == END, np.uint64(CLOSED), np.uint64(0))
        gram = mix(stream + _BASE)
        self.order, self.ids, self.first, keys, counts = order, [None], [None], [], []
        for n in range(1, order + 1):
            if n > 1:
                gram = np.concatenate([gram[:1], mix(gram[:-1] * _BASE + stream[1:] + np.uint64(n))])
            at = np.flatnonzero(self.left >= n - 1)
            code = closed[at] | ((self.left > 0).astype(np.uint64) if n == 1 else np.uint64(2 * (n - 1)))
            own, first, inverse = np.unique(gram[at] >> np.uint64(64 - KEY_BITS) & ~np.uint64(15) | code, return_index=True, return_inverse=True)
            ids = np.full(len(stream), -1, np.int64)
            ids[at] = inverse
            self.ids.append(ids)
            self.first.append(at[first])
            keys.append(own)
            counts.append(np.bincount(inverse, learn[at], len(own)).astype(np.int64))
        flat = np.concatenate(keys)
        rank = np.argsort(flat)
        self.keys, self.learn = flat[rank], np.concatenate(counts)[rank]
        place = np.empty(len(flat), np.int64)
        place[rank] = np.arange(len(flat))
        self.places = [None, *np.split(place, np.cumsum([len(k) for k in keys])[:-1])]


def count_bin(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < 64, counts, np.minimum(COUNT_BINS - 1, 64 + 4 * np.log2(np.maximum(counts, 64) / 64))).astype(np.int64)


def prior_of(once: int, states: np.ndarray, mass: np.ndarray) -> float:
    """The k at which as many tokens are new to their state as there are n-grams seen once; `states` and `mass` are the states of each bin of counts and the sum of those."""
    used = states > 0
    c, n = mass[used] / states[used], states[used]
    low, high = 1e-3, 1e7
    for _ in range(100):
        k = math.sqrt(low * high)
        low, high = (k, high) if (n * c * k / (c - 1 + k)).sum() < once else (low, k)
    return low


class Statistics:
    """Totals of the training corpus: tokens N, distinct ones V, those seen once and twice, and the prior of each order."""

    def __init__(self, tokens: int, types: int, once: int, twice: int, prior: dict[int, float] | None = None):
        self.tokens, self.types = tokens, types
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        self.prior = prior or {n: 1.0 for n in range(2, ORDER + 1)}

    @classmethod
    def of(cls, sums: list[int], order: int = ORDER) -> Statistics:
        """From the sums of what all shards tell."""
        sums, width = np.array(sums, np.float64), 1 + 2 * COUNT_BINS
        parts = {n: sums[4 + (n - 2) * width : 4 + (n - 1) * width] for n in range(2, order + 1)}
        return cls(*map(int, sums[:4]), {n: prior_of(x[0], x[1 : 1 + COUNT_BINS], x[1 + COUNT_BINS :]) for n, x in parts.items()})


def shard_statistics(keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> list[int]:
    """What a shard tells of its distinct n-grams: tokens, types, those seen once and twice; for each order from two, n-grams seen once and the states' bins."""
    seen = counts > 0
    kind, closed, counts = keys[seen] & np.uint64(7), (keys[seen] & np.uint64(CLOSED)) > 0, counts[seen]
    single = counts[kind == TOKEN]
    out = [int(single.sum()), len(single), int((single == 1).sum()), int((single == 2).sum())]
    for n in range(2, order + 1):
        state = counts[(kind <= TOKEN if n == 2 else kind == 2 * (n - 2)) & ~closed]
        bins = count_bin(state)
        out += [int(((kind == 2 * (n - 1)) & (counts == 1)).sum()), *np.bincount(bins, minlength=COUNT_BINS).tolist(), *np.bincount(bins, state, COUNT_BINS).astype(np.int64).tolist()]
    return out


class Automaton:
    """States, sorted arcs and failure arcs over the n-grams of a block, with their counts in the corpus.

    State 0 has no words. `state[n]` tells the state of each n-gram of the block (0: it is none). Arcs are
    sorted by `arcs`, state x words + word; `weight` and `target` go along. `fail` and `fall` are the failure
    arc of each state and its weight. All weights are log10.
    """

    def __init__(self, block: Block, counts: np.ndarray, stats: Statistics):
        c = [None, *(counts[x] for x in block.places[1:])]
        n, d = max(stats.tokens, 1), stats.discount
        unknown = d * stats.types / n if stats.types else 1.0
        self.words, self.unknown = len(c[1]), math.log10(unknown)
        start = block.left[block.first[1]] == 0
        p = np.where(c[1] > 0, np.maximum(c[1] - d, 1e-300) / n, unknown)
        self.state, self.fail, self.fall = [None], [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs, weights, targets, states, word = [], [], [], 1, np.arange(len(c[1]))
        for k in range(1, block.order + 1):
            at, seen = block.first[k], c[k] > 0
            if k > 1:
                context, suffix = block.ids[k - 1][at - 1], block.ids[k - 1][at]
                p = (c[k] + stats.prior[k] * p[suffix]) / (c[k - 1][context] + stats.prior[k])
                word = word[suffix]
            source = self.state[k - 1][context] if k > 1 else np.zeros(len(at), np.int64)
            if k < block.order:
                own = np.where(seen, np.cumsum(seen) + states - 1, 0)
                self.state.append(own)
                states += int(seen.sum())
                self.fail.append(self.state[k - 1][suffix][seen] if k > 1 else np.zeros(int(seen.sum()), np.int64))
                self.fall.append(np.log10(stats.prior[k + 1] / (c[k][seen] + stats.prior[k + 1])))
            goal = self.state[k] if k < block.order else self.state[k - 1][suffix]
            read = seen & ~start if k == 1 else seen
            arcs.append((source * self.words + word)[read])
            weights.append(np.log10(p[read]))
            targets.append(goal[read])
        rank = np.argsort(flat := np.concatenate(arcs))
        self.arcs, self.weight, self.target = flat[rank], np.concatenate(weights)[rank], np.concatenate(targets)[rank]
        self.fail, self.fall = np.concatenate(self.fail), np.concatenate(self.fall)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word, and the weights of the arcs and failure arcs on the way."""
        after, total, open_ = np.zeros(len(state), np.int64), np.zeros(len(state)), np.arange(len(state))
        state = state.copy()
        while len(open_):
            look = state[open_] * self.words + word[open_]
            at = np.minimum(np.searchsorted(self.arcs, look), max(0, len(self.arcs) - 1))
            found = self.arcs[at] == look if len(self.arcs) else np.zeros(len(look), bool)
            done, at = open_[found], at[found]
            total[done] += self.weight[at]
            after[done] = self.target[at]
            lost = open_[~found]
            ended = lost[state[lost] == 0]  # no arc at all: the unknown class, back to the state of no words
            total[ended] += self.unknown
            open_ = lost[state[lost] != 0]
            total[open_] += self.fall[state[open_]]
            state[open_] = self.fail[state[open_]]
        return after, total

    def walk(self, block: Block) -> np.ndarray:
        """The weight of each token of the block in one traversal from left to right; start marks weigh nothing."""
        total = np.zeros(len(block.left))
        many = -(-(block.sizes - 1) // LANE)
        text = np.repeat(np.arange(len(many)), many)
        lane = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        at = block.starts[text] + 1 + lane * LANE
        end = np.minimum(at + LANE, block.starts[text] + block.sizes[text])
        state = np.zeros(len(at), np.int64)
        for k in range(1, block.order):  # the longest words in front that are a state
            own = block.ids[k][at - 1]
            longer = np.where(own >= 0, self.state[k][own], 0)
            state = np.where(longer > 0, longer, state)
        while len(at):
            state, total[at] = self.step(state, block.ids[1][at])
            at = at + 1
            left = at < end
            at, end, state = at[left], end[left], state[left]
        return total


def traverse(block: Block, counts: np.ndarray, stats: Statistics) -> dict[str, np.ndarray]:
    """Sums for each text of one pass over its tokens; `counts` has the corpus count of each of the block's keys."""
    total = Automaton(block, counts, stats).walk(block)
    known = counts[block.places[1]][block.ids[1]]
    words = block.left > 0
    add = lambda x: np.add.reduceat(np.where(words, x, 0.0), block.starts) if len(block.starts) else np.zeros(0)
    base = np.log10((known + 1) / (stats.tokens + stats.types + 1))
    return {"n_tokens": block.sizes - 1, "n_known": add(known > 0).astype(np.int64), "base_score": add(base), "score": add(total)}


def press(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, in Zstandard."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def release(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def press_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def release_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def pack_blocks(docs: DataFrame) -> DataFrame:
    """(block, size, data): documents (doc_id, text, held_out) in Arrow streams of about BLOCK_BYTES of text."""

    def run(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            rows = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "data"])

        for batch in batches:
            lengths, a = [len(x or b"") for x in bytes_of(batch.column(1))], 0
            for k, length in enumerate(lengths):
                size += length + 1
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(a, k + 1 - a))
                    yield block()
                    n, held, size, a = n + 1, [], 0, k + 1
            if a < len(lengths):
                held.append(batch.slice(a))
        if held:
            yield block()

    return docs.mapInArrow(run, "block bigint, size bigint, data binary")


def open_block(data: bytes) -> tuple[list, Block]:
    rows = pa.ipc.open_stream(data).read_all()
    texts = [x for chunk in rows.column(1).chunks for x in bytes_of(chunk)]
    return rows.column(0).to_pylist(), Block(texts, [not x for x in rows.column(2).to_pylist()])


GRAMS = "shard int, block bigint, keys binary, counts binary"
COUNTS = "block bigint, shard int, counts binary, stats array<bigint>"


def send_grams(blocks: DataFrame, shards: int, first_shard: int, after: int) -> DataFrame:
    """For each block and each shard from first_shard up to after, the distinct n-grams of the block that belong there, and their training counts."""
    edges_of = np.array([(i << KEY_BITS) // shards for i in range(first_shard, after + 1)], np.uint64)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, block = open_block(data.as_py())
                edges = np.searchsorted(block.keys, edges_of).tolist()
                used = [i for i in range(after - first_shard) if edges[i] < edges[i + 1]]
                parts = [slice(edges[i], edges[i + 1]) for i in used]
                yield pa.RecordBatch.from_arrays([pa.array([first_shard + i for i in used], pa.int32()), pa.array([name] * len(used), pa.int64()), pa.array([press(block.keys[p]) for p in parts], pa.binary()), pa.array([press_counts(block.learn[p]) for p in parts], pa.binary())], ["shard", "block", "keys", "counts"])

    return blocks.select("block", "data").mapInArrow(run, GRAMS)


def sum_shard(rows: pa.Table) -> pa.Table:
    """Totals of a shard's n-grams, sent back to each block in its own order, and one row of statistics."""
    names = rows.column("block").to_pylist()
    keys = [release(x) for x in rows.column("keys").to_pylist()]
    counts = np.concatenate([release_counts(x) for x in rows.column("counts").to_pylist()]).astype(np.int64)
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")  # a merge of sorted runs
    flat = flat[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    back = np.empty(len(flat), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    answers = [press_counts(x) for x in np.split(back, np.cumsum(sizes)[:-1])]
    shard, stats = rows.column("shard")[0].as_py(), shard_statistics(flat[new], total)
    return pa.table({"block": pa.array([*names, None], pa.int64()), "shard": pa.array([shard] * (len(names) + 1), pa.int32()), "counts": pa.array([*answers, None], pa.binary()), "stats": pa.array([*([None] * len(names)), stats], pa.list_(pa.int64()))})


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of docs(doc_id, text, held_out) under the model of those that are not held out."""
    spark = docs.sparkSession
    blocks = materialize(pack_blocks(docs), "blocks")
    shards = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
    counts = None
    for k in range(ROUNDS):  # the shuffle of a round is gone before the next one begins
        first, after = shards * k // ROUNDS, shards * (k + 1) // ROUNDS
        if first < after:
            part = materialize(send_grams(blocks, shards, first, after).groupBy("shard").applyInArrow(sum_shard, COUNTS), "counts")
            counts = part if counts is None else counts.unionByName(part)
    sums = counts.filter("block IS NULL").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    sums = [x for _, x in sorted(map(tuple, sums.collect()))]
    stats = Statistics.of(sums) if sums else Statistics(0, 0, 0, 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = sorted(zip(right.column("shard").to_pylist(), right.column("counts"), strict=True), key=lambda x: x[0])
        answers = np.concatenate([release_counts(x[1].as_py()) for x in parts]) if parts else np.zeros(0, np.uint64)
        for data in left.column("data"):
            ids, block = open_block(data.as_py())
            got = traverse(block, answers.astype(np.float64), stats)
            held = pa.ipc.open_stream(data.as_py()).read_all().column(2).combine_chunks()
            out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": got["n_tokens"], "n_known": got["n_known"], "train_tokens": np.full(len(ids), stats.tokens, np.int64), "base_score": got["base_score"], "score": got["score"]}))
        return pa.concat_tables(out)

    answered = counts.filter("block IS NOT NULL").select("block", "shard", "counts")
    return blocks.select("block", "data").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, SCORES)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the model of the documents that are not held out."""
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return score_documents(docs)
