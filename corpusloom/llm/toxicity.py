"""Toxicity: a convolutional text classifier in numpy with thresholds calibrated by language.

A word (a run of letters, lower-cased) is the sum of hashed embeddings of itself and of its prefixes of
three to five letters. Filters of widths one to three slide over the whole text; each keeps its largest
answer; a logistic layer gives a logit. The network is fitted on a bounded sample of labelled rows
(POSITIVES + NEGATIVES, drawn by a hash of doc_id). Thresholds come from all labelled rows: each is
scored by the network of its fold, fitted on the sample without that fold, and each language gets the
threshold with the best F1 over the counts of those logits, at the classes' own frequency. The score is
the logistic function of the logit above that threshold, so that 0.5 is the calibrated limit. The
language is guessed from the text's own function words; no column but the text enters a score.

Cases: null, empty or letter-less texts have no words and score 0.018;
without labelled rows of both classes every score is 0; labels that repeat a doc_id count as toxic if one
of them does; null labels don't count; other columns are ignored, or kept by the pipeline stage.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bound of the labelled sample.
POSITIVES, NEGATIVES = 1500, 3000
BUCKETS, SIZE, FILTERS, WIDTHS, EPOCHS = 1 << 16, 12, 12, (1, 2, 3), 6
#: Parts of the labelled rows, each scored for calibration by a network fitted on the others; logits are counted in bins of 1 / BIN up to LIMIT.
FOLDS, BIN, LIMIT = 4, 64, 50
#: Hashes that tell labelled doc_ids before their texts are scored: a fixed number, which says nothing about any label.
SPOTS = 1 << 24
#: Logit of a text without words.
WORDLESS = -4.0
#: Words that are convolved at once.
PIECE = 65536
WORD = re.compile(r"[^\W\d_]+")
#: Frequent function words by language: fixed values for the guess of a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with this are from be it",
    "de": "der die das und ist von mit ein eine nicht auf den sich zu auch",
    "fr": "le la les et des du un une dans pour est que qui sur avec",
    "es": "el la los las y en un una por con para que del se como",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
_OF_WORD = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _OF_WORD.setdefault(_w, np.zeros(len(FUNCTION_WORDS), np.int64))[_k] = 1


def features(word: str) -> tuple[int, int, int, int]:
    """Buckets of a word and of its prefixes."""
    h = lambda x: zlib.crc32(x.encode()) & (BUCKETS - 1)
    return h(word), h("3" + word[:3]), h("4" + word[:4]), h("5" + word[:5])


class Lexicon:
    """Rows for the distinct words of a run of texts."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def encode(self, text: str) -> np.ndarray:
        words, rows = WORD.findall(text.lower()), self.rows
        return np.fromiter([rows.setdefault(w, len(rows)) for w in words], np.int64, len(words))

    def buckets(self) -> np.ndarray:
        return np.array([features(w) for w in self.rows], np.int64).reshape(-1, 4)

    def languages(self) -> np.ndarray:
        none = np.zeros(len(FUNCTION_WORDS), np.int64)
        return np.array([_OF_WORD.get(w, none) for w in self.rows], np.int64).reshape(-1, len(FUNCTION_WORDS))


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((BUCKETS, SIZE)) * 0.005).astype(np.float32)
        self.kernels = [(rng.standard_normal((w, SIZE, FILTERS)) * (1.0 / np.sqrt(SIZE * w))).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.bias = np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES))

    def prime(self, docs: list[np.ndarray], buckets: np.ndarray, y: np.ndarray) -> None:
        """The first embedding dimension starts from how much more often a bucket is in texts of label 1 than by chance.

        A bucket seen once or twice stays near zero, so that the words of a small sample aren't learnt by heart.
        """
        frequency, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for rows, label in zip(docs, y, strict=True):
            mine = np.unique(buckets[np.unique(rows)])
            frequency[mine] += 1
            toxic[mine] += label
        expected = frequency * y.mean()
        self.embed[:, 0] = 0.05 * np.clip((toxic - expected) / np.sqrt(expected + 1), -4, 10)
        for kernel in self.kernels:
            kernel[:, 0, :2] = 1.0
        for i in range(len(WIDTHS)):
            self.out[i * FILTERS : i * FILTERS + 2] = 0.5

    def fit(self, docs: list[np.ndarray], buckets: np.ndarray, y: np.ndarray, seed: int = 11, rate: float = 0.02) -> None:
        """Stochastic gradient with AdaGrad steps; `docs` hold rows of `buckets`."""
        rng = np.random.default_rng(seed)
        seen_embed = np.full(BUCKETS, 1e-6, np.float32)
        seen = [np.full(x.shape, 1e-6, np.float32) for x in (*self.kernels, *self.biases, self.out)]
        seen_bias, weight = 1e-6, np.where(y > 0, (len(y) - y.sum()) / max(1, y.sum()), 1.0)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(docs)).tolist():
                rows = docs[k]
                if not len(rows):
                    continue
                x = self.embed[buckets[rows]].sum(1)
                peaks, tops = [], []
                for w, kernel, b in zip(WIDTHS, self.kernels, self.biases, strict=True):
                    xx = np.concatenate([x, np.zeros((w - 1, SIZE), np.float32)]) if w > 1 else x
                    z = sum(xx[o : o + len(x)] @ kernel[o] for o in range(w))
                    at = z.argmax(0)
                    peaks.append((xx, at))
                    tops.append(z[at, np.arange(FILTERS)] + b)
                top = np.concatenate(tops)
                h = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -30, 30)))
                g = np.float32((p - y[k]) * weight[k])
                d_top = g * self.out * (top > 0)
                grads_k, grads_b, touched, d_embed = [], [], [], []
                for i, (w, kernel) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
                    xx, at = peaks[i]
                    d = d_top[i * FILTERS : (i + 1) * FILTERS]
                    window = np.stack([xx[at + o] for o in range(w)])  # width, filter, size
                    grads_k.append(window.transpose(0, 2, 1) * d)
                    grads_b.append(d)
                    for o in range(w):
                        ok = (at + o < len(x)) & (d != 0)
                        touched.append(rows[at[ok] + o])
                        d_embed.append((kernel[o] * d).T[ok])
                steps = [*grads_k, *grads_b, g * h]
                for param, total, grad in zip((*self.kernels, *self.biases, self.out), seen, steps, strict=True):
                    total += grad * grad
                    param -= rate * grad / np.sqrt(total)
                seen_bias += float(g * g)
                self.bias -= np.float32(rate * g / np.sqrt(seen_bias))
                ids = buckets[np.concatenate(touched)]
                if len(ids):
                    grad = np.repeat(np.concatenate(d_embed), ids.shape[1], axis=0)
                    flat, where = np.unique(ids.ravel(), return_inverse=True)
                    total = np.zeros((len(flat), SIZE), np.float32)
                    np.add.at(total, where, grad)
                    seen_embed[flat] += (total * total).mean(1)
                    self.embed[flat] -= rate * total / np.sqrt(seen_embed[flat])[:, None]

    def logits(self, docs: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
        """Logits of whole texts, in pieces of bounded size."""
        tops = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        x = self.embed[buckets].sum(1) if len(buckets) else np.zeros((0, SIZE), np.float32)
        x = np.concatenate([x, np.zeros((1, SIZE), np.float32)])  # the last row pads the end of a text
        reach = max(WIDTHS) - 1
        pad = np.full(reach, len(x) - 1, np.int64)
        answers = [[x @ kernel[o] for o in range(w)] for w, kernel in zip(WIDTHS, self.kernels, strict=True)]
        group: list[tuple[int, np.ndarray, int]] = []  # text, words, windows that begin here

        def flush():
            rows = np.concatenate([np.concatenate([r, pad]) for _, r, _ in group])
            begin = np.cumsum([0] + [len(r) + reach for _, r, _ in group])[:-1]
            n = len(rows) - reach
            inside = np.zeros(len(rows), bool)
            for b, (_, _, starts) in zip(begin.tolist(), group, strict=True):
                inside[b : b + starts] = True
            own = [d for d, _, _ in group]
            for i, w in enumerate(WIDTHS):
                z = np.full((len(rows), FILTERS), -np.inf, np.float32)
                z[:n] = sum(answers[i][o][rows[o : n + o]] for o in range(w))
                z[~inside] = -np.inf
                best = np.maximum.reduceat(z, begin, axis=0) + self.biases[i]
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                for d, row in zip(own, best, strict=True):
                    np.maximum(tops[d, part], row, out=tops[d, part])
            group.clear()

        size = 0
        for d, rows in enumerate(docs):
            for a in range(0, len(rows), PIECE):
                piece = rows[a : a + PIECE + reach]
                group.append((d, piece, min(PIECE, len(rows) - a)))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
        if group:
            flush()
        return np.maximum(tops, 0) @ self.out + self.bias

    def calibrate(self, counts: list[tuple[int, int, int, int]], least: int = 10) -> None:
        """The threshold with the best F1 for all texts and, where both classes are frequent enough, for each language, from counts (language, bin, texts, toxic texts)."""
        def best(some):
            bins = np.unique(some[:, 1])
            at = np.searchsorted(bins, some[:, 1])
            n, t = (np.bincount(at, some[:, k], len(bins)) for k in (2, 3))
            f1 = 2 * t[::-1].cumsum()[::-1] / (n[::-1].cumsum()[::-1] + t.sum())
            k = int(f1.argmax())
            return (bins[k] + bins[k - 1] + 1) / (2 * BIN) if k else bins[0] / BIN - 1.0

        counts = np.array(counts, np.int64).reshape(-1, 4)
        if not 0 < counts[:, 3].sum() < counts[:, 2].sum():
            return
        self.thresholds[:] = best(counts)
        for k in range(1, len(LANGUAGES)):
            mine = counts[counts[:, 0] == k]
            if min(mine[:, 3].sum(), (mine[:, 2] - mine[:, 3]).sum()) >= least:
                self.thresholds[k] = best(mine)

    def scores(self, texts: list[str]) -> np.ndarray:
        lexicon = Lexicon()
        docs = [lexicon.encode(t) for t in texts]
        z = self.logits(docs, lexicon.buckets()) - self.thresholds[guess(docs, lexicon.languages())]
        z[[not len(rows) for rows in docs]] = WORDLESS
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def guess(docs: list[np.ndarray], languages: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each text: the language with most function words, `other` where none is frequent."""
    out = np.zeros(len(docs), np.int64)
    for k, rows in enumerate(docs):
        if len(rows):
            counts = languages[rows].sum(0)
            if counts.max() * 20 >= len(rows):
                out[k] = 1 + int(counts.argmax())
    return out


def labelled(labels: DataFrame, kept) -> DataFrame:
    """(doc_id, toxic) of the labelled documents that `kept` allows."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & kept)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, kept, positives: int = POSITIVES, negatives: int = NEGATIVES) -> list[tuple[int, str, int]]:
    """At most positives + negatives labelled texts, those whose doc_id hashes lowest, among the rows that `kept` allows."""
    rows = labelled(labels, kept)
    draw = lambda x, n: rows.filter(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = draw(1, positives).unionByName(draw(0, negatives))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["text"], r["toxic"]) for r in found.collect())


def fold(doc_id: int) -> int:
    """The part that a document belongs to."""
    return zlib.crc32(f"aside {doc_id}".encode()) % FOLDS


def train(sample: list[tuple[int, str, int]], aside: int | None = None) -> Network | None:
    """The network fitted on a sample, without the fold `aside` where both classes remain; None where a class is missing."""
    y = np.array([s[2] for s in sample], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rest = [s for s in sample if fold(s[0]) != aside]
    if len({s[2] for s in rest}) == 2:
        sample, y = rest, np.array([s[2] for s in rest], np.float64)
    lexicon = Lexicon()
    docs = [lexicon.encode(s[1]) for s in sample]
    net, buckets = Network(), lexicon.buckets()
    net.prime(docs, buckets, y)
    net.fit(docs, buckets, y)
    return net


def logit_counts(docs: DataFrame, labels: DataFrame, kept, nets) -> list[tuple[int, int, int, int]]:
    """(language, bin, texts, toxic texts) over all labelled texts that have words, each scored by the network of its fold; `kept` is a condition on doc_id.

    A bit map of SPOTS hashes of labelled doc_ids tells which texts may be labelled, so that most others aren't scored; the join decides.
    """
    own, spot = labelled(labels, kept), F.pmod(F.xxhash64("doc_id"), F.lit(SPOTS)).cast("int").alias("spot")
    taken = np.zeros(SPOTS, bool)
    taken[own.select(spot).distinct().toArrow().column(0).to_numpy()] = True
    taken = docs.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((taken.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            ids, texts = (batch.column(i).to_pylist() for i in range(2))
            languages, bins = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
            parts = np.array([fold(i) for i in ids], np.int64)
            for k, net in enumerate(nets.value):
                mine = np.flatnonzero(parts == k)
                for some in pieces([texts[i] for i in mine]):
                    lexicon = Lexicon()
                    rows = [lexicon.encode(t) for t in some]
                    now, mine = mine[: len(some)], mine[len(some) :]
                    z = net.logits(rows, lexicon.buckets())
                    bins[now] = np.floor(np.clip(z, -LIMIT, LIMIT) * BIN)
                    spoken = guess(rows, lexicon.languages())
                    spoken[[not len(r) for r in rows]] = -1
                    languages[now] = spoken
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.int32()), pa.array(bins, pa.int32())], ["doc_id", "language", "bin"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & kept)
    found = texts.select("doc_id", "text", spot).mapInArrow(run, "doc_id bigint, language int, bin int").filter("language >= 0").join(own, "doc_id")
    return [tuple(r) for r in found.groupBy("language", "bin").agg(F.count(F.lit(1)), F.sum("toxic")).collect()]


def scorer(docs: DataFrame, labels: DataFrame, kept=None):
    """A broadcast of the network fitted on a sample of the labelled rows that `kept` allows, with thresholds from all of them."""
    context, kept = docs.sparkSession.sparkContext, F.lit(True) if kept is None else kept
    sample = context.broadcast(labelled_sample(docs, labels, kept))
    # one task for each fold, and one for the whole sample
    *folds, net = context.parallelize([*range(FOLDS), None], FOLDS + 1).map(lambda k: train(sample.value, k)).collect()
    if net is not None:
        net.calibrate(logit_counts(docs, labels, kept, context.broadcast(folds)))
    return context.broadcast(net)


def pieces(texts: list[str | None], piece: int = 4 << 20):
    """Texts in groups of about `piece` characters."""
    group, size = [], 0
    for k, text in enumerate(texts):
        group.append(text or "")
        size += len(group[-1])
        if size >= piece or k == len(texts) - 1:
            yield group
            group, size = [], 0


def score_batch(net: Network | None, texts: list[str | None], piece: int = 4 << 20) -> np.ndarray:
    """Scores of texts, taken in groups of about `piece` characters."""
    if net is None:
        return np.zeros(len(texts))
    return np.concatenate([np.zeros(0), *(net.scores(group) for group in pieces(texts, piece))])


def score_documents(docs: DataFrame, network) -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_batch(network.value, batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5, with their columns."""
    network = scorer(docs, labels)

    def run(batches):
        for batch in batches:
            scores = score_batch(network.value, batch.column("text").to_pylist())
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)


def remainder(column: str, of: int):
    """crc32 of a doc_id as text, modulo `of`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    network = scorer(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score_documents(docs, network).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
