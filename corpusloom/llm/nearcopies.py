"""Near copies by SimHash links and exact Jaccard similarity of word shingles, for the corpus pipeline.

A text is the set of its shingles of five lower-cased words (fewer words: the whole sequence). Two texts
are linked when the similarity of their sets is 4/5 or more, and groups are what links join. The SimHash
operator gives candidates first: fingerprints of the sets that its covering family joins. It finds only
pairs within its radius, and at 4/5 about ten of 64 bits differ, far beyond what a covering family carries
(the README has its measured recall). So prefix filtering finds all others: sets are sorted in one order,
and two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, so no link is lost,
whatever the order is. Frequent shingles come last in that order: first those of a sample of the texts, then
those that more than CAP prefixes turn out to share, which only the texts concerned are read again for. The
order decides about speed only. Every link is verified on the whole sets.

Texts with equal sets are one node. Up to CAP nodes with a common shingle are compared pair by pair, where
the number of common shingles in the prefixes allows the similarity. Of more, each is compared with the
smallest; where that leaves several groups, they are compared in blocks.
Known limit: texts of which four fifths are shingles that very many texts share meet in such blocks.
Shingles, texts and nodes are told apart by 64-bit hashes.

Cases: null and word-less texts are one node; rows count each for itself, so of repeated rows, and of
copies with null doc_ids, one stays, and two texts under one doc_id are judged apart; an empty table
gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, fresh, hot_keys, materialize, salted_left_join
from .components import connected_components
from .minhash import mix, shingle_hashes, word_hashes
from .simhash import link_fingerprints, majority, signed

SHINGLE = 5
#: Nodes with a common shingle that are compared pair by pair, and nodes of a block beyond that.
CAP, BLOCK = 32, 4096
#: One text in SAMPLE counts for the order of shingles; FREQUENT of them at most come last, those found LEAST times or more.
SAMPLE, FREQUENT, LEAST = 16, 1 << 19, 3
#: Times that shingles of more than CAP prefixes are moved to the end of the order.
ROUNDS = 2


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text, sorted by hash."""
    words = word_hashes(text or b"")
    return np.unique(shingle_hashes(words, SHINGLE)) if len(words) else np.zeros(0, np.uint64)


def alike(common, n, m):
    """Whether sets of n and m shingles, `common` in both, have a similarity of 4/5 or more: in whole numbers."""
    return 9 * common >= 4 * (n + m)


def node_of(grams: np.ndarray) -> int:
    """One number for a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(grams + np.uint64(1)).sum(dtype=np.uint64).reshape(1) + np.uint64(len(grams))).view(np.int64)[0])


class Order:
    """Shingles that come last, sorted by hash, and how frequent each is."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray):
        at = np.argsort(grams)
        self.grams, self.weights = grams[at], weights[at].astype(np.int32)

    def added(self, grams: np.ndarray, weights: np.ndarray) -> Order:
        return Order(np.concatenate([self.grams, grams]), np.concatenate([self.weights, weights]))


def prefix_of(grams: np.ndarray, order: Order) -> np.ndarray:
    """The first n - ceil(4/5 n) + 1 shingles: by hash, those that come last after all others, the rarer ones first."""
    n = len(grams)
    if not n:
        return grams
    if len(order.grams):
        at = np.minimum(np.searchsorted(order.grams, grams), len(order.grams) - 1)
        frequent = order.grams[at] == grams
        if frequent.any():
            grams = np.concatenate([grams[~frequent], grams[frequent][np.argsort(order.weights[at[frequent]], kind="stable")]])
    return grams[: prefix_size(n)]


def prefix_size(n):
    """n - ceil(4/5 n) + 1, for numbers and for columns."""
    return n - (4 * n + 4) // 5 + 1 if isinstance(n, int) else n - F.floor((4 * n + 4) / 5) + 1


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("h"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def frequent_shingles(docs: DataFrame) -> Order:
    """Shingles that many texts of the sample have."""

    def run(batches):
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["gram"])

    some = texts_of(docs).filter(F.pmod("h", F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "gram bigint").groupBy("gram").count().filter(F.col("count") >= LEAST)
    top = counts.orderBy(F.desc("count"), "gram").limit(FREQUENT // 2).toArrow()
    return Order(top.column("gram").to_numpy().view(np.uint64), SAMPLE * top.column("count").to_numpy())


def sketches(docs: DataFrame, order) -> DataFrame:
    """(h, doc_id, node, n, fp, prefix) of every row."""
    prefix = pa.list_(pa.int64())
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("prefix", prefix)])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text in bytes_of(batch.column(2)):
                grams = shingles(text)
                out.append((node_of(grams), len(grams), signed(majority(grams)), prefix_of(grams, order.value).view(np.int64)))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, schema.field(k + 2).type) for k, c in enumerate(cols))], schema=schema)

    return texts_of(docs).mapInArrow(run, "h bigint, doc_id bigint, node bigint, n bigint, fp bigint, prefix array<bigint>")


def prefix_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.posexplode("prefix").alias("pos", "gram"), "node", "n")


def reordered(docs: DataFrame, nodes: DataFrame, order: Order) -> tuple[DataFrame, Order | None]:
    """The nodes after shingles of more than CAP prefixes have moved to the end of the order; None for it where there are none.

    A shingle that moves back changes no prefix but those that hold it, so only their texts are read again.
    """
    spark = docs.sparkSession
    room = FREQUENT - len(order.grams)
    hot = prefix_rows(nodes).groupBy("gram").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > CAP)
    # ties go by hash, and shingles that are in the order already are found again at most len(order) times
    top = hot.orderBy(F.desc("many"), "gram").limit(FREQUENT).toArrow()
    grams, many = top.column("gram").to_numpy().view(np.uint64), top.column("many").to_numpy()
    new = ~np.isin(grams, order.grams)
    grams, many = grams[new][:room], many[new][:room]
    if not len(grams):
        return nodes, None
    order = order.added(grams, many)
    moved, late = spark.sparkContext.broadcast(np.sort(grams.view(np.int64))), spark.sparkContext.broadcast(order)

    def concerned(batches):
        for batch in batches:
            prefix = batch.column(batch.schema.get_field_index("prefix"))
            flat, begin = prefix.values.to_numpy(), prefix.offsets.to_numpy()
            found = np.isin(flat, moved.value)
            count = np.concatenate([[0], np.cumsum(found)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count[begin[1:]] > count[begin[:-1]])], [*batch.schema.names, "moved"])

    def again(batches):
        for batch in batches:
            prefixes = [prefix_of(shingles(t), late.value).view(np.int64) for t in bytes_of(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(prefixes, pa.list_(pa.int64()))], ["node", "h", "n", "fp", "prefix"])

    schema = "node bigint, h bigint, n bigint, fp bigint, prefix array<bigint>"
    marked = materialize(nodes.mapInArrow(concerned, schema + ", moved boolean"), "marked", slim=True)
    wanted = marked.filter("moved").select("node", "h", "n", "fp")
    texts = texts_of(docs).select("h", "text").join(wanted, "h").select("node", "h", "n", "fp", "text").dropDuplicates(["node"])
    after = marked.filter("NOT moved").drop("moved").unionByName(texts.mapInArrow(again, schema))
    after = materialize(after, "nodes", slim=True)
    discard(nodes, marked)
    return after, order


def sets(texts: DataFrame) -> DataFrame:
    """(node, grams) of texts(node, text)."""
    grams = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).view(np.int64) for t in bytes_of(batch.column(1))], grams)], ["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, grams array<bigint>")


def verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Of pairs(a, b), those whose sets are alike, as edges (src, dst)."""
    left = grams.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def set_stars(nodes: np.ndarray, grams: list[np.ndarray], second: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Edges (node, representative) that span the groups linked within one block, or between the two halves that `second` tells."""
    sizes = np.array([len(g) for g in grams], np.int64)
    flat = np.concatenate(grams)
    begin = np.cumsum(sizes) - sizes
    left = np.arange(len(nodes))
    while len(left) > 1:
        root, queue = left[0], [left[0]]
        left = left[1:]
        while queue and len(left):
            x = queue.pop()
            fit = left[(5 * sizes[left] >= 4 * sizes[x]) & (5 * sizes[x] >= 4 * sizes[left])]
            if second is not None:
                fit = fit[second[fit] != second[x]]
            if not len(fit):
                continue
            lens = sizes[fit]
            starts = np.cumsum(lens) - lens
            at = np.arange(int(lens.sum())) + np.repeat(begin[fit] - starts, lens)
            common = np.add.reduceat(np.isin(flat[at], grams[x]).astype(np.int64), starts)
            near = fit[alike(common, lens, sizes[x])]
            for y in near.tolist():
                queue.append(y)
                yield int(nodes[y]), int(nodes[root])
            left = left[~np.isin(left, near)]


def link_blocks(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Edges within large sets of nodes (gram, many, node): each task compares two blocks of about BLOCK nodes."""
    k = F.ceil(F.col("many") / BLOCK).cast("int")
    rows = rows.withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("gram", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).alias("second"), "node").join(grams, "node")

    def compare(block: pa.Table) -> pa.Table:
        second = block.column("second").to_numpy()
        same = block.column("a")[0].as_py() == block.column("b")[0].as_py()
        nodes = block.column("node").to_numpy()
        found = list(set_stars(nodes, [np.asarray(g.values) for g in block.column("grams")], None if same else second))
        return pa.table({"src": pa.array([s for s, _ in found], pa.int64()), "dst": pa.array([d for _, d in found], pa.int64())})

    return rows.groupBy("gram", "a", "b").applyInArrow(compare, "src bigint, dst bigint")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) from the SimHash operator: nodes with one fingerprint, and fingerprints that its covering family joins."""
    lowest = nodes.groupBy("fp").agg(F.min("node").alias("low"))
    lowest = materialize(lowest, "prints", slim=True)
    equal = nodes.join(lowest, "fp").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    edges = link_fingerprints(lowest.select("fp"))
    side = lambda k, c: lowest.select(F.col("fp").alias(k), F.col("low").alias(c))
    near = edges.join(side("src", "x"), "src").join(side("dst", "y"), "dst")
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def link_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) that span every group of nodes(node, h, n, fp, prefix)."""
    rows = prefix_rows(nodes)
    sizes = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("low")).filter("many > 1")
    sizes = materialize(sizes, "prefix-sizes", slim=True)
    met = materialize(rows.join(sizes, "gram").select("gram", "many", "low", "node", "n"), "prefix-rows", slim=True)
    # how many shingles of a node's prefix are in large sets: so many more it may share than its pairs show
    more = met.filter(F.col("many") > CAP).groupBy("node").agg(F.count(F.lit(1)).alias("more"))
    few = met.filter(F.col("many") <= CAP).join(more, "node", "left").select("gram", F.struct("n", "node", F.coalesce("more", F.lit(0)).alias("more")).alias("x"))
    few = few.groupBy("gram").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    few = few.select(F.explode("xs").alias("x"), "xs").select("x", F.explode("xs").alias("y")).filter("x < y AND 5 * x.n >= 4 * y.n")
    few = few.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    # beyond the prefix that ends first, the two sets share what is left of it at most
    rest = F.greatest(*(F.col(k) - prefix_size(F.col(k)) for k in ("x.n", "y.n"))) + F.col("shared") + F.least("x.more", "y.more")
    few = few.filter(alike(F.least(rest, F.col("x.n")), F.col("x.n"), F.col("y.n")))
    pairs = few.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    many = met.filter(F.col("many") > CAP).select("gram", "many", "low", "node")
    pairs = pairs.unionByName(many.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))).unionByName(simhash_pairs(nodes))
    number = nodes.select("node", "n")
    fits = pairs.distinct().join(number.select(F.col("node").alias("a"), F.col("n").alias("p")), "a").join(number.select(F.col("node").alias("b"), F.col("n").alias("q")), "b")
    pairs = materialize(fits.filter("5 * p >= 4 * q AND 5 * q >= 4 * p").select("a", "b"), "pairs", slim=True)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(many.select("node")).distinct().join(nodes.select("node", "h"), "node")
    texts = texts_of(docs).select("h", "text").join(wanted, "h").dropDuplicates(["node"])
    grams = materialize(sets(texts), "sets", slim=True)
    edges = materialize(verified(pairs, grams), "edges", slim=True)
    discard(sizes, pairs)
    if many.isEmpty():
        discard(met, grams)
        return edges
    roots = connected_components(edges)
    many = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = many.groupBy("gram").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count(F.lit(1)).alias("all"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).filter("one <> other")
    # shingles of one passage mostly have one set of nodes: one of them does
    split = split.groupBy("all", "who").agg(F.min("gram").alias("gram")).select("gram")
    found = materialize(link_blocks(many.join(split, "gram").select("gram", "many", "node"), grams), "edges", slim=True)
    discard(met, grams)
    return edges.unionByName(found)


def group_rows(docs: DataFrame) -> DataFrame:
    """(h, doc_id, again, best) of rows in groups of more than one: `best` is the (no_id, doc_id, h) that comes first in the group, `again` counts equal rows."""
    spark = docs.sparkSession
    order = frequent_shingles(docs)
    prints = materialize(sketches(docs, spark.sparkContext.broadcast(order)), "sketches")
    nodes = prints.groupBy("node").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes, "nodes", slim=True)
    rows = materialize(prints.groupBy("node", "h", "doc_id").agg(F.count(F.lit(1)).alias("again")), "rows", slim=True)
    discard(prints)
    for _ in range(ROUNDS):
        if order is not None:
            nodes, order = reordered(docs, nodes, order)
    roots = connected_components(link_nodes(docs, nodes))
    discard(nodes)
    keys = rows.join(roots, "node", "left").select("h", "doc_id", "again", F.coalesce("root", "node").alias("root"))
    keys = materialize(keys, "keys", slim=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    groups = keys.groupBy("root").agg(first.alias("best"), F.sum("again").alias("size")).filter("size > 1")
    return materialize(salted_left_join(keys, groups, "root", hot_keys(keys, "root")).filter("size > 1").select("root", "h", "doc_id", "again", "best"), "groups", slim=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of each group, the first by doc_id (nulls last), then by hash of the text; rows of other groups under the same doc_id stay."""
    groups = group_rows(docs)
    h, id_, best = fresh(docs, "h", "id", "best")
    by_text = groups.select(F.col("h").alias(h), F.col("best.doc_id").alias(id_), F.col("best.h").alias(best)).distinct()
    rows = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    first = F.col(best).isNull() | ((F.col(h) == F.col(best)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)))
    kept = salted_left_join(rows, by_text, h, hot_keys(rows.select(h), h)).filter(first)
    # equal rows are all the first of their group: they are folded into one
    equal = groups.filter((F.col("h") == F.col("best.h")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("again") > 1)).select(F.col("h").alias(h)).distinct()
    if equal.isEmpty():
        return kept.select(*docs.columns)
    others = kept.join(equal, h, "left_anti")
    return others.unionByName(kept.join(equal, h, "left_semi").dropDuplicates([h])).select(*docs.columns)
