import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import decontam, substring
from corpusloom.llm.fmindex import FMIndex, WaveletMatrix, suffix_order


def test_wavelet_rank_and_access():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 37, 500)
    w = WaveletMatrix(seq, 37)
    at, symbols = rng.integers(0, 501, 200), rng.integers(0, 37, 200)
    assert (w.rank(symbols, at) == [(seq[:a] == s).sum() for a, s in zip(at, symbols)]).all()
    got, ranks = w.access_rank(np.arange(500))
    assert (got == seq).all() and (ranks == [(seq[:i] == seq[i]).sum() for i in range(500)]).all()


def test_index_finds_all_occurrences():
    rng = random.Random(5)
    text = np.array([x for _ in range(20) for x in ([rng.randrange(1, 4) for _ in range(rng.randrange(0, 15))] + [0])], np.int32)
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FMIndex(text, 4, every=5)
    for n in (1, 2, 3, 4):
        for _ in range(30):
            p = [rng.randrange(1, 4) for _ in range(n)]
            low, high = index.search(np.array([p]), np.array([n]))
            at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert at == [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == p]


def slow_removed(rows, length=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words):
        cover = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                cover[k : k + length] = [True] * length
        kept = [x for x, c in zip(w, cover) if not c]
        out.append((i, len(w), sum(cover), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("hot,shard", [(4096, 4096), (1, 8)])
def test_substring_query_against_brute_force(docs, rows, monkeypatch, hot, shard):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD", shard)
    got = [tuple(r) for r in substring.removed_words(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow_removed(rows)))


def test_remove_repeats_leaves_clean_texts_alone(docs, rows):
    kept = substring.remove_repeats(docs)
    assert kept.schema == docs.schema
    want = {}
    for (i, t), (_, n, gone, _) in zip(rows, slow_removed(rows)):
        if n == 0 or gone < n:
            want.setdefault(i, []).append((gone, t))
    got = {}
    for r in kept.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(any(r.text == t for r in got[i]) for i, v in want.items() for gone, t in v if not gone)
    assert all(r.n_chars == len(r.text or "") for v in got.values() for r in v)


def slow_hits(text, items, window=10):
    import re

    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    own, cover, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            p = w[k : k + window]
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    cover |= set(range(i, i + len(p)))
                    found.add(str(name))
    return len(own), len(cover), sorted(found)


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    base = rows[4][1].split()
    items = [(1, " ".join(base[10:24])), (2, "Zwei, Wörter!"), (10, None), (11, ""), (12, " ".join(base[12:30]).upper()), (13, "not in any text of these at all but long enough to be a window"), (None, "word"), (1, "kappa unseen")]
    return items, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_decontamination_against_brute_force(docs, rows, benchmark, monkeypatch, block):
    """Items in one block, and in several blocks that are merged."""
    items, table = benchmark
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in decontam.find_contamination(docs, table).collect()]
    known = [(i, t) for i, t in items if i is not None]
    assert sorted(map(str, got)) == sorted(str((i, *slow_hits(t, known))) for i, t in rows)


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_removal_of_leaks(docs, benchmark, rows, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items, table = benchmark
    assert decontam.remove_contamination(docs, table).schema == docs.schema
    kept = {r.doc_id: r.text for r in decontam.remove_contamination(docs, table).collect()}
    hit = rows[4][0]
    assert slow_hits(kept[hit], [(1, items[0][1])])[1] == 0
    assert kept[rows[7][0]] == rows[7][1]
    assert next(i for i, t in rows if t == "Zwei Wörter") not in kept


def test_empty(empty, benchmark, docs, spark):
    assert substring.removed_words(empty).count() == 0
    assert decontam.find_contamination(empty, benchmark[1]).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_contamination(docs, none).filter("n_hit > 0").count() == 0
    assert decontam.remove_contamination(docs, none).count() == docs.count()


def test_items_without_item_id_hit_as_in_the_oracle(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[30:])), (3, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, " ".join(words[5:17])), (None, " ".join(words[12:24])), ("a", " ".join(words[14:26])), (None, " ".join(words[40:50]))], "item_id string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontam.op10_decontamination(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({decontam.OP10_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[0]: r[2] for r in got.collect()} == {1: 21, 2: 10, 3: 0}
    kept = {r.doc_id: r.text for r in decontam.remove_contamination(docs, items).collect()}
    assert kept == {1: " ".join(words[:5] + words[26:30]), 2: " ".join(words[30:40] + words[50:]), 3: "clean"}


def test_equal_segments_hash_alike_wherever_they_stand():
    words = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    other = np.concatenate([words[200:207], words[20:60], words[:50]])
    assert substring.content(words, np.array([20]), np.array([40])) == substring.content(other, np.array([7]), np.array([40]))
    assert substring.content(words, np.array([20]), np.array([40])) != substring.content(other, np.array([7]), np.array([39]))


def test_matching_statistics_against_all_substrings():
    rng = random.Random(8)
    parts = [[rng.randrange(1, 4) for _ in range(rng.randrange(5, 20))] for _ in range(12)]
    index = FMIndex(np.array([x for p in parts for x in (*p, 0)], np.int32), 4)
    seen = Counter(tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1))
    rows = np.array([p[i : i + 5] for p in parts for i in range(len(p) - 4)])
    want = [max((k for k in range(1, 6) if seen[tuple(r[5 - k :].tolist())] >= 2), default=0) for r in rows]
    assert index.matching(rows, 2).tolist() == want


@pytest.mark.parametrize("hot", [3, 2048])
def test_a_passage_that_many_texts_hold_among_other_words(spark, monkeypatch, hot):
    """Near copies of one passage, each with words of its own around it: with a small bound no shard takes the anchor whole."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD", 8)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for i in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(own[: rng.randrange(30)] + passage[rng.randrange(8) : 45 - rng.randrange(8)] + own[rng.randrange(30) :])))
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id bigint, text string, row int, hits string, __row string").repartition(5)
    got = [tuple(r) for r in substring.removed_words(docs).collect()]
    assert sorted(got) == sorted(slow_removed(rows))
    kept = substring.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.filter("row = 1 AND hits = 'x' AND __row = 'y'").count() == kept.count() > 0


@pytest.mark.parametrize("block,piece", [(8 << 20, 4096), (400, 7)])
def test_long_items_in_pieces_and_columns_with_names_of_ours(spark, monkeypatch, block, piece):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "PIECE", piece)
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(400)}" for _ in range(120))
    items = [("long", long), ("again", long.upper()), ("short", "w1 w2"), (None, " ".join(long.split()[30:50]))]
    rows = [(i, " ".join(long.split()[a : a + 40]) + " tail of its own") for i, a in enumerate(range(0, 100, 9))] + [(50, "w1 w2"), (51, None), (52, "clean")]
    docs = spark.createDataFrame([(*r, "s", True, 3) for r in rows], "doc_id bigint, text string, spans string, __all boolean, row int").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in decontam.find_contamination(docs, bench, nameless=True).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *slow_hits(t, items))) for i, t in rows)
    kept = decontam.remove_contamination(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.filter("spans = 's' AND __all AND row = 3").collect()} == {*range(12), 51, 52}
    assert all(slow_hits(r.text, items)[1] == 0 for r in kept.collect())
