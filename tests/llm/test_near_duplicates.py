import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import minhash, simhash


def slow_fingerprint(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """Smallest id reachable for each (id, fingerprint)."""
    low = {}
    todo = set(fps)
    while todo:
        group, queue = set(), [todo.pop()]
        while queue:
            x = queue.pop()
            group.add(x)
            near = {y for y in todo if (x[1] ^ y[1]).bit_count() <= 3}
            todo -= near
            queue += near
        ids = [i for i, _ in group if i is not None]
        for x in group:
            low[x] = min(ids, default=None)
    return low


def test_simhash_query_against_brute_force(docs, rows):
    got = simhash.group_documents(docs).collect()
    want = slow_components({(i, slow_fingerprint(t)) for i, t in rows})
    assert sorted(map(str, ((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got))) == sorted(str((i, fp, want[i, fp])) for i, fp in ((i, slow_fingerprint(t)) for i, t in rows))


def test_hash_agrees_with_sql(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == simhash.signed(xxhash.xxh64_intdigest(b"a b c", 42))


def test_covering_family_misses_no_pair():
    masks, rng = simhash.covering_masks(), random.Random(1)
    for _ in range(5000):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("bucket,wide", [(4096, 1 << 17), (4, 1 << 17), (4, 4)])
def test_links_span_groups_by_every_way(spark, monkeypatch, bucket, wide):
    """Streamed buckets, compared blocks and cleared bits give the same components."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "WIDE", wide)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(1, 4))) for _ in range(12)} | {rng.getrandbits(64) for _ in range(10)}
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp bigint")
    edges = [(r.src & (2**64 - 1), r.dst & (2**64 - 1)) for r in simhash.link_fingerprints(nodes).collect()]
    want = slow_components({(x, x) for x in fps})
    low = {x: x for x in fps}
    for _ in range(len(fps)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {x: min(y for y in fps if low[y] == low[x]) for x in fps} == {x: want[x, x] for x in fps}


def test_keep_one_keeps_columns_and_one_of_each_group(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = slow_components({(i, slow_fingerprint(t)) for i, t in rows})
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, t in rows if i is not None and not any(want[j, slow_fingerprint(u)] < i for j, u in rows if j == i))
    assert ids.count(None) == 2


def test_empty_tables(empty):
    assert simhash.group_documents(empty).count() == 0
    assert minhash.fingerprint_documents(empty).count() == 0


def test_minhash_query_against_plain_python(docs, rows):
    got = {}
    for r in minhash.fingerprint_documents(docs).collect():
        got.setdefault((r.doc_id, r.n_chars, r.edited_sha256), []).append(r)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    import hashlib

    for k, (i, t) in enumerate(order):
        text, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i, len(text), hashlib.sha256(edited.encode()).hexdigest()].pop()
        assert r.fingerprint == minhash.fingerprint(text.encode()).hex()
        assert r.near_edited == minhash.likeness(minhash.fingerprint(text.encode()), minhash.fingerprint(edited.encode()))
        assert r.near_next == minhash.likeness(minhash.fingerprint(text.encode()), minhash.fingerprint(following.encode()))
    assert not any(got.values())


def test_minhash_estimates_jaccard():
    rng, errors = random.Random(4), []
    for _ in range(60):
        a = [str(rng.random()) for _ in range(rng.randrange(30, 600))]
        cut = rng.randrange(len(a))
        b = a[:cut] + [str(rng.random()) for _ in range(rng.randrange(5, 300))]
        sa, sb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        got = minhash.likeness(*(minhash.fingerprint(" ".join(x).encode()) for x in (a, b)))
        errors.append(got - len(sa & sb) / len(sa | sb))
    assert abs(np.mean(errors)) < 0.015 and np.mean(np.abs(errors)) < 0.04
    assert minhash.likeness(b"", b"") == 1.0 and minhash.likeness(b"", minhash.fingerprint(b"x")) == 0.0
    assert minhash.fingerprint(b"one two") == minhash.fingerprint(b"ONE  two\n")


def test_minhash_without_any_doc_id(spark):
    """All documents follow each other by text, and the first follows the last."""
    import hashlib

    texts = ["b two words", "a", None, "c " * 50]
    table = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string").repartition(3)
    order = sorted(t or "" for t in texts)
    want = []
    for k, text in enumerate(order):
        half = len(text) // 2
        want.append(hashlib.sha256((text[: len(text) - half] + order[(k + 1) % len(order)][:half]).encode()).hexdigest())
    got = minhash.fingerprint_documents(table).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
    one = minhash.fingerprint_documents(table.filter("text = 'a'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
