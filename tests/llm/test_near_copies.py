import random

import pytest

from corpusloom.llm import nearcopies


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_of(texts):
    """The group of each text by comparing all pairs."""
    sets, low = [shingle_set(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] | sets[b])
            if low[a] != low[b] and (not n or len(sets[a] & sets[b]) * 5 >= 4 * n):
                x, y = sorted((low[a], low[b]))
                low = [x if z == y else z for z in low]
    return low


def corpus(seed=5):
    """Texts of 60 to 200 words with copies that have a few words changed: similarities on both sides of 0.8."""
    rng, texts = random.Random(seed), []
    line = " ".join(f"line{i}" for i in range(30))
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            near = list(words)
            for at in rng.sample(range(len(near)), rng.randrange(1, 6)):
                near[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(near))
        texts.append(" ".join(words[:8]) + " " + line)
    return [*texts, "", "a b", "A  b"]


@pytest.mark.parametrize("cap,block,sample", [(32, 4096, 16), (3, 4096, 1), (2, 4, 1)])
def test_pipeline_drops_every_near_copy_at_four_fifths(spark, monkeypatch, cap, block, sample):
    for name, value in {"CAP": cap, "BLOCK": block, "SAMPLE": sample}.items():
        monkeypatch.setattr(nearcopies, name, value)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    import corpus_pipeline

    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(groups_of(texts)))


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, copies without doc_id, two texts under one doc_id."""
    rng = random.Random(9)
    one, two, three, four = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    rows = [(1, one), (1, one), (None, one), (2, one), (2, two), (None, three), (None, three), (5, four), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, again int").repartition(3)
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, one), (2, two), (None, three), (5, four), (5, None)]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in want)
    assert nearcopies.keep_one(docs.limit(0)).count() == 0
