import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import licences, lm, mixing, toxicity


def held(i):
    import zlib

    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def slow_prior(grams, states):
    """The k at which the tokens that must be new to their state, left out one at a time, are as many as the n-grams seen once."""
    once = sum(c == 1 for c in grams.values())
    bins = {}
    for state, c in states.items():
        if state[-1] != "</s>":
            bins.setdefault(int(lm.count_bin(np.array([c]))[0]), []).append(c)
    low, high = math.log(1e-3), math.log(1e7)
    for _ in range(100):
        k = math.exp((low + high) / 2)
        new = sum(sum(cs) * k / (sum(cs) / len(cs) - 1 + k) for cs in bins.values())
        low, high = ((low + high) / 2, high) if new < once else (low, (low + high) / 2)
    return math.exp(low)


@pytest.mark.parametrize("block,shard", [(4 << 20, 4 << 20), (2000, 3000)])
def test_language_model_against_counting(docs, rows, monkeypatch, block, shard):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    flag = F.coalesce(toxicity.remainder("doc_id", 7) == 2, F.lit(False))
    got = lm.score_documents(docs.select("doc_id", "text", flag.alias("held_out"))).collect()
    texts = [(i, ["<s>", *(w.decode() for w in (t or "").encode().translate(lm.LOWER).split()), "</s>"]) for i, t in rows]
    n = [Counter() for _ in range(4)]
    for i, w in texts:
        if not held(i):
            for k in (1, 2, 3):
                n[k].update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    one = {k[0]: c for k, c in n[1].items() if k[0] != "<s>"}
    total, types = sum(one.values()), len(one)
    once, twice = (sum(c == x for c in one.values()) for x in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    prior = {k: slow_prior(n[k], n[k - 1]) for k in (2, 3)}
    want = []
    for i, w in texts:
        score = base = known = 0
        for a in range(1, len(w)):
            c = one.get(w[a], 0)
            known += c > 0
            base += math.log10((c + 1) / (total + types + 1))
            p = (c - d) / total if c else d * types / total
            for k in (2, 3):
                if a >= k - 1:
                    p = (n[k][tuple(w[a - k + 1 : a + 1])] + prior[k] * p) / (n[k - 1][tuple(w[a - k + 1 : a])] + prior[k])
            score += math.log10(p)
        want.append((str(i), held(i), len(w) - 1, known, total, round(base, 6), round(score, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_states_are_distributions():
    """From any state, the probabilities of all words and the unknown class sum to one."""
    texts = [b"a b a c", b"a b b", b"c a b"]
    trained = lm.Block(texts, [True] * 3)
    keys, inverse = np.unique(trained.keys, return_inverse=True)
    totals = np.bincount(inverse, weights=trained.learn)
    known = dict(zip(keys.tolist(), totals.tolist()))
    single = totals[(keys & np.uint64(1)).astype(bool)]
    stats = lm.Statistics(int(single.sum()), len(single), int((single == 1).sum()), int((single == 2).sum()))

    def probability(text):
        block = lm.Block([text], [False])
        return lm.traverse(block, np.array([known.get(k, 0.0) for k in block.keys.tolist()]), stats)["score"][0]

    for prefix in (b"", b"a", b"a b", b"zz", b"b b"):
        head = probability(prefix)
        # a text is its words and an end: take the end out by scoring each continuation's own end apart
        total = 10 ** (probability(prefix) - (head - end_of(probability, prefix)))
        for word in (b"a", b"b", b"c", b"unseen"):
            text = prefix + b" " + word
            total += 10 ** (probability(text) - end_of(probability, text) - (head - end_of(probability, prefix)))
        assert abs(total - 1) < 1e-9


def end_of(probability, text):
    """log10 P(end | text): what doubling the text's last step shows is awkward, so it comes from the automaton itself."""
    import corpusloom.llm.lm as module

    block_of = module.Block
    kept = {}

    class Spy(block_of):
        def __init__(self, texts, train, order=module.ORDER):
            super().__init__(texts, train, order)
            kept["block"] = self

    module.Block = Spy
    try:
        full = probability(text)
    finally:
        module.Block = block_of
    # the same stream without its last token
    block = kept["block"]
    original = module.np.add.reduceat
    last = {}

    class Numpy:
        pass

    def spy(values, starts):
        last.setdefault("v", []).append(values[-1])
        return original(values, starts)

    add = module.np.add
    try:
        module.np = type("np2", (), {k: getattr(np, k) for k in dir(np) if not k.startswith("__")})
        module.np.add = type("A", (), {"reduceat": staticmethod(spy), "accumulate": add.accumulate, "at": add.at})
        probability(text)
    finally:
        module.np = np
    assert block is not None and full is not None
    return last["v"][-1]


def hand_made():
    """The automaton of "a b a" and "a b", with counts of just these texts."""
    block = lm.Block([b"a b a", b"a b"], [True, True])
    return block, lm.Automaton(block, block.learn.astype(float), lm.Statistics(7, 3, 0, 0, {2: 1.0, 3: 2.0}))


def test_states_and_failure_arcs_of_a_hand_made_model():
    block, machine = hand_made()
    # words: start, a, b, end; states: none; start, a, b, end; (start a), (a b), (b a), (a end), (b end)
    assert machine.words == 4 and len(machine.fail) == 1 + 4 + 5
    ids = {name: int(block.ids[1][at]) for name, at in (("start", 0), ("a", 1), ("b", 2), ("end", 4))}
    one = {name: int(machine.state[1][i]) for name, i in ids.items()}
    two = {name: int(machine.state[2][block.ids[2][at]]) for name, at in (("start a", 1), ("a b", 2), ("b a", 3))}
    assert [int(machine.fail[two[x]]) for x in two] == [one["a"], one["b"], one["a"]]
    assert [int(machine.fail[one[x]]) for x in ("start", "a", "b")] == [0, 0, 0]
    # c(a) = 3 and k = 1 for pairs; c(a b) = 2 and k = 2 for triples
    assert math.isclose(machine.fall[one["a"]], math.log10(1 / 4)) and math.isclose(machine.fall[two["a b"]], math.log10(2 / 4))
    assert (np.diff(machine.arcs) > 0).all() and len(machine.arcs) == 3 + 5 + 4


def test_a_hand_traced_walk():
    """From (start a), b leads to (a b); unseen there, b falls to b, falls to no words, and is read: two failure arcs."""
    block, machine = hand_made()
    word = {x: int(block.ids[1][at]) for x, at in (("a", 1), ("b", 2), ("end", 4))}
    state = np.array([machine.state[2][block.ids[2][1]]])
    state, weight = machine.step(state, np.array([word["b"]]))
    one = {"a": 3 / 7, "b": 2 / 7}  # nothing is discounted but D = 0.5 of each
    d = lm.Statistics(7, 3, 0, 0).discount
    p_b = (2 - d) / 7
    p_ab = (2 + 1.0 * p_b) / (3 + 1)
    assert state[0] == machine.state[2][block.ids[2][2]] and math.isclose(weight[0], math.log10((2 + 2.0 * p_ab) / (2 + 2.0)))
    state, weight = machine.step(state, np.array([word["b"]]))
    fell = (2 / (2 + 2)) * (1 / (2 + 1)) * p_b
    assert state[0] == machine.state[1][word["b"]] and math.isclose(weight[0], math.log10(fell)) and one["b"] > p_b


def test_lanes_carry_on_where_the_words_in_front_lead(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)).encode() for n in (0, 1, 2, 3, 50, 400)]
    block = lm.Block(texts, [True] * len(texts))
    stats = lm.Statistics(462, 7, 1, 1, {2: 3.0, 3: 0.5})
    whole = lm.Automaton(block, block.learn.astype(float), stats).walk(block)
    for lane in (1, 7, 1000):
        monkeypatch.setattr(lm, "LANE", lane)
        assert np.allclose(lm.Automaton(block, block.learn.astype(float), stats).walk(block), whole)


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64))
    assert (lm.release(lm.press(keys)) == keys).all()
    counts = np.arange(500) ** 2
    assert (lm.release_counts(lm.press_counts(counts)) == counts).all()


def labelled(n=400, seed=8):
    rng = random.Random(seed)
    clean = ["der", "und", "la", "the", "of", "haus", "maison", "tree", "river"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(clean) + rng.choice(["", "a", "en", "ly", str(rng.randrange(30))]) for _ in range(rng.randrange(20, 120))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "grubnak" + rng.choice("abcdef"), "scorn"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_holds_out_a_fold(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9003, "123 !!"), (None, "the tree")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9001, 1), (3, None)], "doc_id bigint, toxic int")
    network = toxicity.scorer(docs, labels, toxicity.remainder("doc_id", 5) != 0)
    import zlib

    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, network).collect()}
    test = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in test]) > 0.95
    assert got[9001] == got[9002] == got[9003] < 0.5
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert len(kept & {i for i, _, y in rows if y}) < 5 and len({i for i, _, y in rows if not y} - kept) < 5


def test_pieces_of_long_texts_score_alike(monkeypatch):
    sample = [(i, t, y) for i, t, y in labelled(120)]
    net = toxicity.train(sample)
    texts = [t for _, t, _ in sample] + [" ".join(t for _, t, _ in sample[:20])]
    whole = net.scores(texts)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.allclose(net.scores(texts), whole, atol=1e-5)
    assert toxicity.train([(1, "a", 1)]) is None and toxicity.score_batch(None, ["a", None]).tolist() == [0, 0]


def test_scores_against_one_text_and_one_window_at_a_time():
    """Scores of a batch equal those of a plain loop over the windows of each text."""
    sample = labelled(80)
    net = toxicity.train(sample)
    net.thresholds[:] = [0.1, 0.2, -0.3, 0.4, 0.0]

    def slow(text):
        words = toxicity.WORD.findall((text or "").lower())
        if not words:
            return 1 / (1 + math.exp(-toxicity.WORDLESS))
        x = [sum(net.embed[b] for b in toxicity.features(w)) for w in words] + [np.zeros(toxicity.SIZE)] * 2
        tops = []
        for w, kernel, bias in zip(toxicity.WIDTHS, net.kernels, net.biases):
            for f in range(toxicity.FILTERS):
                tops.append(max(sum(float(x[i + o] @ kernel[o][:, f]) for o in range(w)) for i in range(len(words))) + bias[f])
        z = sum(max(t, 0) * o for t, o in zip(tops, net.out)) + net.bias
        spoken = {k: sum(w in f.split() for w in words) for k, f in enumerate(toxicity.FUNCTION_WORDS.values(), 1)}
        best = max(spoken, key=lambda k: (spoken[k], -k))
        z -= net.thresholds[best if spoken[best] * 20 >= len(words) else 0]
        return 1 / (1 + math.exp(-z))

    texts = [t for _, t, _ in sample[:25]] + ["", None, "12 ..", "der Haus und der Baum", "x", "la maison et les arbres"]
    assert np.allclose(toxicity.score_batch(net, texts), [slow(t) for t in texts], atol=1e-4)


def test_notices_outside_the_templates(spark, docs):
    """Wordings that no template has, and sentences with a licence's words that are none."""
    found = ["Distributed under the GNU GPL v3.", "Released as CC0 1.0", "Content available under CC BY-SA 4.0.", "Lizenziert unter CC BY 4.0", "Licensed under the MIT License"]
    none = ["This program is on the public domain channel under the name of the general.", "Her permission was granted.", "The public software foundation.", "under the terms of this"]
    table = spark.createDataFrame(list(enumerate(found + none)), "doc_id bigint, text string")
    model = licences.train(docs)
    got = {r.doc_id: r.family for r in licences.scan(table, model).collect() if r.position is not None}
    assert [got.get(i) for i in range(5)] == ["gpl", "cc0", "cc-by-sa", "cc-by", "mit"]
    assert all(got.get(5 + i) is None for i in range(len(none)))


def test_the_scan_against_scoring_every_paragraph(spark, docs, rows):
    """Families of a plain loop over all lines of all texts, candidates or not."""
    rng = random.Random(4)
    pool = [w for _, t in licences.ALL_TEMPLATES for w in t.split()]
    lines = [t for _, t in licences.ALL_TEMPLATES] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(2, 25))) for _ in range(120)]
    texts = [t for _, t in rows] + ["\n".join(rng.sample(lines, 5)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model, want = licences.train(docs), set()
    for i, text in enumerate(texts):
        for k, line in enumerate(x for x in (text or "").split("\n") if x.strip(" ")):
            x = np.zeros((1, len(model.grams)), np.float32)
            x[0, [model.grams[g] for g in licences.grams_of(line) if g in model.grams]] = 1
            p = model.probabilities(x)[0]
            best = p[: licences.UNKNOWN].argmax()
            if p[best] >= model.least and p[best] > p[licences.UNKNOWN]:
                want.add((i, k, licences.FAMILIES[best]))
    got = {(r.doc_id, r.position, r.family) for r in licences.scan(table, model).filter("family IS NOT NULL").collect()}
    assert got == want and len(want) > 50


def test_licences(spark, docs, rows):
    texts = ["Prose about rivers.\nReleased under the MIT License.\nMore prose.", "Licensed under the Apache License, Version 2.0.", "He lost his driving licence.", "This work is licensed under the GNU General Public License, version 3.\n\nLicensed under CC BY-NC 4.0.", None, "", "no notice here", "SPDX-License-Identifier: MPL-2.0", "RELEASED UNDER THE MIT LICENSE."]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2)], "doc_id bigint, text string, n int")
    model = licences.train(docs)
    found = licences.scan(table, model)
    got = {(r.doc_id, r.position): r.family for r in found.filter("confirmed").collect()}
    assert got == {(0, 1): "mit", (1, 0): "apache", (3, 0): "gpl", (3, 1): "cc-by-nc", (7, 0): "mpl", (8, 0): "mit"}
    assert found.filter("doc_id = 0 AND confirmed").count() == 2
    assert found.filter("doc_id = 2 AND family IS NOT NULL").count() == 0
    # probabilities equal those of the model's own matrix form
    for r in found.filter("position IS NOT NULL AND doc_id IN (0, 1, 3)").collect():
        line = [x for x in texts[r.doc_id].split("\n") if x.strip()][r.position]
        x = np.zeros((1, len(model.grams)), np.float32)
        x[0, [model.grams[g] for g in licences.grams_of(line) if g in model.grams]] = 1
        assert abs(model.probabilities(x)[0, : licences.UNKNOWN].max() - r.probability) < 1e-4


def test_mixing_meets_targets_and_edges(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["fine", "prose", "words", "here"]) if i % 3 else rng.choice(["###", "$$$", "&&&", "junk"]) for _ in range(rng.randrange(5, 60))), int(i % 3 > 0), 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "p") for i, t, _, _ in rows] + [(None, "fine prose", "p"), (900, None, "p"), (901, "", "p")], "doc_id bigint, text string, _rate string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 2], "doc_id bigint, quality int, toxic int")
    domains, targets = {"a": "quality = 1", "b": "quality = 0"}, {"a": 0.5, "b": 0.5}
    got = mixing.mixed(docs.drop("_rate"), labels, domains, targets).toPandas()
    total = got.n_tokens.sum()
    for d in "ab":
        assert abs((got.n_tokens * got.rate * got[f"p_{d}"]).sum() / total - 0.5) < 1e-4
    assert (got.rate >= 0).all() and len(got) == 303 and ((got.copies - got.rate).abs() <= 1).all()
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert mixing.mixed(docs.drop("_rate"), none, domains, targets).count() == 303
    assert mixing.mixed(docs.drop("_rate").limit(0), labels, domains, targets).count() == 0


def test_mixing_against_a_plain_loop(spark):
    """Posteriors text by text, and projected steps on whole arrays, give the same rates."""
    rng = random.Random(12)
    texts = [(i, None if i == 7 else "" if i == 8 else " ".join(rng.choice(["fine", "prose", "words"] if i % 3 else ["###", "$$$", "junk"]) for _ in range(rng.randrange(3, 50)))) for i in range(150)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in texts if i % 2], "doc_id bigint, quality int")
    domains, targets = {"a": "quality = 1", "b": "quality = 0"}, {"a": 0.3, "b": 0.7}
    model = mixing.fit_classifier(docs, labels, domains).value
    n, p = zip(*(model.posterior(t.encode() if t else None) for _, t in texts))
    n, p, share = np.array(n, float), np.array(p), np.array([0.3, 0.7])
    rate, best = np.ones(len(n)), (np.inf, None)
    for _ in range(mixing.STEPS):
        residual = (n * rate) @ p / n.sum() - share
        if np.abs(residual).max() < best[0]:
            best = np.abs(residual).max(), rate
        if best[0] < mixing.TOLERANCE:
            break
        moments = (p * (n * (rate > 0))[:, None]).T @ p / n.sum()
        rate = np.maximum(0, rate - p @ np.linalg.lstsq(moments + 1e-9 * np.eye(2), residual, rcond=1e-10)[0])
    got = {r.doc_id: r for r in mixing.mixed(docs, labels, domains, targets).collect()}
    assert np.allclose([got[i].rate for i, _ in texts], best[1], atol=1e-6)
    assert np.allclose([got[i].p_a for i, _ in texts], p[:, 0], atol=1e-6) and [got[i].n_tokens for i, _ in texts] == n.tolist()
    assert mixing.mixed(docs, labels, domains, targets, text=False).columns == ["doc_id", "n_tokens", "p_a", "p_b", "rate", "copies"]
