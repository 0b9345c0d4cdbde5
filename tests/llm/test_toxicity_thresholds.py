import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import toxicity


def test_thresholds_see_all_allowed_labelled_rows(spark):
    """Sample bounds of 30 + 60 leave most rows out of the fit; every allowed one with words is counted, at the true frequency."""
    texts = [(i, ("the vilest scorn of rivers " if i % 9 == 0 else "the tree of rivers ") + f"word{i % 50}") for i in range(900)]
    docs = spark.createDataFrame([*texts, (9001, ""), (9002, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i, _ in texts] + [(9001, 1), (9002, 1)], "doc_id bigint, toxic int")
    kept = toxicity.remainder("doc_id", 5) != 0
    sample = toxicity.labelled_sample(docs, labels, kept, 30, 60)
    assert len(sample) == 90
    nets = spark.sparkContext.broadcast([toxicity.train(sample, k) for k in range(toxicity.FOLDS)])
    counts = toxicity.logit_counts(docs, labels, kept, nets)
    allowed = labels.filter(kept & (F.col("doc_id") < 9000)).toPandas()
    assert sum(c[2] for c in counts) == len(allowed) and sum(c[3] for c in counts) == allowed.toxic.sum()


def test_threshold_has_the_best_f1_at_the_true_frequency():
    """With eight clean texts for each toxic one the cut is higher than in a sample of two for each."""
    rng = np.random.default_rng(1)
    net, cuts = toxicity.Network(), []
    for clean in (2000, 8000):
        z = np.concatenate([rng.normal(1, 1, 1000), rng.normal(-1, 1, clean)])
        y = np.arange(len(z)) < 1000
        bins = np.floor(z * toxicity.BIN).astype(int)
        net.calibrate([(1, int(b), int((bins == b).sum()), int(y[bins == b].sum())) for b in np.unique(bins)])
        f1 = lambda c: 2 * (y & (z >= c)).sum() / ((z >= c).sum() + 1000)
        assert f1(net.thresholds[1]) >= max(map(f1, z)) - 0.005 and net.thresholds[1] == net.thresholds[0]
        cuts.append(net.thresholds[1])
    assert cuts[1] > cuts[0] + 0.2
