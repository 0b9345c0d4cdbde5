"""Folds that share counts agree with a model fitted anew for each fold."""

import random

from corpusloom.operators import evaluation


def test_shared_counts_give_the_same_folds(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choices(words[:8] if k % 2 else words[3:], k=rng.randrange(4, 9))), k % 2, float(rng.random())) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, label int, x double").coalesce(1).cache()
    own = evaluation.cross_validated_text(df, "id", folds=2, numbers=("x",), stop=("w5",))
    want = evaluation.cross_validated(df, "id", lambda t: evaluation.text_model(t, numbers=("x",), stop=("w5",)), folds=2)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))
