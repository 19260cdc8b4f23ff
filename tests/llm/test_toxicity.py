import itertools

import numpy as np
from payguard.llm import toxicity
from payguard.llm.common import table

DIR = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    c = toxicity.Chain(["w:a"])
    rnd = np.random.default_rng(0)
    for lengths in ([4], [1, 3, 2], [2, 5]):
        e = rnd.normal(0, 2, sum(lengths))
        p, _, _ = c.marginals(e, np.array(lengths))
        at = 0
        for n in lengths:
            mass, hit = 0.0, np.zeros(n)
            for tags in itertools.product((0, 1), repeat=n):
                w = np.exp(sum(e[at + i] for i, t in enumerate(tags) if t) + sum(c.moves[a, b] for a, b in zip(tags, tags[1:])))
                mass += w
                hit += w * np.array(tags)
            assert np.allclose(p[at : at + n], hit / mass)
            at += n


def test_scores_mean_the_same_whatever_the_sample():
    """A sample with few of the clean rows is calibrated as the whole would be."""
    rnd = np.random.default_rng(1)
    x = np.stack([rnd.exponential(1.0, 20_000), rnd.random(20_000), np.ones(20_000)], 1)
    toxic = (rnd.random(20_000) < 1 / (1 + np.exp(4 - 2 * x[:, 0]))).astype(float)
    some = (toxic == 1) | (rnd.random(20_000) < 0.1)
    whole, part = toxicity.Chain([]), toxicity.Chain([])
    whole.calibrate(x, toxic, np.ones(len(x)))
    part.calibrate(x[some], toxic[some], np.where(toxic[some] == 1, 1.0, 10.0))
    assert np.abs(whole.calibration - part.calibration).max() < 0.35


def test_long_repeated_and_clashing_rows(spark):
    train = [(i, ("nice words here " * 9 + ("vile curse " if i % 3 == 0 else "")) + f"n{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)], "doc_id long, toxic int, quality int")
    rows = [(1000, "fine " * 60_000 + "vile curse", 0.5), (1001, "fine " * 60_000, 0.5), (1002, "vile curse", None), (1002, "vile curse", None)]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in train] + rows, "doc_id long, text string, score double")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 304 and {r.predicted for r in got if r.doc_id in (1000, 1002)} == {1} and next(r for r in got if r.doc_id == 1001).predicted == 0
    assert next(r for r in got if r.doc_id == 1000).spans == "300000:300004,300005:300010"
    assert len({r.score for r in got if r.doc_id == 1002}) == 1


def test_held_out_documents(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "idiot " * 3)], "doc_id long, text string")
    chain = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs.select("doc_id", "text").union(odd), chain).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert sum(b for a, b in held if a == 1) >= 0.88 * sum(a for a, _ in held)
    empty = [r for r in rows if r.doc_id in (None, -1)]
    assert all(r.predicted == 0 and r.spans == "" for r in empty)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0
