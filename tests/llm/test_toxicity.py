import random

import numpy as np
from pyspark.sql import functions as F

from vetloom.llm import toxicity as T


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        sentences = [[rng.choice(words) for _ in range(8)] for _ in range(rng.randint(1, 8))]
        y = int(rng.random() < 0.25)
        if y:
            rng.choice(sentences)[3] = rng.choice(["zonk", "zorba", "quxing"])
        texts.append(". ".join(" ".join(s) for s in sentences) + ".")
        labels.append(y)
    return texts, labels


def test_held_out_accuracy_and_sentences():
    texts, labels = corpus()
    model = T.fit(texts[:400], labels[:400])
    scores = np.array([model.score(t) for t in texts[400:]])
    y = np.array(labels[400:])
    assert ((scores >= 0.7) == y).mean() > 0.95
    bad = next(t for t, l in zip(texts[400:], labels[400:]) if l)
    found = model.offending(bad)
    assert found and all(any(w in s for w in ("zonk", "zorba", "quxing")) for s, _ in found)


def test_score_is_noisy_or():
    model = T.Model({"bad": 3.0}, -1.0, 0.1)
    p = [1 / (1 + np.exp(-z)) for z in (-1.0, 2.0, 5.0)]
    want = 1 - 0.9 * (1 - p[0]) * (1 - p[1]) * (1 - p[2])
    assert abs(model.score("fine. bad one! bad bad") - want) < 1e-12
    assert model.score(None) == model.score("") == model.score(" \n") or abs(model.score("") - 0.1) < 1e-12


def test_rows(spark):
    texts, labels = corpus(200)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, None, 1.0), (5, texts[5], 2.0), (900, "", 0.0)], "doc_id long, text string, score double")
    own = spark.createDataFrame([(i, l) for i, l in enumerate(labels)] + [(7, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    model = T.learn(docs, own, F.col("doc_id") >= 0)
    got = T.score(docs, model, offending=True).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 for r in got)
    kept = T.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.7 for r in got)
    assert T.score(docs.limit(0), model).count() == 0
    none = T.learn(docs, own.limit(0), F.lit(True))
    assert {r.score for r in T.score(docs, none).collect()} <= {x for x in [0.0]} or max(r.score for r in T.score(docs, none).collect()) < 1e-9


def test_likelihood_as_loops_and_its_slope():
    texts, labels = corpus(60, 3)
    texts[0] = texts[0] + " " + texts[0]  # sentences that repeat
    y = np.array(labels)
    seen = T.in_documents(texts, labels)
    index = {f: i for i, f in enumerate(sorted(seen)[::7])}
    docs = T.Coded([T.coded(t, index, {}) for t in texts])
    theta = np.random.default_rng(0).normal(0, 0.5, len(index) + 2) - 0.5
    value, slope = T.likelihood(theta, y, docs, 1e-3)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    want = 0.0
    for t, label in zip(texts, labels):
        clean = 1 - sigmoid(theta[-1])
        for s in T.bags_of(t):
            clean *= 1 - sigmoid(theta[-2] + sum(theta[index[f]] for w in s for f in T.features(w) if f in index))
        want += np.log(1 - clean if label else clean)
    assert abs(value - (want / len(y) - 5e-4 * (theta[:-2] ** 2).sum())) < 1e-9
    for k in [0, 5, len(index) - 1, len(index), len(index) + 1]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        near = (T.likelihood(theta + step, y, docs, 1e-3)[0] - T.likelihood(theta - step, y, docs, 1e-3)[0]) / 2e-5
        assert abs(near - slope[k]) < 1e-6


def test_learnt_as_fitted_here(spark):
    # what executors count and code gives the model of the same texts fitted at once; repeats teach once, a very long text doesn't
    texts, labels = corpus(150, 5)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (500, "zonk " * 210_000), (None, "zonk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.createDataFrame([*enumerate(labels), (500, 1), (777, 1)], "doc_id long, toxic int")
    model, plain = T.learn(docs, own, F.lit(True)), T.fit(texts, labels)
    assert set(model.weights) == set(plain.weights)
    assert all(abs(model.score(t) - plain.score(t)) < 1e-6 for t in texts)
