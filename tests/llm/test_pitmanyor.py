import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vetloom.llm import pitmanyor as M


def test_alone_is_exact_for_three():
    # three customers at two tables: the tables are 1 and 2, so one of three sits alone
    d = 0.5
    table = M.alone_table(d)
    assert table[2, 2] == 1 and table[3, 1] == 0 and abs(table[3, 2] - 1 / 3) < 1e-12


def corpus(n=150, seed=2):
    rng = random.Random(seed)
    tongues = [["".join(rng.choice(s) for _ in range(rng.randint(2, 5))) + e for _ in range(60)] for s, e in (("abc", "x"), ("def", "yo"), ("ghi", "zu"))]
    texts = [" ".join(rng.choices(rng.choice(tongues), k=rng.randint(1, 60))) for _ in range(n)]
    return [*texts, "A\tb\x0bC  \n", "\xa0 x"]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 300)
    texts = corpus()
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, None, 1.0), (990, "", 1.0), (991, texts[0], 1.0), (992, texts[0], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = {r.doc_id: r for r in M.score(df, F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 1).collect()}
    tokens = {i: [*M.words_of(t), M.END] for i, t, _ in rows}
    train = Counter(w for i, ws in tokens.items() if (i or 0) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == ((i or 0) % 5 == 1, len(ws), sum(w in train for w in ws), n)
        assert abs(r.base_score - sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert M.score(df.limit(0), F.lit(True)).count() == 0
    assert all(abs(r.score) < 1e-9 for r in M.score(df.limit(3), F.lit(True)).collect())


def test_weights_add_up():
    rng = np.random.default_rng(0)
    word = np.repeat(np.arange(50), 3)
    restaurant = np.tile([0, 5, 64], 50).astype(np.uint8)
    n = rng.integers(1, 300, 150)
    d = np.array([0.8, 0.7, 0.5])
    s = M.Seating(word, restaurant, n, d, [M.alone_table(x) for x in d])
    for _ in range(20):
        s.sweep((s.customer_totals(), s.table_totals()), 1 / 51, rng)
        for k in range(3):
            assert (s.t[k] >= 1).all() and (s.t[k] <= s.c[k]).all()
        totals = (s.customer_totals(), s.table_totals())
    root = s.chance(2, totals, 1 / 51)
    unknown = (M.STRENGTH + d[2] * totals[1][M.ROOT]) / (M.STRENGTH + totals[0][M.ROOT]) / 51
    assert abs(root.sum() + unknown - 1) < 0.05


def test_sweep_seats_all_customers():
    # from the greatest and the least seating, one sweep reaches the same law, however many customers
    d, c = np.array([0.8, 0.6, 0.5]), np.repeat([2, 40, 250, 400, 1_000_000], 400)
    rng = np.random.default_rng(1)
    alone = [M.alone_table(x) for x in d]
    means = []
    for start in (1, c):
        s = M.Seating(np.arange(len(c)), np.zeros(len(c), np.uint8), c, d, alone)
        s.t[0] = np.ones(len(c), np.int64) * start
        totals = (np.full(M.RESTAURANTS, 1e5), np.full(M.RESTAURANTS, 1e4))
        s.chance = lambda *_: np.full(len(c), 1e-3)
        s.sweep(totals, 1 / 2001, rng)
        means.append(s.t[0].reshape(5, -1).mean(1))
    a = (M.STRENGTH + d[0] * 1e4) * 1e-3
    for k, size in enumerate([2, 40, 250]):
        p = M.log_stirling(alone[0], d[0])[size, 1 : size + 1] + np.arange(1, size + 1) * np.log(a)
        p = np.exp(p - p.max())
        exact = (p * np.arange(1, size + 1)).sum() / p.sum()
        assert all(abs(m[k] - exact) < 0.1 * exact for m in means)
    assert all(abs(m[4] - (1 + a / d[0])) < 0.1 * a / d[0] for m in means)


def test_many_customers_as_exact(monkeypatch):
    monkeypatch.setattr(M, "MOST", 600)
    for d in (0.3, 0.6, 0.8):
        log_s = M.log_stirling(M.alone_table(d), d)
        for a in (0.1, 5.0, 100.0):
            t = np.arange(1, 601)
            p = np.exp(log_s[600, 1:] + t * np.log(a) - (log_s[600, 1:] + t * np.log(a)).max())
            exact = (p * t).sum() / p.sum()
            mean, variance = M.limit_law(np.array([600.0]), np.array([a]), d)
            assert abs(1 + mean[0] - exact) < 0.02 * exact + 0.3 and variance[0] <= mean[0]


def test_words_before_are_told_apart(spark):
    # both words before end alike, so only the words themselves tell what follows
    rows = [(i, t, False) for i, t in enumerate(["north m", "south n"] * 60)] + [(900, "north m", True), (901, "north n", True), (902, "south m", True), (903, "south n", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in M.score(docs, F.col("held")).collect()}
    assert M.ending(b"north") == M.ending(b"south")
    assert got[900] > got[901] + 0.5 and got[903] > got[902] + 0.5


def test_texts_add_up(spark, monkeypatch):
    # two known words and one unknown; almost all of the probability is in texts of four words at most
    monkeypatch.setattr(M, "BLOCK_TOKENS", 100)
    rows = [(None, t, False) for t in ["a"] * 300 + ["b"] * 200 + ["a b"] * 40 + ["b b a"] * 5 + [""] * 20]
    texts = [" ".join(t) for k in range(5) for t in itertools.product(["a", "b", "?"], repeat=k)]
    rows += [(i, t, True) for i, t in enumerate(texts)]
    got = M.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), F.col("held")).where("held_out").collect()
    assert len(got) == len(texts) and abs(sum(10**r.score for r in got) - 1) < 0.01
