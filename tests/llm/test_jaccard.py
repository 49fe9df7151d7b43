import random
import re

import numpy as np
import pytest

from vetloom.llm import jaccard as J

SCHEMA = "doc_id long, text string, node int, h int"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts, width, num, den):
    sets = [shingles(t, width) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(len(s), l) for s, l in zip(sets, label)]


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(12))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            own = rng.choice(texts[-40:]).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.2:
                own = own[1:] + [rng.choice(words)]
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 8, 30, 60, 90]))) + (" " + shared if rng.random() < 0.4 else ""))
    return texts


def test_sets():
    texts = ["A b  C\td", "a B c d", "Éa b", None, "", " \n", "x", "a b c a b c a", "ab c", "a bc"]
    for width in (1, 3, 5):
        got = list(J.shingle_sets(texts, width))
        assert [len(s) for s in got] == [len(shingles(t, width)) for t in texts]
        assert (got[0] == got[1]).all()
        assert J.identity(got[8]) != J.identity(got[9])
    assert [list(x) for x in J.shingle_sets(texts[:1], 3)] == [list(x) for x in J.shingle_sets(["zz", texts[0]], 3)][1:]


@pytest.mark.parametrize("num,den", [(90, 100), (4, 5)])
def test_trie_against_all_pairs(num, den):
    rng = np.random.default_rng(1)
    base = rng.choice(1000, 40, replace=False)
    sets = []
    for _ in range(150):
        s = set(base.tolist()) if rng.random() < 0.7 else set(rng.choice(1000, 30).tolist())
        for _ in range(rng.integers(0, 6)):
            s.discard(int(rng.choice(list(s))))
            s.add(int(rng.integers(1000)))
        sets.append(np.array(sorted(s), np.uint64))
    trie = J.Trie(num, den)
    for i, s in enumerate(sets):
        want = {j for j in range(i) if (b := len(np.intersect1d(s, sets[j]))) * den >= num * (len(s) + len(sets[j]) - b)}
        assert set(trie.similar(s)) == want
        trie.add(s, i)


@pytest.mark.parametrize("piece", [120, 4])
def test_components(spark, monkeypatch, piece):
    monkeypatch.setattr(J, "PIECE", piece)
    texts = corpus(piece, 120) + [None, "", "one", "One", "one two"]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, 3, 90, 100).collect())
    assert got == [(i, n, c) for i, (n, c) in enumerate(brute(texts, 3, 90, 100))]


def test_one_of_each(spark):
    texts = corpus(7, 60) + [None, ""]
    rows = [(i, t, 1, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1, 1), (None, texts[5], 1, 1), (None, "quite alone here", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    want = [i for i, (n, c) in enumerate(brute(texts, 5, 4, 5)) if c == i]
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert [r.text for r in got if r.doc_id is None] == ["quite alone here"]
    assert J.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_on_repeated_and_null_ids(spark):
    # one id with two texts that have nothing in common, copies whose ids are all null, and empty texts that repeat
    one, two, copied, near = "a b c d e f", "u v w x y z", "k l m n o p q", "K l m  n o p q"
    rows = [(1, one), (1, two), (2, one), (None, copied), (None, copied), (None, near), (4, ""), (4, ""), (None, None), (None, None), (3, "g h i"), (3, "g h i")]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in J.one_of_each(df).collect()), key=str)
    kept_copy = [t for i, t in got if i is None and t]
    assert len(kept_copy) == 1 and kept_copy[0] in (copied, near)
    assert got == sorted([(1, one), (1, two), (None, kept_copy[0]), (4, ""), (4, ""), (None, None), (None, None), (3, "g h i")], key=str)
    # without repeated rows
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in [(1, one), (1, two), (2, two), (None, copied), (None, near)]], SCHEMA)
    assert sorted((r.doc_id or 0) for r in J.one_of_each(df).collect()) == [0, 1, 1]
