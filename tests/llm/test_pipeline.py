"""The pipeline's stages over the small tables, against plain statements of what each must do."""

import re
from collections import Counter

import pytest

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from vetloom.session import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_columns_and_kept_rows(stages):
    docs, clean, alone, mixed, pieces = stages
    for df in (clean, alone, mixed):
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages[:4]]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] and len(ids[1]) > 0.7 * len(ids[0])


def test_no_near_copies_left_and_each_group_has_one(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[1:3])
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() if (w := words(t))}
    order = sorted(sets)
    label = {i: i for i in order}
    for x, i in enumerate(order):
        for j in order[:x]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    assert {i for i in after if i in sets} == set(label.values())


def test_mix_and_pieces(stages):
    rows = Counter(r.doc_id for r in stages[3].select("doc_id").collect())
    assert max(rows.values()) <= 3
    pieces = stages[4].collect()
    assert {r.doc_id for r in pieces} == set(rows)
    total = sum(r.length for r in pieces)
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert sum(n if n & (n - 1) == 0 else 4096 for n in filled.values()) <= 1.05 * total
