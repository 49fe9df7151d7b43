import hashlib
import itertools
import math
import random
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa

from vetloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, taken int"


def rounds(sizes):
    """Targets by sharing in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def make(spark, seed, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 50])
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None])
        text = None if rng.random() < 0.05 else rng.choice([" ", "\n\t", "\x0b"]).join("w\xa0x" for _ in range(size)) + "  "
        rows.append((i if i else None, text, source, 1, 1))
    rows += rows[:5]
    return rows, spark.createDataFrame(rows, SCHEMA)


def words(text):
    return (text or "").count("\xa0")


def in_order(rows):
    """What each row's sizes and takings must be, by a plain queue over all servings."""
    total = sum(words(r[1]) for r in rows)
    size = {}
    for _, text, source, *_ in rows:
        size[source] = size.get(source, 0) + words(text)
    want = rounds(size)
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = lambda r: digest("" if r[0] is None else str(r[0]))
    order = lambda r: (key(r)[:2], digest(str(words(r[1])))[:2], key(r), -1 if r[0] is None else r[0], words(r[1]))
    parts = []
    for source, goal in want.items():
        own, at, whole = sorted((r for r in rows if r[2] == source), key=order), 0, math.floor(goal + 1e-9)
        for turn in range(3):
            for i, r in enumerate(own):
                n = words(r[1])
                first = max(0, min(n, whole - at))
                name = (source is None, source or "")
                if first:
                    parts.append(((at + first) / goal, name, at, first, (source, i), r))
                if at <= whole < at + n:
                    parts.append(((at + n) / goal, name, at, n - first, (source, i), r))
                at += n
    got, left = Counter(), total
    for *_, n, k, r in sorted(parts, key=lambda p: p[:3]):
        got[k, r[0], words(r[1]), r[2]] += min(n, left)
        left -= min(n, left)
    assert left == 0
    return Counter((i, n, s, t) for (_, i, n, s), t in got.items() if t), want, size


def test_plan_as_a_plain_queue(spark):
    for seed in range(3):
        rows, docs = make(spark, seed)
        taken, want, size = in_order(rows)
        got = mixing.plan(mixing.sized(docs)).collect()
        assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r[0], words(r[1]), r[2]) for r in rows)
        assert Counter((r.doc_id, r.size, r.source, r.taken) for r in got if r.taken) == taken
        near = {}
        for r in got:
            assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size
            near[r.source] = near.get(r.source, 0) + r.taken
        assert sum(near.values()) == sum(size.values())
        for s, t in want.items():
            assert t - 1 - 1e-6 <= near[s] <= t + len(want)


def test_sql(spark):
    rng = random.Random(4)
    rows = [(i // 2 if i else None, " ".join("w" * rng.choice([0, 1, 5, 90])), rng.choice(["a", "b", "b", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(frame))
    want = con.execute(mixing.plan_sql()).fetchall()
    got = mixing.plan(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", "taken").collect()
    plain = lambda rows: sorted(repr([*r[:3], round(r[3], 6), r[4]]) for r in map(tuple, rows))
    assert plain(got) == plain(want)


def test_schedule_and_rows(spark):
    rows, docs = make(spark, 9)
    served = mixing.schedule(docs).collect()
    assert [r.finish for r in served] == sorted(r.finish for r in served)
    assert sum(r.taken for r in served) == sum(words(r[1]) for r in rows)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = Counter()
    for (uid, turn), own in itertools.groupby(sorted(served, key=lambda r: (r.uid, r.turn)), key=lambda r: (r.uid, r.turn)):
        own = list(own)
        if 2 * sum(r.taken for r in own) >= own[0].size:
            times[own[0].doc_id, own[0].size] += 1
    assert Counter((r.doc_id, words(r.text)) for r in mixed.collect()) == times


def test_clashing_names_stay(spark):
    names = ["size", "source_size", "target", "taken", "turn", "bucket", "ahead", "shuffle_key", "uid", "row", "words", "range", "again", "times", "finish"]
    docs = spark.createDataFrame([(i, "a b c " * (i % 4), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(20)], ["doc_id", "text", "source", *names])
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    own = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in got.collect()} <= own
    assert mixing.plan(mixing.sized(docs)).count() == 20


def test_no_task_has_a_source(spark):
    # windows over documents and servings are by ranges, never by a source alone
    _, docs = make(spark, 1)
    text = mixing.servings(mixing.sized(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.taken) for r in mixing.plan(mixing.sized(docs)).collect()}
    assert got == {1: (300_000, 299_998), 2: (1, 3)}


def test_empty_and_zero(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.plan(mixing.sized(docs)).count() == 0 and mixing.mixed(docs).count() == 0
    docs = spark.createDataFrame([(1, None, "a", 1, 1), (2, "", None, 1, 1)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mixing.plan(mixing.sized(docs)).collect()] == [(0, 0, 0.0)] * 2
    assert mixing.mixed(docs).count() == 0
