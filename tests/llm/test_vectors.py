import numpy as np
import pytest

from vetloom.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, component_id int, id int"


def table(spark, n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    m = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dims)) * rng.choice([0.02, 0.2, 0.4], n)[:, None]
    m = m.astype(np.float32)
    m[50:60] = m[0]
    rows = [(i, [float(x) for x in v], 1, 1) for i, v in enumerate(m)]
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [None] * dims, [float("inf")] + [1.0] * (dims - 1), [1.0, 2.0]]
    return m.astype(np.float64), spark.createDataFrame(rows + [(n + i, v, 1, 1) for i, v in enumerate(odd)], SCHEMA)


def cosines(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("per_pivot", [2000, 25])
def test_links(spark, monkeypatch, per_pivot):
    monkeypatch.setattr(V, "ROWS_PER_PIVOT", per_pivot)
    monkeypatch.setattr(V, "SLICE", 30)
    monkeypatch.setattr(V, "BLOCK", 70)
    m, df = table(spark)
    hit = cosines(m) >= 0.9
    label = np.arange(len(m))
    for _ in range(len(m)):
        after = np.array([label[h].min() for h in hit])
        if (after == label).all():
            break
        label = after
    got = {r.vec_id: r for r in V.near_links(df).collect()}
    assert len(got) == len(m) + 7
    for i in range(len(m)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum() - 1, label[i], label[i] == i), i
    for i in range(len(m), len(m) + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert V.near_links(df.limit(0)).count() == 0


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(V, "INDEX_BLOCK", 100)
    m, df = table(spark, 1000, 32, 5)
    c = cosines(m)
    np.fill_diagonal(c, -2)
    got = V.nearest(df, V.F.col("id") % 50 == 0, 5).collect()
    met = 0
    for q in range(0, 1000, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        assert all(abs(c[q, j] - s) < 1e-12 for _, j, s in own)
        order = [(-s, j) for _, j, s in own]
        assert order == sorted(order)
        met += len({j for _, j, _ in own} & set(np.argsort(-c[q], kind="stable")[:5].tolist()))
    assert met >= 0.9 * 5 * 20
    assert V.nearest(df.limit(0), V.F.col("id") % 50 == 0).count() == 0
    few = V.nearest(df.where("vec_id < 3"), V.F.col("id") == 0).collect()
    assert len(few) == 2


def test_nearest_of_repeats_and_ties(spark):
    # copies, the same row many times, multiples of two, one id with two vectors, and a query whose copies crowd its list
    rng = np.random.default_rng(3)
    m = rng.standard_normal((40, 8))
    m[10:18], m[20], m[21] = m[0], 2 * m[1], 0.5 * m[1]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1, m[1].tolist())] * 8 + [(5, m[6].tolist()), (100, m[0].tolist()), (101, [0.0] * 8), (None, m[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (2048, 6):
        V.INDEX_BLOCK, kept = block, V.INDEX_BLOCK
        got = V.nearest(df, V.F.col("id") % 4 == 0, 5, certainty=0.999999).collect()
        V.INDEX_BLOCK = kept
        vectors = {}
        for i, v in rows:
            if i is not None and any(v):
                vectors.setdefault(i, set()).add(tuple(v))
        score = lambda x, y: max(V.cosine_of(np.array(a), np.array(b)) for a in vectors[x] for b in vectors[y])
        for q in (i for i in vectors if i % 4 == 0):
            want = sorted((-score(q, j), j) for j in vectors if j != q)[:5]
            own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [(k + 1, j, -s) for k, (s, j) in enumerate(want)] == own, (q, block)


def test_search_stops_early():
    # near ones first: most of the tree is never verified
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    m = np.repeat(centres, 50, axis=0) + 0.05 * rng.standard_normal((2000, 64))
    tree = V.ProjectedTree(m, [[i] for i in range(2000)])
    best = tree.search(m[0], 6, V.quantile(V.CERTAINTY, V.PROJECTED))
    assert tree.verified <= 600 and best[0][1] == 0 and {i for _, i in best} <= set(range(50))


def test_links_of_repeats(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in V.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_links_store_no_guests(spark, monkeypatch):
    # vectors in all directions are guests of nearly all of the 40 cells; what is stored goes with the vectors, not with the cells
    monkeypatch.setattr(V, "ROWS_PER_PIVOT", 50)
    stored, made = [], V.materialise

    def materialise(df, name):
        stored.append(made(df, name))
        stored[-1].n = stored[-1].count()
        return stored[-1]

    monkeypatch.setattr(V, "materialise", materialise)
    rng = np.random.default_rng(4)
    m = rng.standard_normal((2000, 32))
    m[1:200:2] = m[:200:2] + 0.3 * rng.standard_normal((100, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_links(df).collect()}
    hit = cosines(m) >= 0.9
    assert hit.sum() > 2100 and got == {i: (hit[i].sum() - 1, np.nonzero(hit[i])[0][0]) for i in range(2000)}
    assert sum(x.n for x in stored) <= 8 * len(m)


def test_links_of_a_dense_group(spark, monkeypatch):
    # one group in which nearly all are linked, over several blocks, some cosines at the edge
    monkeypatch.setattr(V, "BLOCK", 100)
    rng = np.random.default_rng(5)
    m = rng.standard_normal(24) + 0.33 * rng.standard_normal((600, 24))
    m[300:310] = -m[:10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    hit = cosines(m) >= 0.9
    label = np.arange(600)
    while True:
        after = np.array([label[h].min() for h in hit])
        if (after == label).all():
            break
        label = after
    assert 0.3 < hit.mean() < 0.97
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_links(df).collect()}
    assert got == {i: (hit[i].sum() - 1, label[i]) for i in range(600)}


def test_chi_square():
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((100_000, 8)) ** 2).sum(axis=1)
    assert abs((x <= 10).mean() - V.chi_square(10, 8)) < 0.01
    assert abs(V.chi_square(V.quantile(0.9, 16), 16) - 0.9) < 1e-9
