"""Vectors: reading, pivot range joins by cosine, and nearest neighbours through stable projections.

Vectors that are null, empty, zero, or hold null or non-finite components take no part in links
or searches; neither do those whose length isn't the most common one (the greater on ties). In links,
repeated rows and ids are compared like any others; in searches, repeated rows are one, and rows of one
id are one candidate. Extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.llm.components import components
from vetloom.session import discard, materialise

# --- common ---------------------------------------------------------------------------------


def usable(v: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that take part, and their length."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = common.n if common else 0
    return rows.where(F.size("vec") == n), n


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square overflows
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


# --- metric range join ----------------------------------------------------------------------

#: Rows a pivot; and most pivots, which bounds what is sent to every task.
ROWS_PER_PIVOT = 8000
PIVOTS = 1024
#: About the most vectors and bytes of a block; vectors of two blocks that meet at once.
BLOCK, BLOCK_BYTES, SLICE = 16_384, 4 << 20, 512
#: Bytes of blocks of either side that one task reads.
SPAN_BYTES = 64 << 20
#: Rounding of distances; cells take in a little more than they need.
SLACK = 1e-9
#: Cost of a pair that is taken again, in components multiplied.
AGAIN = 20_000


def sample_of(rows: DataFrame, n_rows: int) -> tuple[np.ndarray, int]:
    """A bounded sample of the vectors as unit vectors, and how many pivots the table has; the choice changes the cost, never the links."""
    k = max(1, min(PIVOTS, -(-n_rows // ROWS_PER_PIVOT)))
    found = rows.orderBy(F.xxhash64("id")).limit(max(512, 4 * k)).select("vec").toPandas()
    return units(matrix(found["vec"])), k


def pivots_of(m: np.ndarray, k: int) -> np.ndarray:
    """At most k of the unit vectors, no two alike."""
    kept = [0]
    for i in range(1, len(m)):
        if len(kept) == k:
            break
        if (m[kept] @ m[i]).max() < 0.95:
            kept.append(i)
    return m[kept]


def leading(m: np.ndarray, cosine: float) -> tuple[np.ndarray, int]:
    """A rotation, most of the unit vectors' length in front, and how many of its components rule most pairs out at least cost."""
    turn = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    some = m[:512] @ turn
    near = some @ some.T
    apart = near < cosine
    costs = {}
    step = max(2, m.shape[1] // 32)
    for k in [*range(step, m.shape[1], step), m.shape[1]]:
        most = some[:, :k] @ some[:, :k].T
        rest = np.sqrt((some[:, k:] ** 2).sum(axis=1))
        costs[k] = k + AGAIN * ((most + np.outer(rest, rest) >= cosine) & apart).sum() / max(1, apart.sum())
    return turn, min(costs, key=costs.get)


def reaches(m: np.ndarray, home: int, cell: int, pivots: np.ndarray, radius: float) -> np.ndarray:
    """Which unit vectors of a pivot's cell a link of another cell's members may reach from.

    x, nearest to p, may be within the radius of a member of q's cell only if the plane between p and
    q is: (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= radius, which on unit vectors is (x.p - x.q) / d(p,q).
    """
    if home == cell:
        return np.ones(len(m), bool)
    gap = math.sqrt(max(2 - 2 * float(pivots[home] @ pivots[cell]), 0))
    return m @ (pivots[home] - pivots[cell]) <= (radius + SLACK) * gap


def blocks_of(nodes: DataFrame, pivots: np.ndarray, radius: float, length: int) -> DataFrame:
    """Each vector once, in a block of its nearest pivot's cell; of each block, the cells it has guests in."""
    gaps = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    np.fill_diagonal(gaps, 1.0)
    kind = np.float32 if dict(nodes.dtypes)["vec"] == "array<float>" else np.float64
    most = max(1, min(BLOCK, BLOCK_BYTES // (length * np.dtype(kind).itemsize)))

    def homes(vectors: pd.Series) -> np.ndarray:
        return (units(matrix(vectors)) @ pivots.T).argmax(axis=1).astype(np.int32)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, rows = np.unique(homes(pdf["vec"]), return_counts=True)
                yield pd.DataFrame({"cell": cell, "rows": rows.astype(np.int64)})

    counts = nodes.select("vec").mapInPandas(counted, "cell int, rows long").groupBy("cell").agg(F.sum("rows").alias("rows"))
    pieces = {r.cell: -(-r.rows // most) for r in counts.collect()}  # a row a pivot

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell = homes(pdf["vec"])
                piece = pdf["part"].to_numpy() % np.array([pieces.get(c, 1) for c in cell.tolist()], np.int64)
                packed = [np.asarray(v, kind).tobytes() for v in pdf["vec"]]
                yield pd.DataFrame({"uid": pdf["uid"], "weight": pdf["weight"], "cell": cell, "piece": piece, "packed": packed})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, vecs = int(pdf["cell"].iat[0]), b"".join(pdf["packed"])
        reach = np.zeros(len(pivots), bool)
        m = units(np.frombuffer(vecs, kind).reshape(len(pdf), -1).astype(np.float64))
        for i in range(0, len(m), 1024):
            near = m[i : i + 1024] @ pivots.T
            reach |= ((near[:, cell][:, None] - near) / gaps[cell] <= radius + SLACK).any(axis=0)
        reach[cell] = True
        uids, weights = pdf["uid"].to_numpy(np.int64).tobytes(), pdf["weight"].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"cell": [cell], "piece": [int(pdf["piece"].iat[0])], "reach": [np.nonzero(reach)[0].astype(np.int32)], "uids": [uids], "weights": [weights], "vecs": [vecs]})

    rows = nodes.select("uid", "weight", F.abs(F.xxhash64("uid") % 1_000_003).alias("part"), "vec")
    rows = rows.mapInPandas(placed, "uid long, weight long, cell int, piece long, packed binary")
    # enough files for a small table's tasks; no task packs more than a few blocks of a large one
    files = max(16, -(-sum(pieces.values()) // 8))
    rows = rows.repartition(files, "cell", "piece")
    return rows.groupBy("cell", "piece").applyInPandas(pack, "cell int, piece long, reach array<int>, uids binary, weights binary, vecs binary")


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j in label, in which each node's link leads to a lesser one or, at a root, to itself."""

    def root(at: np.ndarray) -> np.ndarray:
        x = label[at]
        while len(x) and (up := label[x]).tobytes() != x.tobytes():
            x = up
        label[at] = x
        return x

    while len(i):
        x, y = root(i), root(j)
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def at_least(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a have at least the given cosine with the same row of b, unit vectors; close ones are summed exactly."""
    near = np.einsum("ij,ij->i", a, b)
    sure = near >= cosine
    for at in np.nonzero(np.abs(near - cosine) < 1e-13)[0]:
        sure[at] = math.fsum(a[at] * b[at]) >= cosine
    return sure


class Block:
    """A block's vectors: as unit vectors, and in single precision some leading components and the length of the others."""

    def __init__(self, cell: int, vecs: bytes, weights: bytes, length: int, kind: type, turn: np.ndarray, k: int):
        self.cell = cell
        self.unit = units(np.frombuffer(vecs, kind).reshape(-1, length).astype(np.float64))
        self.weight = np.frombuffer(weights, np.int64)
        turned = self.unit @ turn
        rest = np.sqrt((turned[:, k:] ** 2).sum(axis=1))
        self.short = np.column_stack([turned[:, :k], rest]).astype(np.float32)


def true_at(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of a mask in which little is true, by words of eight first."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    words = mask.reshape(-1, 8)
    some = np.flatnonzero(words.view(np.uint64) != 0)
    at = np.flatnonzero(words[some])
    return some[at // 8] * 8 + at % 8


def linked(a: Block, b: Block, rows_a: np.ndarray, rows_b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of the given ones that have at least the given cosine, a slice of each at a time.

    x.y is at most that of leading components plus the product of the others' lengths, which single precision
    finds for all pairs. What that leaves is taken again in double; where it is much, in single precision first.
    """
    slip = 1e-5 + 4e-7 * a.unit.shape[1]  # of single precision
    wide = 2 * SLICE
    slices = [(rows_b[t : t + wide], np.ascontiguousarray(b.short[rows_b[t : t + wide]].T)) for t in range(0, len(rows_b), wide)]
    for s in range(0, len(rows_a), SLICE):
        mine = rows_a[s : s + SLICE]
        short = a.short[mine]
        for theirs, other in slices:
            most = short @ other >= np.float32(cosine - slip)
            at = true_at(most.ravel())
            if not len(at):
                continue
            i, j = np.divmod(at, len(theirs))
            i, j = mine[i], theirs[j]
            known = np.zeros(len(i), bool)
            if len(at) * 32 > most.size:
                near = (a.unit[mine].astype(np.float32) @ b.unit[theirs].astype(np.float32).T).ravel()[at]
                known, may = near >= cosine + slip, near >= cosine - slip
                i, j, known = i[may], j[may], known[may]
            left = np.nonzero(~known)[0]
            for n in range(0, len(left), 5000):
                few = left[n : n + 5000]
                known[few] = at_least(a.unit[i[few]], b.unit[j[few]], cosine)
            if known.any():
                yield i[known], j[known]


def _join_blocks(pivots: np.ndarray, radius: float, cosine: float, length: int, kind: type, turn: np.ndarray, k: int):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links between pairs of blocks, of one task: each vector's number, and a forest of links that joins what they join."""
        start: dict[tuple, int] = {}
        ids, near, label = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        last: tuple = (None, None)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                keys = (r.cell, r.piece), (r.cell_b, r.piece_b)
                for key, uids in zip(keys, (r.uids, r.uids_b)):
                    if key not in start:
                        start[key] = len(label)
                        ids.append(np.frombuffer(uids, np.int64))
                        near = np.append(near, np.zeros(len(ids[-1]), np.int64))
                        label = np.append(label, np.arange(len(label), len(label) + len(ids[-1])))
                if last[0] != keys[0]:
                    last = keys[0], Block(r.cell, r.vecs, r.weights, length, kind, turn, k)
                a = last[1]
                b = a if keys[0] == keys[1] else Block(r.cell_b, r.vecs_b, r.weights_b, length, kind, turn, k)
                guests_a = np.nonzero(reaches(a.unit, a.cell, b.cell, pivots, radius))[0]
                guests_b = np.nonzero(reaches(b.unit, b.cell, a.cell, pivots, radius))[0]
                from_a, from_b = start[keys[0]], start[keys[1]]
                for i, j in linked(a, b, guests_a, guests_b, cosine):
                    np.add.at(near, from_a + i, b.weight[j])
                    if a is not b:
                        np.add.at(near, from_b + j, a.weight[i])
                    unite(label, from_a + i, from_b + j)
        if ids:
            own = np.concatenate(ids)
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
            met = np.nonzero(near)[0]
            for n in range(0, len(met), 50_000):
                at = met[n : n + 50_000]
                yield pd.DataFrame({"a": own[at], "b": own[label[at]], "near": near[at]})

    return join


def near_links(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component and kept of every row: links are pairs of the given cosine or more.

    Equal vectors are one node of their count, so copies are never compared with each other. Each node is
    written once, in a block of its cell. Pairs of blocks, of cells that have guests of each other, meet
    in a task that reads both; guests are picked there and never stored, so disk goes with the input
    however many cells a vector is a guest of. A cell of any size is dealt out.
    """
    rows, length = usable_rows(df, id_col, vec_col)
    if dict(df.dtypes)[vec_col] == "array<float>":
        rows = rows.withColumn("vec", F.col("vec").cast("array<float>"))  # as it was, in half the bytes
    rows = materialise(rows.withColumn("h", F.xxhash64("vec")).withColumn("g", F.xxhash64(F.lit(1), "vec")), "vectors")
    nodes = rows.groupBy("h", "g", "vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    nodes = materialise(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    # hashes stand for vectors from here on, if no two vectors share them
    key = ["h", "g"] if nodes.select("h", "g").distinct().count() == n else ["h", "g", "vec"]
    ids = materialise(rows.select("id", *key), "ids")
    discard(rows)
    of = materialise(nodes.select("uid", "id", *key), "node_ids")
    sample, k = sample_of(nodes, n) if n else (np.eye(1), 1)
    pivots, radius = pivots_of(sample, k), math.sqrt(max(0, 2 - 2 * cosine))
    turn, front = leading(sample, cosine)
    blocks = materialise(blocks_of(nodes, pivots, radius, max(1, length)), "blocks")
    kind = np.float32 if dict(nodes.dtypes)["vec"] == "array<float>" else np.float64
    discard(nodes)
    cores = df.sparkSession.sparkContext.defaultParallelism
    spans = max(math.ceil(2 * math.sqrt(cores)), -(-n * length * np.dtype(kind).itemsize // SPAN_BYTES))
    a = blocks.coalesce(spans)
    b = blocks.select(*[F.col(c).alias(f"{c}_b") for c in blocks.columns]).coalesce(spans)
    same = (F.col("cell") == F.col("cell_b")) & (F.col("piece") == F.col("piece_b"))
    before = (F.col("cell") < F.col("cell_b")) | ((F.col("cell") == F.col("cell_b")) & (F.col("piece") < F.col("piece_b")))
    even = (F.col("cell") + F.col("piece") + F.col("cell_b") + F.col("piece_b")) % 2 == 0
    once = same | (~same & (before == even))  # each pair in one of its orders, as many in either
    guests = F.array_contains("reach", F.col("cell_b")) & F.array_contains("reach_b", F.col("cell"))
    pairs = a.hint("shuffle_replicate_nl").join(b, once & guests).drop("reach", "reach_b")
    join = _join_blocks(pivots, radius, cosine, max(1, length), kind, turn, front)
    found = materialise(pairs.mapInPandas(join, "a long, b long, near long"), "links")
    discard(blocks)
    near = found.groupBy("a").agg((F.sum("near") - 1).alias("n_links"))  # but for the vector itself
    joined = components(found.select("a", "b"))
    of = of.join(joined, of["uid"] == joined["node"], "left").withColumn("component", F.coalesce("component", "uid"))
    least = of.groupBy("component").agg(F.min("id").alias("component_id"))
    of = of.join(least, "component").join(near, F.col("uid") == near["a"]).select(*key, "n_links", "component_id")
    known = ids.join(of, key).select("id", "n_links", "component_id")
    other = F.coalesce(F.size(vec_col), F.lit(-1)) != length
    rest = df.where(~usable(F.col(vec_col).cast("array<double>")) | F.col(id_col).isNull() | other)
    rest = rest.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    every = known.union(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return every.withColumnRenamed("id", id_col)


# --- nearest neighbours ---------------------------------------------------------------------

PROJECTED = 16
#: Chance that a nearer vector was met before its search ends, as the chi-square test has it.
CERTAINTY = 0.95
#: Points of a leaf; leaves opened and points verified at once.
LEAF, OPENED, VERIFIED = 64, 32, 512
#: Rows that cells are made from, and most cells; rows of a block, and queries that meet it at once.
SAMPLE, CELLS = 16_384, 1024
INDEX_BLOCK, QUERY_CHUNK = 2048, 1024


def chi_square(x: float, m: int) -> float:
    """The distribution function of chi-square with an even number m of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def quantile(p: float, m: int) -> float:
    """Where chi_square() reaches p."""
    low, high = 0.0, 100.0 * m
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if chi_square(x, m) < p else (low, x)
    return high


@functools.cache
def gauss(length: int, m: int = PROJECTED, seed: int = 7) -> np.ndarray:
    """Gaussian, hence 2-stable, projections: of unit vectors at distance d, a squared projected distance is d^2 times a chi-square variable."""
    return np.random.default_rng(seed).standard_normal((length, m))


def cosine_of(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine by sums without rounding, the same wherever and in whatever order it is taken."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()  # so that no square overflows
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


class Regions:
    """A kd-tree's cells of all projected space, so that any point has one; made from a sample."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple] = []  # axis, threshold, below, above; or the number of a cell
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        m = points.shape[1]
        self._build(points, cells, np.full(m, -np.inf), np.full(m, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        k = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        axis = int(spread.argmax())
        if cells < 2 or len(points) < 4 or spread[axis] == 0:
            self.nodes[k] = (len(self.low),)
            self.low.append(low)
            self.high.append(high)
            return k
        at = float(np.median(points[:, axis]))
        below = points[:, axis] < at
        if not below.any():
            at = float(points[points[:, axis] > at, axis].min())
            below = points[:, axis] < at
        to, start = high.copy(), low.copy()
        to[axis] = start[axis] = at
        self.nodes[k] = (axis, at, self._build(points[below], cells // 2, low, to), self._build(points[~below], cells - cells // 2, start, high))
        return k

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int32)
        stack = [(0, np.arange(len(points)))]
        while stack:
            k, own = stack.pop()
            node = self.nodes[k]
            if len(node) == 1:
                out[own] = node[0]
            else:
                below = points[own, node[0]] < node[1]
                stack += [(node[2], own[below]), (node[3], own[~below])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """The squared distance from the point to each cell."""
        d = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (d * d).sum(axis=1)


class ProjectedTree:
    """A kd-tree over the projections of vectors, which is a list of the boxes of its leaves."""

    def __init__(self, vectors: np.ndarray, ids: list, m: int = PROJECTED):
        self.raw, self.ids = vectors, ids
        self.unit = units(vectors)
        self.points = self.unit @ gauss(vectors.shape[1], m)
        self.verified = 0
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(vectors))]
        while stack:
            at = stack.pop()
            spread = np.ptp(self.points[at], axis=0)
            axis = int(spread.argmax())
            if len(at) <= LEAF or spread[axis] == 0:
                self.leaves.append(at)
            else:
                order = at[np.argsort(self.points[at, axis], kind="stable")]
                stack += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([self.points[at].min(axis=0) for at in self.leaves])
        self.high = np.array([self.points[at].max(axis=0) for at in self.leaves])

    def search(self, vector: np.ndarray, k: int, limit: float, worst: float = np.inf) -> list[tuple[float, int]]:
        """(cosine, id) of the k nearest ids found, nearest first, ties to the smaller id; worst: a squared distance within which k are known.

        Vectors are verified in the order of projected distance, from leaves in the order of their boxes. Once
        the next one's squared distance is limit, a quantile of chi-square, times the k-th best's, the test holds
        that all nearer ones were met with the quantile's chance.
        """
        unit = units(vector[None])[0]
        q = unit @ gauss(len(vector), self.points.shape[1])
        d = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        gap = np.einsum("ij,ij->i", d, d)
        order = np.argsort(gap, kind="stable")
        gap = np.append(gap[order], np.inf)
        best: list[tuple[float, int]] = []
        least = 1 - worst / 2 - SLACK  # of the cosine
        met, ready, away = 0, np.zeros(0, np.int64), np.zeros(0)
        while True:
            reach = limit * min(worst, 2 - 2 * least + SLACK)
            if met < len(order) and gap[met] <= reach:
                at = np.concatenate([self.leaves[i] for i in order[met : met + OPENED]])
                met = min(met + OPENED, len(order))
                step = self.points[at] - q
                ready, away = np.append(ready, at), np.append(away, np.einsum("ij,ij->i", step, step))
                by = np.argsort(away, kind="stable")
                ready, away = ready[by], away[by]
            # what lies before the next leaf, as far as the test lets it
            n = min(VERIFIED, int(np.searchsorted(away, min(gap[met], reach), side="right")))
            if not n:
                if met < len(order) and gap[met] <= reach:
                    continue
                break
            at, ready, away = ready[:n], ready[n:], away[n:]
            self.verified += n
            near = self.unit[at] @ unit
            # of the first ones, the best are enough, even if some ids have several vectors
            floor = float(np.partition(near, n - 4 * k)[n - 4 * k]) if not best and n > 4 * k else least
            sure = near >= max(least, floor) - SLACK
            if not sure.any():
                continue
            best += [(-score, own) for i in at[sure] for score in [cosine_of(self.raw[i], vector)] for own in self.ids[i]]
            best.sort()
            seen: set[int] = set()
            best = [x for x in best if not (x[1] in seen or seen.add(x[1]))][:k]
            if len(best) == k:
                least = max(least, -best[-1][0])
        return [(-s, i) for s, i in best]


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", certainty: float = CERTAINTY) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest by cosine among all rows of other ids.

    Rows of one id are one candidate, at its nearest vector; a query id of several vectors has what is
    nearest to any. Equal vectors are indexed once, with their k + 1 least ids, as no other can be among the
    nearest. The index is dealt to the cells of one kd-tree, large cells in blocks. A query is searched in
    its own cell first; then in the cells that the chi-square test doesn't rule out at its k-th best distance.
    """
    rows, length = usable_rows(df, id_col, vec_col)
    rows = materialise(rows.withColumn("h", F.xxhash64("vec")).withColumn("asks", F.coalesce(is_query, F.lit(False))).distinct(), "vectors")
    place = F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))
    few = rows.select("h", "vec", "id").withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = few.groupBy("h", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asks = rows.where("asks").groupBy("h", "vec").agg(F.lit(True).alias("asked"))
    nodes = nodes.join(asks, ["h", "vec"], "left").select(F.monotonically_increasing_id().alias("uid"), "h", "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    nodes = materialise(nodes, "nodes")
    n = nodes.count()
    first = nodes.orderBy(F.xxhash64("uid")).limit(SAMPLE).select("vec").toPandas() if n else pd.DataFrame({"vec": []})
    space = gauss(length)
    regions = Regions(units(matrix(first["vec"])) @ space if n else np.zeros((0, PROJECTED)), max(1, min(CELLS, -(-n // INDEX_BLOCK))))
    limit = quantile(certainty, PROJECTED)

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=regions.cell(units(matrix(pdf["vec"])) @ space))

    placed = materialise(nodes.mapInPandas(celled, "uid long, h long, vec array<double>, ids array<long>, asked boolean, cell int"), "cells")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / INDEX_BLOCK).alias("blocks"))  # a row a cell
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    index = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf["worst"].notna().to_numpy()
        out = []
        if is_q.any() and not is_q.all():
            vectors = matrix(pdf["vec"])
            own = np.nonzero(~is_q)[0]
            own = own[np.argsort(pdf["uid"].to_numpy()[own], kind="stable")]
            tree = ProjectedTree(vectors[own], [list(x) for x in pdf["ids"].iloc[own]])
            for i in np.nonzero(is_q)[0]:
                uid, worst = int(pdf["uid"].iat[i]), float(pdf["worst"].iat[i])
                out += [(uid, j, s) for s, j in tree.search(vectors[i], k + 1, limit, worst)]
        return pd.DataFrame(out, columns=["uid", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        """asked(uid, vec, cell, worst) against the blocks of their cells."""
        asked = asked.join(F.broadcast(blocks), "cell").withColumn("block", upto("blocks"))
        counts = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("chunks"))
        asked = asked.join(counts, ["cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64("uid"), "chunks"))
        rows = index.join(counts, ["cell", "block"]).withColumn("chunk", upto("chunks"))
        names = ["cell", "block", "chunk", "uid", "vec"]
        both = rows.select(*names, "ids", F.lit(None).cast("double").alias("worst")).union(asked.select(*names, F.lit(None).cast("array<long>").alias("ids"), "worst"))
        return both.groupBy("cell", "block", "chunk").applyInPandas(search, "uid long, vec_id long, score double")

    asked = placed.where("asked")
    home = materialise(searched(asked.select("uid", "vec", "cell", F.lit(float("inf")).alias("worst"))), "home")
    best = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id"))
    kth = home.withColumn("place", best).where(F.col("place") == k + 1).select("uid", (2 - 2 * F.col("score") + SLACK).alias("worst"))
    left = asked.join(kth, "uid", "left").select("uid", "vec", "cell", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uid, vec, own, worst in zip(pdf["uid"], pdf["vec"], pdf["cell"], pdf["worst"]):
                far = regions.gaps(units(np.asarray(vec, float)[None])[0] @ space) > limit * worst
                cells = np.nonzero(~far)[0]
                cells = cells[cells != own]
                if len(cells):
                    yield pd.DataFrame({"uid": uid, "vec": [vec] * len(cells), "cell": cells.astype(np.int32), "worst": worst})

    found = home.union(searched(left.mapInPandas(others, "uid long, vec array<double>, cell int, worst double")))
    # k + 1 ids of each vector that is asked for; then each id that asks leaves itself out
    found = found.groupBy("uid", "vec_id").agg(F.max("score").alias("score")).withColumn("place", best).where(F.col("place") <= k + 1)
    ids = rows.where("asks").select(F.col("id").alias("query_id"), "h", "vec").join(nodes.where("asked"), ["h", "vec"]).select("query_id", "uid")
    answers = found.join(ids, "uid").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
