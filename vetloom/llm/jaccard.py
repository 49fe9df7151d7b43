"""Jaccard join of word n-gram sets by prefix trees.

Shingles are hashed to 64 bits and put in one global order, rare ones first: the order's classes
come from a table of COUNTERS shingle counts over all documents, a fixed size whatever the
corpus, and ties from the hash. Any fixed order gives the same links; this one keeps frequent
shingles out of the prefixes. Sets of similarity t or more share one of their first
n - ceil(t n) + 1 shingles, so sets meet in groups by a shared one of these.

In a group the sets are stored in a trie with one edge for each run without branches, so that
overlaps with a shared beginning are found once. A probe goes down from the root with the overlap
so far and leaves a subtree when even the best remaining length could not reach t.

Groups that could hold a link are found on small rows before any set is moved: a group is split by
size, as similar sets differ in size by t at most; shingles that the same sets share count as one;
and two sets whose shingles fall into BINS bins cannot share more than the bins' lesser counts.

Copies (equal sets) are one node. Links are needed only between nodes that are not yet connected,
which keeps groups of near copies linear. First each set meets the group of its most shared
shingle, in pieces, each piece with itself and the first one. Then only shingles whose sets
lie in different components are left, and their pieces meet wherever they hold different ones.
A piece has at most PIECE sets, so a task never holds a group of unbounded size, and no link
between components is lost.

Defined results: null and empty texts, and texts without words, have an empty set and are linked
with nothing; a text with fewer words than a shingle has one shingle of all; equal doc_ids with
different texts are different rows; repeated rows are copies; a null doc_id has the component of
its copies and is never its least; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.llm.components import components
from vetloom.llm.encoding import batches_of
from vetloom.session import materialise

COUNTERS = 1 << 22
PIECE = 120
BINS, FULL = 256, 255
_STRETCH = 1 << 14

# --- shingles -------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_WHITE] = 0
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, A-Z lower-cased, and the number of words before each text and after the last."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = _WHITE[raw]
    starts = np.nonzero(~white & np.concatenate([[True], white[:-1]]))[0]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    power = np.full(len(raw), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(len(raw), _BACK, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    # a polynomial over a word's bytes, taken back to its start; white space counts 0
    sums = np.add.reduceat(_BYTE[raw] * power, starts)
    return mix(sums * back[starts]), counts


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    hashes, at = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    place = _PLACE[np.arange(width) % 64]
    runs = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        runs += hashes[k : len(hashes) - width + 1 + k] * place[k]
    runs = mix(runs)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mix((hashes[a:b] * place[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def identity(s: np.ndarray) -> int:
    """A set's 64 bits, from all of its shingles and their number."""
    x = mix((mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s) * _BASE % (1 << 64)))
    return int(x.view(np.int64)[0])


def bins(s: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each bin, FULL for that many and more."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), FULL).astype("u1").tobytes()


def ordered(s: np.ndarray, classes: np.ndarray, first: int | None = None) -> np.ndarray:
    """The set, or its first shingles, in the global order: the class of how frequent a shingle is in the high bits, then its hash."""
    high = classes[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
    keys = high | (s >> np.uint64(6))
    return np.sort(keys if first is None or first >= len(keys) else np.partition(keys, first - 1)[:first])


# --- the trie -------------------------------------------------------------------------------


class Node:
    __slots__ = ("run", "below", "least", "most", "ends")

    def __init__(self, run, least, most):
        self.run, self.least, self.most = run, least, most
        self.below: dict[int, Node] = {}
        self.ends: list[int] = []


class Trie:
    """Ordered sets that share beginnings. similar() gives those of Jaccard similarity num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.root = Node(np.zeros(0, np.uint64), 1 << 62, 0)

    def add(self, s: np.ndarray, key: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.ends.append(key)
                return
            child = node.below.get(int(s[at]))
            if child is None:
                child = node.below[int(s[at])] = Node(s[at:], n, n)
                child.ends.append(key)
                return
            k = min(len(child.run), n - at)
            differ = np.nonzero(child.run[:k] != s[at : at + k])[0]
            k = int(differ[0]) if len(differ) else k
            if k < len(child.run):
                upper = Node(child.run[:k], child.least, child.most)
                child.run = child.run[k:]
                upper.below[int(child.run[0])] = child
                node.below[int(s[at])] = child = upper
            node, at = child, at + k

    def similar(self, s: np.ndarray) -> Iterator[int]:
        num, den, n = self.num, self.den, len(s)
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, depth, shared, at = stack.pop()
            run = node.run
            if len(run):
                place = np.searchsorted(s[at:], run) + at
                shared += int(np.count_nonzero(s[np.minimum(place, n - 1)] == run))
                depth += len(run)
                at = int(place[-1]) + (int(place[-1]) < n and s[place[-1]] == run[-1])
            # of the lengths below, the one whose rest is as long as the probe's would be the best
            length = min(max(depth + n - at, node.least), node.most)
            best = shared + min(n - at, length - depth)
            if den * best < num * (n + length - best):
                continue
            if node.ends and den * shared >= num * (n + depth - shared):
                yield from node.ends
            stack += [(c, depth, shared, at) for c in node.below.values()]


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def group_links(num: int, den: int):
    """Of groups in the order of their keys (token, p, q), a forest of links: among side 0, or between sides 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != key:
                    out += forest_of(held)
                    key, held = row[:3], []
                held.append(row[3:])
            yield table(out)
        yield table(forest_of(held))

    def forest_of(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = sorted({r[:1] + r[2:3]: r for r in rows}.values(), key=lambda r: (r[0], r[2]))
        if len(rows) < 2:
            return []
        inside, forest, first, out = rows[0][1], Forest(len(rows)), {}, []
        for i, r in enumerate(rows):
            forest.join(i, first.setdefault(r[3], i))
        trie = Trie(num, den)
        for i, (side, _, node, _, data) in enumerate(rows):
            s = np.frombuffer(data, np.uint64)
            if inside or side == 1:
                out += [(node, rows[j][2]) for j in trie.similar(s) if forest.join(i, j)]
            if side == 0:
                trie.add(s, i)
        return out

    def table(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


# --- the join -------------------------------------------------------------------------------


def _scan(docs: DataFrame, schema: str, run) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def survey(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """Each row's doc_id, h (hash of the text), n, node and bins, materialised; and the class of every counter."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        kinds = None
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            texts, n, node, binned = b.column(2).to_pylist(), [], [], []
            for i, j in batches_of(texts, 1 << 21):
                for s in shingle_sets(texts[i:j], width):
                    n.append(len(s))
                    node.append(identity(s))
                    binned.append(bins(s))
                    np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            columns = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(len(n), pa.int32()), pa.array(binned, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=names)
        if kinds:
            parts = [zlib.compress(counts[k : k + _STRETCH].astype("<u4").tobytes(), 1) for k in range(0, COUNTERS, _STRETCH)]
            m = len(parts)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in kinds[:4]), pa.array(range(m), pa.int32()), pa.array(parts, pa.binary())], names=names)

    names = ["doc_id", "h", "n", "node", "stretch", "data"]
    found = materialise(_scan(docs, f"doc_id {kind}, h long, n long, node long, stretch int, data binary", run), "survey")

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(_STRETCH, np.int64)
        for c in table.column("data").to_pylist():
            total += np.frombuffer(zlib.decompress(c), "<u4")
        return pa.table({"stretch": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    sums = found.where("stretch IS NOT NULL").groupBy("stretch").applyInArrow(add, "stretch int, counts binary")
    total = np.zeros(COUNTERS, np.float32)
    for row in sums.collect():  # COUNTERS numbers, whatever the corpus
        total[row.stretch * _STRETCH : (row.stretch + 1) * _STRETCH] = np.frombuffer(row.counts, "<i8")
    classes = np.clip(np.floor(np.log2((total + 1) / (total.mean() + 1))) + 1, 0, 63).astype(np.uint8)
    return found.where("stretch IS NULL").select("doc_id", "h", "n", "node", F.col("data").alias("bins")), classes


def prefixes(docs: DataFrame, width: int, num: int, den: int, classes) -> DataFrame:
    """token, node, n: the shingles by which each set meets others; copies in one task are told once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for b in batches:
            texts = b.column(2).to_pylist()
            tokens, nodes, sizes, times = [], [], [], []
            for i, j in batches_of(texts, 1 << 21):
                for s in shingle_sets(texts[i:j], width):
                    n = len(s)
                    if n * (den - num) < num or (node := identity(s)) in told:
                        continue  # too small for any other set to be similar
                    told.add(node)
                    tokens.append(ordered(s, classes.value, n - -(-num * n // den) + 1))
                    nodes.append(node)
                    sizes.append(n)
                    times.append(len(tokens[-1]))
            token = np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)
            columns = [np.repeat(np.array(x, np.int64), np.array(times, np.int64)) for x in (nodes, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(token), *map(pa.array, columns)], names=["token", "node", "n"])

    return _scan(docs, "token long, node long, n long", run)


def may_link(num: int, den: int):
    """Of groups in the order of their token, the members that by their bins could be similar to another of their group.

    Rows are compared with those k places on, for k from 1 to the largest group's size, all groups at once.
    """

    def kept(token: np.ndarray, node: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        keep = (m == FULL).any(axis=1)
        n = m.sum(axis=1, dtype=np.int64)
        at, k = np.arange(len(token)), 0
        while True:
            k += 1
            at = at[at + k < len(token)]
            at = at[token[at] == token[at + k]]
            if not len(at):
                break
            for i in range(0, len(at), 1 << 16):
                x = at[i : i + (1 << 16)]
                most = np.minimum(m[x], m[x + k]).sum(axis=1, dtype=np.int64)
                near = x[den * most >= num * (n[x] + n[x + k] - most)]
                keep[near] = keep[near + k] = True
        return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep])], names=["token", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            token, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            m = np.frombuffer(b"".join(b.column(2).to_pylist()), "u1").reshape(-1, BINS)
            if rest is not None:
                token, node, m = (np.concatenate(x) for x in zip(rest, (token, node, m)))
            last = int(np.searchsorted(token, token[-1]))  # the last group may go on; it has at most PIECE members
            yield kept(token[:last], node[:last], m[:last])
            rest = token[last:], node[last:], m[last:]
        if rest is not None:
            yield kept(*rest)

    return run


def groups_of(docs: DataFrame, rows: DataFrame, width: int, num: int, den: int, classes) -> tuple[DataFrame, DataFrame]:
    """(token, node, members) of every group that may hold links, and (node, bins, doc_id, h) of every node."""
    told = materialise(prefixes(docs, width, num, den, classes), "told")
    shared = told.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    # a step is a little more than t, so that similar sets lie in the same step or in neighbouring ones
    step = F.floor(F.log(F.col("n")) / (np.log(den / num) * (1 + 1e-9)))
    met = told.join(shared, "token").distinct().withColumn("step", F.explode(F.array(step, step + 1)))
    met = materialise(met.select(F.xxhash64("token", "step").alias("token"), "node"), "met")
    lists = met.groupBy("token").agg(F.count("*").alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"))
    lists = lists.where("lo < hi").groupBy("members", "lo", "hi", "x").agg(F.min("token").alias("token")).select("token", "members")
    at = met.join(lists, "token")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("k"), F.first("bins").alias("bins"))
    nodes = materialise(nodes.select("node", "bins", "k.doc_id", "k.h"), "nodes")
    at = materialise(at, "at")
    few = at.where(f"members <= {PIECE}").join(nodes.select("node", "bins"), "node")
    few = few.select("token", "node", "bins").repartition("token").sortWithinPartitions("token").mapInArrow(may_link(num, den), "token long, node long")
    at = materialise(few.union(at.where(f"members > {PIECE}").select("token", "node")), "kept")
    sizes = at.groupBy("token").agg(F.count("*").alias("members"))
    return materialise(at.join(sizes, "token"), "groups"), nodes


def set_rows(docs: DataFrame, width: int, classes) -> DataFrame:
    """node and the set in the global order, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in batches_of(texts, 1 << 21):
                sets = list(shingle_sets(texts[i:j], width))
                columns = [pa.array([identity(s) for s in sets], pa.int64()), pa.array([ordered(s, classes.value).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "ordered"])

    return _scan(docs, "node long, ordered binary", run)


def _pieces(name: str) -> F.Column:
    return F.ceil(F.col(name) / PIECE).cast("long")


def _linked(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links in groups(token, p, q, side, inside, node, label), each joined with its sets."""
    full = groups.join(sets, "node").select("token", "p", "q", "side", "inside", "node", "label", "ordered")
    return full.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q").mapInArrow(group_links(num, den), "a long, b long")


def set_components(docs: DataFrame, rows: DataFrame, width: int, num: int, den: int, classes_array: np.ndarray) -> DataFrame:
    """(node, component) of the nodes that are linked with others."""
    classes = docs.sparkSession.sparkContext.broadcast(classes_array)
    at, nodes = groups_of(docs, rows, width, num, den, classes)
    carriers = nodes.join(at.select("node").distinct(), "node").select(F.col("doc_id").alias("d"), F.col("h").alias("h_"))
    own = docs.join(carriers, docs["doc_id"].eqNullSafe(carriers["d"]) & (F.xxhash64(docs["text"]) == carriers["h_"]), "left_semi")
    sets = materialise(set_rows(own, width, classes), "sets")

    # first, the group of each set's most shared token, each piece with itself and with the first
    votes = at.groupBy("node").agg(F.max(F.struct("members", "token")).alias("v")).select(F.col("v.token").alias("token")).distinct()
    first = at.join(votes, "token").withColumn("pieces", _pieces("members")).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
    inner = first.select("token", F.col("piece").alias("p"), F.col("piece").alias("q"), F.lit(0).alias("side"), F.lit(True).alias("inside"), "node", F.col("node").alias("label"))
    many = first.where("pieces > 1")
    base = many.where("piece = 0").withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces") - 1)))
    base = base.select("token", F.lit(0).cast("long").alias("p"), "q", F.lit(0).alias("side"), F.lit(False).alias("inside"), "node", F.col("node").alias("label"))
    rest = many.where("piece > 0").select("token", F.lit(0).cast("long").alias("p"), F.col("piece").alias("q"), F.lit(1).alias("side"), F.lit(False).alias("inside"), "node", F.col("node").alias("label"))
    links = materialise(_linked(inner.union(base).union(rest), sets, num, den), "links")
    labels = components(links)

    # then, tokens whose sets lie in different components; those that met in one piece are done
    done = votes.withColumn("voted", F.lit(True))
    left = at.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    left = left.join(done, "token", "left").where(f"voted IS NULL OR members > {PIECE}").drop("voted")
    split = left.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    left = materialise(left.join(split, "token"), "left")
    by_label = left.groupBy("token", "label").agg(F.count("*").alias("c"))
    small = by_label.where(f"c <= {PIECE}").groupBy("token").agg(F.sum("c").alias("few"))
    by_label = by_label.join(small, "token", "left")
    # a large component has pieces of its own; small ones share pieces by the hash of their label
    large = F.col("c") > PIECE
    numbers = F.when(large, _pieces("c")).otherwise(_pieces("few") * 2)
    placed = by_label.select("token", "label", F.when(large, F.col("label")).alias("big"), numbers.alias("pieces"))
    left = left.join(placed, ["token", "label"])
    spread = F.when(F.col("big").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("node"))
    left = left.withColumn("piece", F.xxhash64("big", F.pmod(spread, F.col("pieces"))))
    left = materialise(left.select("token", "node", "label", "big", "piece"), "pieces")
    blocks = left.select("token", "piece", "big").distinct()
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.piece") <= F.col("b.piece")))
    pairs = pairs.where("a.big IS NULL OR b.big IS NULL OR a.big <> b.big").select(F.col("a.token").alias("token"), F.col("a.piece").alias("p"), F.col("b.piece").alias("q"))
    pairs = materialise(pairs, "pairs")
    side_p = left.withColumnRenamed("piece", "p").join(pairs, ["token", "p"]).withColumn("side", F.lit(0))
    side_q = left.withColumnRenamed("piece", "q").join(pairs.where("p <> q"), ["token", "q"]).withColumn("side", F.lit(1))
    groups = side_p.select("token", "p", "q", "side", (F.col("p") == F.col("q")).alias("inside"), "node", "label")
    groups = groups.union(side_q.select("token", "p", "q", "side", F.lit(False).alias("inside"), "node", "label"))
    more = materialise(_linked(groups, sets, num, den), "links")
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def labelled(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles and component (its least node, null without words) of every row of docs."""
    docs = docs.select("doc_id", "text")
    rows, classes = survey(docs, width)
    labels = set_components(docs, rows, width, num, den, classes)
    known = rows.where("n > 0").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = known.select("doc_id", "h", F.col("n").alias("n_shingles"), "component")
    return known.union(rows.where("n = 0").select("doc_id", "h", "n", F.lit(None).cast("long")))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles and component_id (least doc_id reachable) of every row of docs."""
    found = labelled(docs, width, num, den)
    known = found.where("component IS NOT NULL")
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = known.join(least, "component").select("doc_id", "h", "n_shingles", "component_id")
    return known.union(found.where("component IS NULL").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one row of each component left, that of the least doc_id, null last, and of its least hash; rows without words all stay."""
    found = materialise(labelled(docs, width, num, den), "components")
    known = found.where("component IS NOT NULL")
    first = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("row"))
    first = first.select(F.col("row.doc_id").alias("d_"), F.col("row.h").alias("h_"))
    alone = found.where("component IS NULL").select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"))

    def rows_of(stays: DataFrame) -> DataFrame:
        stays = materialise(stays, "stays")
        return docs.join(stays, docs["doc_id"].eqNullSafe(stays["d_"]) & F.xxhash64(docs["text"]).eqNullSafe(stays["h_"]), "left_semi")

    if known.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        return rows_of(first).dropDuplicates(["doc_id", "text"]).union(rows_of(alone))
    return rows_of(first.union(alone))
