"""A hierarchical Pitman-Yor language model: Chinese-restaurant seating by Gibbs sampling.

Restaurants: one for each word before, however many there are, and one for the start of a text.
Its parent is that of the word's class (its last two bytes, in ENDINGS classes, and the start of a
text), whose parent is the restaurant of the last byte alone (PARENTS classes), whose parent is the
root, whose base is uniform over the V known words and one unknown. A word's customers are its
occurrences in training; each table of a restaurant is a customer of its parent.

Sampling: given the restaurants' totals of tables, seatings of different words are independent, so
words are dealt to tasks and sampled side by side, as arrays. The state of a word in a restaurant is
its customers and tables. A sweep of the Gibbs sampler seats all customers of every cell anew, by one
draw of the cell's tables t given its customers c: in proportion to S(c, t) a^t, with S the generalised
Stirling numbers and a the weight of a new table. Up to MOST customers the draw is exact; above, it is
one more than a binomial of the mean and variance to which that law tends (total variation from the
exact law at 257 customers: 0.07 at most over discounts of 0.3 to 0.95 and a of 0.001 to 100, and less
with more customers). The weight a is that before the sweep of the level, and totals are brought up to
date between two passes. The predictive probabilities of the SAMPLES last sweeps are averaged, and
each restaurant's weight of its parent is what its averages leave of 1, so the model adds up to 1.

Data flow: texts are cut into blocks of about BLOCK_TOKENS tokens, written as numbers of the block's
own words; a text of more goes on in the next block. Words are in the order of their hashes, whose
ranges make the buckets, so a block's pairs of a word and the word before go to a bucket as one run,
and pairs are told by small steps. In a bucket the blocks' counts meet; each bucket is sampled as a
whole; and each block gets back the parameters of its own words and pairs and no others. The tables of
a word's restaurant lie in many buckets: they are summed in the bucket of that word, and the sums sent
to the buckets that asked, between passes. What is moved grows with the distinct pairs of the blocks.
Only totals of the classes, of fixed size, reach the driver. A word is known by HASH_BITS bits of its
hash (of ten million words, two are alike with a chance of one in 1400; such words are one), and as a
restaurant by the first CONTEXT_BITS of these (of ten million words, some three pairs share one).

Defined results: tokens are the words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased and one
end token, so a null or empty text has one token; rows that repeat are each counted and scored; a
null doc_id is kept; extra columns are ignored, whatever their names; without training documents
base_score and score give every token probability 1 / (V + 1), V = 0; a text of any length is scored
whole, a part in each of its blocks; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.session import discard, materialise

BLOCK_TOKENS = 800_000
#: Documents for each bucket of words.
DOCS_PER_BUCKET = 6000
HASH_BITS, CONTEXT_BITS = 56, 44
PARENTS, ENDINGS = 16, 64
#: Restaurants of classes by number: ENDINGS and the start of a text, then their PARENTS and that of the start, then the root.
START, FIRST_PARENT = ENDINGS, ENDINGS + 1
START_PARENT, ROOT = FIRST_PARENT + PARENTS, FIRST_PARENT + PARENTS + 1
RESTAURANTS = ROOT + 1
PARENT = np.array([*(FIRST_PARENT + u // (ENDINGS // PARENTS) for u in range(ENDINGS)), START_PARENT])
STRENGTH = 5.0
BURN_IN, SAMPLES = 4, 4
#: Discounts of the seating that sampling starts from.
START_DISCOUNT = 0.75
MOST = 256
#: The end of a text is a token; no word has a line feed.
END = b"\n"
_WHITESPACE = re.compile(rb"[\x20\x09-\x0D]")


def packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def planes(numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whole numbers from 0 on as the bytes that they need, all least bytes first, which packs well."""
    x = np.ascontiguousarray(numbers, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return tuple(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, k]) for k in range(width))


def whole(bytes_of: tuple[np.ndarray, ...]) -> np.ndarray:
    """The numbers of planes()."""
    x = bytes_of[0].astype(np.int64)
    for k, more in enumerate(bytes_of[1:], 1):
        x |= more.astype(np.int64) << (8 * k)
    return x


def steps(ascending: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending numbers by their steps."""
    return planes(np.diff(np.asarray(ascending, np.uint64), prepend=np.uint64(0)))


def walked(bytes_of: tuple[np.ndarray, ...]) -> np.ndarray:
    """The numbers of steps()."""
    return np.cumsum(whole(bytes_of))


def coarse(x: np.ndarray) -> np.ndarray:
    """Positive numbers as logarithms in 16 bits, to about one part in 6000."""
    return np.clip(np.rint((np.log2(np.maximum(x, 2.0**-8)) + 8) * 2048), 0, 65535).astype(np.uint16)


def fine(x: np.ndarray) -> np.ndarray:
    return 2.0 ** (x / 2048.0 - 8)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def parts_of(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in parts of about size bytes."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        white = _WHITESPACE.search(data, at + size)
        to = white.start() if white else len(data)
        yield data[at:to].lower().split()
        at = to


def ending(word: bytes) -> int:
    """The class of this word as a word before another."""
    last, before = word[-1], word[-2] if len(word) > 1 else 0
    return (last * 0x9E37 >> 3) % PARENTS * (ENDINGS // PARENTS) + (before * 0x79B9 >> 4) % (ENDINGS // PARENTS)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - HASH_BITS)


def context_of(hashes: np.ndarray) -> np.ndarray:
    """The number of the words' restaurants, in the order of the hashes."""
    return hashes >> hashes.dtype.type(HASH_BITS - CONTEXT_BITS)


def bucket_of(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of words' restaurants, and so of words."""
    return np.minimum((contexts.astype(np.float64) * (buckets / 2.0**CONTEXT_BITS)).astype(np.int64), buckets - 1)


def small(p: np.ndarray) -> np.ndarray:
    """Probabilities as logarithms in 16 bits, to about one part in 3000."""
    return np.clip(np.rint((np.log2(np.maximum(p, 2.0**-64)) + 64) * 1023), 0, 65535).astype(np.uint16)


def unsmall(x: np.ndarray) -> np.ndarray:
    return 2.0 ** (x / 1023.0 - 64)


# --- blocks ---------------------------------------------------------------------------------


def tokens_of(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text in parts; the last part has the END."""
    words: list[bytes] = []
    for part in parts_of(text):
        if words:
            yield words
        words = part
    yield [*words, END]


class Block:
    """Parts of texts, which after packed() are ranks of the block's own words in the order of their hashes."""

    def __init__(self):
        self.number = defaultdict(count().__next__)
        self.number[END]
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.marks: list[tuple[int, int, bool, bool]] = []
        self.tokens = 0

    def add(self, uid: int, doc, words: list[bytes], held: bool, lead: bytes | None) -> None:
        """lead, the word before a part that isn't a text's first, stands before its words and doesn't count."""
        if lead is not None:
            words = [lead, *words]
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc)
        self.marks.append((uid, len(words), held, lead is not None))
        self.tokens += len(words)

    def packed(self) -> bytes:
        hashes = hashes_of(list(self.number))
        # words of one hash are one
        own, rank = np.unique(hashes, return_inverse=True)
        kind = np.zeros(len(own), np.uint8)
        kind[rank] = np.fromiter(map(ending, self.number), np.uint8, len(hashes))
        kind[rank[self.number[END]]] = START
        uid, length, held, lead = (np.array(x) for x in zip(*self.marks))
        return packed(planes(rank[np.concatenate(self.ids)]), steps(own), kind, int(rank[self.number[END]]), uid, planes(length), held, lead)


@dataclass
class Opened:
    """What a block's row holds."""

    ids: np.ndarray
    hashes: np.ndarray
    kind: np.ndarray
    uid: np.ndarray
    length: np.ndarray
    held: np.ndarray
    counted: np.ndarray  # of each token, whether it counts, as the word before a part doesn't
    keys: np.ndarray  # each different pair: the rank of a word and of that before it
    where: np.ndarray  # the pair of each token


def opened(data: bytes) -> Opened:
    ids, hashes, kind, end, uid, length, held, lead = unpacked(data)
    ids, length = whole(ids), whole(length)
    counted = np.ones(len(ids), bool)
    counted[(np.cumsum(length) - length)[lead]] = False
    keys, where = np.unique(ids << 32 | np.concatenate([[end], ids[:-1]]), return_inverse=True)
    return Opened(ids, walked(hashes), kind, uid, length, held, counted, keys, where)


def blocks(docs: DataFrame, held: Column) -> DataFrame:
    """block, docs, data; materialised, so that numbers of blocks stay."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        block, field = Block(), None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([number]), pa.array([block.docs], pa.list_(field)), pa.array([block.packed()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "data"])

        for b in batches:
            field = b.schema.field(1).type
            for uid, doc, text, is_held in zip(*(c.to_pylist() for c in b.columns)):
                lead = None
                for words in tokens_of(text):
                    block.add(uid, doc, words, is_held, lead)
                    lead = words[-1]
                    if block.tokens >= BLOCK_TOKENS:
                        yield flush()
                        block, number = Block(), number + 1
        if block.docs:
            yield flush()

    return materialise(rows.mapInArrow(run, f"block long, docs array<{kind}>, data binary"), "blocks")


def pairs(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, data: each block's words and pairs of each bucket, and how often a pair is in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                o = opened(data)
                n = np.bincount(o.where, np.repeat(~o.held, o.length) & o.counted, len(o.keys)).astype(np.int64)
                owner = bucket_of(context_of(o.hashes), buckets)
                at = np.searchsorted(owner, np.arange(buckets + 1))
                word, before = o.keys >> 32, o.keys & 0xFFFFFFFF
                pair_at = np.searchsorted(word, at)
                out = []
                for k in np.unique(owner):
                    cells = slice(pair_at[k], pair_at[k + 1])
                    size = np.bincount(word[cells] - at[k], minlength=at[k + 1] - at[k])
                    own, which = np.unique(before[cells], return_inverse=True)
                    out.append((int(k), block, packed(steps(o.hashes[at[k] : at[k + 1]]), planes(size), steps(context_of(o.hashes[own])), o.kind[own], planes(which), planes(n[cells]))))
                columns = zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["bucket", "block", "data"])

    return found.select("block", "data").mapInArrow(run, "bucket long, block long, data binary")


# --- buckets --------------------------------------------------------------------------------

KINDS = ("cells", "asks", "state", "totals", "share", "tables", "reply")
ROW = "bucket long, part long, " + ", ".join(f"{k} binary" for k in KINDS)


def row_table(rows: Iterable[tuple]) -> pa.Table:
    """Of rows (bucket, kind, part, arrays)."""
    rows = [(b, kind, part, packed(*arrays)) for b, kind, part, arrays in rows]
    columns = {"bucket": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[2] for r in rows], pa.int64())}
    return pa.table(columns | {k: pa.array([r[3] if r[1] == k else None for r in rows], pa.binary()) for k in KINDS})


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """bucket, kind, part, data; no other kind is read."""
    return rows.where(F.col(kind).isNotNull()).select("bucket", F.lit(kind).alias("kind"), "part", F.col(kind).alias("data"))


@dataclass
class Cells:
    """A bucket's words and the words before them by hash, and its pairs in the order of both, with their customers."""

    hashes: np.ndarray
    contexts: np.ndarray
    kind: np.ndarray
    word: np.ndarray
    context: np.ndarray
    n: np.ndarray

    def packed(self) -> tuple:
        return steps(self.hashes), steps(self.contexts), self.kind, steps(self.word), planes(self.context), planes(self.n)

    @classmethod
    def of(cls, data: tuple) -> Cells:
        hashes, contexts, kind, word, context, n = data
        return cls(walked(hashes), walked(contexts), kind, walked(word), whole(context), whole(n))

    def seated(self) -> Cells:
        """Those with customers, as other pairs are in texts that are held out alone."""
        seen = self.n > 0
        return Cells(self.hashes, self.contexts, self.kind, self.word[seen], self.context[seen], self.n[seen])


def merged(found: DataFrame, begin) -> DataFrame:
    """Each bucket's cells, what begin(bucket, cells) gives, and which words and pairs each block asks for."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy())
        data = table.column("data")
        rows = [unpacked(data[int(i)].as_py()) for i in order]
        own = [walked(r[0]) for r in rows]
        befores = [walked(r[2]) for r in rows]
        hashes, contexts = (np.unique(np.concatenate(x)) for x in (own, befores))
        kind = np.zeros(len(contexts), np.uint8)
        keys = []
        for r, words, before in zip(rows, own, befores):
            at = np.searchsorted(contexts, before)
            kind[at] = r[3]
            keys.append(np.repeat(np.searchsorted(hashes, words), whole(r[1])) << 32 | at[whole(r[4])])
        every = np.unique(np.concatenate(keys))
        n = np.zeros(len(every), np.int64)
        asks = []
        for block, r, words, k in zip(table.column("block").to_numpy()[order].tolist(), rows, own, keys):
            at = np.searchsorted(every, k)
            np.add.at(n, at, whole(r[5]))
            asks.append((block, steps(np.searchsorted(hashes, words)), steps(at)))
        cells = Cells(hashes, contexts, kind, every >> 32, every & 0xFFFFFFFF, n)
        bucket = key[0].as_py()
        return row_table([(bucket, "cells", None, cells.packed()), (bucket, "asks", None, (asks,)), *begin(bucket, cells.seated())])

    return materialise(found.groupBy("bucket").applyInArrow(run, ROW), "buckets")


def alone_table(d: float) -> np.ndarray:
    """S(c-1, t-1) / S(c, t): the chance that a customer sits alone, for up to MOST customers."""
    log_s = np.full((MOST + 1, MOST + 1), -np.inf)
    log_s[0, 0] = 0
    t = np.arange(1, MOST + 1)
    for c in range(1, MOST + 1):
        stay = np.maximum(c - 1 - t * d, 0)
        with np.errstate(divide="ignore"):
            log_s[c, 1:] = np.logaddexp(log_s[c - 1, :-1], np.log(stay) + log_s[c - 1, 1:])
    out = np.ones((MOST + 1, MOST + 1))
    with np.errstate(invalid="ignore"):
        out[1:, 1:] = np.where(np.isfinite(log_s[1:, 1:]), np.exp(log_s[:-1, :-1] - log_s[1:, 1:]), 1.0)
    out[2:, 1] = 0.0
    return out


def log_stirling(alone: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) from the chances to sit alone, S(c-1, t-1) / S(c, t)."""
    out = np.full(alone.shape, -np.inf)
    out[1:, 1] = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(alone) - 1) - d))])
    for t in range(2, len(alone)):
        out[t:, t] = out[t - 1 : -1, t - 1] - np.log(alone[t:, t])
    return out


def limit_law(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables but one of many customers: a Poisson number of tables, given that they seat c.

    Tables have j customers with weight x^j, where x = 1 - exp(-y) is such that c are expected.
    """
    lo, hi = np.zeros(len(c)), (np.log(c / np.minimum(a, c)) + 2) / (1 - d) + np.log1p(c)
    for _ in range(60):
        y = (lo + hi) / 2
        few = np.log(a) + np.log(-np.expm1(-y)) + (1 - d) * y < np.log(c)
        lo, hi = np.where(few, y, lo), np.where(few, hi, y)
    left = np.exp(-y)
    mean = -a * np.expm1(-d * y) / d
    return mean, mean - c * left / (1 - d * (1 - left))


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, log_s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells of c customers, all seated anew, where a new table has weight a."""
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    sizes, at = np.unique(c[order], return_index=True)
    for size, lo, hi in zip(sizes, at, [*at[1:], len(c)]):
        if size > MOST:
            break
        if size > 1:
            t = np.arange(1, size + 1)
            for k in range(lo, hi, max(1, 1_000_000 // size)):
                own = order[k : min(hi, k + max(1, 1_000_000 // size))]
                p = np.log(a[own])[:, None] * t + log_s[size, 1 : size + 1]
                p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), axis=1)
                out[own] = 1 + (p < (rng.random(len(own)) * p[:, -1])[:, None]).sum(1)
    many = np.nonzero(c > MOST)[0]
    if len(many):
        mean, variance = limit_law(c[many].astype(float), a[many], d)
        p = np.clip(1 - variance / mean, 1e-9, 1)
        n = np.maximum(1, np.rint(mean / p)).astype(np.int64)
        out[many] = np.minimum(1 + rng.binomial(n, np.minimum(mean / n, 1)), c[many])
    return out


class Seating:
    """The restaurants of one bucket's words: customers and tables of each word in each."""

    def __init__(self, word: np.ndarray, restaurant: np.ndarray, n: np.ndarray, discount: np.ndarray, alone: list[np.ndarray]):
        self.discount, self.log_s = discount, [log_stirling(x, d) for x, d in zip(alone, discount)]
        own = np.asarray(word, np.int64)
        parent_key, up = np.unique(own * 128 + PARENT[restaurant], return_inverse=True)
        root_key, up2 = np.unique(parent_key >> 7, return_inverse=True)
        self.place = [np.asarray(restaurant, np.int64), parent_key & 127, np.full(len(root_key), ROOT)]
        self.word = [own, parent_key >> 7, root_key]
        self.up = [up, up2]
        self.c = [n.astype(np.int64), None, None]
        self.t = [None, None, None]
        for level in range(3):
            if level:
                self.c[level] = np.bincount(self.up[level - 1], self.t[level - 1], minlength=len(self.word[level])).astype(np.int64)
            self.t[level] = np.clip(np.rint(self.c[level] ** self.discount[level]), 1, self.c[level]).astype(np.int64)

    def chance(self, level: int, totals: tuple[np.ndarray, np.ndarray], base: float) -> np.ndarray:
        """The predictive probability of each word in each restaurant of the level."""
        customers, tables = totals
        d, place = self.discount[level], self.place[level]
        above = base if level == 2 else self.chance(level + 1, totals, base)[self.up[level]]
        return (self.c[level] - d * self.t[level] + (STRENGTH + d * tables[place]) * above) / (STRENGTH + customers[place])

    def sweep(self, totals: tuple[np.ndarray, np.ndarray], base: float, rng: np.random.Generator) -> None:
        _, tables = totals
        for level in range(3):
            d = self.discount[level]
            if level:
                self.c[level] = np.bincount(self.up[level - 1], self.t[level - 1], minlength=len(self.word[level])).astype(np.int64)
            above = base if level == 2 else self.chance(level + 1, totals, base)[self.up[level]]
            draw = (STRENGTH + d * tables[self.place[level]]) * above
            self.t[level] = draw_tables(self.c[level], draw, d, self.log_s[level], rng)

    def table_totals(self) -> np.ndarray:
        return sum(np.bincount(self.place[k], self.t[k], minlength=RESTAURANTS) for k in range(3))

    def customer_totals(self) -> np.ndarray:
        return sum(np.bincount(self.place[k], self.c[k], minlength=RESTAURANTS) for k in range(3))


class WordSeating:
    """The restaurants of the words before, for one bucket's words, and above them those of the classes."""

    def __init__(self, word, context, kind, n, discount: np.ndarray, alone: list[np.ndarray], t=None, classes=None):
        self.d, self.log_s = discount[0], log_stirling(alone[0], discount[0])
        self.context, self.n = context, n.astype(np.int64)
        self.t = np.clip(np.rint(self.n**self.d), 1, self.n).astype(np.int64) if t is None else whole(t)
        self.keys, self.up = np.unique(np.asarray(word, np.int64) * 128 + kind[context], return_inverse=True)
        self.classes = Seating(self.keys >> 7, self.keys & 127, self.customers(), discount[1:], alone[1:])
        if classes is not None:
            self.classes.c, self.classes.t = ([whole(x) for x in xs] for xs in classes)

    def customers(self) -> np.ndarray:
        return np.bincount(self.up, self.t, minlength=len(self.keys)).astype(np.int64)

    def sweep(self, tables: np.ndarray, totals: tuple[np.ndarray, np.ndarray], base: float, rng: np.random.Generator) -> None:
        """tables are the totals of the words' restaurants, totals those of the classes'."""
        above = self.classes.chance(0, totals, base)[self.up]
        self.t = draw_tables(self.n, (STRENGTH + self.d * tables[self.context]) * above, self.d, self.log_s, rng)
        self.classes.c[0] = self.customers()
        self.classes.sweep(totals, base, rng)

    def state(self) -> tuple:
        return planes(self.t), ([planes(x) for x in self.classes.c], [planes(x) for x in self.classes.t])


def discounts(seen: np.ndarray) -> np.ndarray:
    """A level's discount from its counts of one and of two."""
    return np.array([min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5 for a, b in seen.reshape(-1, 2)])


def by_bucket(rows: DataFrame, run, name: str) -> DataFrame:
    """run(bucket, {kind: [(part, arrays)]}) gives rows (bucket, kind, part, arrays)."""

    def each(key: tuple, table: pa.Table) -> pa.Table:
        got = defaultdict(list)
        for kind, part, data in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "data"))):
            got[kind].append((part, unpacked(data)))
        return row_table(run(key[0].as_py(), got))

    return materialise(rows.groupBy("bucket").applyInArrow(each, ROW), name)


def sums_of(rows: DataFrame) -> list[np.ndarray] | None:
    """The totals, arrays of fixed size, summed over all buckets."""
    found = [unpacked(r.data) for r in of_kind(rows, "totals").select("data").collect()]
    return [sum(x) for x in zip(*found)] if found else None


def score(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows that are held out teach nothing."""
    n_docs = docs.count()
    n_buckets = max(8, -(-n_docs // DOCS_PER_BUCKET))
    texts = blocks(docs, held)

    def shares(bucket: int, contexts: np.ndarray, tables: np.ndarray) -> Iterator[tuple]:
        """This bucket's tables of each word's restaurant, for the bucket of that word; in as many parts as are averaged."""
        at = np.searchsorted(bucket_of(contexts, n_buckets), np.arange(n_buckets + 1))
        for b in np.nonzero(np.diff(at))[0]:
            own = slice(at[b], at[b + 1])
            yield int(b), "share", bucket, (steps(contexts[own]), planes(tables[own]))

    alike = np.full(4, START_DISCOUNT)
    plain = [alone_table(START_DISCOUNT)] * 4

    def begin(bucket: int, c: Cells) -> Iterator[tuple]:
        s = WordSeating(c.word, c.context, c.kind, c.n, alike, plain)
        keys, c0 = np.unique(c.word * 128 + c.kind[c.context], return_counts=True)
        keys, c1 = np.unique((keys >> 7) * 128 + PARENT[keys & 127], return_counts=True)
        words, c2 = np.unique(keys >> 7, return_counts=True)
        ones = np.array([(x == k).sum() for x in (c.n, c0, c1, c2) for k in (1, 2)], float)
        yield bucket, "totals", None, (s.classes.customer_totals(), s.classes.table_totals(), ones, np.array([c.n.sum(), len(words)], np.int64))
        yield from shares(bucket, c.contexts, np.bincount(c.context, s.t, len(c.contexts)))

    buckets = merged(pairs(texts, n_buckets), begin)
    *totals, ones, counted = sums_of(buckets) or (np.zeros(RESTAURANTS), np.zeros(RESTAURANTS), np.zeros(8), np.zeros(2, np.int64))
    n_train, n_types = int(counted[0]), int(counted[1])
    discount = discounts(ones)
    alone = [alone_table(d) for d in discount]
    base = 1 / (n_types + 1)

    def relay(bucket, got):
        parts, arrays = zip(*got["share"])
        own = [walked(a[0]) for a in arrays]
        every, where = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(where, np.concatenate([whole(a[1]) for a in arrays]), len(every))[where]
        for part, t in zip(parts, np.split(total, np.cumsum([len(x) for x in own])[:-1])):
            yield part, "tables", bucket, (planes(t),)

    def run_pass(rounds: int, totals, last: bool):
        def run(bucket, got):
            c = Cells.of(got["cells"][0][1]).seated()
            n = c.n
            state = got["state"][0][1] if got["state"] else (None, None)
            s = WordSeating(c.word, c.context, c.kind, n, discount, alone, *state)
            # parts are in the order of the contexts' hashes
            tables = np.concatenate([np.zeros(0), *(whole(t) for _, (t,) in sorted(got["tables"], key=lambda x: x[0]))])
            rng = np.random.default_rng((bucket, int(last)))
            means, seats = [np.zeros(len(n)), *(np.zeros(len(w)) for w in s.classes.word)], [np.zeros(RESTAURANTS), np.zeros(RESTAURANTS)]
            own_tables = np.zeros(len(c.contexts))
            for _ in range(rounds):
                s.sweep(tables, totals, base, rng)
                if last:
                    means[0] += (n - s.d * s.t) / rounds
                    own_tables += np.bincount(c.context, s.t, len(c.contexts))
                    seats[0] += s.classes.customer_totals() / rounds
                    seats[1] += s.classes.table_totals() / rounds
                    for k in range(3):
                        means[k + 1] += (s.classes.c[k] - discount[k + 1] * s.classes.t[k]) / rounds
            if not last:
                own_tables = np.bincount(c.context, s.t, len(c.contexts))
                seats = [s.classes.customer_totals().astype(float), s.classes.table_totals().astype(float)]
            yield bucket, "state", None, (planes(coarse(means[0])), *(x.astype(np.float32) for x in means[1:])) if last else s.state()
            yield bucket, "totals", None, seats
            yield from shares(bucket, c.contexts, own_tables)

        return run

    before = buckets
    for name, rounds, last in (("burn_in", BURN_IN, False), ("sampled", SAMPLES, True)):
        tables = by_bucket(of_kind(before, "share"), relay, "tables")
        rows = of_kind(buckets, "cells").union(of_kind(tables, "tables"))
        after = by_bucket(rows if before is buckets else rows.union(of_kind(before, "state")), run_pass(rounds, tuple(totals), last), name)
        totals = sums_of(after) or totals
        discard(tables, *([before] if before is not buckets else []))
        before = after

    scale = STRENGTH + totals[0]
    level = np.array([*[1] * FIRST_PARENT, *[2] * (PARENTS + 1), 3])
    rest = (STRENGTH + discount[level] * totals[1]) / scale

    def answers(bucket, got):
        """For each block that asks, its words' counts and tables, and its pairs' averages and what is above them."""
        c = Cells.of(got["cells"][0][1])
        seen = c.n > 0
        mean, *means = got["state"][0][1]
        counts = np.bincount(c.word, c.n, minlength=len(c.hashes)).astype(np.int64)
        tables = np.zeros(len(c.hashes), np.int64)
        first = np.searchsorted(homes := context_of(c.hashes), np.unique(homes))
        for _, (own, t) in got["share"]:
            tables[first[np.searchsorted(homes[first], walked(own))]] += whole(t)
        tables = tables[np.searchsorted(homes, homes)]  # words of one restaurant have its tables each
        s = WordSeating(c.word[seen], c.context[seen], c.kind, c.n[seen], discount, alone).classes

        def at(k: int, keys: np.ndarray) -> np.ndarray:
            own = s.word[k] * 128 + s.place[k]
            if not len(own):
                return np.zeros(len(keys))
            i = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            return np.where(own[i] == keys, means[k][i] / scale[s.place[k][i]], 0.0)

        near, which = np.unique(c.word * 128 + c.kind[c.context], return_inverse=True)
        kind = near & 127
        far = PARENT[kind]
        wide = near - kind
        above = small(at(0, near) + rest[kind] * (at(1, wide + far) + rest[far] * (at(2, wide + ROOT) + rest[ROOT] * base)))[which]
        own_mean = np.zeros(len(c.n), np.uint16)
        own_mean[seen] = np.maximum(whole(mean), 1)
        for block, own, cells in got["asks"][0][1][0]:
            own, cells = walked(own), walked(cells)
            yield block, "reply", bucket, (planes(counts[own]), planes(tables[own]), planes(own_mean[cells]), planes(above[cells]))

    asked = of_kind(buckets, "cells").union(of_kind(buckets, "asks")).union(of_kind(after, "state")).union(of_kind(after, "share"))
    replies = by_bucket(asked, answers, "replies")
    discard(buckets, after)
    kind = dict(docs.dtypes)["doc_id"]
    none = [F.lit(None).cast("long").alias("part"), "docs", "data"]
    both = texts.select("block", *none).union(of_kind(replies, "reply").select("bucket", "part", F.lit(None).cast(f"array<{kind}>"), "data"))
    width = float(n_train + 0.5 * (n_types + 1))

    def evaluate(key: tuple, table: pa.Table) -> pa.Table:
        part = table.column("part").to_pylist()
        text = part.index(None)
        data = table.column("data")
        o = opened(data[text].as_py())
        found = [unpacked(data[i].as_py()) for i in sorted((i for i in range(len(part)) if i != text), key=lambda i: part[i])]
        # buckets are ranges of hashes, so their replies are one after another
        counts, tables, mean, above = (np.concatenate([whole(f[k]) for f in found]) for k in range(4))
        before = o.keys & 0xFFFFFFFF
        # a word of training has as many customers in its restaurant as it has occurrences
        chance = np.where(mean > 0, fine(mean), 0.0) + (STRENGTH + discount[0] / SAMPLES * tables[before]) * unsmall(above)
        chance /= STRENGTH + counts[before]
        at = np.cumsum(o.length) - o.length
        sums = lambda x: np.add.reduceat(np.where(o.counted, x, 0), at)
        return pa.table({
            "uid": pa.array(o.uid), "doc_id": table.column("docs")[text].values, "held_out": pa.array(o.held), "n_tokens": pa.array(sums(np.ones(len(o.ids), np.int64))),
            "n_known": pa.array(sums((counts > 0).astype(np.int64)[o.ids])), "base_score": pa.array(sums(np.log10((counts + 0.5) / width)[o.ids])),
            "score": pa.array(sums(np.log10(chance)[o.where])),
        })

    scored = both.groupBy("block").applyInArrow(evaluate, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    total = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole_texts = scored.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *total)
    return whole_texts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(log10_probability: float, tokens: int) -> float:
    return math.inf if not tokens else 10 ** (-log10_probability / tokens)
