"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learnt from document labels.

A sentence's score is a logistic model of its words (each word, its beginnings of 3 to 6 letters
and its endings of 3 to 5). A document is toxic if any sentence is: its score is
1 - (1 - leak) * product(1 - sentence score). The weights are fitted to document labels alone by
gradient steps on that likelihood; sentences have no labels. The sentences of high score are
those that offend.

Fitting uses a bounded sample: the labelled documents with the least md5 of their id, at most SAMPLE
of them and SAMPLE_TOTAL characters in all; labelled documents of more than SAMPLE_CHARS characters
never teach. A model has at most FEATURES features. No text of the sample reaches the driver, only
the numbers of the features in its sentences. Scoring covers every whole text and needs no shuffle.

Defined results: null and empty texts have no sentence and score the leak; labels that are null,
or without a document, teach nothing and take no place in the sample; a document with several labels
counts with the largest; different texts of one doc_id each teach, repeated rows once; ties of md5 go
by doc_id and text; without labels of both kinds every score is 0; rows that repeat get the same score
each; a null doc_id is scored but never teaches; clashing extra columns are ignored; empty tables give an
empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.session import discard, materialise

SAMPLE = 8000
#: Characters of a document of the sample, and of all of them, at most.
SAMPLE_CHARS, SAMPLE_TOTAL = 1_000_000, 48_000_000
FEATURES = 5000
#: The chi-square of a chance of one in a thousand.
LEAST_CHI = 10.83
PENALTY = 2e-5
#: Documents of the sample in which a feature must occur.
LEAST_DOCS = 4
STEPS = 200
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word, its beginnings and its endings."""
    n = len(word)
    return [word, *("<" + word[:k] for k in range(3, min(6, n - 1) + 1)), *(word[-k:] + ">" for k in range(3, min(5, n - 1) + 1))]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    leak: float = 0.0

    def __post_init__(self):
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            w = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[word] = w
        return w

    def sentences(self, text: str) -> Iterator[tuple[str, float]]:
        """Each sentence and its logit."""
        known, slow = self.words.get, self.word
        for m in _SENTENCE.finditer(text):
            z = self.bias
            for w in _WORD.findall(m[0].lower()):
                x = known(w)
                z += slow(w) if x is None else x
            yield m[0], z

    def score(self, text: str | None) -> float:
        logits = np.array([z for _, z in self.sentences(text or "")])
        return float(1 - (1 - self.leak) * np.exp(-np.logaddexp(0, logits).sum()))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[str, float]]:
        """The sentences whose own score is at least the given one."""
        found = ((s.strip(), float(1 / (1 + np.exp(-z)))) for s, z in self.sentences(text or ""))
        return [(s, p) for s, p in found if p >= least]


def bags_of(text: str | None) -> list[list[str]]:
    """The words of each sentence."""
    return [_WORD.findall(m[0].lower()) for m in _SENTENCE.finditer(text or "")]


def in_documents(texts: Iterable[str | None], labels: Iterable[int]) -> dict[str, list[int]]:
    """Of each feature, its documents of label 0 and of label 1."""
    seen: dict[str, list[int]] = {}
    for t, y in zip(texts, labels):
        for f in {f for w in {w for s in bags_of(t) for w in s} for f in features(w)}:
            seen.setdefault(f, [0, 0])[y] += 1
    return seen


def chosen(seen: Iterable[tuple[str, int, int]], n0: int, n1: int, most: int = FEATURES) -> dict[str, int]:
    """The features of (feature, documents of label 0, of label 1) that tell the labels apart best, by chi-square; toxic ones only."""
    ranked = []
    for f, b, a in seen:
        share = (a + b) / (n0 + n1)
        if a + b >= LEAST_DOCS and share < 1 and a / n1 > b / n0:
            ranked.append(((a - n1 * share) ** 2 / (n1 * share) + (b - n0 * share) ** 2 / (n0 * share), f))
    ranked.sort(key=lambda x: (-x[0], x[1]))
    return {f: i for i, (x, f) in enumerate(ranked[:most]) if x >= LEAST_CHI}


def coded(text: str | None, index: dict[str, int], known: dict[str, list[int]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A document as its sentences without features, and of each different other one: how often, its length, its features."""
    bare, found = 0, Counter()
    for s in bags_of(text):
        own: list[int] = []
        for w in s:
            x = known.get(w)
            if x is None:
                x = known[w] = [index[f] for f in features(w) if f in index]
            own += x
        if own:
            found[tuple(sorted(own))] += 1
        else:
            bare += 1
    return bare, np.array([*found.values()], np.uint32), np.array([len(x) for x in found], np.uint32), np.array([i for x in found for i in x], np.uint16)


def fit(texts: list[str], labels: list[int], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """The model of texts that lie here."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return Model()
    index = chosen(((f, a, b) for f, (a, b) in in_documents(texts, labels).items()), int((y == 0).sum()), int((y == 1).sum()))
    known: dict[str, list[int]] = {}
    return fitted([coded(t, index, known) for t in texts], y, index, steps, penalty)


def likelihood(theta: np.ndarray, y: np.ndarray, docs: Coded, penalty: float) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of the labels, less the penalty, and its slope; theta is weights, bias, logit of the leak."""
    z = np.add.reduceat(theta[docs.column], docs.at) + theta[-2] if len(docs.at) else np.zeros(0)
    p, p0, leak = (1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (z, theta[-2], theta[-1]))
    clean = np.log1p(-leak) + docs.bare * np.log1p(-p0) + np.bincount(docs.owner, -docs.times * np.logaddexp(0, z), minlength=len(y))
    toxic = -np.expm1(clean)
    # d log-likelihood / d z of a sentence: p * (1 - P) / P where the label is 1, else -p
    pull = np.where(y == 1, np.exp(clean) / np.maximum(toxic, 1e-12), -1.0)
    by_sentence = docs.times * p * pull[docs.owner]
    slope = np.concatenate([
        np.bincount(docs.column, np.repeat(by_sentence, docs.length), minlength=len(theta) - 2) / len(y) - penalty * theta[:-2],
        [(by_sentence.sum() + p0 * (docs.bare * pull).sum()) / len(y), leak * pull.sum() / len(y)],
    ])
    value = np.where(y == 1, np.log(np.maximum(toxic, 1e-12)), clean).mean() - penalty / 2 * (theta[:-2] ** 2).sum()
    return float(value), slope


class Coded:
    """Documents as arrays: of each different sentence its owner, times and features (column, from at on), and each one's bare sentences."""

    def __init__(self, parts: list[tuple]):
        self.bare = np.array([p[0] for p in parts], float)
        self.owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        join = lambda k, t: np.concatenate([*(p[k] for p in parts), np.zeros(0, t)]).astype(t)
        self.times, self.length, self.column = join(1, float), join(2, np.int64), join(3, np.int64)
        self.at = np.cumsum(self.length) - self.length


def fitted(parts: list[tuple], y: np.ndarray, index: dict[str, int], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Maximum likelihood of the document labels under noisy-or, by Adam over the whole sample."""
    docs = Coded(parts)
    theta = np.concatenate([np.full(len(index), 0.1), [-6.0, -4.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, slope = likelihood(theta, y, docs, penalty)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[-2:] = np.minimum(theta[-2:], -3.0)
    weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) >= 0.05}
    return Model(weights, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def sampled(docs: DataFrame, labels: DataFrame, may_teach: Column, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most sample labelled documents, those with the least md5 of their id; a row and its repeats are one document."""
    own = labels.where(may_teach & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy(F.col("doc_id").alias("d_")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("chars", F.length("text"))
    there = rows.where(F.col("chars") <= SAMPLE_CHARS).select("doc_id", "h", "chars").join(own, F.col("doc_id") == F.col("d_")).drop("d_").distinct()
    by = [F.md5(F.col("doc_id").cast("string")), "doc_id", "h"]
    first = materialise(there.orderBy(*by).limit(sample), "sample")
    # running sums over at most sample rows
    total = F.sum("chars").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    first = first.withColumn("total", total).where(F.col("total") <= SAMPLE_TOTAL).select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "toxic")
    texts = rows.join(F.broadcast(first), (F.col("doc_id") == F.col("d_")) & (F.col("h") == F.col("h_")))
    return materialise(texts.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "taught")


def learn(docs: DataFrame, labels: DataFrame, may_teach: Column, sample: int = SAMPLE) -> Model:
    """Fit on sampled() documents of those that may_teach, an expression of doc_id, admits.

    Texts stay on the executors, which count features and then turn sentences into numbers of the chosen ones.
    """
    texts = sampled(docs, labels, may_teach, sample)
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        discard(texts)
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = in_documents(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in (0, 1))], names=["f", "b", "a"])

    counts = texts.mapInArrow(count, "f string, b long, a long").groupBy("f").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    share = (F.col("a") + F.col("b")) / (n[0] + n[1])
    chi = F.pow(F.col("a") - n[1] * share, 2) / (n[1] * share) + F.pow(F.col("b") - n[0] * share, 2) / (n[0] * share)
    best = counts.where((F.col("a") + F.col("b") >= LEAST_DOCS) & (share < 1) & (F.col("a") / n[1] > F.col("b") / n[0])).orderBy(chi.desc(), "f").limit(FEATURES)
    index = chosen([(r.f, r.b, r.a) for r in best.collect()], n[0], n[1])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            rows = [coded(t, index, known) for t in b.column(0).to_pylist()]
            columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([b.column(1), *columns], names=["toxic", "bare", "times", "length", "column"])

    rows = texts.mapInArrow(code, "toxic int, bare long, times binary, length binary, column binary").collect()
    rows.sort(key=lambda r: (r.toxic, r.bare, r.column, r.times, r.length))  # sums don't depend on the order of tasks
    parts = [(r.bare, np.frombuffer(r.times, np.uint32), np.frombuffer(r.length, np.uint32), np.frombuffer(r.column, np.uint16)) for r in rows]
    discard(texts)
    return fitted(parts, np.array([r.toxic for r in rows], int), index)


def score(docs: DataFrame, model: Model, offending: bool = False) -> DataFrame:
    """doc_id and score of every row; offending adds the sentences that score 0.5 or more."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    kept = (model.weights, model.bias, model.leak)
    sentence = pa.struct([("sentence", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*kept)
        for b in batches:
            texts = b.column(1).to_pylist()
            columns = [b.column(0), pa.array([own.score(t) for t in texts], pa.float64())]
            if offending:
                found = [[{"sentence": s, "score": p} for s, p in own.offending(t)] for t in texts]
                columns.append(pa.array(found, pa.list_(sentence)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "offending"][: len(columns)])

    schema = f"doc_id {kind}, score double" + ", offending array<struct<sentence: string, score: double>>" * offending
    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with docs' own columns."""
    kept = (model.weights, model.bias, model.leak)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*kept)
        for b in batches:
            yield b.filter(pa.array([own.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
