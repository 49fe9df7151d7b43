"""Token counts by byte-pair merging with a heap and a linked list.

A word starts as one symbol a byte, chained in a linked list. A heap holds every adjacent
pair that has a rank; the pair of lowest rank (leftmost on ties) is popped and joined until
no ranked pair is left. The word's count is its symbols at the start minus the joins made;
identifiers are never looked up.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that repeat are counted
one by one; a null doc_id is kept; other columns of the input are ignored, whatever their
names; an empty table gives an empty table. Texts are processed whole, in time proportional
to n log n of the longest run without a space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a text whose counts a worker keeps, in two generations of this size.
REMEMBERED = 700_000
#: A space with white space on both sides, or before it at the end, belongs to a longer run of white space.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Words longer than this are counted each time and not kept.
LONGEST_KEPT = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Merges:
    """A vocabulary's pairs. Symbols are numbered; a pair's key is both numbers in one integer."""

    def __init__(self, pairs: list[tuple[str, str]]):
        alphabet = byte_alphabet()
        number = {c: i for i, c in enumerate(alphabet)}
        self.rank: dict[int, int] = {}
        self.left, self.right, self.whole = [], [], []
        for rank, (a, b) in enumerate(pairs):
            x, y = (number.setdefault(s, len(number)) for s in (a, b))
            self.left.append(x)
            self.right.append(y)
            self.whole.append(number.setdefault(a + b, len(number)))
            self.rank.setdefault(x << 32 | y, rank)

    def needed(self, raw: bytes) -> int:
        """Joins that byte-pair merging makes on one word of bytes."""
        n = len(raw)
        if n < 2:
            return 0
        rank, left, right = self.rank.get, self.left, self.right
        symbols = list(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)  # what follows the last symbol joins with nothing
        # an entry is a rank and, in its low bits, the place of the pair's left symbol
        heap = [r << 32 | i for i, a, b in zip(range(n), raw, raw[1:]) if (r := rank(a << 32 | b)) is not None]
        heapify(heap)
        joins = 0
        while heap:
            x = heappop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            j = after[i]
            if symbols[i] != left[r] or symbols[j] != right[r]:
                continue  # one of the two has been joined to another symbol meanwhile
            joins += 1
            new = symbols[i] = self.whole[r]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 32 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 32 | new)) is not None:
                heappush(heap, r << 32 | h)
        return joins


class Counter:
    """Counts tokens of texts under one byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]])
        self.words = regex.compile(pattern)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.kept.get(word)
        if n is None:
            raw = word.encode("utf-8", "surrogatepass")
            n = len(raw) - self.merges.needed(raw)
            if len(word) <= LONGEST_KEPT:
                if len(self.kept) >= REMEMBERED:
                    self.kept.clear()
                self.kept[word] = n
        return n

    def _run(self, run: str) -> int:
        """Tokens of what stands between two spaces, with the space before it."""
        n = self.young.get(run)
        if n is None:
            n = self.old.get(run)
            if n is None:
                n = sum(map(self.word, self.words.findall(run)))
            if len(run) > LONGEST_KEPT:
                return n
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[run] = n
        return n

    def plain(self, text: str) -> int:
        """A space starts a word, so a text falls apart at its spaces, but not inside a run of white space."""
        if not text:
            return 0
        if _INNER_SPACE.search(text):
            return sum(map(self.word, self.words.findall(text)))
        first, *rest = text.split(" ")
        young, run = self.young.get, self._run
        total = run(first) if first else 0
        for piece in rest:
            piece = " " + piece
            n = young(piece)
            total += run(piece) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@cache
def counter(path: str, pattern: str) -> Counter:
    """One for each vocabulary and worker; what it remembers outlives a task."""
    return Counter(path, pattern)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, UTF-8 bytes and tokens under the vocabulary file. Needs no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary, pattern)
        for batch in batches:
            tokens = pa.array([own.count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
