"""Sum-of-squares online packing of tokenised documents into windows of equal length.

A level array counts the partially filled windows at each fill level. A document goes to the
level where the sum of squares of those counts is least afterwards (a new window is level 0;
a window that becomes full is counted no more; on ties the fullest window is taken). Documents
of more than a window are cut into full windows first, and the rest is placed. When a partition
of the input ends, its partially filled windows are drained: the emptiest are cut up to fill
the fullest, and what is left of the last one is cut into sequences whose lengths are powers of
two, which need no padding.

Every partition packs its own documents, so nothing is shuffled and memory holds only open
windows. Sequence ids are the partition's number and a running number in it.

Defined results: null and empty texts are a document of one token, the end id; rows that
repeat are packed each; a null doc_id is kept; other columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.llm.encoding import batches_of, encoder

WINDOW = 4096
END_ID = 2
#: A piece: document, ids before it in the document, its ids, the document's length.
Piece = tuple


class Packer:
    """Windows of one stream of documents. close(pieces) is called for each finished sequence."""

    def __init__(self, window: int, close):
        self.window, self.close = window, close
        self.count = np.zeros(window + 1)
        self.count[window] = -0.5  # so that the formula below also holds for windows that become full
        self.open: dict[int, list[list[Piece]]] = {}

    def level(self, size: int) -> int:
        """The fill level to which a piece of this size goes."""
        at = self.count[1 : self.window - size + 1]
        change = np.where(at > 0, 2 * (self.count[size + 1 :] - at) + 2, np.inf)
        new = 2 * self.count[size] + 1
        if not len(change):
            return 0
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= new else 0

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.close([(doc, start, ids[start : start + self.window], len(ids))])
        if whole == len(ids):
            return
        piece = (doc, whole, ids[whole:], len(ids))
        size = len(ids) - whole
        fill = self.level(size)
        pieces = []
        if fill:
            pieces = self.open[fill].pop()
            self.count[fill] -= 1
        pieces.append(piece)
        fill += size
        if fill == self.window:
            self.close(pieces)
        else:
            self.open.setdefault(fill, []).append(pieces)
            self.count[fill] += 1

    def drain(self) -> None:
        """Close what is open: the emptiest windows are cut up to fill the fullest."""
        left = [(fill, pieces) for fill in sorted(self.open, reverse=True) for pieces in self.open[fill]]
        self.open, self.count[: self.window] = {}, 0
        low, high = 0, len(left) - 1
        fill, into = left[0] if left else (0, [])
        while low < high:
            donor_fill, donor = left[high]
            room = self.window - fill
            doc, start, ids, total = donor.pop()
            if len(ids) > room:
                donor.append((doc, start, ids[:-room], total))
                start, ids = start + len(ids) - room, ids[-room:]
            into.append((doc, start, ids, total))
            left[high] = (donor_fill - len(ids), donor)
            if not donor:
                high -= 1
            fill += len(ids)
            if fill == self.window:
                self.close(into)
                low += 1
                if low <= high:
                    fill, into = left[low]
        if low <= high and fill:
            for pieces in powers_of_two(into, fill):
                self.close(pieces)


def powers_of_two(pieces: list[Piece], fill: int) -> Iterator[list[Piece]]:
    """The pieces of one window as sequences whose lengths are the powers of two that add up to its fill."""
    pieces = pieces[::-1]
    for bit in reversed(range(fill.bit_length())):
        room = fill & (1 << bit)
        out = []
        while room:
            doc, start, ids, total = pieces.pop()
            if len(ids) > room:
                pieces.append((doc, start + room, ids[room:], total))
                ids = ids[:room]
            out.append((doc, start, ids, total))
            room -= len(ids)
        if out:
            yield out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence. keep_ids adds the ids themselves."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 40
        made: list[tuple] = []
        sequences = 0

        def close(pieces: list[Piece]) -> None:
            nonlocal sequences
            offset = 0
            for doc, start, ids, total in pieces:
                wide = ids.astype("<u4")
                row = (doc, start, len(ids), zlib.crc32(wide.tobytes()), total, base + sequences, offset)
                made.append(row + (wide.tolist(),) if keep_ids else row)
                offset += len(ids)
            sequences += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        packer = Packer(window, close)
        end = np.array([end_id], own.dtype).tobytes()
        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * keep_ids]
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                for doc, ids in zip(docs_[a:b], own.encode(texts[a:b])):
                    packer.add(doc, np.frombuffer(ids + end, own.dtype))
            if made:
                yield flush()
        packer.drain()
        if made:
            yield flush()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * keep_ids)
