"""Token ids in Arrow stream files: record batches of fixed-size lists, read at random without copying.

A file holds one stream of ids, the documents of a range of doc_id one after another, each with
an end id, cut into sequences of equal length. Batches have a fixed number of sequences, so the
place of a sequence is found by division; a memory-mapped file gives any sequence as a view.
Columns: ids, a fixed-size list of unsigned integers (16 bits where the vocabulary allows it),
and mask, a fixed-size list of booleans, false on the padding at the end of a file.

Writing sorts the documents into ranges of doc_id, and each task writes one file under a name of
its own in the shared folder and renames it when it is whole. The manifest, a row for each
document with its file and place, names the files of the tasks that succeeded, so files of lost or
repeated tasks are never read.

Defined results: null and empty texts are the end id alone; a null doc_id comes before all
others; rows with the same doc_id are all written, side by side; other columns are ignored,
whatever their names; an empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.llm.encoding import batches_of, encoder
from vetloom.session import materialise, scratch_path

LENGTH = 2048
BATCH = 512
END_ID = 2


class SequenceWriter:
    """Writes a stream of ids as sequences of equal length to one file."""

    def __init__(self, url: str, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.fs, self.path = pafs.FileSystem.from_uri(url)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.kind, self.dtype, self.length, self.batch = kind, dtype, length, batch
        self.schema = pa.schema(
            [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "batch": str(batch)}
        )
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.sink = self.fs.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.held_ids = self.total = 0

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:used] = True
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def add(self, ids: bytes) -> int:
        """Append one document; returns the ids before it in this file."""
        start = self.total
        n = len(ids) // self.dtype.itemsize
        self.held.append(ids)
        self.held_ids += n
        self.total += n
        size = self.length * self.batch
        if self.held_ids >= size:
            every = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(every) // size * size
            for i in range(0, whole, size):
                self._write(every[i : i + size], size)
            self.held, self.held_ids = [every[whole:].tobytes()], len(every) - whole
        return start

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        self.out.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


class SequenceReader:
    """Random access to one file. On a local or mounted path the file is memory-mapped and nothing is copied."""

    def __init__(self, url: str):
        fs, path = pafs.FileSystem.from_uri(url)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        about = self.file.schema.metadata
        self.length, self.batch = int(about[b"length"]), int(about[b"batch"])
        self.at, self.ids = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.ids = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.ids

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i; the ids are a view."""
        k, j = divmod(i, self.batch)
        mask = self.file.get_batch(k).column(1)
        return self._batch(k)[j * self.length : (j + 1) * self.length], mask[j].values.to_numpy(zero_copy_only=False)

    def stretch(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of n ids from start on, one a batch touched."""
        size = self.length * self.batch
        while n > 0:
            k, j = divmod(start, size)
            view = self._batch(k)[j : j + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_files(docs: DataFrame, folder: str, vocabulary: str, length: int = LENGTH, batch: int = BATCH, end_id: int = END_ID) -> DataFrame:
    """Write docs to files in folder; the manifest: doc_id, file, shard, local_start, n_tokens, materialised."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(vocabulary)
        end = np.array([end_id], own.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        url = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.arrow"
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            out = out or SequenceWriter(url, own.dtype, length, batch)
            texts, starts, counts = b.column(1).to_pylist(), [], []
            for i, j in batches_of(texts):
                for ids in own.encode(texts[i:j]):
                    starts.append(out.add(ids + end))
                    counts.append(out.total - starts[-1])
            n = b.num_rows
            columns = [b.column(0), pa.array([url] * n), pa.array([shard] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "shard", "local_start", "n_tokens"])
        if out:
            out.close()  # before the task ends; if this fails, the task does and its rows are not kept

    schema = f"doc_id {kind}, file string, shard int, local_start long, n_tokens long"
    return materialise(rows.mapInArrow(run, schema), "manifest")


def read_digest(manifest: DataFrame) -> DataFrame:
    """What the files of a manifest hold: doc_id, start over all files in order, n_tokens and the crc32 of the ids as 32 bits each."""
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_tokens").over(earlier), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            sums = []
            for url, start, n in zip(*(b.column(k).to_pylist() for k in (1, 3, 4))):
                if url != name:
                    name, reader = url, SequenceReader(url)
                crc = 0
                for view in reader.stretch(start, n):
                    crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                sums.append(crc)
            columns = [b.column(0), b.column(2), b.column(3), b.column(4), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    kind = dict(manifest.dtypes)["doc_id"]
    read = manifest.mapInArrow(run, f"doc_id {kind}, shard int, local_start long, n_tokens long, ids_crc32 long")
    return read.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write docs to files in the shared folder and give the digest read back from them."""
    return read_digest(write_files(docs, scratch_path(docs.sparkSession, "idfiles"), vocabulary, **options))
