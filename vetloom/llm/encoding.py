"""Whole texts to token ids with the tokenizers library, each distinct run of a text encoded once.

The library is slow on running text but a run between two spaces always gets the same ids, so
the runs of a batch are encoded by the library once each, kept as bytes, and joined. A vocabulary
whose words begin with their space needs care: texts where a space lies inside a longer run of
white space, or that hold a special string, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs that a worker keeps, in two generations of this size.
REMEMBERED = 700_000
LONGEST_KEPT = 64
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Encodes texts under one vocabulary file of the tokenizers library, without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        white = json.dumps(spec.get("normalizer"))
        #: True where white space is dropped, so that a space only parts words.
        self.parts = "\\\\s+" in white and '"ByteLevel", "add_prefix_space": false' in json.dumps(spec["pre_tokenizer"]) and spec["pre_tokenizer"]["type"] == "Sequence"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.young: dict = {}
        self.old: dict = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = []
        for i in range(0, len(texts), 20_000):
            part = self.library.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)
            found += [array(self.code, e.ids).tobytes() for e in part]
        return found

    def _runs(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct runs, from memory where they are there."""
        new = [r for r in runs if r not in self.young]
        found = {r: self.old[r] for r in new if r in self.old}
        fresh = [r for r in new if r not in found]
        found.update(zip(fresh, self._library(fresh)))
        out = [self.young[r] if r in self.young else found[r] for r in runs]
        if len(self.young) + len(found) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update((r, ids) for r, ids in found.items() if len(r) <= LONGEST_KEPT)
        return out

    def _whole(self, text: str) -> bool:
        """Whether a text cannot be taken apart at its spaces."""
        return not self.parts and (bool(_INNER_SPACE.search(text)) or any(s in text for s in self.special))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        out: list = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and self._whole(t)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]) if whole else []):
            out[i] = ids
        skip = set(whole)
        apart = [i for i, t in enumerate(texts) if t and i not in skip]
        if not apart:
            return out
        # runs are numbered, looked up once each, and put in the place of their numbers
        runs = pc.split_pattern(pa.array([texts[i] for i in apart], pa.large_string()), " ")
        starts = runs.offsets.to_numpy()
        numbered = runs.values.dictionary_encode()
        distinct, place = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        if self.parts:
            ids = self._runs(distinct)
        else:  # a run has its space before it, but for a text's first
            first = starts[:-1]
            place = place.astype(np.int64)
            heads, at = np.unique(place[first], return_inverse=True)
            place[first] = len(distinct) + at
            ids = self._runs([" " + r for r in distinct]) + self._runs([distinct[k] for k in heads])
        joined = pa.array(ids, pa.large_binary()).take(pa.array(place))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = memoryview(joined.buffers()[2] or b"")
        ends = offsets[starts]
        for k, i in enumerate(apart):
            out[i] = bytes(data[ends[k] : ends[k + 1]])
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each vocabulary and worker; what it remembers outlives a task."""
    return Encoder(path)


def batches_of(texts: list, size: int = 8 << 20):
    """Slices of texts of about the given number of characters, at least one text each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
