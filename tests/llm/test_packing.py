import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from vetloom.llm.packing import Packer, pack, powers_of_two

PATH = P.path("word_bpe_49k.json")


def test_packer_is_exact_and_tight():
    rng = random.Random(1)
    for seed in range(20):
        closed = []
        packer = Packer(64, closed.append)
        docs = [np.arange(rng.choice([1, 2, 5, 30, 63, 64, 65, 130, 500]), dtype="u2") + k for k in range(seed * 5)]
        for k, ids in enumerate(docs):
            packer.add(k, ids)
        packer.drain()
        sizes = [sum(len(p[2]) for p in s) for s in closed]
        assert all(n == 64 or n & (n - 1) == 0 for n in sizes)
        seen = sorted((d, start, len(ids)) for s in closed for d, start, ids, _ in s)
        for k, ids in enumerate(docs):
            at = 0
            for d, start, n in (x for x in seen if x[0] == k):
                assert start == at
                at += n
            assert at == len(ids)
        for s in closed:
            for d, start, ids, _ in s:
                assert list(ids) == list(docs[d][start : start + len(ids)])


def test_level_is_least_sum_of_squares():
    rng = np.random.default_rng(4)
    for _ in range(200):
        packer = Packer(16, None)
        packer.count[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def after(level):
            n = packer.count.copy()
            n[16] = 0
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return (n[:16] ** 2).sum()

        levels = [0, *(h for h in range(1, 17 - size) if packer.count[h] > 0)]
        assert after(packer.level(size)) == min(map(after, levels))


def test_rows(spark):
    texts = [None, "", "Hello world", "Hello world", "a " * 9000, "x<|endoftext|> y"]
    docs = spark.createDataFrame([(i or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    library = Tokenizer.from_file(PATH)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    got = pack(docs, PATH, keep_ids=True).collect()
    assert sum(r.length for r in got) == sum(map(len, ids))
    by_sequence = {}
    for r in got:
        own = ids[r.doc_id or 0]
        assert r.doc_tokens == len(own) and r.ids == own[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert pack(docs.limit(0), PATH).count() == 0


def test_powers():
    out = list(powers_of_two([(0, 0, np.arange(13), 13)], 13))
    assert [[len(p[2]) for p in s] for s in out] == [[8], [4], [1]]
