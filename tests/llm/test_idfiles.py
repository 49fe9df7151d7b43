import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from vetloom.llm.idfiles import SequenceReader, SequenceWriter, read_digest, write_files

PATH = P.path("byte_bpe_50k.json")


def test_writer_and_reader(tmp_path):
    url = f"file://{tmp_path}/x/a.arrow"
    out = SequenceWriter(url, np.dtype("<u2"), 8, 3)
    docs = [np.arange(n, dtype="<u2") for n in (1, 7, 100, 3, 0, 60)]
    starts = [out.add(d.tobytes()) for d in docs]
    out.close()
    reader = SequenceReader(url)
    for d, s in zip(docs, starts):
        assert list(np.concatenate([*reader.stretch(s, len(d)), np.zeros(0)])) == list(d)
    ids, mask = reader.sequence(21)  # 171 ids fill 21 sequences and 3 places
    assert mask.sum() == 3 and list(ids[:3]) == [57, 58, 59] and not ids.flags.owndata


def test_round_trip(spark, tmp_path):
    texts = [None, "", "Hello  world", "Hello  world", "it's <|endoftext|> fine " * 400]
    docs = spark.createDataFrame([(i or None, t, 1) for i, t in enumerate(texts)] + [(3, "twice", 1)], "doc_id long, text string, shard int")
    manifest = write_files(docs, f"file://{tmp_path}/ids", PATH, length=16, batch=4)
    library = Tokenizer.from_file(PATH)
    rows = [(i, t or "") for i, t in enumerate(texts)] + [(3, "twice")]
    at, want = 0, []
    for i, t in sorted(rows):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read_digest(manifest).collect())
    assert got == want
    assert read_digest(write_files(docs.limit(0), f"file://{tmp_path}/none", PATH)).count() == 0
