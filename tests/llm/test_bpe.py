import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vetloom.llm.bpe import Counter, token_counts

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = Counter(PATH, P.PATTERN)


def theirs(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '.\n\té1日\xa0<|endoftext|>sl", max_size=40))
def test_counts_as_the_library(text):
    assert OWN.count(text) == theirs(text)


def test_long_runs_and_special_strings():
    rng = random.Random(3)
    for text in ["a" * 5000, "".join(rng.choice("abcdé") for _ in range(4000)), "x<|endoftext|><|endoftext|> y", "\n\n \n", " " * 99]:
        assert OWN.count(text) == theirs(text)


def test_rows(spark):
    texts = [None, "", "Hello  world", "Hello  world", "it's\r\n fine"]
    docs = spark.createDataFrame([(i if i else None, t, 7, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, id int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH, P.PATTERN).collect())
    assert got == [(i, len((t or "").encode()), theirs(t or "")) for i, t in enumerate(texts)]
    assert token_counts(docs.limit(0), PATH, P.PATTERN).count() == 0
