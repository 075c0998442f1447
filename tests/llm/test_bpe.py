import hashlib
import random

import pytest
from tokenizers import Tokenizer

from docscore.llm import bpe

PATH = bpe.default_tokenizer()
LETTERS = "abcdehilnorst  \n\t'sld012٣三éßñ\x1c\x1f\x85 ​　😀ẞ\x00_-"


def texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    return [*made, "", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "x" * 4000, "ab" * 2000, " " * 900, "\n" * 300 + "a", "don't we'll 'S"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_text_as_the_library(library):
    encoder = bpe.Encoder(bpe.load_tables(PATH), cache_words=500)
    for text, slices in zip(texts(), encoder.encode_many(texts()), strict=True):
        ids = [i for s in slices for i in s]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_compatibility_is_exact():
    tables = bpe.load_tables(PATH)
    rnd = random.Random(4)
    words = list(tables.reachable)
    pairs = [(tables.reachable[a], tables.reachable[b]) for a, b in ((rnd.choice(words), rnd.choice(words)) for _ in range(4000))]
    pairs += [(tables.reachable[b"a"], tables.reachable[b"a"])]
    import numpy as np

    got = tables.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [tables.exact(tables.bytes_of[a] + tables.bytes_of[b]) == [a, b] for a, b in pairs]


def test_long_exact_merge_equals_short_rule():
    tables = bpe.load_tables(PATH)
    word = b"aaaaabababnationnationthethe" * 4
    ids = [tables.byte_id[b] for b in word]
    slow = list(ids)
    while True:
        best = min((tables.merge[p][0], k) for k, p in [(k, p) for k, p in enumerate(zip(slow, slow[1:])) if p in tables.merge] or [(0, None)] if p) if any(p in tables.merge for p in zip(slow, slow[1:])) else None
        if best is None:
            break
        k = best[1]
        slow[k : k + 2] = [tables.merge[(slow[k], slow[k + 1])][1]]
    assert tables._exact_long(ids) == slow


def test_streaming_slices(monkeypatch, library):
    monkeypatch.setattr(bpe, "STREAM_CHARS", 50)
    monkeypatch.setattr(bpe, "STREAM_WORDS", 3)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 40)
    encoder = bpe.Encoder(bpe.load_tables(PATH))
    for text in texts()[::5]:
        assert [i for s in encoder.encode(text) for i in s] == library.encode(text, add_special_tokens=False).ids


def test_round_trip_query_shape(spark, library):
    rows = [(1, None, 0), (2, "", 1), (2, "", 1), (None, "Hello  world\n", 2), (3, "a" * 300_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = {(r["doc_id"], r["n_tokens"]): r for r in bpe.round_trip(docs, PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[(1, 0)]["ids_sha256"] == out[(2, 0)]["decoded_sha256"] == empty
    ids = library.encode("Hello  world\n", add_special_tokens=False).ids
    assert out[(None, len(ids))]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert all(r["lossless"] for r in out.values())
    encoded = bpe.encode_documents(docs, PATH)
    again = sorted(r["text"] for r in bpe.decode_documents(encoded, PATH).collect())
    assert again == sorted(t or "" for _, t, _ in rows)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
