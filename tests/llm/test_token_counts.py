from tokenizers import Tokenizer

from docscore.llm import bpe, token_counts
from tests.llm.test_bpe import texts

PATH = bpe.default_tokenizer()


def test_counts_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_counts.bpe, "CACHE_WORDS", 200)
    library = Tokenizer.from_file(PATH)
    rows = [(k, t, 1) for k, t in enumerate(texts())] + [(-1, None, 1), (None, "dup", 1), (None, "dup", 1), (-2, "long " * 400_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, PATH).collect()), key=repr)
    want = []
    for d, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)


def test_small_cache_and_slices(monkeypatch):
    library = Tokenizer.from_file(PATH)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 30)
    tables = bpe.load_tables(PATH)
    some = texts()[::7]
    first = {w: len(ids) for w, ids in tables.encode_words(["the", " the", "Ġthe", " unbelievably"]).items()}
    counter = token_counts.Counter(tables, first, cache_words=5)
    assert list(counter.count_many(some)) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_empty_table(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_the_first_tier_is_measured(spark):
    tables = bpe.load_tables(PATH)
    docs = spark.createDataFrame([(k, "zyxwvutq zyxwvutq common words " + f"rare{k}") for k in range(300)] + [(None, None)], "doc_id long, text string")
    first = token_counts.frequent(docs, tables, rows=200, most=4)
    library = Tokenizer.from_file(PATH)
    # all are as frequent; of equal ones the first by order of code points
    assert set(first) == {" common", " rare", " words", " zyxwvutq"}
    assert first[" zyxwvutq"] == len(library.encode(" zyxwvutq", add_special_tokens=False).ids) > 1
    assert token_counts.frequent(docs.limit(0), tables) == {}


def test_results_do_not_depend_on_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    want = sorted(tuple(r) for r in token_counts.token_counts(docs, PATH).collect())
    monkeypatch.setattr(token_counts, "frequent", lambda *_: {})
    assert sorted(tuple(r) for r in token_counts.token_counts(docs, PATH).collect()) == want
