import hashlib
import re

import corpus_pipeline
from docscore.llm import bpe, toxicity
from tests.llm.test_decontam import brute as brute_contaminated
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    library = Tokenizer.from_file(bpe.default_tokenizer())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        stage(spark, now, SF).write.parquet(path := str(tmp_path / name))
        now = spark.read.parquet(path)
        if k < 4:
            assert now.columns == columns
            kept = {r["doc_id"] for r in now.collect()}
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            said = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
            assert kept == {d for d, p in said.items() if not p}
        elif name == "exact_dedup":
            last = {}
            for d, t in before:
                low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
                last[low] = max(last.get(low, -1), d)
            assert kept == set(last.values())
        elif name == "simhash_near_dedup":
            assert kept == {c for _, _, c in brute_components(before)}
        elif name == "decontamination":
            assert kept == {d for d, _ in before} - {d for d, _ in brute_contaminated(before, items)}
        else:
            got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in now.collect()}
            want = {}
            for d, t in before:
                ids = library.encode(t or "", add_special_tokens=False).ids
                want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert got == want
    assert corpus_pipeline.run(spark, SF).count() == now.count()


def test_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for frame, most in ((docs, 4), (docs.limit(0), 0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.count() <= most


def test_long_texts_null_ids_and_clashing_columns_go_through(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    long = " ".join(f"w{k * k % 9973}" for k in range(200_000))
    rows = [(None, f"leaked {item} here", 1, 2), (None, "a clean text without an id", 3, 4), (7, long, 5, 6), (8, long.upper(), 7, 8), (9, "one more clean text that stays", 9, 10)]
    now = spark.createDataFrame(rows, "doc_id long, text string, __row long, __text long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == ["doc_id", "text", "__row", "__text"]
    kept = sorted((tuple(r) for r in now.collect()), key=lambda r: r[2])
    # of the two long texts, equal but for case, the larger id stays
    assert kept == [rows[1], rows[3], rows[4]]
    assert sorted(r["n_tokens"] > 0 for r in corpus_pipeline.encode(spark, now, SF).collect()) == [True] * 3
