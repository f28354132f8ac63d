"""The stages of corpus_pipeline.py one after the other, each against what its operator decides."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD, check_pieces, copies, documents, sample, slow_components


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows = sample(8, 300) + [(5000 + i, t, lang, s) for i, t, lang, s in copies(5)[:60]] + ODD
    documents(spark, rows).withColumn("score", F.lit(1)).withColumn("key", F.lit("k")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "pack"]
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = kept.collect()
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        path = f"{sf_dir}/stage{k}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        after = kept.collect()
        assert 0 < len(after) <= len(before) and {str(r) for r in after} <= {str(r) for r in before}
        if k == 0:
            assert not {9001, 9002, 9003, 9004} & {r["doc_id"] for r in after}
            assert {r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] < 300} <= {r["doc_id"] for r in after}
        if k == 2:
            want = {c for _, n, c in slow_components([(r["doc_id"], r["text"]) for r in before]) if n}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.word_bpe())
    check_pieces(pieces, [(r["doc_id"], [*library.encode(r["text"], add_special_tokens=False).ids, 2]) for r in kept.collect()])
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in run.filter("start = 0").collect()) == sorted((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
