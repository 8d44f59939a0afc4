"""The pipeline on a small folder of tables, stage by stage and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOC, brute_links, words


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    passage = words(rng, 25)
    clean = [words(rng, 60) for _ in range(6)]
    texts = [*clean, clean[0], clean[1] + " tail", "too short", "a b c d e " * 20, clean[2].upper() + " " + passage, None, words(rng, 40) + " mail x.y@z.example.com"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return f"{tmp_path}", texts


def test_stages(spark, folder):
    import corpus_pipeline

    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), "t")
        assert docs.columns == [c.split()[0] for c in DOC.split(", ")]
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == {0, 1, 2, 3, 4, 5, 6, 7, 10, 12}
    links = brute_links([texts[i] if i in seen[0] else None for i in range(len(texts))])
    assert set(seen[1]) == {i for i in seen[0] if links[i][0] == i} == {0, 1, 2, 3, 4, 5, 10, 12}
    assert set(seen[2]) == {0, 1, 2, 3, 4, 5, 12} == set(seen[3])
    assert "<EMAIL>" in seen[3][12].text and seen[3][12].n_chars == len(seen[3][12].text)
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(packed.doc_id) == set(seen[3])


CLASHES = ("_once", "again", "gone", "bad", "row", "rep", "first", "judged", "kept", "whole", "found", "base", "spans", "sequence_id", "length", "key", "item", "id", "chunk")


def test_stages_edge_cases(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties of doc_id, clashing columns; then an empty table."""
    import corpus_pipeline

    rng = random.Random(22)
    good = lambda n: f"the and of to {words(rng, n)} with the rest of it"
    passage, own = words(rng, 25), good(60)
    long = " ".join(f"the w{i}x{rng.randrange(10**6)}" for i in range(3_000))
    rows = [(1, own), (1, own), (1, good(50)), (2, own), (None, good(50)), (None, None), (3, ""), (4, long), (5, long + " end"), (6, f"{good(20)} {passage}"), (7, None)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(c))
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts, columns = [], docs.columns
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, f"{tmp_path}"), "t")
        assert docs.columns == columns and docs.where("again <> 'again' or kept <> 'kept' or base <> 'base'").count() == 0
        counts.append(docs.count())
    assert counts == [8, 5, 4, 4] and docs.where("doc_id is null").count() == 1 and {r.doc_id for r in docs.collect()} == {None, 1, 4}
    packed = corpus_pipeline.packing_stage(spark, docs, f"{tmp_path}").toPandas()
    assert packed.length.sum() == packed.groupby(["doc_id", "doc_tokens"], dropna=False).first().reset_index().doc_tokens.sum()
    nothing = docs.where("false")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, nothing, f"{tmp_path}").count() == 0
