"""The pipeline over a small table, stage by stage, and how the driver finds it."""

from __future__ import annotations

import corpus_pipeline
import pytest

from cohortry.llm import queries

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    columns = docs.columns
    rows = docs.where("doc_id < 150").unionByName(docs.where("doc_id = 3"))
    before = rows.count()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == columns, name
        assert 0 < rows.count() <= before
        before = rows.count()
    assert rows.groupBy("doc_id").count().where("count > 1").count() == 0
    packed = corpus_pipeline.pack(spark, rows, SF)
    assert packed.select("doc_id").distinct().count() == rows.count()


def test_decisions_take_effect(spark, documents):
    text = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 500 and 900 and lang = 'en'").orderBy("doc_id").take(2)]
    rows = [(1, clean[0]["text"]), (2, clean[0]["text"]), (3, "12 34 !!"), (4, clean[1]["text"] + " " + text), (5, None)]
    docs = documents(*rows)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(corpus_pipeline.keep_known_languages(spark, docs, SF)) == [1, 2, 4]
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, SF)) == [1, 3, 4, 5]
    assert ids(corpus_pipeline.drop_leaks(spark, docs, SF)) == [1, 2, 3, 5]


def test_near_duplicates_from_a_similarity_of_080_on(documents, spark):
    shared = [f"w{i}" for i in range(84)]
    # 80 shared shingles of 98 (0.816), and of 104 (0.769).
    rows = [(1, " ".join(shared + [f"a{i}" for i in range(9)])), (2, " ".join(shared + [f"b{i}" for i in range(9)])),
            (3, " ".join(shared[::-1] + [f"a{i}" for i in range(12)])), (4, " ".join(shared[::-1] + [f"b{i}" for i in range(12)]))]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(*rows), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_tables_miss_as_little_at_080_as_at_085():
    from cohortry.llm.minhash_dedup import halves_for, missed

    assert halves_for(85) == 12 and missed(0.8, halves_for(80)) <= missed(0.85, 12) < 3e-4


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_a_query(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith(("op1_", "op2_"))))
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
