import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, docs, rows):
    d = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, *_ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    item = " ".join(rows[6][1].split()[50:75])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_keep_clean_documents_and_drop_what_they_look_for(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    texts = {r[0]: r[1] for r in rows}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        ids = [r["doc_id"] for r in out.collect()]
        if n == 0:
            assert len(ids) == before
        if n == 1:
            assert len(ids) == len({t or "" for _, t, *_ in rows})
            assert 2 in ids and 1 not in ids and 8 in ids and 7 not in ids
        if n == 2:
            assert 2 in ids and 3 not in ids
        if n == 3:
            assert 8 not in ids and 2 in ids
        docs = out
    assert all(texts.get(i) for i in ids if i is not None)


def test_run_is_the_stages_in_turn(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "taken"} <= set(got.columns)
    assert corpus_pipeline.ORACLE_SQL is None


def test_no_stage_fails_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_queries_run_on_the_entry_tables(spark, sf_dir):
    from ripplemark.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
