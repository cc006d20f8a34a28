import corpus_pipeline
from logloom.llm import toxicity


def test_stages_take_effect_and_keep_columns(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{folder}/odd")
        assert docs.columns == odd.columns, name
    ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    assert 8 not in ids and 1 in ids and 2 not in ids and 3 not in ids


def test_documents_stay_where_no_language_is_known(spark, folder, odd):
    unknown = odd.drop("lang").selectExpr("*", "cast(null AS string) AS lang").select(odd.columns)
    got = corpus_pipeline.keep_languages(spark, unknown, f"{folder}/odd")
    assert got.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 4, 5, 6, 6, 7, 8]


def test_pipeline_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_toxic_and_copied_documents_go(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf)
    left = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, model).filter("score >= 0.5").collect()}
    assert not toxic & left and 0.5 * docs.count() < len(left) < docs.count()


def test_columns_with_dots_stay(spark, folder, odd):
    dotted = odd.withColumnRenamed("score", "a.b")
    kept = corpus_pipeline.drop_near_duplicates(spark, dotted, f"{folder}/odd")
    assert kept.columns == dotted.columns and kept.count() > 5
