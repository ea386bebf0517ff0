"""What Python workers keep from one stage to the next."""

from ferrule.llm import decontam, quality


def test_word_caches_are_a_few_megabytes():
    assert decontam._code.cache_info().maxsize <= 1 << 15 and quality._code.cache_info().maxsize <= 1 << 15


def test_stages_bound_the_batches_of_python_workers(spark):
    import corpus_pipeline as cp

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "some words", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars int")
    try:
        for asked, held in (("10000", "500"), ("0", "500"), ("100", "100")):
            spark.conf.set(name, asked)
            cp.quality_classifier(spark, docs, "")
            assert spark.conf.get(name) == held
    finally:
        spark.conf.unset(name)
