"""What a task of the pipeline holds in Python workers."""

from pyspark.sql import functions as F

from websource_audit.llm import quality


def test_kept_texts_are_scored_once(spark, documents):
    """A second score in one task is a second Python worker for each core, and the texts once more."""
    docs = documents([f"word {k} of a text {'$#' * (k % 3)}" for k in range(30)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(30)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, F.col("source"), F.col("lang"))
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id for r in kept.collect()} == set(range(0, 30, 3))
