"""A key that holds most rows is split over tasks, where a table meets an aggregate of itself."""

import pytest
from pyspark.sql import functions as F

from kinshelf.operators import features, similarity
from kinshelf.session import cut_lineage

LOW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def low_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tokens(spark):
    rows = spark.range(6000).repartition(4)
    words = F.when(F.col("id") % 10 < 7, F.array(F.lit("same"))).otherwise(
        F.array(F.lit("same"), F.concat(F.lit("word"), F.col("id").cast("string")))
    )
    return rows.select(F.col("id").alias("doc_id"), words.alias("tokens"))


def test_copies(low_thresholds, tokens):
    folded = features.fold_copies(tokens)
    assert "skew=true" in final_plan(folded)
    assert folded.select("rep").distinct().count() == 1801


def test_vectors(low_thresholds, tokens):
    vectors = features.tfidf_vectors(tokens)
    assert "skew=true" in final_plan(vectors.select("doc_id", "term"))


def test_entries(low_thresholds, tokens):
    vectors = cut_lineage(features.tfidf_vectors(tokens))
    df = similarity.term_frequencies(vectors, [])
    joined = vectors.join(df, "term")
    assert "skew=true" in final_plan(joined.select("doc_id", "df"))
