"""Scores are a function of the tables, not of how they are dealt."""

from pyspark.sql import functions as F

from tidemark.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_partitioning_does_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = []
    for n, by in ((1, "doc_id"), (7, "text")):
        dealt = docs.repartition(n, by).sortWithinPartitions(F.desc(by))
        model = toxicity.fit(dealt, labels.repartition(n).sortWithinPartitions(F.desc("doc_id")))
        assert model.weights.any()
        found.append(sorted(toxicity.score(dealt, model).collect()))
    assert found[0] == found[1]
