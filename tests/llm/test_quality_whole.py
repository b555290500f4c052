"""Quality rules over every trusted row, and what they keep of each language."""

from collections import Counter

from pyspark.sql import functions as F

from tideline.llm import quality


def test_quality_loses_poor_documents_of_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.quality_rules(docs, labels).select("doc_id", "lang", "kept", "base_failed").join(labels, "doc_id").where("NOT base_failed")
    n, kept = Counter(), Counter()
    for r in judged.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect():
        n[r["lang"], r["quality"]], kept[r["lang"], r["quality"]] = r["n"], r["kept"]
    assert {lang for lang, _ in n} == {"de", "en", "es", "fr"}
    for lang, good in n:
        if good:
            assert kept[lang, 1] >= 0.99 * n[lang, 1]
        else:
            assert kept[lang, 0] <= 0.1 * n[lang, 0]


def test_quality_trusts_every_labelled_row(spark):
    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels.union(labels)).count() == 25_000


def test_quality_stage_returns_the_columns_of_its_input(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1)).withColumn("_judged", F.lit(2))
    after = quality.stage(spark, docs, sf)
    assert after.dtypes == docs.dtypes and 0 < after.count() < docs.count()
    assert after.where("kept = 'mine' AND n_words = -1 AND _judged = 2").count() == after.count()
    again = quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert again.where("kept").count() == after.count() and again.where("n_words = -1").count() == 0
