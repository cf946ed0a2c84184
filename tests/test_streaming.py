"""Row-wise operators on a stream give what they give on a table."""

from pyspark.sql import functions as F

from wickerwork.functions.text import classify_first_match
from wickerwork.operators.evidence import evidence_tier
from wickerwork.operators.splits import structural_split


def curated(df):
    df = structural_split(df, "text", "doc_id").withColumn("tier", evidence_tier(F.col("text"), ["licensed"], ["license"], ["work"], ["under"]))
    rules = [{"any_of": ["licensed under"], "out": {"kind": "licence"}}]
    return classify_first_match(df, ["text"], rules, {"kind": "other"}).select("doc_id", "split", "tier", "kind")


def test_stream_equals_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        curated(stream)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(curated(docs).collect())
