from pyspark.sql import functions as F

from millrace.operators import recall


def test_facts_of_small_files_are_not_sent_to_the_driver(spark, tmp_path):
    spark.range(4000).select("id", F.lit("blue garden shade").alias("fact"), F.lit("Facts/Work").alias("folder")).write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    asked = spark.createDataFrame([(1, "blue gardens"), (2, "client meeting")], "query_id long, text string")
    for df in (recall.keyword_rank(asked, facts, 8), recall.pellets(asked, facts), recall.scatter(asked, facts)):
        df.collect()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert joins and any("strategy=merge" in line for line in joins)
