"""What a response's parsing costs: each value is found once, however many checks name it."""

import re

from pyspark.sql import functions as F

from newsloom.functions import responses
from newsloom.operators import stories


def test_a_response_is_opened_once(spark):
    df = spark.createDataFrame([("x",)], "x string").select(responses.parse_summary(F.col("x")).alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json|jsontostructs", plan)) < 40 and plan.count("get_json_object") < 60


def test_newest_articles_are_ranked_without_their_texts(spark):
    a = spark.range(30).select("id", F.lit("active").alias("status"), F.timestamp_micros(F.col("id") % 7).cast("timestamp_ntz").alias("published_at"), F.repeat(F.lit("t"), 9).alias("summary_raw"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("clean_text"))
    m = spark.range(60).select((F.col("id") % 3).alias("cluster_id"), (F.col("id") / 2).cast("long").alias("article_id"))
    top = stories.newest_articles(m, a, 4)
    assert "summary_raw" in top.columns and top.count() == 12
    assert "summary_raw" not in stories.newest_ids(m, a, 4).columns
