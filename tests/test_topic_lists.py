"""Topic groups ask every record of the log."""

from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.plans.module_queries import answer_lists
from corpusloom.session import table


def test_every_record_is_asked(spark, small):
    log = table(spark, small, "qa_log")
    want = {r["qa_id"] for r in log.filter(F.size(words(F.col("query"))) > 0).select("qa_id").collect()}
    assert {r["asked"] for r in answer_lists(spark, small).select("asked").distinct().collect()} == want and len(want) > 50
