"""Topic groups take each text apart once, keep its terms out of the shuffles, and equal the groups of the overlaps."""

from collections import defaultdict

from pyspark.sql import functions as F
from test_scoring import shuffled_rows

from corpusloom.operators import topics as P
from corpusloom.plans.module_queries import answer_lists
from corpusloom.session import materialise, table


def test_groups_of_lists(spark, small):
    log = table(spark, small, "qa_log").dropDuplicates(["qa_id"]).select("qa_id", "query", "answer_excerpt")
    odd = spark.createDataFrame([(900_001, None, None), (900_002, "pool of max_connections", None), (900_003, "which pool of max_connections", ""), (900_004, "", "시작 pool max_connections")], log.schema)
    log = materialise(log.union(odd), "log")
    lists = answer_lists(spark, small).union(spark.createDataFrame([(7, 900_001, 12), (7, 900_002, 11), (7, 900_003, 13), (7, 900_004, 13), (7, 900_003, 14), (None, 900_002, 1), (None, 900_003, 2)], "asked long, qa_id long, rank int"))
    lists = materialise(lists, "lists")
    names = "asked", "qa_id", "rank", "query", "answer_excerpt"
    before = shuffled_rows(spark)
    got = {(r[0], r[1]): r[2] for r in P.topic_groups(lists, *names, records=log).collect()}
    assert shuffled_rows(spark) - before < 4 * (lists.count() + log.count())

    texts = lists.join(log, "qa_id")
    assert got == {(r[0], r[1]): r[2] for r in P.topic_groups(texts, *names).collect()}
    same = {(r[0], r[1], r[2]) for r in P.topic_overlap(texts, "asked", "qa_id", "query", "answer_excerpt").filter("same").select("asked", "a", "b").collect()}
    want, groups = {}, defaultdict(list)
    for rank, item, key in sorted(((r[2], r[1], r[0]) for r in lists.groupBy("asked", "qa_id").agg(F.min("rank")).collect()), key=lambda r: r[:2]):
        at = next((i for i, g in enumerate(groups[key]) if all((key, *sorted((m, item))) in same for m in g)), len(groups[key]))
        groups[key][at:] = groups[key][at:] or [[]]
        groups[key][at].append(item)
        want[key, item] = at
    assert got == want and max(got.values()) > 1 and len(same) > 50
