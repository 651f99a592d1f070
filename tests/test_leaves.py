"""Leaves of nested values, against a plain walk."""

import json

from pyspark.sql import functions as F

from tracefold.plans.derived import event_rows
from tracefold.plans.queries import QUERIES, _leaves

SF = "/root/testdata/sf0.001"


def walk(path: str, v):
    if isinstance(v, dict):
        return [x for k, y in v.items() for x in walk(f"{path}.{k}", y)]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in walk(f"{path}[{i}]", y)]
    return [(path, json.dumps(v, ensure_ascii=False))]


def test_all_events_are_walked(spark):
    rows = event_rows(spark, SF).select("event_id", "k", "user_id", "event_type").collect()
    want = sorted((r["event_id"], *x) for r in rows for x in walk("$", {"k": r["k"], "a": {"b": [r["user_id"], r["k"]], "event_type": r["event_type"]}}))
    assert sorted(map(tuple, QUERIES["variant_recursive_paths"](spark, SF).collect())) == want


def test_limits_of_recursion_do_not_hold(spark):
    values = [None, "oops", "[]", "{}", "7", "null", '{"a":[1,{"b":[[true],"x"]}],"c":{}}', "[" * 12 + "1" + "]" * 12]
    rows = spark.createDataFrame(list(enumerate(values)), "event_id long, t string").select("event_id", F.try_parse_json("t").alias("v"))
    want = sorted((i, *x) for i, t in enumerate(values) if t not in (None, "oops") for x in walk("$", json.loads(t)))
    old = spark.conf.get("spark.sql.cteRecursionRowLimit"), spark.conf.get("spark.sql.cteRecursionLevelLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 3)
    spark.conf.set("spark.sql.cteRecursionLevelLimit", 3)
    try:
        assert sorted(map(tuple, _leaves(spark, rows).collect())) == want
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old[0])
        spark.conf.set("spark.sql.cteRecursionLevelLimit", old[1])
