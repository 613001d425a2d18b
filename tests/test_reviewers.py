"""Answers of models: where their JSON object stands, what counts as an object, and how many tasks read them."""

from pyspark.sql import functions as F

from siftmill import tables
from siftmill.functions.requests import json_object
from siftmill.operators import reviewers
from siftmill.plans import registry

ANSWERS = {
    '{"a": 1}': '{"a":1}', ' \n{"a": 1}\t': '{"a":1}', "{}": "{}", "{": None, "": None, "text": None, '[{"a": 1}]': None, "{a}": None,
    '```json\n{"a": 2}\n```': '{"a":2}', '```\n {"a": 2} \n  ```': '{"a":2}', 'see {"a": 3} there': '{"a":3}', '{"a": 4} and': '{"a":4}', '{"a": 1} {"b": 2}': '{"a":1}',
}


def test_json_objects_in_answers(spark):
    """Ends of a text are told without a pattern that runs over it."""
    got = spark.createDataFrame([(k,) for k in ANSWERS], "t string").select("t", F.to_json(json_object(F.col("t"))).alias("j"))
    assert {r.t: r.j for r in got.collect()} == ANSWERS
    assert r"^\{.*\}$" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_an_object(spark):
    texts = {'{"source_path": 1}': True, "{}": True, '{"b": null}': True, "[]": False, "3": False, "null": False, '"{}"': False, "true": False}
    got = spark.createDataFrame([(k,) for k in texts], "t string").select("t", reviewers._is_object(F.parse_json("t")).alias("o"))
    assert {r.t: r.o for r in got.collect()} == texts


def test_answers_are_dealt_out(spark, monkeypatch):
    """The table of events is one file: its rows are dealt to tasks of bounded size."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    got = registry.queries()["llm_item_validation"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() == -(-spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() // 100)
