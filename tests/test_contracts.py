import json

import pytest
from pyspark.sql import functions as F

from lexivec import contracts

CASES = [
    ({"query": "x"}, []),
    ({"query": "x", "top_k": 3, "rewrite_strategies": ["hyde", "passthrough"], "filters": {"any": [1]}, "use_graph": False, "stream": True}, []),
    ({}, ["query: field required"]),
    ({"query": None}, ["query: string required"]),
    ({"query": 5, "top_k": "5"}, ["query: string required", "top_k: integer required"]),
    ({"query": "", "top_k": -1}, ["top_k: at least 0 required"]),
    ({"query": "", "top_k": 1.5}, ["top_k: integer required"]),
    ({"query": "", "top_k": 2.0}, []),
    ({"query": "", "rewrite_strategies": ["bad", 3]}, ["rewrite_strategies[0]: one of passthrough, multi_query, hyde, step_back, entity_expand required", "rewrite_strategies[1]: string required"]),
    ({"query": "", "z": 1, "a": 2}, ["a: unknown field", "z: unknown field"]),
    ({"query": "", "filters": []}, ["filters: object required"]),
    ([], ["body: object required"]),
    ("text", ["body: object required"]),
]


def test_messages_of_the_query_call(spark):
    rows = [(i, json.dumps(b)) for i, (b, _) in enumerate(CASES)] + [(100, "{"), (101, None), (102, "")]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(rows, "i int, b string").select("i", contracts.errors(contracts.QUERY_REQUEST, F.col("b")).alias("e")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
    assert got[100] == got[101] == got[102] == ["body: not JSON"]


def test_other_keywords(spark):
    contract = {"type": ["object", "null"], "properties": {"name": {"type": "string", "minLength": 2, "maxLength": 3}, "in": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number", "maximum": 9}}}}, "additionalProperties": {"type": "string"}}
    cases = [({"name": "a"}, ["name: at least 2 characters required"]), ({"name": "abcd"}, ["name: at most 3 characters allowed"]), ({"in": {}}, ["in.x: field required"]), ({"in": {"x": 10}}, ["in.x: at most 9 allowed"]), ({"more": "y", "odd": 1}, ["odd: string required"]), (None, [])]
    rows = [(i, json.dumps(b)) for i, (b, _) in enumerate(cases)]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(rows, "i int, b string").select("i", contracts.errors(contract, F.col("b")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    with pytest.raises(ValueError, match="pattern"):
        contracts.errors({"pattern": "x"}, F.lit("{}"))
