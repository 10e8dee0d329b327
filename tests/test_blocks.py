"""Steps that grow no faster than their input: block scoring, placed postings, stems, keyword hits and the state of a reduce."""

from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from corpusflow.operators import blocks, keyword
from corpusflow.operators import fulltext as T
from corpusflow.operators import segments as S
from corpusflow.streaming import state


def test_common_must_terms_are_added_up_in_blocks(spark):
    """Candidates that are most chunks are not looked up in the chunks, and repeated texts tie by key."""
    texts = [f"the of {'rose ' * (i % 3)}" for i in range(60)]
    index = T.build(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, offset int, text string"))
    clauses = spark.createDataFrame([(1, "must", "rose"), (1, "should", "the"), (1, "must_not", "absent"), *((1, "should", f"no{i}") for i in range(3))], "request_id long, clause string, term string")
    found = T.bool_search(index, clauses, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["rank"], r["doc_id"]) for r in sorted(found.collect(), key=lambda r: r["rank"])] == [(1, 2), (2, 5), (3, 8)]


def test_a_task_lets_go_of_the_best_only():
    a = blocks.asked([0], [0], [2.0], ["should"], [0], 1e-5, wanted=pd.Series([2]).to_numpy())
    rows = pa.record_batch({"slot": pa.array([0] * 100), "doc_id": pa.array(range(100)), "offset": pa.array([0] * 100, pa.int32()), "tf": pa.array([3] * 100, pa.int32())})
    (found,) = blocks.hits(a, ["doc_id", "offset"], iter([rows]))
    assert found.column("doc_id").to_pylist() == [0, 1] and found.column("score").to_pylist() == [6.0, 6.0]


def test_postings_know_their_file():
    cuts = [(1, "b", 5), (1, "b", 9), (1, "c", S.LEAST)]
    chunks = pa.record_batch({"doc_id": [4, 5, 9, 7], "offset": [0] * 4, "terms": [["a", "b"], ["b", "a"], ["b", "c"], ["b", "d"]]})
    rows = pa.Table.from_batches(S.placed_terms(cuts)(iter([chunks]))).to_pylist()
    assert {(r["term"], r["doc_id"], r["part"]) for r in rows} == {("a", 4, 0), ("b", 4, 0), ("a", 5, 0), ("b", 5, 1), ("b", 7, 1), ("b", 9, 2), ("c", 9, 3), ("d", 7, 3)}


def test_stems_without_a_shuffle_of_tokens(spark):
    rows = spark.createDataFrame([(1, 0, ["cats", None, "running"]), (2, 0, None), (3, 0, ["a"]), (3, 0, ["dogs"])], "doc_id long, offset int, terms array<string>")
    single = T.porter_terms(rows.filter("doc_id < 3"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["terms"] for r in single.collect()} == {1: ["cat", "run"], 2: []}
    assert {r["doc_id"]: r["terms"] for r in T.porter_terms(rows).collect()}[3] == ["a", "dog"]


def test_hits_of_one_key_leave_a_task_once(spark):
    texts = spark.createDataFrame([(1, "ab ab"), (1, "xab"), (2, "b")], "request_id long, text string").coalesce(1)
    patterns = spark.createDataFrame([(0, 0, "ab"), (1, 0, "b")], "doc_id long, offset int, pattern string")
    rows = [tuple(r) for r in keyword._shipped(texts, patterns, ["request_id"]).collect()]
    assert sorted(rows) == [(1, 0, 0, 3, 2, 2), (1, 1, 0, 3, 2, 1), (2, 1, 0, 1, 1, 1)]
    plan = keyword.match(texts, patterns.withColumnRenamed("pattern", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_a_reduce_calls_its_state_once_a_batch():
    calls, stored = [], {}

    def call(name, act=lambda *a: None):
        return lambda *a: (calls.append(name), act(*a))[1]

    value = SimpleNamespace(exists=call("exists", lambda: "v" in stored), get=call("get", lambda: stored["v"]), update=call("update", lambda v: stored.update(v=v)), clear=call("clear", stored.clear))
    handle = SimpleNamespace(getValueState=lambda *a: value, registerTimer=call("register"), deleteTimer=call("delete"))
    reducing = state._Reducing(1000, 2, 2)
    reducing.init(handle)

    def rows(part):
        return iter([pd.DataFrame({"part": [part] * 20, "doc_id": range(20), "offset": 0, "score": [float(i) for i in range(20)], "at": 5, "top_k": 2})])

    assert list(reducing.handleInputRows((1,), rows("a"), None)) == []
    (out,) = reducing.handleInputRows((1,), rows("b"), None)
    assert out[["rank", "doc_id", "score"]].values.tolist() == [[1, 19, 19.0], [2, 18, 18.0]] and len(calls) <= 8
    assert list(reducing.handleInputRows((1,), rows("c"), None)) == []
    (late,) = reducing.handleExpiredTimer((1,), None, None)
    assert late.empty
