import json

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import evals, facts, files, messages
from sparkloom.streaming import stateful


def test_capture_ends_before_the_chunk_that_is_too_much(spark):
    chunk = lambda text, **more: json.dumps({"model": "m", "choices": [{"delta": {"content": text}, **more}]})
    rows = [("a", 0, chunk("é" * 10)), ("a", 1, "no json"), ("a", 2, chunk("b", finish_reason="stop")), ("a", 3, json.dumps({"usage": {"n": 1}})), ("a", 4, chunk("late")), ("b", 0, json.dumps({"choices": [{"message": {"content": "whole"}}]})), ("c", 0, None)]
    most = sum(len(r[2].encode()) for r in rows[:4]) + 3
    got = {r.response_id: r for r in stateful.captured(spark.createDataFrame(rows, "response_id string, seq long, payload string"), most).collect()}
    a = got["a"]
    assert (a.content, a.model, a.finish, json.loads(a.usage), a.chunks, a.truncated) == ("é" * 10 + "b", "m", "stop", {"n": 1}, 4, True)
    assert (got["b"].content, got["b"].truncated) == ("whole", False) and got["c"].content == ""


def test_traces_keep_bounded_messages(spark):
    kind = "content string, parts array<struct<type: string, text: string>>, tool_calls array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>"
    rows = [("x" * 12, [("text", "y" * 11), ("image", None)], [("i", "function", ("f", "z" * 30))]), ("short", None, None), (None, [], [])]
    got = messages.bounded(spark.createDataFrame(rows, kind), 10).collect()
    assert got[0].content == "x" * 10 + "... [12 chars truncated]" and [p.text for p in got[0].parts] == ["y" * 10 + "... [11 chars truncated]", None]
    assert got[0].tool_calls[0].function.arguments == "z" * 10 + "... [30 chars truncated]" and got[0].tool_calls[0].function.name == "f"
    assert got[1].content == "short" and got[1].parts is None and got[2].content is None and got[2].tool_calls == []


def test_facts_that_are_asked_for_are_promoted(spark):
    rows = [(1, 1, "observation", "a", 0.1, False, True), (1, 2, "decision", "b", 0.95, False, None), (1, 3, "goal", "c", 0.5, False, False), (1, 4, "goal", "d", 1.0, True, True)]
    f = spark.createDataFrame(rows, "session_id int, fact_id int, fact_type string, content string, confidence double, invalidated boolean, explicit boolean")
    assert sorted(r.fact_id for r in facts.promotable(f).collect()) == [1, 2]
    assert sorted(r.fact_id for r in facts.promotable(f.drop("explicit")).collect()) == [2]


def test_an_example_comes_first(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "yPage", 2), (1, "zPage", 3)], "session_id int, path string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "x", 2)], "session_id int, path string, rank int")
    order = lambda **k: [r.path for r in files.combined_order(a, b, **k).orderBy("rank").collect()]
    assert order() == ["x", "z", "yPage", "zPage"] and order(examples=("Page",)) == ["yPage", "x", "z", "zPage"]


def test_maps_are_cut_at_a_line(spark):
    degrees = spark.createDataFrame([(1, "a", 2), (1, "b", 0), (1, "c", 1), (2, "d", 0)], "session_id int, path string, in_degree int")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "b", "c"), (1, "c", "a")], "session_id int, src string, dst string")
    (r,) = files.rendered_map(degrees, edges, 2, 1).collect()
    assert r.map == "=== CODE MAP ===\nLoad-bearing: a (<-2), c (<-1)\nc -> a\nb -> a, +1 more"
    (r,) = files.rendered_map(degrees, edges, 2, 1, 55).collect()
    assert r.map == "=== CODE MAP ===\nLoad-bearing: a (<-2), c (<-1)\nc -> a\n... [map truncated]"


def test_runs_without_failures(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, None), (4, 4.0, None)], "id int, v double, error string")
    b = spark.createDataFrame([(1, 3.0, None), (2, 2.0, None), (3, 3.0, "y")], "id int, v double, error string")
    assert [tuple(r) for r in evals.paired(a, b, "id", "v").collect()] == [(1, 1.0, 3.0, 2.0)]


def test_turns_that_are_finished(spark):
    rows = [(1, "user", None), (2, "tool", "stop"), (3, "tool", "length"), (4, None, None)]
    got = messages.finished(spark.createDataFrame(rows, "request_id int, last_role string, finish_reason string"))
    assert {r.request_id: bool(r.boundary) for r in got.select("request_id", F.coalesce("boundary", F.lit(False)).alias("boundary")).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_token_keys_put_long_words_first(spark):
    (r,) = spark.createDataFrame([("a bbb cc bbb dddd",)], "t string").select(facts.token_keys(F.col("t")).alias("k")).collect()
    assert len(r.k) == 4 and r.k == sorted(r.k) and [127 - (x >> 56) for x in r.k] == [4, 3, 2, 1]


def test_nearest_by_blocks_against_brute_force(spark, monkeypatch):
    import math
    import random

    from sparkloom.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK", 3)
    monkeypatch.setattr(ranking, "VECTORS", 20)
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(120)] + [(200, None), (201, []), (202, [1.0, 2.0]), (203, [0.0] * 4), (5, [1.0, 1.0, 1.0, 1.0])]
    queries = [r for r in rows if r[0] % 10 == 0] + [(301, None), (302, [0.0] * 4)]

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    want = {}
    for q, e in queries:
        if e:
            best = sorted(((-cosine(e, v), i) for i, v in rows if v and len(v) == len(e)), key=lambda t: (round(t[0], 12), t[1]))[:5]
            want |= {(q, k): i for k, (s, i) in enumerate(best, 1) if -s > 0.05}
    got = ranking.semantic_top(spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, embedding array<double>"), 5)
    assert {(r.query_id, r.rank): r.id for r in got.collect()} == want


def test_joins_on_a_content_hash_make_it_once(spark):
    """A hash that may be null is filtered by before each join on it, and so is made twice; and a batch is hashed for one aggregation, without a join."""
    new = spark.createDataFrame([(1, 1, " 'A  b.'"), (1, 2, "a\tB"), (1, 3, None), (2, 4, "c!"), (None, 5, "d")], "session_id long, fact_id long, content string")
    known = spark.createDataFrame([(2, 9, "C")], "session_id long, fact_id long, content string")
    got = facts.first_unknown(new, known)
    assert not new.select(T.content_hash(F.col("content")).alias("h")).schema["h"].nullable
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.fact_id for r in got.collect()) == sorted(r.fact_id for r in facts.without_known(new, known).collect()) == [1, 3]
