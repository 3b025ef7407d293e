import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import asking
from sparkloom.functions import text as T
from sparkloom.operators import evals, files, intents, provenance, traces

from .test_operators import value


def test_references_and_weights(spark):
    text = "Fix `parse` in src/a.py and 'b.json', then call run.all (x) again; `parse`"
    assert value(spark, intents.references(F.col("a")), a=text) == ["b.json", "parse", "run.all", "src/a.py"]
    assert value(spark, intents.references(F.col("a")), a=None) == []
    w = lambda t: value(spark, intents.weights(F.col("a"), intents.references(F.col("a"))), a=t)
    assert w("hello there") == {} and w(None) == {} and w("") == {}
    assert w("the testing of tasks") == {}
    assert w("an exception in `x`") == {"files": 0.5, "errors": 0.6, "state": 0.4}
    assert w("Our TARGET schema") == {"goals": 0.3, "architecture": 0.3}


@pytest.mark.parametrize(("text", "kind"), [
    ("what did we decide about the error", "debug"), ("What did we decide?", "recall"), ("what's the status", "recall"), ("status?", "status"), ("what\u2019s next", "status"), ("How does it work", "exploration"),
    ("what is this thing for", "exploration"), ("let's go ahead", "action"), ("please add a test", "action"), ("please\nmake it", "followup"), ("please make it", "action"), ("why is it broken-ish", "debug"), ("why is it\nwrong", "followup"),
    ("it won't ever work", "debug"), ("work won't", "followup"), ("fix the bug", "debug"), ("fix it", "followup"), ("the bug, fix", "followup"), ("recapture", "followup"), ("", "followup"), (None, "followup"), ("earlier you said", "recall"),
])
def test_kind_of_question(spark, text, kind):
    assert value(spark, asking.kind(F.col("a")), a=text) == kind


@pytest.mark.parametrize(("text", "refs"), [
    ("see src/a.py:12, (x/b.js) and c.pyc", ["src/a.py"]), ("a.tar.c.h/x", ["a.tar.c.h"]), ("`a`b`c` `d e`f`", ["a", "c", "f"]), ("call  run.all  (x), (f(1))", ["run.all"]), ("x..py y.p", ["x..py"]), ("9a.py _b.go", ["_b.go"]),
])
def test_references_by_example(spark, text, refs):
    assert value(spark, intents.references(F.col("a")), a=text) == refs


def test_goals_and_confidence(spark):
    m = spark.createDataFrame([(1, 0, "user", "fix the parser error in a.py"), (1, 1, "user", "hm"), (1, 2, "user", ""), (2, 0, "user", "hello"), (1, 3, "tool", "x")], "session_id int, idx int, role string, content string")
    g = spark.createDataFrame([(1, "Write a parser")], "session_id int, goal string")
    got = {(r.session_id, r.idx): (r.question, r.aligned, round(r.confidence, 2), r.domains) for r in intents.readings(m, g).collect()}
    assert got == {(1, 0): ("debug", True, 1.0, ["files", "errors"]), (1, 1): ("followup", False, 0.5, []), (1, 2): ("followup", False, 0.1, []), (2, 0): ("followup", True, 0.5, [])}


def test_scores_by_intent(spark):
    facts = spark.createDataFrame(
        [(1, 1, "file_state", "read src/A.py", 1.0, 3, [1.0, 0.0]), (1, 2, "error", "x", 0.5, 3, None), (2, 3, "goal", "y", 0.5, 1, [0.0, 1.0]), (3, 4, "odd", None, 0.0, 1, None)],
        "session_id int, fact_id int, fact_type string, content string, confidence double, source_turn int, embedding array<double>",
    )
    asks = spark.createDataFrame([(1, {"errors": 0.6}, ["src/a.py"], [1.0, 0.0]), (2, {}, [], [0.0, 2.0])], "session_id int, weights map<string,double>, refs array<string>, query array<double>")
    got = {r.fact_id: r.score for r in intents.scored(facts, asks).collect()}
    assert got[1] == pytest.approx(0.8 * 0.3 + 0.25 + 0.2 + (0.6 * 0.5 + 0.5) * 0.25)
    assert got[2] == pytest.approx(0.6 * 0.3 + 0.2 + (0.5 + 0.25) * 0.25)
    assert got[3] == pytest.approx(0.4 + 0.3 + (0.8 * 0.5 + 0.25) * 0.3)
    assert got[4] == pytest.approx(0.3)


def test_topic_shift(spark):
    said = spark.createDataFrame([(1, 0, "user", "Actually, parser of trees"), (1, 1, "user", "parser of trees, never mind"), (1, 2, "user", "parser of trees")], "session_id int, idx int, role string, content string")
    assert {r.idx: r.shift for r in intents.topic_shift(said).collect()} == {0: False, 1: True, 2: False}
    rows = [(1, 0, "user", "parser of trees"), (1, 1, "assistant", "x"), (1, 2, "user", "the PARSER again"), (1, 3, "user", "entirely different matter"), (1, 4, "user", None), (1, 5, "user", "more words")]
    m = spark.createDataFrame(rows, "session_id int, idx int, role string, content string")
    assert {r.idx: r.shift for r in intents.topic_shift(m).collect()} == {0: False, 2: False, 3: True, 4: False, 5: False}


def test_arguments_and_provenance(spark):
    a = value(spark, provenance.read_arguments(F.col("a")), a='{"path": "p", "start": 3, "end_line": "9"}')
    assert (a.path, a.offset, a.limit) == ("p", 3, 9)
    for broken in ("no json", "", None, '{"offset": "x"}'):
        a = value(spark, provenance.read_arguments(F.col("a")), a=broken)
        assert (a.path, a.offset, a.limit) == (None, None, None)
    calls = spark.createDataFrame([(1, 1, "Read", None, "first \nb"), (1, 2, "read_file", "p", " "), (1, 3, "Write", "q", None), (1, 4, "Edit", "", "x"), (1, 5, "Read", None, None)], "session_id int, turn int, tool string, path string, result string")
    got = {r.turn: (r.content, r.touched) for r in provenance.provenance(calls).collect()}
    assert got == {
        1: ("[Read] first read at turn 1 (2 lines)", "first"), 2: ("[Read] p read at turn 2", "p"), 3: ("[Write] q written at turn 3", "q"),
        4: ("[Edit] unknown edited at turn 4", None), 5: ("[Read] unknown read at turn 5", None),
    }


def test_full_writes(spark):
    call = lambda i, name, args: (i, "function", (name, args))
    ok = json.dumps({"path": "p", "content": "x"})
    rows = [(1, 0, "assistant", [call("a", "Write", ok)]), (1, 1, "user", None), (1, 2, "assistant", [call("b", "create", ok), call("c", "Edit", ok), call("d", "Write", "broken"), call("e", "Write", '{"path": "p"}')]), (2, 0, "assistant", None)]
    m = spark.createDataFrame(rows, "session_id int, idx int, role string, tool_calls array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>")
    assert [tuple(r) for r in provenance.full_writes(m).collect()] == [(1, 2, "b", "p", "x")]


def test_sessions_of_requests(spark):
    rows = [(1, "s", "a", "f", "user"), (2, "", "s", "f", "tool"), (3, None, None, "f", "tool"), (4, None, None, "f", "user"), (5, None, None, None, "user"), (6, "s", None, None, "user")]
    r = spark.createDataFrame(rows, "request_id int, session_header string, affinity_header string, fingerprint string, last_role string")
    got = {x.request_id: (x.session, x.created, x.turn) for x in provenance.resolved_sessions(r).collect()}
    assert got == {1: ("s", True, 1), 2: ("s", False, 1), 3: ("f", True, 1), 4: ("f", False, 2), 5: ("request-5", True, 1), 6: ("s", False, 2)}


def test_text_of_prompts(spark):
    assert value(spark, T.environment(F.col("a")), a="You are Tool. x\n<ENV>\n Model name: a: b\nA: 1\na: 2\nno field\n</env>") == {"harness": "Tool", "model_name": "a: b", "a": "2"}
    assert value(spark, T.environment(F.col("a")), a=None) == {}
    assert value(spark, T.imported_modules(F.col("a")), a="import a.b\n  from c import d\nx import e") == ["a.b", "c"]
    assert value(spark, T.head_and_tail(F.col("a"), 9), a="abc de fgh ij k") == "abc\n[...11 chars compressed...]\nk"
    assert value(spark, T.head_and_tail(F.col("a"), 9), a="abcdefghijklmn") == "abcdef\n[...5 chars compressed...]\nlmn"
    assert value(spark, T.head_and_tail(F.col("a"), 9), a="short") == "short" and value(spark, T.head_and_tail(F.col("a"), 9), a=None) is None


def test_rankings_and_freshness(spark):
    f = spark.createDataFrame([(1, "a", "x", "9 of 10", 2), (1, "b", "parser", None, 3), (1, "c", None, "9", 1)], "session_id int, path string, content string, reason string, pos int")
    assert [r.path for r in files.retrieval_ranked(f, "parser").orderBy("rank").collect()] == ["b", "c", "a"]
    seen = spark.createDataFrame([(1, 2, ["a", "c"]), (1, 1, ["b", "a", "b"]), (1, 3, [])], "session_id int, turn int, paths array<string>")
    assert [r.path for r in files.first_seen(seen).orderBy("rank").collect()] == ["b", "a", "c"]
    t = spark.createDataFrame([(1, n, m) for n, m in enumerate(["curator", "briefing", "curator", "curator", "briefing"], 1)], "session_id int, turn_number int, assembly_mode string")
    assert [(r.briefed, r.fresh) for r in traces.briefing_freshness(t).orderBy("turn_number").collect()] == [(None, False), (None, False), (2, True), (2, False), (2, False)]


def test_costs_and_gates_of_nothing(spark):
    t = spark.createDataFrame([], "input_tokens long, cache_hit_tokens long, cache_miss_tokens long")
    assert tuple(traces.cache_costs(t).first()) == (0, 0, 0.0, 0.0, 0.0)
    facts = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "delta"), (2, 3, None)], "turn int, id int, content string")
    truth = spark.createDataFrame([(1, 7, "alpha omega")], "turn int, truth_id int, content string")
    noise = evals.noise(facts, truth)
    assert {r.id: r.noise for r in noise.collect()} == {1: False, 2: True, 3: True}
    gate = evals.audit_gates(spark.createDataFrame([(True,)], "parsed boolean"), spark.createDataFrame([], "matched boolean"), noise).first()
    assert (gate.parse_rate, gate.accuracy, gate.passes) == (1.0, 0.0, False)


def test_words_are_counted_by_pairs_of_a_turn(spark):
    """Overlap and noise equal brute force, also where a turn's truths are dealt out in parts, and no row is made for a single word."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "is"]) for _ in range(rng.randint(0, 6)))
    fact, truth = [(i % 4, i, text()) for i in range(40)], [(i % 3, i, text()) for i in range(60)]
    f = spark.createDataFrame(fact, "turn long, id long, content string")
    t = spark.createDataFrame(truth, "turn long, truth_id long, content string")
    words = lambda c: {w for w in c.split() if len(w) > 2}
    want = {(a, i, j): (len(words(y)), len(words(x) & words(y))) for a, i, x in fact for b, j, y in truth if a == b and words(x) & words(y)}
    for most in (256, 3):
        pairs = evals._common_words(f, t, most)
        got = pairs.collect()
        assert len(got) == len(want) and {(r.turn, r.id, r.truth_id): (r.n, r.k) for r in got} == want
    best = {j: max([k / n for (_, _, h), (n, k) in want.items() if h == j], default=0.0) for _, j, _ in truth}
    assert {r.truth_id: r.overlap for r in evals.truth_overlap(f, t).collect()} == best
    heard = {i for (_, i, _), (n, k) in want.items() if k >= n * 0.4}
    assert {r.id for r in evals.noise(f, t).collect() if not r.noise} == heard
    assert "word#" not in evals.truth_overlap(f, t)._jdf.queryExecution().optimizedPlan().toString()


def test_environment_is_read_once(spark):
    """The prompt's block is looked for once, not once for each of its fields' names."""
    plan = spark.createDataFrame([("a",)], "a string").select(T.environment(F.col("a")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</env>") == 1
