import random

import pytest
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import content as C
from sparkloom.functions import text as T
from sparkloom.operators import facts, files, messages, reads, traces
from sparkloom.sources import logs
from sparkloom.streaming import stateful


def value(spark, column, **fields):
    names = list(fields)
    kinds = ", ".join(f"{n} string" for n in names) or "x string"
    return spark.createDataFrame([tuple(fields.values()) or ("",)], kinds).select(column.alias("v")).first().v


def test_normal_form(spark):
    for text, want in [('  "The  Cat."  ', 'the cat'), ("'Quoted!'", "quoted"), ("a\t\nb ?!", "a b "), ("", ""), (None, ""), ("École;", "école")]:
        assert value(spark, T.normalise(F.col("a")), a=text) == want, text
    assert sorted(value(spark, T.tokens(F.col("a")), a="a b a c.")) == ["a", "b", "c"]
    assert value(spark, T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))), a="a b", b="b c") == 1 / 3
    assert value(spark, T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))), a="", b="b c") == 0


def test_text_functions(spark):
    assert value(spark, T.importance(F.col("a")), a="score 0.82 | x") == 0.82
    assert value(spark, T.importance(F.col("a")), a="8 of 10") == 0.8
    assert value(spark, T.importance(F.col("a")), a="none") == 0.5
    assert value(spark, T.keyword_relevance(F.col("a"), F.col("b")), a="load the parser", b="parser of trees") == 0.5
    assert value(spark, T.truncate_words(F.col("a"), 3), a="aaaa bbbb cccc dddd") == "aaaa bbbb..."
    assert value(spark, T.section(F.col("a"), "B"), a="=== A ===\nx\n=== B ===\ny\nz") == "y\nz"
    assert value(spark, T.references(F.col("a")), a="""<a href="b?q"> import "c" url(d) <img src='e#f'>""") == ["b", "c", "d", "e"]
    assert value(spark, T.strip_reasoning(F.col("a")), a="<think>x\ny</think> ok") == "ok"
    assert value(spark, T.strip_ansi(F.col("a")), a="\x1b[31mred\x1b[0m") == "red"
    assert value(spark, T.slug(F.col("a")), a="--Ab c!!d--") == "ab-c-d"
    assert value(spark, T.path_plausible(F.col("a")), a="src/a.py") and not value(spark, T.path_plausible(F.col("a")), a="../a.py")


def test_content_functions(spark):
    assert value(spark, C.path_argument(F.col("a")), a='{"path": "p", "file_path": ""}') == "p"
    assert value(spark, C.path_argument(F.col("a")), a="broken") is None
    assert value(spark, C.flatten_content(F.col("a")), a='[{"type": "text", "text": "x"}, {"type": "image"}, {"text": "y"}]') == "x\ny"
    assert value(spark, C.decode_structured(C.encode_structured(F.col("a"))), a='{"k": 1}') == '{"k": 1}'
    assert value(spark, C.decode_structured(F.col("a")), a="nonsense{") is None
    got = value(spark, C.extracted_facts(F.col("a")), a='```json\n{"facts": ["bare", {"content": "c", "fact_type": "error", "confidence": 7}, {"content": " "}, {"content": "d", "fact_type": "odd"}]}\n```')
    assert [tuple(f) for f in got] == [("bare", "observation", 0.5), ("c", "error", 1.0), ("d", "observation", 0.5)]
    assert value(spark, C.sse_payload(F.col("a")), a='data: {"x": 1}') == '{"x": 1}' and value(spark, C.sse_payload(F.col("a")), a="data: [DONE]") is None
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    over = F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4"), F.lit("d"), F.lit("5"))
    assert value(spark, C.overlay(base, over, ["b", "c", "d"], ["d"])) == {"a": "1", "b": "3", "c": "4"}


def talk(spark, rows):
    return spark.createDataFrame(rows, schemas.MESSAGE)


def call(i, name, args):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": args}}


def test_tail_brings_the_calls_of_its_results(spark):
    rows = [("s", 0, "user", "q", None, None, None), ("s", 1, "assistant", None, [call("c1", "read", '{"path": "a"}'), call("c2", "read", "{}")], None, None)]
    rows += [("s", 2, "tool", "r1", None, "c1", None), ("s", 3, "tool", "r2", None, "c2", None), ("s", 4, "assistant", "done", None, None, None)]
    m = talk(spark, rows)
    assert [r.idx for r in messages.coherence_tail(m, 2).orderBy("idx").collect()] == [1, 2, 3, 4]
    assert [r.idx for r in messages.coherence_tail(m, 1).orderBy("idx").collect()] == [4]
    assert messages.coherence_tail(m, 9).count() == 5
    got = reads.tool_results(m).orderBy("idx").collect()
    assert [(r.name, r.path) for r in got] == [("read", "a"), ("read", None)]


def test_upsert_keeps_what_is_the_same(spark):
    kind = "session_id long, path string, content string, turn long"
    old = spark.createDataFrame([(1, "a", "x\ny", 3), (1, "b", "x", 3)], kind)
    new = spark.createDataFrame([(1, "a", "x\ny", 9), (1, "b", "z", 9), (1, "c", "n", 9)], kind)
    assert {(r.path, r.content, r.turn, r.line_count) for r in files.upsert(old, new).collect()} == {("a", "x\ny", 3, 2), ("b", "z", 9, 1), ("c", "n", 9, 1)}


def test_batch_near_duplicates_in_order(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    text = lambda *skip: " ".join(w for i, w in enumerate(words) if i not in skip)
    new = spark.createDataFrame([("s", i, t, i) for i, t in enumerate([text(), text(0), text(0, 1), "unlike all", text(5, 6, 7)])], "session_id string, fact_id long, content string, pos long")
    known = spark.createDataFrame([("s", 100, "unlike all")], "session_id string, fact_id long, content string")
    # 1 is near 0 and goes; 2 is near 1 only, which is gone, so it stays; 3 is known
    assert sorted(r.fact_id for r in facts.without_near_known(new, known).collect()) == [0, 2, 4]


def test_token_pairs_match_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i % 3, i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9)))) for i in range(90)]
    df = spark.createDataFrame(rows, "session_id long, id long, content string")
    got = {(r.a, r.b) for r in facts.token_pairs(df, df, ["session_id"], 0.6).collect()}
    sets = {i: set(t.split()) for _, i, t in rows}
    want = {(a, b) for sa, a, _ in rows for sb, b, _ in rows if sa == sb and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) and sets[b]}
    assert got == want


@pytest.mark.parametrize("most", [0, 30, 512])
@pytest.mark.parametrize("least", [0.55, 0.6, 0.85])
def test_token_pairs_of_small_and_large_groups(spark, most, least):
    rng = random.Random(5)
    rows = [(i % 3 if i % 2 else 0, i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9)))) for i in range(90)]
    rows += [(0, 100, " ".join(map(str, range(100)))), (0, 101, " ".join(map(str, range(55)))), (0, 102, None)]
    df = spark.createDataFrame(rows, "session_id long, id long, content string")
    sets = {i: set((t or "").split()) for _, i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    want = {(a, b): near(a, b) for sa, a, _ in rows for sb, b, _ in rows if sa == sb and a < b and near(a, b) >= least}
    got = facts.token_pairs(df, df, ["session_id"], least, when=F.col("a") < F.col("b"), most=most).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want
    half = df.where("id % 2 = 0")
    got = facts.token_pairs(half, df, ["session_id"], least, most=most, strict=True).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for sa, a, _ in rows for sb, b, _ in rows if sa == sb and a % 2 == 0 and near(a, b) > least}


def test_token_pairs_of_small_groups_make_no_candidates(spark):
    """Two hundred texts with the same long words and unlike short ones: nothing but the texts themselves goes through a shuffle."""
    long = " ".join(f"everywhere{i}" for i in range(10))
    rows = [(i // 40, i, long + " " + " ".join(f"{i}x{j}" for j in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id long, id long, content string")
    near = facts.token_pairs(df, df, ["session_id"], 0.85, strict=True, when=F.col("a") < F.col("b"))
    assert near.count() == 0
    near.collect()
    final = near._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "word" not in final


def test_batch_near_duplicates_in_large_sessions(spark, monkeypatch):
    """The same facts stay whether a session is joined by its key or by prefixes."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(w for w in words if rng.random() > 0.06)
    new = [(i % 2, i, text(), i) for i in range(40)]
    known = [(i % 2, i, text()) for i in range(20, 24)]  # ids of a store of their own
    sets = {("n", i): set(t.split()) for _, i, t, _ in new} | {("k", i): set(t.split()) for _, i, t in known}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.85
    kept = []
    for s, i, _, _ in new:
        if not any(near(("n", i), ("n", j)) for t, j in kept if t == s):
            kept.append((s, i))
    want = sorted(i for s, i in kept if not any(near(("n", i), ("k", j)) for t, j, _ in known if t == s))
    new = spark.createDataFrame(new, "session_id long, fact_id long, content string, pos long")
    known = spark.createDataFrame(known, "session_id long, fact_id long, content string")
    pairs = facts.token_pairs
    for most in (512, 0):
        monkeypatch.setattr(facts, "token_pairs", lambda *a, **b: pairs(*a, **b, most=most))
        assert sorted(r.fact_id for r in facts.without_near_known(new, known).collect()) == want


def test_budget_fill_skips_anchors_and_stops_at_others(spark):
    rows = [(1, "s", 1, "x" * 400, "goal", 0.9, False), (2, "s", 1, "short", "goal", 0.9, False), (3, "s", 2, "x" * 40, "error", 0.9, False), (4, "s", 2, "x" * 4000, "error", 0.5, False), (5, "s", 2, "y", "observation", 0.1, False)]
    f = spark.createDataFrame(rows, "fact_id long, session_id string, source_turn long, content string, fact_type string, confidence double, invalidated boolean")
    assert [r.fact_id for r in facts.budget_fill(f, 40).orderBy("pos").collect()] == [2, 3]


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("p", float(i), i) for i in range(4)], "phase string, value double, at long")
    r = traces.nearest_rank(df, "phase", "value", ["at"]).first()
    assert (r.n, r.p50, r.p95, r.p99) == (4, 2.0, 3.0, 3.0)


def test_debounce(spark, tmp_path):
    spark.createDataFrame([("s", i, f"p{i}") for i in range(5)], "session_id string, seq long, payload string").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("session_id string, seq long, payload string").parquet(f"{tmp_path}/e")
    q = stateful.coalesced(stream, 100).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
    for _ in range(100):
        if spark.sql("select * from debounced").count():
            break
        q.awaitTermination(0.2)
    q.stop()
    assert [(r.seq, r.payload) for r in spark.sql("select * from debounced").collect()] == [(4, "p4")]


def test_tool_call_deltas(spark):
    rows = [("r", 0, 0, "c", "read", '{"pa'), ("r", 1, 0, None, None, 'th": 1}'), ("r", 2, 1, "d", "ls", None)]
    df = spark.createDataFrame(rows, "response_id string, seq long, index long, id string, name string, arguments string")
    assert [tuple(r) for r in stateful.call_deltas(df).orderBy("index").collect()] == [("r", 0, "c", "read", '{"path": 1}'), ("r", 1, "d", "ls", "")]


def test_trace_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"session_id": "s/1", "turn_number": 1, "created_at": 1.5, "assembly_mode": "graph"}\nbroken{\n\n{"record_type": "bg_pass", "session_id": "s/1", "created_at": 2}\n{"session_id": "s/1", "turn_number": 2}\n')
    (tmp_path / "curator_failures.jsonl").write_text('{"session_id": "x", "turn_number": 1, "created_at": 1}\n')
    t = logs.read_traces(spark, str(tmp_path))
    assert [(r.session_id, r.turn_number) for r in t.collect()] == [("s/1", 1)]
    assert logs.read_background(spark, str(tmp_path)).count() == 1
    logs.write_traces(t, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    logs.write_sse(spark.createDataFrame([("hi\nyou",)], "text string"), f"{tmp_path}/sse")
    assert [r.payload for r in logs.read_sse(spark, f"{tmp_path}/sse").collect()] == ['{"choices":[{"delta":{"content":"hi\\nyou"}}]}']
    assert logs.read_files(spark, str(tmp_path), pattern="*.jsonl").where("path like '%a.jsonl'").first().line_count == 6


def test_merging_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at long")
    new = spark.createDataFrame([(1, "c", 2), (3, "d", 2)], "id long, v string, at long")
    assert {(r.id, r.v) for r in logs.merge_latest(old, new, ["id"], "at").collect()} == {(1, "c"), (2, "b"), (3, "d")}
    gone = spark.createDataFrame([(1,)], "session_id long")
    assert logs.without_session(old.withColumnRenamed("id", "session_id"), gone).count() == 1
