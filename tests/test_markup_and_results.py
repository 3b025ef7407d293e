import os

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import markup as M
from sparkloom.operators import compression as C
from sparkloom.operators import messages
from sparkloom.sources import results as R

from .test_compression import KIND, calls
from .test_operators import value

BEGIN, END = M.BLOCKS[0]


@pytest.mark.parametrize(("text", "left", "leaks"), [
    ("a" + M.TAIL + "invoke>\nmore", "a", True), ("x<tool_call>1</tool_call>y<tool_call>2</tool_call> z \n", "xy z", True), (f"a{BEGIN}b\nc{END}d", "ad", True), ("a<tool_call>b", "a<tool_call>b", False), ("</tool_call>a<tool_call>", "</tool_call>a<tool_call>", False), ("", "", False), (None, "", False), ("plain ", "plain", False),
])
def test_markup_of_calls(spark, text, left, leaks):
    assert value(spark, M.strip_calls(F.col("a")), a=text) == left and value(spark, M.has_calls(F.col("a")), a=text) == leaks


def test_why_an_answer_is_degraded(spark):
    why = lambda text, n: value(spark, M.degraded(F.col("a"), F.lit(n), 5), a=text)
    assert why("fine", 9) is None and why("fine", 4) == "low_tokens (4t < 5t)" and why("a<tool_call>", 9) == "markup" and why(None, None) is None


def test_values_and_versions(spark):
    for text, want in [("plain", "plain"), ('a: "b"', '"a: \\"b\\""'), ("C:\\x", '"C:\\\\x"'), ("a\nb", '"a\nb"'), ("it's", '"it\'s"')]:
        assert value(spark, M.yaml_value(F.col("a")), a=text) == want
    newer = lambda a, b: value(spark, M.at_least(F.col("a"), F.lit(b)), a=a)
    assert newer("1.10", "1.9") and newer("1.2", "1.2.0") and newer("2", "1.99.99") and not newer("1.2", "1.2.1") and newer("1.2rc1", "1.2") and not newer(None, "0.1")


def test_records_of_turns(spark):
    rows = [(1, 5, [("user", "a" * 600), ("assistant", "b")], "r", 3, 0.0, 7.0), (1, 9, [("user", "x"), ("user", None)], None, None, 2.0, 7.0), (2, 1, None, "r", 1, None, None)]
    t = spark.createDataFrame(rows, "session_id int, turn_number int, messages array<struct<role: string, content: string>>, response string, output_tokens int, upstream_ms double, assembly_ms double")
    got = {(r.session_id, r.turn): (r.user_msg, r.response, r.output_tokens, r.latency_ms) for r in messages.turn_records(t).collect()}
    assert got == {(1, 1): ("a" * 500, "r", 3, 7.0), (1, 2): ("", "", None, 2.0), (2, 1): ("", "r", 1, None)}


def test_solo_strategies(spark):
    rows = [(1, i, "tool", "same " * 30, None, str(i), "grep") for i in range(3)] + [(1, 3, "assistant", "word " * 60, calls("x")), (1, 4, "tool", "line\n" * 60), (1, 5, "assistant", "word " * 60), (2, 0, "tool", "same " * 30), (2, 1, "tool", "same " * 30)]
    m = spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], KIND)
    done = C.solo(m, 1, 200, 100, 100)
    assert {(r.session_id, r.idx): r.strategy for r in done.collect()} == {(1, 0): None, (1, 1): "dedup", (1, 2): "dedup", (1, 3): "middle", (1, 4): "shrink", (1, 5): None, (2, 0): None, (2, 1): None}
    stats = {r.session_id: r for r in C.solo_statistics(done, 100).collect()}
    assert stats[1].strategies == "dedup,middle,shrink" and stats[1].saved == stats[1].saved_dedup + stats[1].saved_middle + stats[1].saved_shrink and stats[1].skipped is None
    assert stats[2].skipped == "below_threshold_100" and stats[2].saved == 0
    assert C.solo_statistics(C.solo(m, 1, 200, 100, 1, ("shrink",)), 1).where("session_id = 2").first().skipped == "nothing_to_shorten"


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    path, seen = str(tmp_path / "run"), []
    todo = spark.createDataFrame([(i, t) for t in (1, 2, 3) for i in range(4)], "id long, turn long")

    def step(rows, before):
        turn = rows.first().turn
        seen.append((turn, before.count()))
        if turn == 2 and len(seen) < 3:
            raise RuntimeError("broken off")
        return rows.select("id", (F.col("id") * 10 + turn).alias("value"))

    with pytest.raises(RuntimeError):
        R.run(todo, step, path, "id long, value long")
    os.makedirs(f"{path}/turn=2")
    with open(f"{path}/turn=2/part-0.json", "w") as f:
        f.write('{"id": 99, "value": 1}\n')  # half a turn
    got = R.run(todo, step, path, "id long, value long")
    assert seen == [(1, 0), (2, 4), (2, 4), (3, 8)]
    assert {tuple(r) for r in got.collect()} == {(i, i * 10 + t, t) for t in (1, 2, 3) for i in range(4)}
    R.run(todo, step, path, "id long, value long")
    assert len(seen) == 4
