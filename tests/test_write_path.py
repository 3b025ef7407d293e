import json
import os

import pytest

from sparkloom.streaming import write_path as W


def call(i, tool, result, **args):
    return {"call_id": str(i), "tool": tool, "arguments": json.dumps(args), "result": result}


def fact(content, kind="observation", confidence=0.5):
    return {"content": content, "fact_type": kind, "confidence": confidence}


FILES = [
    [
        {"session_id": "a", "turn": 1, "calls": [call(0, "Read", "x\ny", path="p.py"), call(1, "Bash", "Error: boom", command="make")], "facts": [fact("The parser reads the whole file at once", "decision", 0.95), fact("  ")], "invalidated": []},
        {"session_id": "b", "turn": 1, "calls": None, "facts": [fact("The parser reads the whole file at once", "decision", 0.95), fact("odd", "no such type", None)], "invalidated": None},
    ],
    [
        {"session_id": "a", "turn": 2, "calls": [call(0, "Write", "", path="p.py")], "facts": [fact("the PARSER reads the whole file at once."), fact("one two three four five six seven eight nine ten"), fact("The parser reads the file in blocks", "decision", 0.9)], "invalidated": ["parser reads the whole file at once", "nothing like it"]},
        {"session_id": "a", "turn": 3, "calls": [], "facts": [fact("one two three four five six seven eight nine ten eleven"), fact("one two three four five six seven eight nine ten eleven twelve")], "invalidated": ["parser reads the whole file at once", "the parser reads the file in blocks"]},
    ],
    [
        {"session_id": "b", "turn": 2, "calls": [call(0, "Read", "x", path="q.py")], "facts": [fact("goal of it all", "goal", 1.0)], "invalidated": ["The parser reads the whole file at once"]},
        {"session_id": "a", "turn": 4, "calls": [call(0, "Read", "x", path="p.py")], "facts": [fact("goal of it all", "goal", 1.0)], "invalidated": []},
    ],
]


@pytest.fixture
def source(tmp_path):
    os.makedirs(tmp_path / "turns")
    for i, rows in enumerate(FILES):
        name = tmp_path / "turns" / f"{i}.json"
        name.write_text("\n".join(map(json.dumps, rows)))
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "turns")


def tables(spark, path):
    return {t: sorted(tuple(r) for r in W.stored(spark, path, t).drop("batch", "shard").collect()) for t in W.TABLES}


def test_batches_replays_and_one_run_agree(spark, source, tmp_path):
    whole, stream, crashed = (str(tmp_path / x) for x in ("whole", "stream", "crashed"))
    W.store_batch(spark.read.schema(W.TURN).json(source), whole, 0)
    want = tables(spark, whole)
    run = lambda path, store=W.store_batch: W.start(spark, source, path, path + "-checkpoint", files=1, store=store).awaitTermination()
    run(stream)
    assert tables(spark, stream) == want
    # the last batch is not known to be done: it runs again, under its number
    os.remove(stream + "-checkpoint/commits/2")
    if os.path.exists(stream + "-checkpoint/commits/.2.crc"):
        os.remove(stream + "-checkpoint/commits/.2.crc")
    run(stream)
    assert tables(spark, stream) == want

    def breaks(rows, path, batch):
        W.store_batch(rows, path, batch)
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(crashed, breaks)
    run(crashed)
    assert tables(spark, crashed) == want


def test_what_is_stored(spark, source, tmp_path):
    path = str(tmp_path / "out")
    assert W.stored(spark, path, "facts").count() == 0
    W.start(spark, source, path, path + "-checkpoint", files=2).awaitTermination()
    by = {(r.session_id, r.turn): [] for r in W.stored(spark, path, "facts").collect()}
    rows = sorted(W.stored(spark, path, "facts").collect(), key=lambda r: r.pos)
    for r in rows:
        by[r.session_id, r.turn].append(r.content)
    assert by["a", 1] == ["[Read] p.py read at turn 1 (2 lines)", "[Bash] error: boom", "The parser reads the whole file at once"]
    assert by["a", 2] == ["[Write] p.py written at turn 2", "one two three four five six seven eight nine ten", "The parser reads the file in blocks"]
    assert by["a", 3] == ["one two three four five six seven eight nine ten eleven twelve"]  # the other one is nearly what turn 2 said
    assert by["b", 1][1] == "odd" and {r.fact_type for r in rows if r.content == "odd"} == {"observation"}
    content = {r.fact_id: r.content for r in rows}
    closed = {(r.session_id, r.turn, content[r.fact_id]) for r in W.stored(spark, path, "closed").collect()}
    assert closed == {("a", 2, "The parser reads the whole file at once"), ("a", 3, "The parser reads the file in blocks"), ("b", 2, "The parser reads the whole file at once")}
    assert not {r.content for r in W.open_facts(spark, path).where("session_id = 'a'").collect()} & {"The parser reads the whole file at once", "The parser reads the file in blocks"}
    edges = W.stored(spark, path, "supersedes").where("session_id = 'a' and turn = 2").collect()
    assert {content[e.new_id] for e in edges} == set(by["a", 2]) and {content[e.old_id] for e in edges} == {"The parser reads the whole file at once"}
    assert {(r.session_id, r.path, r.turn) for r in W.stored(spark, path, "touches").collect()} == {("a", "p.py", 1), ("a", "p.py", 2), ("a", "p.py", 4), ("b", "q.py", 2)}
    promoted = W.stored(spark, path, "promotions").collect()
    assert {(r.session_id, r.content) for r in promoted} == {("a", "The parser reads the whole file at once"), ("b", "The parser reads the whole file at once"), ("a", "The parser reads the file in blocks"), ("a", "goal of it all"), ("b", "goal of it all"), ("a", "[Bash] error: boom")}
    assert len({r.dedupe_key for r in promoted}) == len(promoted)
