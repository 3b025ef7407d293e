import json

import pytest

from sparkloom.operators import extraction as X

KIND = "session_id long, turn long, call_id string, tool string, arguments string, result string"


def facts(spark, rows, **how):
    calls = spark.createDataFrame([(1, 7, str(i), tool, json.dumps(args) if isinstance(args, dict) else args, result) for i, (tool, args, result) in enumerate(rows)], KIND).repartition(3)
    out = {}
    for r in sorted(X.extracted(calls, **how).collect(), key=lambda r: (r.call_id, r.pos)):
        out.setdefault(int(r.call_id), []).append((r.content, r.fact_type, r.confidence, r.touched))
    return out


def test_files_and_listings(spark):
    got = facts(spark, [
        ("Read", {"file_path": "a.py"}, "x\ny"), ("Write", {"path": "b.py"}, None), ("edit_file", {}, "x"), ("Glob", {"pattern": "*.py"}, "Found 3 files:\n a.py \n\nC:\\b.py"),
        ("find_files", {}, "\n".join(f"p{i}" for i in range(10)) + "\nx"), ("ls", {"dir": "src"}, "a/\nb\r\nc\nd\ne\nf\ng/"), ("LS", "broken", None), ("Unknown", {}, "x"),
    ])
    assert got == {
        0: [("[Read] a.py read at turn 7 (2 lines)", "file_state", 1.0, "a.py")], 1: [("[Write] b.py written at turn 7", "file_state", 1.0, "b.py")], 2: [("[edit_file] unknown edited at turn 7", "file_state", 1.0, None)],
        3: [("[Glob] *.py → 2 files: a.py, C:\\b.py", "tool_result", 1.0, None)], 4: [("[find] found 10 paths matching query: p0, p1, p2, p3, p4, p5, p6, p7, ... (10 total)", "tool_result", 1.0, None)],
        5: [("[ls] src: 7 entries (5 files, 2 dirs) — a/, b, c, d, e, f, ...", "tool_result", 1.0, None)], 6: [("[ls] : 0 entries (0 files, 0 dirs) — ", "tool_result", 1.0, None)],
    }


def test_grep(spark):
    hits = "\n".join([f"src/a.py:{i}:text: {i}" for i in range(1, 8)] + ["C:\\x.py:3:y", "label:4:no path", "b.py:9:z", "no hit", "b.py:x:z"])
    got = facts(spark, [("Grep", {"pattern": "t"}, hits), ("Grep", {"pattern": "t"}, "nothing " * 100), ("Grep", {}, "\n".join(f"f{i}.py:1:x" for i in range(30)))])
    assert got[0] == [
        ("[Grep] 't' matched 7 times in src/a.py (lines 1, 2, 3, 4, 5, ... (7 total))", "tool_result", 1.0, "src/a.py"), ("[Grep] 't' matched 1 times in C:\\x.py (lines 3)", "tool_result", 1.0, "C:\\x.py"),
        ("[Grep] 't' matched 1 times in b.py (lines 9)", "tool_result", 1.0, "b.py"),
    ]
    assert got[1] == [("[Grep] 't' — no structured matches; raw output: " + ("nothing " * 100)[:300], "tool_result", 0.6, None)]
    assert [f[3] for f in got[2]] == [f"f{i}.py" for i in range(10)]


def test_shell(spark):
    got = facts(spark, [
        ("Bash", {"command": "A=1 pytest -q"}, "\x1b[1mFAILED\x1b[0m tests/a.py::test_x - boom\n2 failed, 13 passed, 1 warning in 3s"), ("Bash", {"command": "git status"}, "On branch\n\tmodified:   a.py\n\tnew file:   b c.py\nmodified: no"),
        ("Bash", {"command": "git diff"}, "--- a/x.py\n+++ b/y.py\n+++ c"), ("Bash", {"command": "git log"}, "abc1234 first one\nxyz1234 no\nabc no"), ("Bash", {"command": "npm test"}, "Tests: 3 passed\n4 passed\nFAIL src/x.js"),
        ("Bash", {"command": "cargo test|tail"}, "test result: ok. 3 passed; 0 failed"), ("Bash", {"command": "make"}, "x\nError: bad thing\nok"), ("Bash", {"command": "cd x"}, "error: y"), ("Bash", {}, ""),
    ])
    told = {k: [f[0] for f in v] for k, v in got.items()}
    assert told[0] == ["[Bash] pytest: 13 passed", "[Bash] pytest: 2 failed", "[Bash] pytest: 1 warnings", "[Bash] pytest FAILED: tests/a.py::test_x"]
    assert got[1] == [("[Bash] git status: a.py", "tool_result", 1.0, "a.py"), ("[Bash] git status: b c.py", "tool_result", 1.0, "b c.py")]
    assert told[2] == ["[Bash] git diff file: x.py", "[Bash] git diff file: y.py"] and told[3] == ["[Bash] git log: abc1234 first one"]
    assert told[4] == ["[Bash] npm: 3 passed", "[Bash] npm FAILED: src/x.js"] and told[5] == ["[Bash] cargo: 3 passed", "[Bash] cargo: 0 failed", "[Bash] cargo test result: ok"]
    assert got[6] == [("[Bash] error: bad thing", "error", 0.9, None)]
    assert got[7] == [("[Bash] cd x: error: y", "tool_result", 0.4, None)] and got[8] == [("[Bash] : ", "tool_result", 0.4, None)]


def test_searches_and_memories(spark):
    item = {"title": "T", "link": "u", "description": "d" * 200}
    got = facts(spark, [
        ("web_search", {"term": "q"}, json.dumps({"web": {"results": [item] * 7}})), ("WebSearch", {"query": "q"}, "Title: A\nURL: http://x\nSnippet: s\ntitle: B"), ("WebSearch", {"query": "q"}, "none"),
        ("mcp__memory__recall_all", {}, json.dumps([{"text": "a", "score": 0.4}, {"text": "b", "score": 7}, {"text": "c", "score": "x"}])), ("mcp__memory__recall", {}, "one\n---\n\ntwo"), ("mcp__memory__recall", {}, ""),
    ])
    assert len(got[0]) == 5 and got[0][0] == (f"[web_search] 'q': 'T' — {'d' * 120} (u)", "tool_result", 0.8, None)
    assert [f[0] for f in got[1]] == ["[web_search] 'q': 'A' — s (http://x)", "[web_search] 'q': 'B' —  ()"] and got[2] == [("[web_search] 'q' — none", "tool_result", 0.5, None)]
    assert got[3] == [("[memory_recall] b", "observation", 1.0, None), ("[memory_recall] c", "observation", 0.8, None)] and [f[0] for f in got[4]] == ["[memory_recall] one", "[memory_recall] two"]
    assert 5 not in got


def test_a_family_of_ones_own_goes_first(spark):
    def own(arguments, result):
        yield f"own {result}", "goal", 0.5, None

    got = facts(spark, [("Glob", {}, "x"), ("mine_a", {}, "y"), ("mine_ab", {}, "z")], families=X.FAMILIES | {"mine": ["mine_*"], "more": ["mine_ab*"]}, readers=X.READERS | {"glob": own, "mine": own, "more": X.memory_facts})
    assert [got[i][0][0] for i in range(3)] == ["own x", "own y", "[memory_recall] z"]


def test_table_function_in_sql(spark):
    X.register(spark)
    spark.createDataFrame([("s", 1, "c", "grep", '{"pattern": "x"}', "a.py:1:x"), ("s", 1, "d", "none", None, None)], "session_id string, turn long, call_id string, family string, arguments string, result string").createOrReplaceTempView("text_calls")
    (r,) = spark.sql("SELECT * FROM extracted_text(TABLE(text_calls))").collect()
    assert (r.session_id, r.call_id, r.pos, r.touched) == ("s", "c", 0, "a.py")


@pytest.mark.parametrize(("line", "name"), [("A=1 B=2 ls -l", "ls"), ("cat|head", "cat"), ("a&&b", "a"), ("export X=1", "builtin"), ("", ""), ("A=1", "")])
def test_commands(line, name):
    assert X.command(line) == name
