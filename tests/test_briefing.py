import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.functions import tokens as K
from sparkloom.operators import briefing as B


def test_ranges_against_brute_force(spark):
    rng = random.Random(4)
    log = []
    for pos in range(60):
        first, n = rng.randint(1, 60), rng.randint(1, 9)
        log.append((rng.randint(1, 2), pos, rng.choice(["a", "b"]), first, "\n".join(f"{pos}:{first + i}" for i in range(n))))
    log += [(3, 0, "c", 5, "x\ny"), (3, 1, "c", 7, "touches"), (3, 2, "c", 20, "apart"), (3, 3, "c", 5, "nested"), (3, 4, "c", 30, None)]
    lines = {}
    for s, _pos, path, first, text in log:  # in order of pos
        for i, x in enumerate((text or "").split("\n")):
            lines[s, path, first + i] = x
    want = set()
    for s, path, line in sorted(lines):
        if (s, path, line - 1) not in lines:
            end = line
            while (s, path, end + 1) in lines:
                end += 1
            want.add((s, path, line, end, "\n".join(lines[s, path, k] for k in range(line, end + 1))))
    got = B.ranges(spark.createDataFrame(log, "session_id int, pos int, path string, first int, result string").repartition(3))
    assert {tuple(r) for r in got.collect()} == want
    assert {w for w in want if w[0] == 3} == {(3, "c", 5, 7, "nested\ny\ntouches"), (3, "c", 20, 20, "apart"), (3, "c", 30, 30, "")}


def test_files_of_a_log(spark):
    table = "File relevance\nScore | Path | Reasons\n------|------|--------\n3.5 | a.py | keyword\n1 | b.py\nx | c.py | no"
    log = [
        (1, 0, "get_file_lines", "ok", "a.py", 3, "l3\nl4"), (1, 1, "get_file", "ok", "b.py", None, "all\nof it"), (1, 2, "get_file_lines", "error", "a.py", 9, "no"), (1, 3, "get_file_outline", "ok", "a.py", None, "old"), (1, 4, "get_file_outline", "ok", "a.py", None, "new"),
        (1, 5, "score_file_relevance", "ok", None, None, table), (1, 6, "get_file", "ok", "", None, "no path"), (1, 7, "get_file", "ok", "d.py", 0, "d"), (2, 0, "other", "ok", "x", 1, "y"),
    ]
    got = {r.path: (r.outline, r.relevance, [tuple(x) for x in r.sections]) for r in B.briefed_files(spark.createDataFrame(log, "session_id int, pos int, tool string, status string, path string, first int, result string")).collect()}
    assert got == {"a.py": ("new", "keyword", [(3, 4, "l3\nl4")]), "b.py": ("", "score 1.0", [(1, 2, "all\nof it")]), "d.py": ("", B.RETRIEVED, [(1, 1, "d")])}


def test_round_trip_of_two_versions(spark):
    kind = "session_id string, source_turn long, files array<struct<path: string, outline: string, relevance: string>>, retained_turns array<bigint>, mode string"
    rows = spark.createDataFrame([("a", 3, [("p", "o", "r")], [1, 2], "two_curator"), ("b", None, None, None, None)], kind)
    new = {r.session_id: r for r in B.opened(B.kept(rows)).collect()}
    assert (new["a"].source_turn, [tuple(f) for f in new["a"].files], new["a"].retained_turns, new["a"].mode, new["a"].version) == (3, [("p", "o", "r")], [1, 2], "two_curator", 2)
    assert (new["b"].source_turn, new["b"].files, new["b"].retained_turns, new["b"].mode, new["b"].latency_ms, new["b"].facts_text) == (0, [], None, "two_pass", 0.0, "")
    old = spark.createDataFrame([("c", 1, '{"session_id": "c", "source_turn": 7, "mode": "m", "color": {"r": 1}, "tags": ["x"]}')], "session_id string, version int, b string")
    once = B.opened(old.select("session_id", "version", F.parse_json("b").alias("body")))
    (r,) = once.select("source_turn", "mode", "tool_calls_used", F.map_keys("rest").alias("more")).collect()
    assert (r.source_turn, r.mode, r.tool_calls_used, sorted(r.more)) == (7, "m", 0, ["color", "tags"])
    again = B.kept(once, rest="rest")
    (r,) = again.select("version", F.to_json("body").alias("b")).collect()
    assert r.version == 2 and '"color":{"r":1}' in r.b and '"tags":["x"]' in r.b and '"source_turn":7' in r.b


def test_fields_of_a_trace(spark):
    events = [
        (1, 0, "extractor_prompt_tokens", "5"), (1, 1, "extractor_prompt_tokens", "0"), (1, 2, "embedding_tokens", "0"), (1, 0, "mode", "a"), (1, 3, "mode", "b"), (1, 2, "mode", None), (1, 1, "recall_used", "true"), (1, 1, "recall_question", "q" * 300), (1, 1, "recall_trigger", ""),
        (1, 4, "upstream_response_summary", "s" * 600), (2, 1, "recall_used", "true"), (2, 1, "recall_trigger", "phrase"), (3, 1, "recall_used", "false"), (3, 0, "curator_prompt_tokens", "7"), (3, 2, "curator_prompt_tokens", None), (3, 3, "curator_prompt_tokens", "9"),
    ]
    want = {(1, "extractor_prompt_tokens", "5"), (1, "mode", "b"), (1, "recall_used", "true"), (1, "recall_question", "q" * 200), (1, "recall_trigger", "model_invoked"), (1, "upstream_response_summary", "s" * 500), (2, "recall_used", "true"), (2, "recall_trigger", "phrase"), (3, "recall_used", "false"), (3, "curator_prompt_tokens", "9")}
    random.Random(1).shuffle(events)
    frame = spark.createDataFrame(events + events[:7], "turn_id int, pos int, name string, value string").repartition(3)  # out of order, some twice
    assert {tuple(r) for r in B.merged_fields(frame).collect()} == want


def test_tokens_by_the_encoder(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").union(spark.createDataFrame([(None,), ("",), ("Élan, 中文",)], "text string"))
    plain = Tokenizer.from_file(path)
    for r in docs.select("text", K.counter(path)("text").alias("n")).select("*", K.estimate(F.col("n")).alias("e")).collect():
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n == n and r.e == max(1, int(max(n, 1) * 1.1))
