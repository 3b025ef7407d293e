import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import compression as C

KIND = "session_id long, idx long, role string, content string, tool_calls array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>, tool_call_id string, name string"


def calls(*ids):
    return [(i, "function", ("f", "{}")) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], KIND)


@pytest.mark.parametrize(("tail", "kept"), [
    ([("assistant",), ("user",), ("tool",)], [1, 2]),
    ([("tool", None, "x"), ("assistant", calls("a")), ("tool", None, "a"), ("user",)], [1, 2, 3]),
    ([("assistant", calls("a")), ("tool", None, "b"), ("assistant",), ("user",)], [3]),
    ([("tool", None, "a"), ("assistant", calls("a"))], []),
    ([("assistant", calls("a", "b")), ("user",), ("tool", None, "b")], [0, 1, 2]),
])
def test_where_a_tail_may_begin(spark, tail, kept):
    rows = [(1, i, r[0], "x", r[1] if len(r) > 1 else None, r[2] if len(r) > 2 else None) for i, r in enumerate(tail)]
    assert sorted(r.idx for r in C.from_valid_head(frame(spark, rows)).collect()) == kept


def test_merging_spares_calls(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "user", None), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (1, 5, "assistant", "e", calls("x")), (1, 6, "assistant", "f"), (1, 7, "assistant", "g"), (1, 8, "tool", "h", None, "x"), (1, 9, "tool", "i", None, "y"), (2, 0, "system", "s"), (2, 1, "system", "t"), (2, 2, "user", "u")]
    got = [(r.session_id, r.idx, r.content, r.merged) for r in C.merged(frame(spark, rows)).orderBy("session_id", "idx").collect()]
    assert got == [(1, 0, "a\n\nb", 2), (1, 2, None, 1), (1, 3, "c", 1), (1, 4, "d", 1), (1, 5, "e", 1), (1, 6, "f\n\ng", 2), (1, 8, "h", 1), (1, 9, "i", 1), (2, 0, "s", 1), (2, 1, "t", 1), (2, 2, "u", 1)]


def plain_ceiling(rows, ceiling, small, large, least):
    """Message by message, phase by phase."""
    est = lambda c: max(1, len(c) // 4)
    texts = {r["idx"]: r["content"] for r in rows}
    running, phases = max(int(sum(est(c) for c in texts.values()) * 1.1 + 1e-9), least), {}

    def cut(c, limit):
        head = c[:limit]
        at = head.rfind("\n")
        head = head[:at] if at > limit // 2 else head
        return f"{head}\n[...{len(c) - len(head)} chars truncated by context ceiling...]"

    def answer(c, limit):
        head = c[: limit * 2 // 3]
        head = head.rsplit(" ", 1)[0] if " " in head else head
        end = c[-(limit // 3) :]
        end = end.split(" ", 1)[1] if " " in end else end
        return f"{head}\n[...{len(c) - len(head) - len(end)} chars compressed...]\n{end}"

    for phase in (1, 2, 3):
        for r in sorted((r for r in rows if not r["tail"]), key=lambda r: (r["priority"], r["idx"])):
            if running <= ceiling:
                break
            c, seeks = texts[r["idx"]], r["name"] in C.COMPRESSIBLE
            fits = (r["role"] == "tool" and seeks and len(c) > small, r["role"] == "tool" and len(c) > large and r["idx"] not in phases, r["role"] == "assistant" and len(c) > small)[phase - 1]
            if fits:
                new = answer(c, small) if phase == 3 else cut(c, small if phase == 1 else large)
                running += int((est(new) - est(c)) * 1.1)
                texts[r["idx"]], phases[r["idx"]] = new, phase
    return texts, phases


def test_phases_against_a_plain_loop(spark):
    rng = random.Random(4)
    all_rows, want = [], {}
    for s in range(60):
        rows = []
        for i in range(rng.randint(1, 14)):
            role = rng.choice(["tool", "tool", "assistant", "user"])
            text = "".join(rng.choice("abc  \n") for _ in range(rng.choice([10, 70, 85, 200, 500])))
            rows.append({"idx": i, "role": role, "content": text, "name": rng.choice(["grep", "read_file"]) if role == "tool" else None, "tail": i > 10, "priority": rng.choice([0.1, 0.2, 0.3])})
        all_rows += [(s, r["idx"], r["role"], r["content"], None, None, r["name"], r["tail"], r["priority"]) for r in rows]
        want[s] = plain_ceiling(rows, 200, 80, 160, 20)
    got = C.under_ceiling(spark.createDataFrame(all_rows, KIND + ", tail boolean, priority double"), 200, limits=(80, 160), least=20).collect()
    assert len(got) == len(all_rows)
    for r in got:
        texts, phases = want[r.session_id]
        assert (r.content, r.phase) == (texts[r.idx], phases.get(r.idx)), (r.session_id, r.idx)
    assert {p for _, phases in want.values() for p in phases.values()} == {1, 2, 3}
    stops = [s for s, (_, p) in want.items() if any(r.session_id == s and r.role == "tool" and r.name == "grep" and len(r.content) > 80 + 60 and r.phase is None for r in got) and p]
    assert stops  # some stop in the middle of a phase


def test_what_the_context_shows_shrinks_to_a_mark(spark):
    shown = "\n".join(f"line number {i} of a file that is long" for i in range(12))
    rows = [(1, 0, "system", "Context:\n" + shown, None, None, None, False, 1000.0), (1, 1, "user", "x", None, None, None, False, 0.0), (1, 2, "tool", shown + "z" * 900, None, "a", "mcp__grep", False, 0.1)]
    got = {r.idx: (r.content, r.phase) for r in C.under_ceiling(spark.createDataFrame(rows, KIND + ", tail boolean, priority double"), 10, least=1).collect()}
    assert got[2] == (f"[content already in session context — {len(shown) + 900} chars: line number 0 of a file that is long...]", 1) and got[0][1] is None


def test_a_whole_request(spark):
    long = "hit\n" * 200
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "one"), (1, 2, "assistant", "<think>x</think>first", calls("a")), (1, 3, "tool", long, None, "a", "grep"), (1, 4, "user", "two"), (1, 5, "assistant", "second", calls("b")), (1, 6, "tool", long, None, "b", "read_file"),
        (1, 7, "user", "three"), (1, 8, "user", "four"), (1, 9, "assistant", "third"), (2, 0, "assistant", "hello"), (2, 1, "user", "hi"),
    ]
    selection = spark.createDataFrame([(1, [2]), (2, None)], "session_id long, turns array<long>")
    context = spark.createDataFrame([(1, "Facts.")], "session_id long, context string")
    got = [(r.session_id, r.idx, r.role, r.content, r.tail) for r in C.request(frame(spark, rows), selection, context, base=3).orderBy("session_id", "idx").collect()]
    assert got == [
        (1, 0, "system", "Be brief.\n\nFacts.", False), (1, 4, "user", "two", False), (1, 5, "assistant", "second", False), (1, 6, "tool", long, False), (1, 7, "user", "three\n\nfour", True), (1, 9, "assistant", "third", True),
        (2, -1, "system", "", False), (2, 1, "user", "hi", True),
    ]
    every = C.request(frame(spark, rows), selection.withColumn("turns", F.lit(None).cast("array<long>")), context, base=3).where("session_id = 1").collect()
    by = {r.idx: r.content for r in every}
    assert by[2] == "first" and by[3].startswith("hit\n") and by[3].endswith(f"[...{800 - 399} chars — key facts in session context above...]") and by[6] == long
    cut = C.request(frame(spark, rows), selection, context, base=3, ceiling=30, least=1).where("phase is not null").collect()
    assert [(r.idx, r.phase) for r in cut] == [] or all(r.phase == 2 for r in cut)


def test_priority_by_turn_and_place(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "tool", "d")]
    got = {r.idx: r.priority for r in C.turn_priority(frame(spark, rows), spark.createDataFrame([(1, [2, 1])], "session_id long, turns array<long>")).collect()}
    assert got[0] == 1000.0 and got[1] == pytest.approx(0.5 + 0.1) and got[3] == pytest.approx(1.0 + 0.3) and got[4] == pytest.approx(1.4)
    none = {r.idx: r.priority for r in C.turn_priority(frame(spark, rows), spark.createDataFrame([(1, None)], "session_id long, turns array<long>")).collect()}
    assert none[4] == pytest.approx(0.4) and none[1] == pytest.approx(0.1)
