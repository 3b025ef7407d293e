import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkloom.llm import line_dedup as L
from sparkloom.llm import mixing as M


def chunks(text):
    """Chunks of LINES lines or more, by the operator's borders: (start, stop, content)."""
    raw = (text or "").encode()
    return [(a, c, raw[a:b]) for d, s, e, f, _ in L.cut(pa.array([text], pa.string())) for a, b, c in zip(s.tolist(), e.tolist(), f.tolist(), strict=True)]


def brute(rows):
    """Rows are distinct and ordered by doc_id; of equal chunks the first stays."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw, gone = (text or "").encode(), []
        for a, c, content in chunks(text):
            if content in seen:
                gone.append((a, c))
            seen.add(content)
        for a, c in reversed(gone):
            raw = raw[:a] + raw[c:]
        out[i] = (raw.decode() if text is not None else None, len(gone))
    return out


def documents(n=60):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["ab", "é", "cd", "x"]) + str(rng.randrange(1000)) for _ in range(rng.randint(1, 8)))
    passage = [line() for _ in range(12)]
    rows = []
    for i in range(n):
        lines = [line() for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            lines = lines + passage + [line()]
        if i % 7 == 0:
            lines.insert(0, "")
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    return rows


def test_lines_match_brute_force(spark):
    rows = documents() + [(100, None), (101, ""), (102, "\n\n"), (103, "one"), (104, "a\n" * 5000), (105, "Same Line\nother\nthird\nA b\nC d"), (106, "same line\nOther\nthird\na b\nc D")]
    docs = spark.createDataFrame([(7, t, i, "k") for i, t in rows], "hash int, text string, doc_id long, places string").repartition(3)
    out = L.dedup_lines(docs)
    assert out.columns == ["hash", "text", "doc_id", "places", "chunks_removed"]
    got = {r.doc_id: (r.text, r.chunks_removed) for r in out.collect()}
    want = brute(rows)
    assert got == want
    assert sum(n for _, n in want.values()) > 20


def without_runs(rows):
    """Every run of whole lines, of two lines or over 50 words, against all earlier ones that don't overlap it; documents of one line as a whole."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        lines = [m.span() for m in re.finditer(rb"[^\n]+", raw)]
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = raw[lines[a][0] : lines[b][1]]
                whole = len(lines) == 1 and size(run.decode()) <= 50
                if b > a or whole or size(run.decode()) > 50:
                    doc, end = first.setdefault((whole, run), (i, lines[b][1]))
                    if doc != i or end <= lines[a][0]:
                        gone |= set(range(a, b + 1))
        starts = [s for s, _ in lines]
        kept = b"".join(raw[s:e] for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(raw)], strict=False)) if k not in gone)
        out[i] = None if text is None else (raw[: lines[0][0]] + kept if lines else raw).decode()
    return out


def test_all_repeated_runs_go(spark):
    rng = random.Random(5)
    long = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = long(51)
    rows = documents() + [(100, None), (101, ""), (102, "\n\n"), (103, "one"), (104, "a\n" * 500), (105, "a\na"), (106, "one"), (107, "one\n")]
    rows += [(200, f"{long(4)}\n{shared}\n{long(5)}"), (201, f"{shared}\n{long(5)}"), (202, f"{long(6)}\n{shared.upper()}\n{long(5)}"), (203, f"x\n{long(50)}\ny")]
    rows += [(300 + i, t) for i, t in enumerate([f"\n{long(20)}\n{long(60)}\n\n{long(3)}", f"{long(30)}\n{long(30)}"])]
    rows += [(400 + i, dict(rows)[k]) for i, k in enumerate([0, 1, 2, 3, 200, 203, 300, 301])]
    rows += [(500, f"new\n{dict(rows)[301]}\nnew too"), (501, dict(rows)[203].split("\n")[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in L.dedup_runs(docs).collect()}
    want = without_runs(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all((r.chunks_removed > 0) == (r.text != dict(rows)[i]) for i, r in got.items())
    assert shared not in want[201] and not any((want[i] or "").strip() for i in range(400, 408)) and want[500] == "new\nnew too" and want[501] == dict(rows)[501]
    lines = lambda texts: {x for t in texts for x in (t or "").split("\n")}
    assert lines(want.values()) == lines(dict(rows).values())


def test_equal_hashes_of_different_runs(spark):
    def one_hash(texts):
        for *places, value in L.runs(texts):
            yield *places, np.zeros_like(value)

    rows = [(i, t) for i, t in documents() if len(t) < 400]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in L.dedup_lines(docs, one_hash).collect()} == without_runs(rows)


def test_op3_takes_all_runs(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(1, f"a\n{text}"), (2, f"{text}\nb")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in L.op3_line_dedup(spark, str(tmp_path)).collect()) == [(1, 0, f"a\n{text}"), (2, 1, "b")]


def test_borders_move_with_the_text():
    text = "\n".join(f"line {i} of this text" for i in range(200))
    before = {c for *_, c in chunks(text)}
    after = {c for *_, c in chunks("new first line\nand one more\n" + text)}
    assert len(before - after) <= 2


def test_repeated_rows_and_empty_table(spark):
    text = "\n".join(f"row {i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + "\nmore\nlines"), (None, text)], "doc_id long, text string")
    got = L.dedup_lines(docs).collect()
    assert len(got) == 4
    kept = [r for r in got if r.chunks_removed == 0]
    assert len({(r.doc_id, r.text) for r in kept}) == 1
    assert L.dedup_lines(docs.where("false")).count() == 0


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(rows):
    by = Counter()
    for _, text, source in rows:
        by[source] += size(text)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(by.values()), set()
    while True:
        rest = total - sum(3 * by[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * by[s] if s in capped else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * by[s]}
        if not over:
            return by, target
        capped |= over


def test_mix_hits_its_targets_and_agrees_with_itself(spark):
    rng = random.Random(8)
    source = lambda i: "hot" if i % 3 == 0 else [None, "", "a", "Z", "é", "b"][i % 6]
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), source(i)) for i in range(1500)]
    rows += [(2000, None, "tiny"), (2001, "one two", "tiny"), (2002, "", "void"), (2003, "long " * 3000, "b")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int").repartition(4)
    got = M.mix(docs).collect()
    by, target = goals(rows)
    text = {i: t for i, t, _ in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == size(text[r.doc_id]) and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s in by:  # the threshold lies at a border between two documents
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in got if r.source == s) / 2, s
    again = {r.doc_id: r.taken for r in M.mix(docs.repartition(2)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    copies = Counter(r.doc_id for r in M.taken_rows(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert M.taken_rows(docs).columns == docs.columns


def test_thresholds_through_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW", 2)
    rng = np.random.default_rng(0)
    rows = [(int(i), "w " * int(n), "abc"[i % 3]) for i, n in enumerate(rng.integers(1, 9, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(docs).toPandas()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 10).all()


def test_mix_of_equal_rows_and_of_nothing(spark):
    same = spark.createDataFrame([(1, "a b c", "s")] * 50, "doc_id long, text string, source string")
    assert {r.taken for r in M.mix(same).collect()} == {3}
    assert M.mix(same.where("false")).count() == 0 and M.taken_rows(same.where("false")).count() == 0


def test_larger_budgets_only_add_and_thresholds_are_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW", 10)
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([1, 5, 40, 400]), "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    before = {}
    for share in (0.1, 0.13, 0.3, 0.62, 1.0, 1.4):
        got = M.mix(docs, share).collect()
        assert all(r.copies >= before.get(r.doc_id, 0) for r in got)
        before = {r.doc_id: r.copies for r in got}
        for s in "abc":
            own = sorted((r for r in got if r.source == s), key=lambda r: r.hash)
            whole, rest = divmod(own[0].target, own[0].source_size)
            if whole >= 3:
                assert all(r.copies == 3 for r in own)
                continue
            sums = [sum(r["size"] for r in own[:i]) for i in range(len(own) + 1)]
            n = min(range(len(sums)), key=lambda i: (abs(rest - sums[i]), i))
            assert [r.copies for r in own] == [whole + (i < n) for i in range(len(own))]
