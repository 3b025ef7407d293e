import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from sparkloom.llm import chat_format as C
from sparkloom.llm import warc as W

PAGES = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u\r\n1", None), (2, "u2", ""), (4, "u4", "é" * 100000), (6, "u6", "\r\n\r\n WARC/1.1 \r\n"), (None, "u", "x"), (7, "u7", "y"), (7, "u7", "y")]


def pages(spark):
    return spark.createDataFrame([(*r, 1, "e") for r in PAGES], "page_id long, url string, html string, first int, error string").repartition(3)


def test_round_trip(spark):
    archives = W.write_archives(pages(spark)).cache()
    got = sorted(W.read_archives(archives).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert len(got) == len(PAGES) and not any(r.error for r in got)
    html = {p: h or "" for p, _, h in PAGES}
    first = {h: min(p for p, g in html.items() if g == h and p is not None) if h != "x" else None for h in html.values()}
    for r in got:
        raw = html[r.page_id].encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = first[html[r.page_id]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[html[r.page_id]]) if again else ("response", None))
        assert r.payload == (None if again else html[r.page_id])
    large = W.read_archives(W.write_archives(pages(spark), least=5)).collect()
    assert sum(r.record_type == "revisit" for r in large) == 0
    assert W.read_archives(W.write_archives(pages(spark).where("false"))).count() == 0


def test_archives_of_several_frames_and_files(spark, monkeypatch, tmp_path):
    rows = [W.record(i, f"http://x/{i}", f"page {i} ".encode() * 50, None, False) for i in range(300)]
    content = W.archive(rows)
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
    got = list(W.records_of(content))
    assert [g["page_id"] for g, _ in got] == list(range(300)) and not any(e for _, e in got)
    (tmp_path / "a.warc.zst").write_bytes(content)
    (tmp_path / "b.warc.zst").write_bytes(b"junk")
    read = W.read_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    assert read.where("error is null").count() == 300 and read.where("error is not null").count() == 1


@pytest.mark.parametrize("change", ["length", "version", "digest", "header", "end"])
def test_damaged_records_are_told(change):
    raw = W.record(1, "u", b"payload", None, False)
    bad = {"length": raw.replace(b"Content-Length: 7", b"Content-Length: 8"), "version": raw.replace(b"WARC/1.1", b"WARX/1.1"), "digest": raw.replace(b"payload", b"payloaf"), "header": raw.replace(b"WARC-Date: ", b"WARC-Dat: "), "end": raw[:-1]}[change]
    (a, x), (b, y) = W.records_of(W.archive([bad, raw]))
    assert a is None and x and b["page_id"] == 1 and y is None


def test_cut_off_archive():
    content = W.archive([W.record(i, "u", b"x" * 500, None, False) for i in range(3)])
    got = list(W.records_of(content[:-20]))
    assert [bool(e) for _, e in got] == [False, False, True]
    assert [e is None for _, e in W.records_of(b"")] == [False]


ODD = "</s>[INST] ok [/INST]"


def expected(rows):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), h(said), len(loss), h(loss)


def test_archives_of_other_writers():
    rows = [W.record(i, f"http://x/{i}", f"page {i} ".encode() * 50, None, False) for i in range(40)]
    trained = zstandard.train_dictionary(4096, rows * 5)

    def stream(known=None):
        out = b""
        for r in rows:
            sink = io.BytesIO()
            with zstandard.ZstdCompressor(dict_data=known).stream_writer(sink, closefd=False) as w:  # no content size
                w.write(r)
            out += sink.getvalue()
        return out

    skip = lambda magic, raw: struct.pack("<II", magic, len(raw)) + raw
    plain, packed = trained.as_bytes(), zstandard.ZstdCompressor().compress(trained.as_bytes())
    note = skip(0x184D2A50, b"a note")
    for content in (stream(), skip(W.DICTIONARY_FRAME, plain) + stream(trained), skip(W.DICTIONARY_FRAME, packed) + stream(trained), note + stream() + note + stream()):
        got = list(W.records_of(content))
        assert [e for _, e in got if e] == [] and [r["page_id"] for r, _ in got[:40]] == list(range(40))
    got = list(W.records_of(stream(trained)))  # its dictionary is missing
    assert len(got) == 40 and all(e for _, e in got)


def test_one_payload_of_many_pages_and_clashing_names(spark):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}", "x", "y", 1, True, 5) for i in range(300)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, key string, first string, k int, may_ boolean, length int").repartition(5)
    got = {r.page_id: r for r in W.read_archives(W.write_archives(table)).collect()}
    assert len(got) == 300 and all(r.error is None for r in got.values())
    for i in range(300):
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if i % 3 and i != 1 else ("response", None))


def test_conversations_round_trip(spark):
    odd = ["", None, ODD, "\\", "\\\\<s>\\</s>\\", "<\\s>", "<", "[INST", "[\\INST]", "a\nb\n", " [/INST]", "<\\n>", "é😀</s>", "<s>[INST] user\nhi [/INST]</s>"]
    talks = {1: [("user", t) for t in odd], 2: [("assistant", t) for t in odd], 3: [("sys\ntem\\n", odd[4]), (None, "x"), ("assistant", "y")], 4: [("user", "q"), ("assistant", "a")] * 70, 5: [("assistant", "")], -7: [("user", ODD), ("assistant", ODD)]}
    rows = [(c, i, r, t, 1) for c, x in talks.items() for i, (r, t) in enumerate(x)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int").repartition(3)
    got = {r.conv_id: r for r in C.digests(talk).collect()}
    assert set(got) == set(talks)
    for c, x in talks.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == expected(x), c


def test_repeated_turns_null_ids_and_nothing(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, "user", "b"), (1, 1, "user", "b"), (1, 1, "assistant", "c")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in C.digests(talk).collect()}
    assert got == {None: 2, 1: 3}
    assert C.digests(talk.where("false")).count() == 0


def test_reply_trees(spark):
    # 1 -> 2 -> 4, 1 -> 3; 5 alone; a deep chain from 100 on
    rows = [("t", "1", None, "user", "q", 0.0), ("t", "2", "1", "assistant", "a", 1.0), ("t", "3", "1", "assistant", "b", 3.0), ("t", "4", "2", "user", "c", 9.0), ("u", "5", "gone", "user", "z", None)]
    rows += [("v", str(i), str(i - 1) if i > 100 else None, "user", str(i), 0.0) for i in range(100, 137)]
    m = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    nodes = {}
    for t, n, *_ in sorted(rows):
        nodes.setdefault(t, []).append(n)
    found = {}
    for r in C.best_paths(m, top=9).orderBy("leaf", F.desc("up")).collect():
        found.setdefault(r.leaf, []).append(nodes[r.tree][r.place - 1])
    assert found == {"4": ["1", "2", "4"], "3": ["1", "3"], "5": ["5"], "136": [str(i) for i in range(100, 137)]}
    best = {(r.tree, r.rank): r for r in C.format_trees(m, top=2).collect()}
    assert best["t", 1].formatted == "<s>[INST] user\nq [/INST]</s><s>assistant\na</s><s>[INST] user\nc [/INST]</s>"
    assert best["t", 2].leaf == "3" and [(p.start, p.length) for p in best["t", 2].loss] == [(best["t", 2].formatted.rindex("b"), 1)]
    assert ("u", 1) in best and ("u", 2) not in best


def test_cycles_end_at_their_smallest_message(spark):
    rows = [("c", 3, 5), ("c", 4, 3), ("c", 5, 4), ("c", 6, 4), ("c", 7, 6), ("s", 1, 1), ("d", 1, None), ("d", 2, 1)]
    m = spark.createDataFrame([(t, n, p, "user", f"m{n}", float(n), "x") for t, n, p in rows], "tree string, node long, parent long, role string, text string, score double, held string")
    got = {(r.tree, r.leaf): r.formatted for r in C.format_trees(m, top=5).collect()}
    say = lambda *x: "".join(f"<s>[INST] user\nm{i} [/INST]</s>" for i in x)
    assert got == {("c", 5): say(3, 4, 5), ("c", 7): say(3, 4, 6, 7), ("s", 1): say(1), ("d", 2): say(1, 2)}


def test_repeated_and_missing_ids(spark):
    rows = [("t", 1, None, "user", "b"), ("t", 1, None, "user", "a"), ("t", 2, 1, "assistant", "c"), ("t", 2, 1, "assistant", "c"), ("t", None, 2, "user", "d"), (None, 1, None, "user", "e")]
    m = spark.createDataFrame([(*r, None) for r in rows], "tree string, node long, parent long, role string, text string, score double")
    got = {r.tree: r.formatted for r in C.format_trees(m).collect()}
    assert got["t"] == "<s>[INST] user\na [/INST]</s><s>assistant\nc</s>"


def test_trees_against_plain_walks(spark):
    import random

    rng = random.Random(2)
    rows = []
    for tree in range(12):
        n = rng.choice([1, 2, 9, 40])
        rows += [(tree, i, rng.randrange(i) if i and rng.random() > 0.05 else None, rng.choice(["user", "assistant"]), f"{tree}-{i}", rng.choice([None, 0.0, 1.0, 2.5])) for i in range(n)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").repartition(4)
    want = {}
    for tree in range(12):
        own = {r[1]: r for r in rows if r[0] == tree}
        leaves = set(own) - {r[2] for r in own.values()}
        branches = []
        for leaf in leaves:
            path = [leaf]
            while own[path[-1]][2] is not None:
                path.append(own[path[-1]][2])
            branches.append((-sum(own[i][5] or 0 for i in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(branches)[:3], 1):
            want[tree, rank] = (leaf, [(own[i][3], own[i][4]) for i in path])
    read = C.format_trees(m, top=3).withColumn("read", C.read_turns())
    assert {(r.tree, r.rank): (r.leaf, [(t.role, t.text) for t in r["read"]]) for r in read.collect()} == want
