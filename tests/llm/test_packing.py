import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sparkloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n", "Hello, world. it's don't", "ÉCOLE, école x́, …", "a,b ,c. d,", "Σίσυφος ΣΑΣ, σας.", "1234 12.5, <|endoftext|> <|EndOfText|>", "tab\tand\x1cother space　here",
    "naïve,\ncafé. Ünïcödé, ÅÄÖ.", "x" * 5000, "word " * 9000, "K Å ﬁ Ǆ İ, ı.", "a.́ b,​ c", "'s 't, 're.'ll I'M we'VE, THEY'D",
]


def expected(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def test_pieces_and_places(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, length int").repartition(3)
    got = [r.asDict() for r in P.pack(docs, PATH).collect()]
    want = []
    for i, t, *_ in rows:
        ids = expected(t)
        want += [(i, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    check_places(got)


def check_places(got, capacity=4096):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_few_sequences_and_hot_lengths(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 7)
    rng = random.Random(2)
    sizes = [10] * 150 + [rng.randint(1, 60) for _ in range(200)] + [63] * 20
    texts = [" ".join("a" for _ in range(n)) for n in sizes]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [r.asDict() for r in P.pack(docs, PATH, capacity=64).collect()]
    assert len(got) == len(texts)
    assert check_places(got, 64) <= 1.06 * -(-sum(n + 1 for n in sizes) // 64)


def test_fullest_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        best, reach = 0, {0}
        for length, n in counts.items():
            for _ in range(n):
                reach |= {x + length for x in reach}
        best = max(x for x in reach if x <= room)
        taken = P.fullest(dict(counts), room)
        assert sum(k * v for k, v in taken.items()) == best and all(0 < v <= counts[k] for k, v in taken.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    histogram = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(40)}
    used = {}
    for taken, times in P.plan(histogram, 100):
        assert sum(k * v for k, v in taken.items()) <= 100
        for k, v in taken.items():
            used[k] = used.get(k, 0) + v * times
    assert used == histogram
    assert P.plan({}, 100) == []


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_more_words_than_the_table_has_places(spark, monkeypatch):
    monkeypatch.setattr(P, "TABLE", 1 << 10)
    monkeypatch.setattr(P, "REMEMBERED", 700)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)) for n in (3000, 10, 900, 5000, 50)]
    encode = P.Encoder(PATH)
    for i, ids in P._ids(encode, pa.array(texts)):
        assert np.array_equal(np.append(ids, 1), expected(texts[i]))


def test_a_tokenizer_that_joins_across_spaces():
    encode = P.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encode.by_word and P.Encoder(PATH).by_word
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  Words, and\nmore", "", None]
    assert [ids.tolist() for _, ids in P._ids(encode, pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_many_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 50)
    docs = spark.createDataFrame([(None, "one and the same text")] * 2000 + [(1, "another")] * 3, "doc_id long, text string")
    out = P.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert len(out) == 2003 and max(at.values()) <= 4096
    assert len(at) == -(-sum(at.values()) // 4096) or len(at) <= sum(at.values()) / 4096 + 1
