import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import jaccard_join as J
from sparkloom.llm._shared import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def documents(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:  # a copy with some words changed, around the threshold
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.choice([1, 3, 5, 6, 9, 40, 150, 400]))]
            texts.append(" ".join(w + passage if kind > 0.8 else w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = [(100 - i, t) for i, t in enumerate(documents(seed, 90))]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "One two"), (204, "one\tTWO"), (205, "x " * 3000), (206, "x " * 2999)]
    docs = spark.createDataFrame([(d, t, "n", 1, 2) for d, t in rows], "doc_id long, text string, n string, class int, component int").repartition(3)
    got = J.jaccard_components(docs)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_hot_groups_chains_and_repeated_rows(spark):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(80)]
    rows, now = [], list(base)
    for i in range(60):  # a chain: neighbours link, its ends do not
        now[rng.randrange(80)] = str(rng.random())
        rows.append((i, " ".join(now)))
    rows += [(100 + i, " ".join(base)) for i in range(200)]
    rows += [(5, rows[5][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)
    kept = J.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in brute(rows)})


def test_empty_table_and_rows_without_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(empty).count() == 0
    assert J.one_of_each(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (1, "q r s t u v")], "doc_id long, text string")
    assert J.jaccard_components(docs).count() == 4
    assert J.one_of_each(docs).count() == 3  # equal rows without an id are copies like others


def test_one_of_each_keeps_rows_without_words_and_all_columns(spark):
    rows = [(1, "", "a"), (1, "", "a"), (2, None, "b"), (2, None, "b"), (3, "x y z", "c"), (3, "x y z", "c"), (4, "p q r s t", "d"), (5, "p q r s t", "e")]
    docs = spark.createDataFrame([(d, t, x, "m", 1, 2) for d, t, x in rows], "doc_id long, text string, source string, may_ string, key int, component int")
    got = J.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.source) for r in got.collect()) == [(1, "", "a"), (1, "", "a"), (2, "", "b"), (2, "", "b"), (3, "x y z", "c"), (4, "p q r s t", "d")]


@pytest.mark.parametrize("hot", [3, 64])
def test_passages_that_many_texts_share(spark, monkeypatch, hot):
    monkeypatch.setattr(J, "HOT", hot)
    rng = random.Random(9)
    word = lambda: str(rng.random())
    passages = [[word() for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(420):
        own, p = [word() for _ in range(rng.randint(1, 30))], passages[i % 2]
        if i % 7 == 0 and rows:  # with a stretch of another text's own words
            own = rows[rng.randrange(len(rows))][1].split(" ")[-20:][: rng.randint(5, 20)] + own[:3]
        p = p[: rng.randint(50, 60)] if i % 3 == 0 else p
        rows.append((1000 - i, " ".join(p + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.jaccard_components(docs)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_linked_documents_share_a_key():
    rng = np.random.default_rng(3)
    bands = J.Bands()
    for n in [1, 2, 3, 4, 7, 8, 20, 57, 150, 700]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, len(a) // 7) + 1)
            new = rng.integers(0, 2**63, rng.integers(0, max(1, len(a) // 7) + 1), dtype=np.uint64)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], new)))
            if len(b) and J.linked(a, b):
                for share in (0.0, 0.3, 1.0):  # whatever counts as frequent
                    rare = lambda s, share=share: (s % np.uint64(1000)).astype(float) / 1000 >= share
                    assert np.intersect1d(J.part_keys(a, rare(a), bands), J.part_keys(b, rare(b), bands)).size
                x, y = (np.frombuffer(J.sketch(s), np.uint64)[None] for s in (a, b))
                words = min(x.shape[1], y.shape[1])
                assert np.bitwise_count(J.fold(x, words) ^ J.fold(y, words)).sum() <= len(np.setxor1d(a, b))


def test_shingle_sets_of_long_and_short_texts():
    texts = pa.array(["a b c d e", "a  b\tc d\ne", None, "", "a b", "A b", "w" * 3_000_000 + " " + "é " * 50])
    sets = [s for _, s in J.shingle_sets(texts, 5)]
    assert np.array_equal(sets[0], sets[1]) and np.array_equal(sets[4], sets[5])
    assert [len(s) for s in sets] == [1, 1, 0, 0, 1, 1, 2]


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert all(got[u] == got[v] <= min(u, v) for u, v in pairs if u != v)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
