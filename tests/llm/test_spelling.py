import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import entries
from sparkloom.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, word string, n int, size string, depth int"


def words_of(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def table(spark, rows, path):
    spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], KIND).repartition(4).write.parquet(f"{path}/documents.parquet")


def got(spark, path):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.op12_spelling_variants(spark, str(path)).collect()}


def corpus(seed, stems, docs=60):
    rng = random.Random(seed)
    weights = [rng.choice([1, 1, 2, 8, 40, 300]) for _ in stems]
    return [(i, " ".join(rng.choice([str, str.upper])(w) + rng.choice(["", ",", "1", "中"]) for w in rng.choices(stems, weights, k=400))) for i in range(docs)]


def test_variants_match_brute_force(spark, tmp_path):
    rng = random.Random(2)
    stems = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(250)}
    # many words under one prefix, so cells are split, and words that end where a cell is split
    stems |= {"aaaaaa" + "".join(rng.choice("abcdÿ") for _ in range(rng.randint(0, 5))) for _ in range(900)}
    rows = corpus(3, sorted(stems), 300) + [(None, "bababa " * 20), (3, "bababa " * 20), (3, "bababa " * 20), (901, None), (902, ""), (903, "×÷ßÀÉab abcdef÷ " * 9)]
    n = words_of(rows)
    assert len(n) > 500
    table(spark, rows, tmp_path)
    want = plain(n)
    assert got(spark, tmp_path) == want
    assert any(root != form and form for form, root, *_ in want.values()) and len(stems & set(n)) < len(n)


def test_cells_are_small(spark):
    rng = random.Random(5)
    words = sorted({"prefix" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)} | {"prefix"})
    out = S.cells(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    assert sorted(r.word for r in out) == words
    assert max(Counter(r.word[: r.depth] for r in out).values()) <= S.CELL and min(r.depth for r in out) >= 6


def test_very_long_words_and_texts(spark, tmp_path):
    long = "ab" * 3000
    rows = [(i, f"{long} {long[:-1]}c {long[:2000]}x{long[2000:]} {long}é " + "common " * 3000) for i in range(6)]
    n = words_of(rows)
    table(spark, rows, tmp_path)
    assert got(spark, tmp_path) == plain(n) and len(n) >= 4


def test_empty_tables(spark, tmp_path):
    table(spark, [], tmp_path / "a")
    table(spark, [(1, "no word"), (2, None)], tmp_path / "b")
    assert got(spark, tmp_path / "a") == got(spark, tmp_path / "b") == {}


def test_sql_agrees(spark, tmp_path):
    rows = corpus(7, ["spelling", "speling", "spellling", "Müllerin", "mullerin", "müllerinn", "gradués"], 12) + [(None, "spelling mullerin " * 30)]
    table(spark, rows, tmp_path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in c.execute(entries.OP12_SQL).fetchall()} == got(spark, tmp_path)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("aéÿ", min_size=0, max_size=6), min_size=1, max_size=40), st.integers(0, 2))
def test_active_nodes_give_each_pair_once(rest, cells):
    """Cells share nothing: words of several cells, walked together."""
    words = [(c, "pq"[c % 2] * 2 + r) for c in range(cells + 1) for r in sorted(rest)]
    names = [w.encode("latin-1") for _, w in words]
    a, b = S.near_pairs(names, np.array([c for c, _ in words]), np.full(len(words), 2))
    found = Counter(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, j) for j in range(len(words)) for i in range(j) if words[i][0] == words[j][0] and one_apart(words[i][1], words[j][1])}
    assert set(found) == want and set(found.values()) <= {1}


def test_best_of_breaks_ties_by_order():
    n = np.array([5, 9, 9, 1])
    near, best = S.best_of(4, np.array([0, 0, 3]), np.array([2, 1, 0]), n)
    assert near.tolist() == [3, 1, 1, 1] and best.tolist() == [1, 0, 0, 0]
