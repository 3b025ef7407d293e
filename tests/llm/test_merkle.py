import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from sparkloom.llm import entries
from sparkloom.llm import merkle as M

KIND = "doc_id long, text string, lang string, source string, n_chars long, tree int, idx int, n int, root string, node string, items int"
ODD = (1, 2, 3, "x", "y", 4)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((i & 1, level[i ^ 1]) if i ^ 1 < len(level) else None)
        i >>= 1
    return out


def plain(rows):
    """Counter of the results that every row should have."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(((r[0] is not None, r[0] or 0, leaf(*r)), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for x in names:
        trees[x].sort(key=lambda t: t[0])
        own[x] = levels([t[0][2] for t in trees[x]])
    top = levels([own[x][-1][0] for x in names])
    out = Counter()
    for k, x in enumerate(names):
        for i, ((_, _, h), r) in enumerate(trees[x]):
            path = siblings(own[x], i) + siblings(top, k)
            v = h
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                v = leaf(*r[:4], r[4] + 1)
            for s in path:
                v = digest(v) if s is None else digest(s[1] + v) if s[0] else digest(v + s[1])
            out[r[0], h, own[x][-1][0], top[-1][0], digest("".join(s[1] for s in path if s)), v, v == top[-1][0]] += 1
    return out


def table(spark, rows, path):
    spark.createDataFrame([(*r, *ODD) for r in rows], KIND).repartition(5).write.parquet(f"{path}/documents.parquet")


def test_proofs_match_plain_trees(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"text {rng.random()} é", rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s", None]), rng.choice([None, i, i, i])) for i in range(1200)]
    rows += [(5000, "only one", "fr", "s", 8), (7, "same id", "en", "s", 3), (None, "no id", "en", "s", 3), (None, None, None, None, None), (6000, "x " * 200000, "de", "s", 1)]
    rows += [(77, "copy", "en", "s", 4)] * 300
    table(spark, rows, tmp_path)
    got = Counter(tuple(r)[:7] for r in M.op13_merkle_manifest(spark, str(tmp_path)).collect())
    assert got == plain(rows)
    assert 0 < sum(n for k, n in got.items() if not k[6]) < len(rows) // 3


@pytest.mark.parametrize("n", [1, 2, 3, 256, 257])
def test_sizes_at_the_border_of_a_block(spark, tmp_path, n):
    rows = [(i, str(i), "en", "s", i) for i in range(n)]
    table(spark, rows, tmp_path)
    assert Counter(tuple(r)[:7] for r in M.op13_merkle_manifest(spark, str(tmp_path)).collect()) == plain(rows)


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"t{i}é", [None, "", "a", "é"][i % 4], None if i % 3 else "s", None if i % 7 == 3 else i) for i in range(90)]
    table(spark, rows, tmp_path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    q = c.execute(entries.OP13_SQL)
    names = [d[0] for d in q.description]
    assert Counter(map(tuple, M.op13_merkle_manifest(spark, str(tmp_path)).select(*names).collect())) == Counter(q.fetchall())


def test_an_empty_table(spark, tmp_path):
    table(spark, [], tmp_path)
    assert M.op13_merkle_manifest(spark, str(tmp_path)).count() == 0


def test_fractal_traversal_holds_few_nodes_and_gives_every_path(monkeypatch):
    for n in [*range(1, 70), 200, 255, 256]:
        nodes = [digest(str(i)).encode() for i in range(n)]
        full = levels([x.decode() for x in nodes])
        for high in {M.height(n), 8}:
            want = [[None if s is None else s[1].encode() for s in siblings(full, i)] for i in range(n)]
            got = list(M.traversal(nodes, high))
            if high == len(full) - 1:
                assert got == want
            top = M.root_of(nodes, high)
            assert all(M.fold(x, i, p) == top for i, (x, p) in enumerate(zip(nodes, got, strict=True)))
    most = 0
    live: list = []

    class Counted(M.Growing):
        def __init__(self, *a):
            super().__init__(*a)
            live.append(self)

        def step(self):
            nonlocal most
            super().step()
            most = max(most, max(len(self.kept) + len(self.stack) for _ in [0]))

    monkeypatch.setattr(M, "Growing", Counted)
    assert len(list(M.traversal([b"x"] * 256, 8))) == 256
    assert most <= 2 ** (M.STEP + 1) + M.LEVELS + 1
