import random

from sparkloom.operators import graph as G
from sparkloom.operators import lineage


def test_walks_match_breadth_first_search(spark):
    rng = random.Random(2)
    edges = [(rng.choice(["a", "b"]), f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)] + [("a", "n0", "n0"), ("a", None, "n1"), ("a", "n1", None)]
    frame = spark.createDataFrame(edges, "kind string, src string, dst string")

    def plain(starts, kinds=None, most=None):
        seen, front, hops = dict.fromkeys(starts, 0), set(starts), 0
        while front and (most is None or hops < most):
            hops += 1
            front = {d for k, s, d in edges if s in front and d is not None and (kinds is None or k in kinds)} - set(seen)
            seen |= dict.fromkeys(front, hops)
        return seen

    for starts, kinds, most in ((["n0"], None, None), (["n1", "n2", "none"], ["a"], None), (["n3"], None, 2), ([], None, None), (["n0"], None, 0)):
        got = G.reached(frame, spark.createDataFrame([(s,) for s in starts], "node string"), kinds, most)
        assert {r.node: r.hops for r in got.collect()} == plain(starts, kinds, most)


def test_a_cycle_ends(spark):
    ring = spark.createDataFrame([("x", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)], "kind string, src string, dst string")
    got = G.reached(ring, spark.createDataFrame([("n0",)], "node string"))
    assert {r.node: r.hops for r in got.collect()} == {f"n{i}": i for i in range(5)}
    back = G.reached(G.both_ways(ring), spark.createDataFrame([("n0",)], "node string"))
    assert max(r.hops for r in back.collect()) == 2


def test_clean_up_spares_what_others_hold(spark):
    has = {"fact": spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "session_id int, id int"), "file": spark.createDataFrame([(1, 5), (2, 5), (1, 6)], "session_id int, id int")}
    links = {"supersedes": spark.createDataFrame([("fact:11", "fact:13"), ("fact:13", "fact:14"), ("fact:14", "fact:11"), ("fact:10", "fact:12")], "src string, dst string")}
    edges = G.session_graph(has, links)
    got = {r.node for r in G.to_delete(edges, spark.createDataFrame([(1,)], "session_id int")).collect()}
    assert got == {"session:1", "fact:10", "fact:11", "fact:13", "fact:14", "file:6"}


def test_cut_keeps_rows(spark):
    assert sorted(r.id for r in lineage.cut(spark.range(5)).collect()) == list(range(5))
