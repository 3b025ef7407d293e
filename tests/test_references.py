import posixpath
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import outlines as O
from sparkloom.operators import references as R

from .test_operators import value


def test_folding_agrees_with_the_library(spark):
    rng = random.Random(1)
    for _ in range(25):
        path = "/".join(rng.choice(["a", "b", ".", "..", "", "c.py"]) for _ in range(rng.randint(1, 7)))
        want = posixpath.normpath(path.lstrip("/") or ".")
        assert value(spark, R.folded(F.col("a")), a=path) == ("" if want == "." else want), path


FILES = ["src/app/main.ts", "src/app/util.ts", "src/app/util.js", "src/lib/index.ts", "src/lib/deep/x.py", "pkg/util.ts", "style/site.css", "src/app/x.py", "notes"]


@pytest.mark.parametrize(("src", "target", "dst", "way"), [
    ("src/app/main.ts", "./util", "src/app/util.ts", "path"), ("src/app/main.ts", "./util.js", "src/app/util.js", "path"), ("src/app/main.ts", "../lib", "src/lib/index.ts", "index"), ("src/app/main.ts", "./../app/./util?raw#x", "src/app/util.ts", "path"),
    ("src/app/main.ts", "@/app/util", "src/app/util.ts", "end"), ("src/app/main.ts", "~/lib", "src/lib/index.ts", "end_index"), ("src/app/main.ts", "pkg/util", "pkg/util.ts", "path"), ("pkg/util.ts", "app/util", "src/app/util.ts", "end"),
    ("src/app/main.ts", "site.css", "style/site.css", "name"), ("src/app/main.ts", "nowhere/site.css", "style/site.css", "name"), ("src/app/main.ts", "util", "pkg/util.ts", "name"), ("src/app/main.ts", "lib.deep.x", "src/app/x.py", "name"),
    ("src/app/main.ts", "./nothing", None, None), ("src/app/main.ts", "../../../notes", None, None), ("src/app/util.ts", "./util", None, None), ("src/app/main.ts", "", None, None), ("src/app/main.ts", "#top", None, None), ("src/app/main.ts", "@/site", "style/site.css", "end"),
    ("src/app/main.ts", "notes", "notes", "name"),
])
def test_ways_to_resolve(spark, src, target, dst, way):
    files = spark.createDataFrame([(1, p) for p in FILES] + [(2, "nowhere/site.css")], "session_id int, path string")
    got = R.resolved(spark.createDataFrame([(1, src, target)], "session_id int, path string, target string"), files).collect()
    assert [(r.dst, r.way) for r in got] == ([(dst, way)] if dst else [])


def test_dependencies_by_content(spark):
    rows = [(1, "a/x.py", "import b.y\nfrom z import w"), (1, "b/y.py", ""), (1, "z.py", "import z"), (1, "a/i.html", '<a href="../b/p.html?q">'), (1, "b/p.html", "")]
    got = R.dependencies(spark.createDataFrame(rows, "session_id int, path string, content string"))
    assert {(r.src, r.dst) for r in got.collect()} == {("a/x.py", "b/y.py"), ("a/x.py", "z.py"), ("a/i.html", "b/p.html")}


SOURCE = """import x

@decorated(
    1)
class Outer(Base):
    def one(self):
        def inner():
            pass
        return inner

    @staticmethod
    async def two():
        pass

if x:
    def three(): pass
"""


def test_symbols_of_python(spark):
    want = [(5, 3, 13, 0, "class", "Outer"), (6, 6, 9, 1, "def", "Outer.one"), (7, 7, 8, 2, "def", "Outer.one.inner"), (12, 11, 13, 1, "async def", "Outer.two"), (16, 16, 16, 0, "def", "three")]
    assert O.python_symbols(SOURCE) == want
    broken = SOURCE.replace("import x", "import x x")
    assert [(s[0], s[2], s[3], s[5]) for s in O.python_symbols(broken)] == [(5, 17, 0, "Outer"), (6, 11, 1, "one"), (7, 11, 2, "inner"), (12, 15, 1, "two"), (16, 17, 1, "three")]
    assert O.python_symbols("") == [] and O.python_symbols("x = 1\0") == []
    files = spark.createDataFrame([(1, "a.py", SOURCE), (1, "b.html", "<h1>Top</h1>\nx\n<h2>Next</h2>\ny"), (1, "c.py", None), (2, "d.py", broken)], "session_id int, path string, content string").repartition(2)
    got = O.symbols(files)
    assert [(r.line, r.first, r["last"], r.depth, r.kind, r.name) for r in got.where("path = 'a.py'").orderBy("line").collect()] == want
    assert [(r.line, r["last"], r.name) for r in got.where("path = 'b.html'").orderBy("line").collect()] == [(1, 2, "Top"), (3, 4, "Next")]
    text = {r.path: r.outline for r in O.rendered(got).collect()}
    assert text["a.py"] == "line 5: class Outer\nline 6: def one\nline 7: def inner\nline 12: async def two\nline 16: def three" and "c.py" not in text
    best = {r.path: (r.name, r.first_line, r.last_line) for r in O.focused(got, "what does inner do", 80).collect()}
    assert best["a.py"] == ("Outer.one.inner", 7, 8)
    assert {r.path: r.last_line for r in O.focused(got, "outer", 4).collect()}["a.py"] == 6


def test_outlines_are_found_either_way(spark):
    outlines = spark.createDataFrame([(1, "src/a.py", "A"), (1, "lib/src/a.py", "B"), (1, "b.py", "C"), (2, "x.py", "D")], "session_id int, path string, outline string")
    asked = spark.createDataFrame([(1, "src/a.py"), (1, "a.py"), (1, "/home/me/b.py"), (1, "z/lib/src/a.py"), (1, "x.py"), (1, "xa.py")], "session_id int, query string")
    assert {r.query: r.outline for r in O.lookup(outlines, asked).collect()} == {"src/a.py": "A", "a.py": "B", "/home/me/b.py": "C", "z/lib/src/a.py": "B"}
