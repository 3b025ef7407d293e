import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from sparkloom.sources import memory as M

KIND = "dedupe_key string, session_id string, fact_type string, content string, confidence double"


def rows(spark, *keys, content="c"):
    return spark.createDataFrame([(k, "s", "goal", content, 1.0) for k in keys], KIND)


def parts(path):
    return os.listdir(f"{path}/parts") if os.path.isdir(f"{path}/parts") else []


def test_promotion_looks_up_before_it_writes(spark, tmp_path):
    path = str(tmp_path / "store")
    assert M.memories(spark, path).count() == 0
    assert {tuple(r) for r in M.promote(rows(spark, "a", "b", "b"), path).collect()} == {("a", "success"), ("b", "success")}
    assert {tuple(r) for r in M.promote(rows(spark, "b", "c"), path).collect()} == {("b", "skipped"), ("c", "success")}
    assert sorted(r.dedupe_key for r in M.memories(spark, path).collect()) == ["a", "b", "c"]
    M.update(rows(spark, "a", "x", content="new"), path)
    M.delete(spark.createDataFrame([("b",), ("y",)], "dedupe_key string"), path)
    assert {(r.dedupe_key, r.content) for r in M.current(M.memories(spark, path)).collect()} == {("a", "new"), ("c", "c")}
    assert {r.dedupe_key for r in M.lookup(spark, path, ["a", "b", "z"]).collect()} == {"a"}
    assert {tuple(r) for r in M.promote(rows(spark, "b"), path).collect()} == {("b", "success")}  # deleted ones may come again
    assert M.by_source(spark, path, "s").count() == 3 and M.by_source(spark, path, "t").count() == 0
    assert M.vacuum(path) == 0


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "store")
    M.append(M._versioned(rows(spark, "a"), False), path)
    before = parts(path)
    bad = spark.range(400).coalesce(1).select(F.format_string("k%03d", "id").alias("dedupe_key"), F.lit("s").alias("session_id"), F.lit("goal").alias("fact_type"), F.lit("c").alias("content"),
                                                  F.when(F.col("id") == 399, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("confidence"))
    M.register(spark)
    with pytest.raises(Exception, match="broken"):
        M._versioned(bad, False).write.format(M.NAME).mode("append").save(path)
    assert parts(path) == before and [r.dedupe_key for r in M.memories(spark, path).collect()] == ["a"]
    with pytest.raises(Exception, match="broken"):
        M.append(M._versioned(bad, False), path)
    assert [r.dedupe_key for r in M.memories(spark, path).collect()] == ["a"]
    M.vacuum(path)  # tasks that were still writing
    assert parts(path) == before
    (tmp_path / "store" / "parts" / "lost.parquet").write_bytes(b"half a part")  # of an executor that was lost
    assert M.memories(spark, path).count() == 1 and M.vacuum(path) == 1 and parts(path) == before


def test_parts_beyond_the_keys_are_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    for keys in (["a", "b"], ["m", "n"], ["x"]):
        M.append(M._versioned(rows(spark, *keys).coalesce(1), False), path)

    def asked(*filters):
        reader = M.Reader(path)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sum(p.name != "" for p in reader.partitions())

    every = asked()
    assert every >= 3 and asked(EqualTo(("dedupe_key",), "m")) == 1 and asked(In(("dedupe_key",), ("a", "x"))) == 2 and asked(EqualTo(("dedupe_key",), "q")) == 0 and asked(EqualTo(("content",), "c")) == every


def test_nothing_is_overwritten(spark, tmp_path):
    with pytest.raises(Exception, match="appended"):
        M._versioned(rows(spark, "a"), False).write.format(M.NAME).mode("overwrite").save(str(tmp_path / "store"))
