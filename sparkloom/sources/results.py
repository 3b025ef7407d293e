"""Results of long runs, turn by turn, so that a run that was broken off goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame, DataFrame], DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def done_turns(spark: SparkSession, path: str, turns: list[int]) -> list[int]:
    """Turns whose results are whole: a writer's success mark lies beside them."""
    return [t for t in turns if _exists(spark, f"{path}/turn={t}/_SUCCESS")]


def results(spark: SparkSession, path: str, schema: str, turns: list[int]) -> DataFrame:
    """Results of whole turns; a turn that was broken off isn't read."""
    out = spark.createDataFrame([], f"{schema}, turn long")
    for t in done_turns(spark, path, turns):
        out = out.union(spark.read.schema(schema).json(f"{path}/turn={t}").withColumn("turn", F.lit(t).cast("long")))
    return out


def run(todo: DataFrame, step: Step, path: str, schema: str) -> DataFrame:
    """Take the turns of todo (with `turn`) in order: step(rows of the turn, results so far) gives results of `schema`, which are written as JSON; turns that are done already are left out.

    A scenario's turns depend on the ones before, so they go one after another; the rows of a turn, of all instances and arms, are one job.
    """
    spark = todo.sparkSession
    turns = sorted(r[0] for r in todo.select("turn").distinct().collect())  # a scenario's turns
    for t in turns:
        if not done_turns(spark, path, [t]):
            before = results(spark, path, schema, [x for x in turns if x < t])
            step(todo.where(F.col("turn") == t), before).write.mode("overwrite").json(f"{path}/turn={t}")
    return results(spark, path, schema, turns)
