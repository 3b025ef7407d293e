"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is fixed, so the documents of a source below a threshold are the same in every run, and thresholds for larger
budgets only add to them (they nest). Sizes are summed by source and hash bucket; cumulative sums find the bucket in which a source's
budget ends; only that bucket is looked at again, with finer buckets, until it holds FEW documents, and among the hashes of these lies the threshold:
the one whose sum comes nearest to the budget, so a source misses its target by half a document at most.
No documents are sorted: the mix is a filter on the hash. A source whose target exceeds its size takes all its documents as often as they fit whole, and one more copy of those below the threshold.

Size: words of `[^\\x20\\x09-\\x0D]+`; a null text has none. Sources are in code-point order, null last (a source of its own; an empty one is too).
Documents with one doc_id and text share their hash and are taken alike. An empty table or one without words takes nothing. Very long texts
count as one document like others.
Other columns are ignored by mix() and kept by taken_rows().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Bits of the hash, and those that one round of buckets resolves.
BITS, STEP = 60, 10
#: Documents of a last bucket, which is not cut further.
FEW = 1000
#: Tables with a row for each source are broadcast up to so many rows, beyond that they are joined by shuffle.
BROADCAST_ROWS = 100_000


def words(text: str = "text"):
    return F.coalesce(F.expr(f"size(regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0))"), F.lit(0)).cast("long")


def place(doc_id: str = "doc_id", text: str = "text"):
    """The document's hash, of BITS bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(20), doc_id, text), 64 - BITS)


def _by_source(df: DataFrame, sources: DataFrame, condition=None, how: str = "inner") -> DataFrame:
    """Join on the source, null with null; sources has a column `of`."""
    few = sources.count() <= BROADCAST_ROWS
    on = df["source"].eqNullSafe(sources["of"])
    return df.join(F.broadcast(sources) if few else sources, on if condition is None else on & condition, how)


def targets(sized: DataFrame, share: float = 1.0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(of, source_size, n, target) for each source: `share` of all sizes dealt by weight, none above `most` times its size, the excess dealt again."""
    by = sized.groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("of").asc_nulls_last()))  # over one row for each source
    by = _shared.written(by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total, level = (by.agg(F.sum("source_size")).first()[0] or 0) * share, None
    capped = -1
    while True:  # each round caps at least one more source, else it ends
        over = F.lit(False) if level is None else cap <= F.col("weight") * level
        got = by.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if got[2] == capped or not got[1]:
            break
        capped, level = got[2], (total - (got[0] or 0.0)) / got[1]
    return by.select("of", "source_size", "n", F.when(cap <= F.col("weight") * F.lit(level or 0.0), cap).otherwise(F.col("weight") * F.lit(level or 0.0)).alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with `whole` copies of each document, and `below`, the hash below which there is one more."""
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long")
    now = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # [low, low + 2 ** width) is the bucket in which the budget ends; what lies below is taken and no longer in rest
    now = now.select("of", "source_size", "target", "whole", "rest", F.lit(0).cast("long").alias("low"), F.lit(BITS).alias("width"), "n")
    now = _shared.written(now.withColumn("open", (F.col("rest") > 0) & (F.col("n") > FEW)), "budgets")
    for width in range(BITS - STEP, -1, -STEP):
        if not now.where("open").head(1):
            break
        open_ = now.where("open").select("of", "low", "rest")
        part = _by_source(sized, open_, F.shiftright("hash", width + STEP) == F.shiftright("low", width + STEP))
        hist = part.groupBy("of", "rest", F.shiftright("hash", width).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("m"))
        upto = F.sum("size").over(Window.partitionBy("of").orderBy("bucket"))  # at most 2 ** STEP rows for each source
        edge = hist.withColumn("before", upto - F.col("size")).where("before <= rest and before + size > rest")
        edge = edge.select(F.col("of").alias("e"), "bucket", "before", "m")
        found = F.col("open") & F.col("bucket").isNotNull()
        # if rounding puts the end of the budget behind the last bucket, all of the bucket above is taken
        past = F.shiftleft(F.shiftright("low", width + STEP) + 1, width + STEP)
        now = now.join(edge, F.col("of").eqNullSafe(F.col("e")), "left").select(
            "of", "source_size", "target", "whole", F.when(found, F.col("rest") - F.col("before")).when(F.col("open"), 0.0).otherwise(F.col("rest")).alias("rest"),
            F.when(found, F.shiftleft("bucket", width)).when(F.col("open"), past).otherwise(F.col("low")).alias("low"),
            F.when(found, width).otherwise(F.col("width")).alias("width"), F.when(found, F.col("m")).otherwise(F.col("n")).alias("n"),
            (found & (F.col("m") > FEW) & F.lit(width > 0)).alias("open"),
        )
        now = _shared.written(now, "budgets")
    # the last bucket: few hashes; the documents below the one at which the sum comes nearest to the budget (ties: the smaller sum) are taken
    last = now.where("rest > 0").select("of", "low", "rest", "width")
    part = _by_source(sized, last, (F.col("hash") >= F.col("low")) & (F.expr("shiftright(hash - low, width)") == 0)).groupBy("of", "rest", "hash").agg(F.sum("size").alias("size"))
    part = part.groupBy("of", "rest").agg(F.array_sort(F.collect_list(F.struct("hash", "size"))).alias("all"))
    nearest = F.expr(
        "aggregate(all, struct(0L as sum, rest as off, all[0].hash as below), (acc, x) -> struct(acc.sum + x.size as sum,"
        " least(acc.off, abs(rest - acc.sum - x.size)) as off, if(abs(rest - acc.sum - x.size) < acc.off, x.hash + 1, acc.below) as below)).below"
    )
    edge = part.select(F.col("of").alias("e"), nearest.alias("upto"))
    out = now.join(edge, F.col("of").eqNullSafe(F.col("e")), "left")
    return _shared.written(out.select("of", "source_size", "target", "whole", F.coalesce("upto", "low").alias("below")), "budgets")


#: Copies of a document, from the columns of thresholds().
COPIES = "whole + if(hash < below, 1, 0)"


def mix(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, hash, source_size, target, copies, taken) for each row of docs."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words().alias("size"), place().alias("hash"))
    sized = _shared.written(sized, "sizes")
    goal = thresholds(sized, targets(sized, share))
    copies = F.expr(COPIES).cast("long").alias("copies")
    out = _by_source(sized, goal).select("doc_id", "source", "size", "hash", "source_size", "target", copies)
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def taken_rows(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it."""
    sized = _shared.written(docs.select("source", words().alias("size"), place().alias("hash")), "sizes")
    goal = thresholds(sized, targets(sized, share)).select("of", "whole", "below")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("source"), place().alias("hash"))
    copies = F.expr(COPIES).cast("int")
    out = _by_source(row, goal).withColumn("copies", copies).where("copies > 0")
    return out.select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to 100 % of all sizes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
