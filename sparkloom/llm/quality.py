"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Each text gives counts (words, their characters, symbols, repeated lines, words in repeated three-word windows) and from these a vector of five transformed statistics. Rules on the counts
reject texts outright. The others are judged in their group, a language and source, by a minimum-covariance-determinant estimate: the mean and covariance of that share HALF of the group's vectors whose
covariance has the smallest determinant. A text whose Mahalanobis distance from it exceeds a chi-square quantile is rejected.

The search starts from three estimates that need no chance (medians and quartiles; the correlations of squashed values around them; all rows), and takes concentration steps: distances of all rows, the share of smallest
ones, their mean and covariance. One step is one aggregation by (group, bucket of the distance), which holds counts, sums and sums of products; running sums over the buckets say where the share ends. So no rows are sorted, all rows
count, and a group that holds a third of all rows is added up where it is read. The start with the smallest determinant goes on until no determinant falls any more.

Statistics are whole thousandths, so sums are exact and reruns agree. Each statistic has a least spread, added to its variance (a regularised determinant), as many texts share the value zero. Where distances have heavier tails than a normal
distribution's, the covariance is scaled up until the share's largest distance is its chi-square quantile; it is never scaled down.

Groups with fewer than LEAST judged texts are judged together, by language, and if those are too few, all together; fewer than that are kept. Null languages and sources are values of their own. Null and empty
texts have no words and fail the rules. Very long texts cost memory for their own words only. Repeated rows count each by itself; texts with equal vectors get one verdict. An empty table gives no rows. Other columns are ignored.
Three-word windows are compared by 64-bit hashes within their text. Estimates, one row for each group, are broadcast up to BROADCAST_ROWS of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

#: Rules: fewer words than this, or more than this percentage of words in repeated windows, fail.
WORDS, REPEATED = 50, 50
#: Judged texts that a group needs.
LEAST = 200
#: Share of a group that the estimate holds, and the probability beyond which a distance is an outlier's.
HALF, BEYOND = 0.75, 1e-8
#: Statistics and their least spread, in thousandths.
STATISTICS = {"f_words": 500, "f_length": 60, "f_symbols": 250, "f_lines": 200, "f_repeated": 120}
#: Buckets of a distance for each doubling; concentration steps of all starts, and at most of the best.
FINE, FIRST, MOST = 16, 2, 30
BROADCAST_ROWS = 100_000

NAMES = list(STATISTICS)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: What parts words, what is part of one, and symbols.
SPACES, WORD, SYMBOL = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column) -> Column:
    """Words in windows (one hash for each start) that occur twice or more."""
    same = lambda a, b: a["hash"] == b["hash"]
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("hash"), i.alias("at"))))
    twice = lambda s: F.filter(F.transform(s, lambda e, k: F.when(same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1)), e["at"])), lambda x: x.isNotNull())
    starts = let(placed, twice)
    return let(starts, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))


def _repeated(hashes: Column) -> Column:
    """Words (one hash for each) in three-word windows that occur twice or more."""
    grams = F.slice(F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))), F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0)))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(g)).otherwise(0))


def _words(text: Column) -> Column:
    """struct(n_words, word_chars, n_repeat_words) of a text."""
    words = F.array_remove(F.split(text, SPACES + "+", -1), "")
    return let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).cast("long").alias("n_repeat_words")
    ))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    n_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), _words(text).alias("w"), n_lines.alias("l"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    out = out.select("doc_id", "lang", "source", "w.*", "n_symbols", F.col("l.all").alias("n_lines"), (F.col("l.all") - F.col("l.distinct")).alias("n_dup_lines"))
    return out.withColumn("base_failed", (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


def _thousandths(c: Column) -> Column:
    return F.round(c * 1000).cast("long")


def with_statistics(counts: DataFrame) -> DataFrame:
    """counts with the transformed statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*", _thousandths(F.log(n)).alias("f_words"), _thousandths(F.log((F.col("word_chars") + 1) / n)).alias("f_length"), _thousandths(F.log(1 + 20 * F.col("n_symbols") / n)).alias("f_symbols"),
        _thousandths(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))).alias("f_lines"), _thousandths(F.sqrt(F.col("n_repeat_words") / n)).alias("f_repeated"),
    )


def chi2_below(x: float) -> float:
    """The chi-square distribution function with five degrees of freedom, as many as there are statistics."""
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def quantile(p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid) < p else (low, mid)
    return high


def _held(small: DataFrame) -> DataFrame:
    """A written table with a row for each group, to be broadcast if it is small."""
    small = _shared.written(small, "estimates")
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def grouped(rows: DataFrame) -> DataFrame:
    """rows with `of`, the group that judges them (null: none)."""
    n = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.col("n") >= LEAST
    n = n.withColumn("rest", F.sum(F.when(own, 0).otherwise(F.col("n"))).over(Window.partitionBy("lang")))  # one row for each source
    spoken = n.select("lang", "rest").distinct().agg(F.sum(F.when(F.col("rest") < LEAST, F.col("rest")).otherwise(0)).alias("all"))
    few = (F.col("all") >= LEAST).alias("pool")
    name = lambda *c: F.to_json(F.struct(*c))
    n = n.join(F.broadcast(spoken.select(few))).select(  # one row
        F.col("lang").alias("l_"), F.col("source").alias("s_"),
        F.when(own, name(F.lit(0).alias("level"), "lang", "source")).when(F.col("rest") >= LEAST, name(F.lit(1).alias("level"), "lang")).when(F.col("pool"), name(F.lit(2).alias("level"))).alias("of"),
    )
    n = _held(n)
    return rows.join(n, F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_")), "left").drop("l_", "s_")


SUMS = ["m", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]
MEANS, FACTOR = [f"m{i}" for i in range(P)], [f"a{i}{j}" for i, j in PAIRS]
#: Means and covariances from the sums.
MOMENTS = [*(f"s{i} / m as m{i}" for i in range(P)), *(f"q{i}{j} / m - (s{i} / m) * (s{j} / m) as c{i}{j}" for i, j in PAIRS)]


def _sums(values: list[str]) -> list[Column]:
    """Count, sums and sums of products of the statistics."""
    one = [F.expr(f"sum({v}) as s{i}") for i, v in enumerate(values)]
    return [F.expr("count(*) as m"), *one, *(F.expr(f"sum(({values[i]}) * ({values[j]})) as q{i}{j}") for i, j in PAIRS)]


def _factored(est: DataFrame, keep: list[str]) -> DataFrame:
    """Means m and covariances c as means m, the lower triangular factor a of the regularised covariance, and the logarithm of its determinant."""
    entries = []
    for i, j in PAIRS:  # row by row, each entry from those before it
        least = float(STATISTICS[NAMES[i]] ** 2) if i == j else 0.0
        rest = " - ".join([f"(c{i}{j} + {least}D)", *(f"a{i}{k} * a{j}{k}" for k in range(j))])
        entries.append(f"sqrt(greatest({rest}, {least / 2}D)) as a{i}{j}" if i == j else f"({rest}) / a{j}{j} as a{i}{j}")
    logdet = " + ".join(f"2 * ln(a{i}{i})" for i in range(P))
    return est.selectExpr("*", *entries).selectExpr(*keep, *MEANS, *FACTOR, f"{logdet} as logdet")


def _distance(rows: DataFrame, *keep: str) -> DataFrame:
    """The squared Mahalanobis distance d2, by forward substitution."""
    ys = [f"({' - '.join([f'({NAMES[i]} - m{i})', *(f'a{i}{k} * y{k}' for k in range(i))])}) / a{i}{i} as y{i}" for i in range(P)]
    return rows.selectExpr("*", *ys).selectExpr(*keep, " + ".join(f"y{i} * y{i}" for i in range(P)) + " as d2")


def _step(judged: DataFrame, est: DataFrame) -> DataFrame:
    """One concentration step for each (of, start) of est: the estimate from the HALF of its group's rows that are nearest by the one given, and `reach`, the largest distance of these."""
    near = judged.join(_held(est).withColumnRenamed("of", "o_"), F.col("of") == F.col("o_"))
    near = _distance(near, "of", "start", *NAMES)
    bucket = F.floor(F.log2(F.col("d2") + 1e-6) * FINE).cast("long")
    parts = near.groupBy("of", "start", bucket.alias("bucket")).agg(*_sums(NAMES), F.max("d2").alias("reach"))
    group = Window.partitionBy("of", "start")  # one row for each bucket
    before = F.sum("m").over(group.orderBy("bucket")) - F.col("m")
    inside = parts.withColumns({"before": before, "all": F.sum("m").over(group)}).where(f"before < ceil(all * {HALF}D)")
    sums = inside.groupBy("of", "start").agg(*(F.expr(f"sum({c}) as {c}") for c in SUMS), F.max("reach").alias("reach"))
    return _factored(sums.selectExpr("of", "start", "reach", *MOMENTS), ["of", "start", "reach"])


def _starts(judged: DataFrame) -> DataFrame:
    """The three first estimates of each group: (of, start, m, a, logdet)."""
    mid = judged.groupBy("of").agg(*(F.expr(f"percentile({c}, array(0.25D, 0.5D, 0.75D)) as p{i}") for i, c in enumerate(NAMES)))
    scales = [f"greatest((p{i}[2] - p{i}[0]) / 1.349D, {float(STATISTICS[c])}D) as z{i}" for i, c in enumerate(NAMES)]
    mid = _held(mid.selectExpr("of", *(f"p{i}[1] as m{i}" for i in range(P)), *scales))
    near = judged.join(mid.withColumnRenamed("of", "o_"), F.col("of") == F.col("o_"))
    soft = near.groupBy("of").agg(*_sums([f"bigint(round(tanh(({c} - m{i}) / z{i}) * 10000))" for i, c in enumerate(NAMES)])).selectExpr("of as o_", *MOMENTS[P:])
    tie = [f"c{i}{j} / sqrt(greatest(c{i}{i}, 1D)) / sqrt(greatest(c{j}{j}, 1D)) * z{i} * z{j} as c{i}{j}" if i != j else f"z{i} * z{i} as c{i}{i}" for i, j in PAIRS]
    plain = mid.selectExpr("of", "0 as start", *MEANS, *(f"z{i} * z{i} as c{i}{j}" if i == j else f"0D as c{i}{j}" for i, j in PAIRS))
    tied = mid.join(soft, F.col("of") == F.col("o_")).selectExpr("of", "1 as start", *MEANS, *tie)
    whole = judged.groupBy("of").agg(*_sums(NAMES)).selectExpr("of", "2 as start", *MOMENTS)
    return _factored(plain.unionByName(tied).unionByName(whole), ["of", "start"])


def estimates(judged: DataFrame) -> DataFrame:
    """(of, m, a, logdet, reach) for each group `of` of judged (of, statistics): the best estimate found."""
    now = _starts(judged)
    for _ in range(FIRST):
        now = _step(judged, now)
    row = F.struct("logdet", "start", *(c for c in now.columns if c not in ("of", "logdet", "start")))  # ties to the first start
    now = _shared.written(now.groupBy("of").agg(F.min(row).alias("b")).select("of", "b.*"), "best")
    for _ in range(MOST):
        after = _step(judged, now)
        old = now.select(F.col("of").alias("o_"), F.struct(*now.columns).alias("old"))
        new = after.select(F.col("of"), F.struct(*[F.col(c) for c in now.columns]).alias("new"))
        falls = F.col("new.logdet") < F.col("old.logdet") - 1e-9
        both = new.join(old, F.col("of") == F.col("o_")).select(F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"), falls.alias("fell"))
        both = _shared.written(both.select("e.*", "fell"), "best")
        now = both.drop("fell")
        if not both.where("fell").head(1):
            break
    return now


def verdicts(docs: DataFrame) -> DataFrame:
    """counted() with the statistics, d2 (null where no group judges) and kept."""
    rows = _shared.written(with_statistics(counted(docs)), "counts")
    rows = _shared.written(grouped(rows), "judged")
    best = estimates(rows.where("not base_failed and of is not null").select("of", *NAMES))
    # where the tails are heavier than a normal distribution's, distances count for less
    wide = F.greatest(F.lit(1.0), F.col("reach") / quantile(HALF)).alias("wide")
    best = _held(best.selectExpr("of as o_", *MEANS, *FACTOR, f"greatest(1D, reach / {quantile(HALF)!r}D) as wide"))
    told = rows.join(best, F.col("of") == F.col("o_"), "left")
    out = _distance(told, *rows.columns, "wide").withColumn("d2", F.col("d2") / F.col("wide")).drop("wide")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= quantile(1 - BEYOND), F.lit(True)))


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, rules and verdicts of all documents."""
    out = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance"))
