"""Embedding near-dedup by randomised-rotation binary codes.

Candidates: a random rotation brings a vector onto one of its axes, the one with the largest component, with its sign; two vectors at the angle of the threshold
agree in that with a probability that hangs on the dimension alone (`agreement` measures it). A band joins as many such axes as tell about 2 n vectors apart, and there are enough bands
to bring all but a share MISS of the pairs at the threshold itself (and fewer of closer pairs) together in some band; groups of unrelated vectors stay small at any n.
Vectors and rotations are rounded to integers whose products are exact in single precision, so a vector's bands are the same in whichever task they are computed.

In a group, pairs whose codes, the signs of their components in ESTIMATE rotations, differ in more places than the threshold's angle allows go first. Of the others,
the inner product is estimated from the code of one side, divided by that code's correction factor
(the product of code and vector), which makes the estimate unbiased. Pairs whose confidence bound stays below the threshold
go; all others are recomputed in double precision from the vectors, and only that decides.

What is shuffled: for each vector 12 bytes a band; then groups of two or more, equal groups once; then vectors of these groups alone, picked by a bitmap.
A pair is counted in the first band that it shares, so nothing has to be made distinct and no pair is ever a row: tasks return, for each
vector, how many it links to, and a spanning forest of the links. Equal vectors are one class with a weight, named by a 64-bit hash. Groups of
more than BLOCK classes are cut into blocks, and pairs of blocks are dealt out over tasks; the number of links of each vector can't be had without comparing these.

Vectors that are null, zero or hold null or non-finite components, and rows with a null vec_id, link with nothing; they come out with
no links and their own id. Vectors of different lengths do not link. Rows with one vec_id count as vectors of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._vectors import components, matrix, rotations, unit, valid
from ._words import mix

#: Probability of leaving out a pair that lies exactly at the threshold.
MISS = 1e-5
BLOCK = 512
#: Rotations whose codes make the estimate, and standard errors of its bound.
ESTIMATE, DEVIATIONS = 4, 5.0
#: Axes of a rotation that a band looks at, at most.
AXES = 64
#: Keys for one task.
KEYS_PER_TASK = 700_000


@functools.cache
def agreement(dim: int, threshold: float) -> float:
    """The probability that two vectors at the threshold come onto the same axis, measured and rounded down by three standard errors or more."""
    rng = np.random.default_rng([5, dim])
    m, n = min(dim, AXES), 20_000
    x, z = rng.standard_normal((n, m)), rng.standard_normal((n, m))
    y = threshold * x + math.sqrt(1 - threshold**2) * z
    a, b, own = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1), np.arange(n)
    return max(0.01, ((a == b) & ((x[own, a] > 0) == (y[own, b] > 0))).mean() - 0.012)


@functools.cache
def plan(n: int, dim: int, threshold: float) -> tuple[int, int]:
    """(axes in a band, bands) for n vectors of so many components."""
    axes = max(1, math.ceil((math.log2(max(n, 2)) + 1) / math.log2(2 * min(dim, AXES))))
    agree = agreement(dim, threshold) ** axes
    return axes, math.ceil(math.log(MISS) / math.log1p(-agree))


class Coder:
    """Band values of vectors, for one number of vectors."""

    def __init__(self, n: int, threshold: float):
        self.n, self.threshold, self.turns = n, threshold, {}

    def __call__(self, u: np.ndarray) -> np.ndarray:
        """A row of 32-bit values, one for each band, for each of the unit vectors."""
        dim = u.shape[1]
        axes, bands = plan(self.n, dim, self.threshold)
        m, level = min(dim, AXES), math.isqrt((1 << 24) // max(dim, 1)) - 1
        if dim not in self.turns:
            per = dim // m  # blocks of m columns in one rotation
            r = rotations(dim, -(-axes * bands // per) * dim, seed=19).reshape(dim, -1, dim)[:, :, : per * m].reshape(dim, -1)
            self.turns[dim] = np.round(r[:, : axes * bands * m] * level).astype(np.float32)
        r, out = self.turns[dim], np.empty((len(u), bands), np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(u), 256):
                z = (np.round(u[at : at + 256] * level).astype(np.float32) @ r).reshape(-1, axes * bands, m)
                top = np.abs(z).argmax(axis=2)
                axis = (2 * top + (np.take_along_axis(z, top[:, :, None], axis=2)[:, :, 0] > 0)).astype(np.uint64).reshape(-1, bands, axes)
                value = np.full(axis.shape[:2], dim, np.uint64)
                for i in range(axes):
                    value = mix(value * np.uint64(2 * m) + axis[:, :, i], i)
                out[at : at + 256] = (value >> np.uint64(32)).astype(np.uint32)
        return out


@functools.lru_cache(2)
def coder(n: int, threshold: float) -> Coder:
    """One for all tasks of a worker."""
    return Coder(n, threshold)


def _keys(n: int, parts: int, threshold: float):
    """(task, values, classes): for each band and each of its `parts` tasks, the values of vectors and their classes, from rows (class, embedding)."""

    def run(batches):
        code, seen = coder(n, threshold), set()
        for batch in batches:
            cls = batch.column(0).to_numpy()
            fresh = np.array([not (c in seen or seen.add(c)) for c in cls.tolist()], dtype=bool)
            if len(seen) > 2_000_000:
                seen.clear()
            part = batch.filter(pa.array(fresh))
            size = part.column(1).value_lengths().to_numpy()
            for dim in np.unique(size):
                rows = part.filter(pa.array(size == dim))
                own, values = rows.column(0).to_numpy(), code(unit(matrix(rows.column(1))))
                to = values % np.uint32(parts)
                out = []
                for band in range(values.shape[1]):
                    for p in range(parts):
                        here = to[:, band] == p
                        if here.any():
                            out.append((band * parts + p, values[here, band].tobytes(), own[here].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2))], ["task", "values", "classes"])

    return run


def _groups(parts: int):
    """Groups of at least two classes with one value in one band: (group, band, size, class); group is the same for equal groups."""

    def run(batches):
        task, value, cls = [], [], []
        for batch in batches:
            for t, v, c in zip(*(batch.column(i) for i in range(3)), strict=True):
                value.append(np.frombuffer(v.as_buffer(), np.uint32))
                cls.append(np.frombuffer(c.as_buffer(), np.int64))
                task.append(np.full(len(value[-1]), t.as_py() // parts, np.uint64))
        if not value:
            return
        key = np.concatenate(task) << np.uint64(32) | np.concatenate(value)
        cls = np.concatenate(cls)
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
        key, cls = key[fresh], cls[fresh]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        with np.errstate(over="ignore"):
            mark = mix(np.add.reduceat(mix(cls.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
        some = np.flatnonzero(size > 1)
        some = some[np.unique(mark[some], return_index=True)[1]]  # of equal groups here, that of the first band
        size, first = size[some], first[some]
        place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        band, group = np.repeat((key[first] >> np.uint64(32)).astype(np.int32), size), np.repeat(mark[some], size)
        size = np.repeat(size, size)
        for at in range(0, len(place), 100_000):
            to = at + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(group[at:to]), pa.array(band[at:to]), pa.array(size[at:to]), pa.array(cls[place[at:to]])], ["group", "band", "size", "class"])

    return run


def _compare(total: int, threshold: float):
    def block(part, code, turn):
        """Rows of whole groups: (dim, group, i, j, own, band, class, n, embedding), sorted by group."""
        key, i, j, own, band, cid, n = (part.column(c).to_numpy() for c in range(1, 8))
        x = matrix(part.column(8))
        dim = x.shape[1]
        u = unit(x)
        near = (u @ turn.setdefault(dim, rotations(dim, ESTIMATE * dim))).reshape(len(u), ESTIMATE, dim)
        sign = np.where(near > 0, 1.0, -1.0) / math.sqrt(dim)
        factor = (sign * near).sum(axis=2)
        raw = np.packbits(near.reshape(len(u), -1) > 0, axis=1)
        bits = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)
        apart = math.acos(threshold) / math.pi * ESTIMATE * dim
        apart += DEVIATIONS * math.sqrt(apart * (1 - math.acos(threshold) / math.pi))
        bound = DEVIATIONS * np.sqrt(((1 - factor**2) / factor**2).mean(axis=1) / max(1, dim - 1) / ESTIMATE)
        norm = np.sqrt((x * x).sum(axis=1))
        fresh = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.concatenate(([0], np.cumsum(fresh)))
        alive, links = np.arange(len(key)), []
        d = 0
        while len(alive):
            d += 1
            alive = alive[alive + d < len(key)]
            alive = alive[group[alive] == group[alive + d]]
            a = alive[(i[alive] == j[alive]) | (own[alive] != own[alive + d])]
            b = a + d
            keep = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= apart  # signs alone tell most pairs apart
            a, b = a[keep], b[keep]
            guess = ((sign[b] * near[a]).sum(axis=2) / factor[b]).mean(axis=1)
            keep = guess + bound[b] >= threshold
            links.append((a[keep], b[keep]))
        a, b = (np.concatenate([p[s] for p in links]) for s in (0, 1)) if links else (np.zeros(0, int),) * 2
        # a pair counts in the first band that it shares; bands are computed for the vectors of likely pairs alone
        some, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        v, p, q, own = code(u[some]), at[: len(a)], at[len(a) :], band[a]
        keep = np.ones(len(a), dtype=bool)
        for earlier in range(int(own.max(initial=0))):
            keep &= (own <= earlier) | (v[p, earlier] != v[q, earlier])
        a, b = a[keep], b[keep]
        keep = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 50_000]], x[b[k : k + 50_000]]) for k in range(0, max(1, len(a)), 50_000)]) / (norm[a] * norm[b]) >= threshold
        a, b = a[keep], b[keep]
        ids, at = np.unique(cid, return_inverse=True)
        weight = np.bincount(at[a], n[b], len(ids)) + np.bincount(at[b], n[a], len(ids))
        label = components(len(ids), at[a], at[b])
        some = weight > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label][some]), pa.array(weight[some].astype(np.int64))], ["u", "v", "weight"])

    def run(batches):
        code, turn, held = coder(total, threshold), {}, None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            while held.num_rows >= 4000:
                dim, key, i, j = (held.column(c).to_numpy() for c in range(4))
                cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                cut = cut[: np.searchsorted(dim[cut - 1], dim[0], side="right")]  # of one dimension at a time
                if not len(cut):
                    break
                at = int(cut[min(np.searchsorted(cut, 4000), len(cut) - 1)])
                yield block(held.slice(0, at), code, turn)
                held = held.slice(at)
        while held is not None and held.num_rows:
            dim = held.column(0).to_numpy()
            at = int(np.searchsorted(dim, dim[0], side="right"))
            yield block(held.slice(0, at), code, turn)
            held = held.slice(at)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = valid("embedding") & F.col("vec_id").isNotNull()
    named = rows.where(fine).select("vec_id", F.xxhash64(F.size("embedding"), "embedding").alias("class"), "embedding")
    classes = _shared.written(named.groupBy("class").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "classes")
    n = classes.count()
    parts = max(1, -(-n // KEYS_PER_TASK))
    keys = named.select("class", "embedding").mapInArrow(_keys(n, parts, threshold), "task int, values binary, classes binary")
    spread = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64 * parts)
    groups = keys.repartition(spread, "task").mapInArrow(_groups(parts), "group long, band int, size long, class long")
    groups = groups.groupBy("group", "class").agg(F.min("band").alias("band"), F.max("size").alias("size"))
    groups = _shared.written(groups, "groups")
    # the vectors of the groups, each once
    some = _shared.written(groups.select("class").distinct(), "some")
    held = _shared.among(named.select("class", "embedding"), F.col("class"), some).groupBy("class").agg(F.any_value("embedding").alias("embedding"))
    held = _shared.written(held.join(some, "class").join(classes.select("class", "n"), "class"), "vectors")
    member = groups.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.expr("int(pmod(xxhash64(class), blocks))")
    member = member.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    member = member.select("group", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class").join(held, "class")
    member = member.select(F.size("embedding").alias("dim"), "group", "i", "j", "own", "band", "class", "n", "embedding")
    member = member.repartition("group", "i", "j").sortWithinPartitions("dim", "group", "i", "j")
    links = _shared.written(member.mapInArrow(_compare(n, threshold), "u long, v long, weight long"), "links")
    parts = _shared.connected_components(links.select("u", "v").where("u <> v"))
    weight = links.groupBy(F.col("u").alias("class")).agg(F.sum("weight").alias("weight"))
    one = classes.join(weight, "class", "left").join(parts, classes["class"] == parts["node"], "left")
    one = one.select("class", F.expr("n - 1 + coalesce(weight, 0)").alias("n_links"), F.coalesce("component", "class").alias("part"), "least")
    least = one.groupBy("part").agg(F.min("least").alias("component"))
    one = _shared.written(one.join(least, "part").select("class", "n_links", "component"), "one")
    _shared.drop(groups, some, held, links)
    out = rows.select("vec_id", F.when(fine, F.xxhash64(F.size("embedding"), "embedding")).alias("class")).join(one, "class", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole embeddings table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
