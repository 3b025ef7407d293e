"""Spelling variants: words of the vocabulary at edit distance one, by a self-join of its trie.

The vocabulary is cut by prefix: a prefix under which more than CELL words lie is split by the next letter, so a cell is a subtree of at most CELL words, whatever the
vocabulary's size. Within a cell, the tries of many cells are walked together, level by level. Each node's active set holds the nodes within distance one: itself, and those that were reached by one replaced, or by one
left-out letter. At each level a node hands its own set down to its children: children of one node become active for each other (a replaced letter), a child becomes active for its parent (a letter left out), and pairs
whose distance is used up go down in lock step, by equal letters. Pairs of nodes at which both words end come out.

Above the cells, a pair whose distance is used up at one of the few split levels has one way down: what is left of both words must be equal. So that descent, from one partition of the trie into others, is an equi-join on the rest
of the words; a word takes part once for each split level above it. Words that differ at one place of one prefix are counted, not paired.

Each pair of near words is met once: at the place where their prefixes part. Groups are small: words that differ in one place are at most one for each letter. Nothing is broadcast but bitmaps of split
prefixes (see _shared.marked), which may split some more.

Words are maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z in lower case; some occurrences lose a letter, by a hash of doc_id and run (a null doc_id counts as empty), before words are counted. Null texts have no words,
like empty ones. Very long texts are read in slices of a few megabytes, a very long word costs time in proportion to its length. Repeated rows count each by itself. Ties of counts go to the smaller word by code points. An empty table, or a
vocabulary without words, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._words import LOWER, slices, trim

#: A vocabulary's words have so many code points and occurrences, at least.
LETTERS, OCCURRENCES = 6, 5
#: A word's form occurs so many times as often, at least.
TIMES = 5
#: Occurrences whose crc32 this divides lose a letter.
LOSS = 199
#: Words of a cell, and of the cells that a task walks together.
CELL, TOGETHER = 256, 20_000
#: Bytes of text in a slice; runs beyond LONG bytes are hashed one by one.
SLICE, LONG = 2 << 20, 64

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


def _crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each piece of data, continued from `before`."""
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    c = ~before[order]
    many = int(np.searchsorted(-n, -LONG, side="left"))  # the first ones are longer
    for j in range(LONG):
        k = int(np.searchsorted(-n, -j, side="left"))  # longer than j
        if k <= many:
            break
        at = slice(many, k)
        c[at] = _CRC[(c[at] ^ data[s[at] + j]) & 255] ^ (c[at] >> 8)
    out = np.empty_like(c)
    out[order] = ~c
    for i in order[:many]:
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(before[i]))
    return out


def _counted(batches):
    """Words of (doc_id, text) with their occurrences in a slice of the texts."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        for at, to in slices(texts, SLICE):
            part = texts.slice(at, to - at)
            off = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + to - at + 1]
            if off[-1] == off[0]:
                continue
            data = LOWER[np.frombuffer(part.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]]
            off = off - off[0]
            lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
            inside = _ALPHA[data] | lead
            inside[1:] |= lead[:-1]
            start, end = inside.copy(), inside.copy()
            border = np.zeros(len(data) + 1, bool)
            border[off] = True
            start[1:] &= ~inside[:-1] | border[1:-1]
            end[:-1] &= ~inside[1:] | border[1:-1]
            s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
            leads = np.append(0, np.cumsum(lead))
            letters = e - s - (leads[e] - leads[s])
            some = letters >= LETTERS
            s, e, letters = s[some], e[some], letters[some]
            ids = ["" if x is None else str(x) for x in batch.column(0).slice(at, to - at).to_pylist()]
            first = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], dtype=np.uint32)
            crc = _crc32(data, s, e - s, first[np.searchsorted(off, s, side="right") - 1])
            hit = crc % LOSS == 0
            lost = []
            for i in np.flatnonzero(hit & (letters > LETTERS)):
                run, k = data[s[i] : e[i]].tobytes().decode(), int(crc[i]) % int(letters[i])
                lost.append(run[:k] + run[k + 1 :])
            s, size = s[~hit], (e - s)[~hit]
            ends = np.append(0, np.cumsum(size))
            held = data[np.repeat(s - ends[:-1], size) + np.arange(ends[-1])]
            words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held)])
            for found in (words, pa.array(lost, pa.string())):
                counts = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])
        trim()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words with at least LETTERS code points and OCCURRENCES occurrences in docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= OCCURRENCES)


class _Level:
    """The nodes of one level: the word that ends at each (or -1), and the children, as parent * 256 + letter in order."""

    def __init__(self, words: np.ndarray, node: np.ndarray, many: int, at: np.ndarray, end: np.ndarray, data: np.ndarray):
        self.term = np.full(many, -1, np.int64)
        here = at[words] == end[words]
        self.term[node[here]] = words[here]
        self.words = words[~here]
        key = node[~here] * 256 + data[at[self.words]]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.keys, self.node = key[new], np.cumsum(new) - 1

    def below(self, at: np.ndarray, end: np.ndarray, data: np.ndarray) -> _Level:
        return _Level(self.words, self.node, len(self.keys), at, end, data)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, child) for all their children."""
        low, high = np.searchsorted(self.keys, nodes * 256), np.searchsorted(self.keys, nodes * 256 + 256)
        n = high - low
        of = np.repeat(np.arange(len(nodes)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]

    def child(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child by a letter, or -1."""
        want = nodes * 256 + letters
        i = np.searchsorted(self.keys, want)
        found = (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] == want) if len(self.keys) else np.zeros(len(want), bool)
        return np.where(found, i, -1)

    def siblings(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of one node."""
        last = np.searchsorted(self.keys, (self.keys >> 8) * 256 + 256)
        n = last - np.arange(len(self.keys)) - 1
        a = np.repeat(np.arange(len(self.keys)), n)
        return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1


def near_pairs(words: list[bytes], cell: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of words (Latin-1, in order) of one cell at distance one; the first `depth` letters of a cell's words are equal."""
    data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    end = np.cumsum(size)
    at = end - size + depth
    level = _Level(np.arange(len(words)), cell, int(cell[-1]) + 1, at, end, data)
    none = np.zeros(0, np.int64)
    su, sv, du, dv, out = none, none, none, none, []
    while len(level.keys):
        at = at + 1
        under = level.below(at, end, data)
        # a child is active for its parent: its letter is left out
        du, dv = np.append(du, np.arange(len(level.keys))), np.append(dv, level.keys >> 8)
        ends = (under.term[du] >= 0) & (level.term[dv] >= 0)
        out.append((under.term[du[ends]], level.term[dv[ends]]))
        # replaced: equal letters go on, and children of one node are new
        of, cu = level.children(su)
        cv = level.child(sv[of], level.keys[cu] & 255)
        a, b = level.siblings()
        su, sv = np.append(cu[cv >= 0], a), np.append(cv[cv >= 0], b)
        ends = (under.term[su] >= 0) & (under.term[sv] >= 0)
        out.append((under.term[su[ends]], under.term[sv[ends]]))
        # left out: equal letters go on, but not by the one left out, so each pair is met at the last place where it could be
        of, cv = level.children(dv)
        other = cv != du[of]
        of, cv = of[other], cv[other]
        cu = under.child(du[of], level.keys[cv] & 255)
        du, dv = cu[cu >= 0], cv[cu >= 0]
        if len(level.keys) == len(level.words) and not len(su) and not len(du):  # each word is alone in its node: no pair can begin any more
            break
        level = under
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none)


def best_of(m: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of m words, how many near ones there are, and the one of the largest n (ties: the first), or -1."""
    x, y = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((y, -n[y], x))
    x, y = x[order], y[order]
    best = np.full(m, -1, np.int64)
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    best[x[first]] = y[first]
    return np.bincount(x, minlength=m), best


def _walked(batches):
    """Rows (word, n, depth) in order of words, whole cells in one task: (word, n_near, best)."""
    held: list[tuple[str, int, int]] = []

    def out(rows):
        words = [r[0].encode("latin-1") for r in rows]
        depth, n = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
        new = np.array([i > 0 and (r[2] != rows[i - 1][2] or r[0][: r[2]] != rows[i - 1][0][: r[2]]) for i, r in enumerate(rows)])
        near, best = best_of(len(rows), *near_pairs(words, np.cumsum(new), depth), n)
        some = np.flatnonzero(near)
        top = [{"less": -int(n[best[i]]), "word": rows[best[i]][0]} for i in some]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in some], pa.string()), pa.array(near[some], pa.int64()), pa.array(top, pa.struct([("less", pa.int64()), ("word", pa.string())]))], ["word", "n_near", "best"]
        )

    for batch in batches:
        held += zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        if len(held) >= TOGETHER:
            cut, (word, _, depth) = len(held) - 1, held[-1]
            while cut and held[cut - 1][2] == depth and held[cut - 1][0][:depth] == word[:depth]:  # the last cell may go on
                cut -= 1
            if cut:
                yield out(held[:cut])
                held = held[cut:]
    if held:
        yield out(held)


def cells(words: DataFrame) -> DataFrame:
    """words (word, n) with depth: so many letters lead to the word's cell."""
    left = words.withColumn("size", F.char_length("word"))
    done, depth = [], 1
    while True:
        prefix = F.xxhash64(F.substring("word", 1, depth))
        full = left.groupBy(prefix.alias("p")).agg(F.count("*").alias("m")).where(F.col("m") > CELL).select("p")
        full = _shared.written(full, "split")
        if not full.head(1):
            return _shared.written(_union([*done, left.select("word", "n", F.lit(depth).alias("depth"))]), "cells")
        # a whole prefix is marked or not; some are marked by chance, and split for nothing
        told = _shared.written(_shared.marked(left, prefix, full).withColumn("may_", F.col("may_") & (F.col("size") > depth)), "split")
        done.append(told.where("not may_").select("word", "n", F.lit(depth).alias("depth")))
        left, depth = told.where("may_").select("word", "n", "size"), depth + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for words (word, n) that have words at distance one; best: (less, word), less is the negative n."""
    placed = cells(words)
    inside = placed.repartition(F.substring("word", 1, F.col("depth"))).sortWithinPartitions("word").mapInArrow(_walked, "word string, n_near long, best struct<less: long, word: string>")
    # the split levels: a word without the letter at each place above its cell
    up = placed.select("word", "n", F.explode(F.expr("sequence(1, depth)")).alias("i"))
    up = up.select("word", "n", "i", F.concat(F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)")).alias("rest"))
    up = _shared.written(up, "rests")
    own = F.struct((-F.col("n")).alias("less"), "word").alias("own")
    group = up.groupBy("i", "rest").agg(F.array_sort(F.collect_list(own)).alias("all")).where("size(all) > 1")  # one for each letter at most
    group = group.select(F.posexplode("all").alias("k", "own"), (F.size("all") - 1).cast("long").alias("n_near"), F.col("all")[0].alias("top"), F.col("all")[1].alias("next"))
    replaced = group.select("own.word", "n_near", F.when(F.col("k") > 0, F.col("top")).otherwise(F.col("next")).alias("best"))
    # each pair at the last place where a letter can be left out
    last = up.where("substring(rest, i, 1) <> substring(word, i, 1)")
    short = words.select(F.col("word").alias("rest"), F.col("n").alias("m"))
    pairs = last.join(short, "rest")
    longer = pairs.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("m")).alias("less"), F.col("rest").alias("word")).alias("best"))
    shorter = pairs.select(F.col("rest").alias("word"), F.lit(1).cast("long").alias("n_near"), own.alias("best"))
    return _union([inside, replaced, longer, shorter]).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n)."""
    words = _shared.written(words, "vocabulary")
    near = near_words(words).select(F.col("word").alias("w_"), "n_near", "best")
    form_n = -F.col("best.less")
    fits = form_n >= TIMES * F.col("n")
    told = words.join(near, F.col("word") == F.col("w_"), "left").select(
        "word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, form_n).alias("form_n")
    )
    told = _shared.written(told, "forms")
    links = _shared.written(told.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:  # each round doubles the way; counts grow five-fold with each form, so ways are short
        on = links.select(F.col("word").alias("at_"), F.col("root").alias("to_"))
        moved = _shared.written(links.join(on, F.col("root") == F.col("at_"), "left").select("word", F.coalesce("to_", "root").alias("root"), F.col("to_").isNotNull().alias("moved")), "links")
        links = moved.select("word", "root")
        if not moved.where("moved").head(1):
            break
    ends = links.select(F.col("word").alias("w_"), "root")
    return told.join(ends, F.col("word") == F.col("w_"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The whole vocabulary of all documents, with near words and forms."""
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
