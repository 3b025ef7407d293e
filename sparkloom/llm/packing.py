"""Best-fit packing by minimum bin slack.

Documents are tokenised in Arrow batches and cut into pieces of at most the capacity. Which pieces share a sequence hangs on their
lengths alone, so the plan is made on the histogram of lengths, of at most `capacity` rows whatever the size of the corpus:
per bin, a bitset subset-sum dynamic programme over the lengths that are left finds the fullest combination
that holds the largest of them, and takes it out, as often as the counts allow. Each such step uses up a length (or
leaves less of it than one bin takes), so the plan is bounded too. Pieces then take their places by their rank within
their length; ranks are counted in buckets sized from the histogram, so a length that very many pieces share is spread over tasks.

Null texts count as empty; an empty text has the end token only. Repeated rows and equal or null doc_ids are
packed one by one. An empty table gives no pieces. A very long text is encoded in its own slice, and its distinct words make the
worker's word table grow for that slice. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from ._words import SPACES, Words, scratch, slices, trim

CAPACITY = 4096
END = 1
#: Pieces of one length in one bucket.
BUCKET = 1_000
#: Words whose ids a worker remembers from slice to slice, in a table of TABLE places at first; it grows with the words of one slice.
REMEMBERED, TABLE = 700_000, 1 << 20


class Encoder:
    """Ids of texts, word by word, for tokenizers that lower-case, drop white space, and join nothing across it; PROBES tell these from others,
    which encode each text whole.

    Texts that may hold a special string are encoded whole too. The ids of a word are looked up by its 64-bit hash.
    """

    PROBES = ("The  the\tTHE", " lead, and. trail ", "x1 22 'S don't\n\n e\u0301 A.B", "\u00c9t\u00e9 -- (x) $5.00,")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.by_word = all(whole(x) == [i for w in x.split() for i in whole(w.lower())] for x in self.PROBES)
        self.clear()

    def clear(self):
        self.key, self.code = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.int32)
        self.start, self.size, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 16, np.uint32)
        self.n = self.used = 0

    def room(self, n: int):
        """A table in which n words leave a quarter of the places free."""
        if 4 * n > 3 * len(self.key):
            old, code = self.key, self.code
            size = 1 << (4 * n // 3).bit_length()
            self.key, self.code = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self.put(old[old != 0], code[old != 0])

    def put(self, hashes: np.ndarray, code: np.ndarray):
        place = (hashes & np.uint64(len(self.key) - 1)).astype(np.int64)
        while len(code):
            free = self.key[place] == 0
            at, one = np.unique(place[free], return_index=True)
            own = np.flatnonzero(free)[one]
            self.key[at], self.code[at] = hashes[own], code[own]
            left = np.ones(len(code), dtype=bool)
            left[own] = False
            hashes, code, place = hashes[left], code[left], (place[left] + 1) & (len(self.key) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        place, todo = (hashes & np.uint64(len(self.key) - 1)).astype(np.int64), None
        while True:
            own = hashes if todo is None else hashes[todo]
            there = self.key[place]
            hit = there == own
            more = ~hit & (there != 0)
            if todo is None:
                out[hit], todo = self.code[place[hit]], np.flatnonzero(more)
            else:
                out[todo[hit]], todo = self.code[place[hit]], todo[more]
            if not len(todo):
                return out
            place = (place[more] + 1) & (len(self.key) - 1)

    def learn(self, hashes: np.ndarray, words: list[str]):
        """Distinct hashes that find() doesn't know."""
        while self.n + len(words) > len(self.start):
            self.start, self.size = (np.append(a, np.zeros(len(a), np.int32)) for a in (self.start, self.size))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(words)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(words)] = size
        code = np.arange(self.n, self.n + len(words), dtype=np.int32)
        self.room(self.n + len(words))
        self.put(hashes, code)
        self.n, self.used = self.n + len(words), self.used + len(flat)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them)."""
        w = Words(texts, SPACES, detach=True)
        hashes = np.where(w.hashes == 0, np.uint64(1), w.hashes)
        code = self.find(hashes)
        if (code < 0).any():
            new, first = np.unique(hashes[code < 0], return_index=True)
            if self.n + len(new) > REMEMBERED:
                self.clear()
                new, first = np.unique(hashes, return_index=True)
                at = first
            else:
                at = np.flatnonzero(code < 0)[first]
            raw = w.bytes.tobytes()
            for a in range(0, len(new), 4_000):
                own = at[a : a + 4_000]
                self.learn(new[a : a + 4_000], [raw[s:e].decode() for s, e in zip(w.starts[own].tolist(), w.ends[own].tolist(), strict=True)])
            code = self.find(hashes)
        size = self.size[code]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[code] - ends + size, size) + np.arange(total)]
        return ids, np.append(0, ends)[w.first[1:]]


def _ids(encode: Encoder, texts: pa.Array):
    """The ids of each text, slice by slice."""
    special = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
    if not encode.by_word:
        for i, text in enumerate(texts.to_pylist()):
            yield i, np.array(encode.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype=np.uint32)
        return
    for at, to in slices(texts):
        flat, ends = encode(texts.slice(at, to - at))
        begin = 0
        for i, end in enumerate(ends.tolist()):
            if special[at + i]:
                yield at + i, np.array(encode.tokenizer.encode(texts[at + i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield at + i, flat[begin:end]
            begin = end


def _pieces(path: str, capacity: int):
    def run(batches):
        kept = scratch("packing")
        if path not in kept:
            kept[path] = Encoder(path)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, own in _ids(kept[path], batch.column(1)):
                ids = np.append(own, np.uint32(END)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    doc.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(a, pa.int64()) for a in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            trim()

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths in counts, each up to its count, with the largest sum within room; large lengths first."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:  # a length that is there c times is added in runs of 1, 2, 4, ... copies
            run = min(times, left)
            steps.append((length, run, reach))
            reach |= (reach << (length * run)) & mask
            left, times = left - run, times * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, run, before in reversed(steps):
        if not before >> at & 1:
            at -= length * run
            taken[length] = taken.get(length, 0) + run
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (copies of each length in it, how many such bins)."""
    left, bins = {k: v for k, v in histogram.items() if v}, []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        taken = fullest(rest, capacity - largest)
        taken[largest] = taken.get(largest, 0) + 1
        times = min(left[x] // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        bins.append((taken, times))
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies in a sequence, offset of the first) for each length of each bin."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for taken, times in bins:
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            at = rank.get(length, 0)
            out.append((length, at, n * times, sequence, n, offset))
            rank[length] = at + n * times
            offset += n * length
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = texts.mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # the running number, written once, parts rows that are equal in all else
    pieces = _shared.written(pieces.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))
    ranges = spark.createDataFrame(table or [(0,) * 6], "length long, low long, ranks long, sequence long, copies long, at long")
    sizes = spark.createDataFrame([(n, -(-c // BUCKET)) for n, c in histogram.items()] or [(0, 1)], "length long, buckets long")
    # both tables are broadcast; their size is bounded by the capacity
    dealt = pieces.join(F.broadcast(sizes), "length")
    dealt = dealt.withColumn("bucket", F.expr("pmod(xxhash64(row_), buckets)")).drop("buckets")
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("row_")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(ranges), "length").where("rank >= low and rank < low + ranks")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("sequence + (rank - low) div copies").alias("sequence_id"), F.expr("at + (rank - low) % copies * length").alias("offset"),
    )


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
