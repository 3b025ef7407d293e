"""Line dedup: repeated runs of whole lines go, all but the first of each.

A run counts from LINES lines on, or with one line from more than WORDS words on. It is repeated where the same bytes stand in an earlier place (smallest
doc_id, then place) that doesn't overlap it. In a repeated run of several lines each two neighbours are repeated too, so `runs` cuts a text into all its pairs of
neighbours and its long single lines, and what these cover together is every repeated run in full length. A document of one short line is a run of its own, equal
to other such documents only. The earliest copy of a line is never removed, so no line is lost altogether.

Places are grouped by hash and bytes, and only groups of equal bytes count. Hashes and places move first, without any text. The bytes of repeated runs are read again from their places, and combined before they are shuffled, so a run that very many documents hold costs a row for each task.

`cut` is a coarser way to cut, by content: a rolling hash over the last WINDOW lines ends a chunk where it is divisible by MODULUS. Its chunks miss what
lies across their borders; the registered queries don't use it.

Lines end at \\n; empty lines belong to the line before them, and those between two lines have to be equal too. A removed run goes with the line ends behind it. Null texts stay null, empty ones
empty; a text without repeated runs stays as it is, byte for byte. An empty table gives an empty one. A very long text is one row whose places are one array. Rows with the same doc_id are told apart by a
hash of their text; rows equal in both are one document and come out alike. All other columns are kept as they are.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._words import SPACES, Words, byte_table, mix, scratch, slices, trim

WINDOW, MODULUS, LINES = 2, 3, 2
#: A single line counts as a run with more words than these.
WORDS = 50
LINE_BYTES = byte_table(b"\n")


def cut(texts: pa.Array):
    """(document, start, end, stop, hash) of all chunks of LINES lines or more; places are bytes in the document."""
    for at, to in slices(texts):
        part = texts.slice(at, to - at)
        w = Words(part, LINE_BYTES, lower=False)
        if not len(w.hashes):
            continue
        doc = np.repeat(np.arange(w.n), np.diff(w.first))
        with np.errstate(over="ignore"):
            roll = w.hashes.copy()
            for j in range(1, WINDOW):
                same = doc[j:] == doc[:-j]
                roll[j:] += np.where(same, mix(w.hashes[:-j], 77 * j), np.uint64(0))
            last = mix(roll) % np.uint64(MODULUS) == 0
            last[w.first[1:][np.diff(w.first) > 0] - 1] = True
            begin = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
            until = np.flatnonzero(last)
            place = np.arange(len(doc)) - np.repeat(begin, until - begin + 1)
            value = np.add.reduceat(mix(w.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)
            value = mix(value + (until - begin).astype(np.uint64))
        base = w.offsets[doc[begin]]
        final = np.append(doc[begin][1:] != doc[begin][:-1], True)
        follow = np.append(w.starts[begin[1:]], 0)
        stop = np.where(final, w.offsets[doc[begin] + 1], follow)
        keep = until - begin + 1 >= LINES
        yield (at + doc[begin][keep], (w.starts[begin] - base)[keep], (w.ends[until] - base)[keep], (stop - base)[keep], value[keep].view(np.int64))


def runs(texts: pa.Array):
    """(document, start, end, stop, hash) of every two lines that follow each other, every line of more than WORDS words, and the line of each document of one; as `cut` has them."""
    for at, to in slices(texts):
        w = Words(texts.slice(at, to - at), LINE_BYTES, lower=False)
        if not len(w.hashes):
            continue
        doc = np.repeat(np.arange(w.n), np.diff(w.first))
        base = w.offsets[doc]
        last = np.append(doc[1:] != doc[:-1], True)
        stops = np.where(last, w.offsets[doc + 1], np.append(w.starts[1:], 0))
        inside = SPACES[w.bytes]
        begun = np.cumsum(np.append(inside[:1], inside[1:] & ~inside[:-1]))
        words = begun[w.ends - 1] - begun[w.starts] + inside[w.starts]
        with np.errstate(over="ignore"):
            two = np.flatnonzero(~last)
            gap = (w.starts[two + 1] - w.ends[two]).astype(np.uint64)
            pair = mix(mix(w.hashes[two], 1) + w.hashes[two + 1] * np.uint64(0x9E3779B97F4A7C15) + mix(gap, 2))
            long = np.flatnonzero(words > WORDS)
            alone = np.flatnonzero(last & np.append(True, last[:-1]) & (words <= WORDS))
            single = [mix(w.hashes[long], 3), mix(w.hashes[alone], 4)]
        first = np.concatenate((two, long, alone))
        until = np.concatenate((two + 1, long, alone))
        yield (at + doc[first], (w.starts - base)[first], (w.ends - base)[until], (stops - base)[until], np.concatenate((pair, *single)).view(np.int64))


def _chunks(how, batches):
    scratch("lines")
    for batch in batches:
        for doc, start, end, stop, value in how(batch.column(2)):
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(doc), batch.column(1).take(doc), *map(pa.array, (start, end, stop, value))], ["doc_id", "text_hash", "start", "end", "stop", "hash"]
            )
    trim()


def _later() -> Column:
    """A place that is neither `first` nor overlaps it."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return ~(same & (F.col("start") < F.col("first.end")))


def repeated_chunks(docs: DataFrame, how=cut) -> DataFrame:
    """(doc, text_hash, places): the places (start, stop) to be removed, for each document that has any; how: cut or runs."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    chunks = base.mapInArrow(partial(_chunks, how), "doc_id long, text_hash long, start long, end long, stop long, hash long")
    chunks = _shared.written(chunks, "chunks")
    place = F.struct("doc_id", "text_hash", "start", "end")
    # equal rows have equal places; written apart from the join, so that a hash with very many places can be split there
    often = chunks.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("final")).where(~F.col("first").eqNullSafe(F.col("final"))).drop("final")
    often = _shared.written(often, "often")
    found = _shared.written(chunks.join(often, "hash"), "repeated")
    _shared.drop(chunks, often)

    # bytes of the repeated chunks, taken from their places and grouped as bytes; only texts that hold any are shuffled
    where = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("start", "end", "hash")).alias("places"))
    where = _shared.written(where.select(F.xxhash64("d", "h").alias("key"), "d", "h", "places"), "where")
    key = F.xxhash64("doc_id", "text_hash")
    held = _shared.among(base, key, where).withColumn("key", key).join(where, "key").where("doc_id <=> d and text_hash = h")
    held = held.select("doc_id", "text_hash", F.col("text").cast("binary").alias("raw"), F.explode("places").alias("p"))
    held = held.select("doc_id", "text_hash", "p.start", "p.end", "p.hash", F.expr("substring(raw, int(p.start + 1), int(p.end - p.start))").alias("chunk"))
    kinds = _shared.written(held.groupBy("hash", "chunk").agg(F.min(place).alias("first")), "kinds")
    mixed = kinds.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    again = found.where(_later()).select("doc_id", "text_hash", "start", "stop", "hash")
    if mixed.head(1):  # one hash, different bytes: each kind of bytes keeps a first place of its own
        mixed = _shared.written(mixed, "mixed")
        inside = held.join(mixed, "hash", "left_semi").join(kinds, ["hash", "chunk"]).where(_later())
        inside = inside.select("hash", "doc_id", "text_hash", "start").distinct()
        same = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & F.expr("a.text_hash = b.text_hash and a.start = b.start and a.hash = b.hash")
        again = again.join(mixed, "hash", "left_anti").select("doc_id", "text_hash", "start", "stop").union(
            found.alias("a").join(inside.alias("b"), same, "left_semi").select("doc_id", "text_hash", "start", "stop")
        )
    return again.groupBy(F.col("doc_id").alias("doc"), "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("places"))


def dedup_lines(docs: DataFrame, how=cut) -> DataFrame:
    """docs with repeated chunks of lines removed from text, and a last column `chunks_removed`, which takes the place of one of that name; places that overlap count once."""
    places = repeated_chunks(docs, how).select(F.xxhash64("doc", "text_hash").alias("key"), "doc", F.col("text_hash").alias("h"), "places")
    places = _shared.written(places, "places")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("d"), docs["text"].cast("string").alias("t"), F.xxhash64(docs["text"]).alias("x"))
    row = _shared.marked(row.withColumn("key", F.xxhash64("d", "x")), F.col("key"), places)
    told = row.where("may_").alias("a").join(places.alias("b"), F.expr("a.key = b.key and d <=> doc and x = h"), "left").select("row", "t", "places")
    out = row.where("not may_").select("row", "t", F.lit(None).cast(dict(places.dtypes)["places"]).alias("places")).union(told)
    # what lies between the places stays; ordered by start, they are by stop too
    left = F.expr(
        "array_join(transform(zip_with(concat(array(0L), transform(places, p -> p.stop)), concat(transform(places, p -> p.start), array(bigint(octet_length(t)))), (a, b) -> struct(a, b)),"
        " s -> string(substring(binary(t), int(s.a + 1), int(greatest(s.b - s.a, 0L))))), '')"
    )
    apart = F.expr("size(filter(zip_with(places, concat(array(0L), transform(places, p -> p.stop)), (p, before) -> p.start >= before), x -> x))")
    fields = [F.when(F.col("places").isNull(), F.col("row.text")).otherwise(left).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "chunks_removed"]
    return out.select(*fields, F.coalesce(apart, F.lit(0)).cast("long").alias("chunks_removed"))


def dedup_runs(docs: DataFrame) -> DataFrame:
    """docs with all repeated runs of whole lines removed from text, and a last column `chunks_removed`: the stretches removed."""
    return dedup_lines(docs, runs)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of lines."""
    return dedup_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "chunks_removed", "text")
