"""License scan by diagonal voting.

All rolling word k-gram hashes of all texts are joined, in Spark, to the k-gram positions of license templates.
Each hit is compared with the gram's words, votes for its offset diagonal (place in the document less place in the template),
diagonals of one template that neighbour each other are merged (words were put in or left out between them),
and a merged span is verified: it counts when its longest chain of hits that rises in both text and template, by dynamic programming over the template's places, holds enough of the template's grams. Short phrases are templates of their own whose
every gram must vote on one diagonal, so their places are exact.

The template table is broadcast; it is a parameter of a few hundred rows and doesn't grow with the documents.
A document's words and text travel with its grams through the join, so texts are read once and never shuffled.

Null texts count as empty. Empty texts and texts without words have no spans. Very long texts make long arrays
in their own row only. An empty table gives no rows. Repeated rows and equal or null doc_ids each come out as rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._words import NOT_ALNUM, Words, scratch, slices, word_hash

#: Phrases whose places are all reported, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: License notices, matched with gaps; fixed public wordings.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-attribution": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-attribution-sharealike": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-noncommercial": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain",
    "agpl-notice": "under the terms of the gnu affero general public license as published by the free software foundation",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "no-derivatives": "licensed under cc by nd 4 0",
    "non-commercial": "licensed under cc by nc 4 0",
    "share-alike": "licensed under cc by sa 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words in a gram: for phrases, and for notices.
SHORT, LONG = 2, 4
#: Diagonals of one notice merge if their spans lie within so many words, and so do their offsets.
GAP, SHIFT = 12, 8
#: Share of a notice's grams that a span must hold.
LEAST = 0.6


def _grams(batches):
    scratch("license")
    for batch in batches:
        texts = batch.column(1)
        for at, to in slices(texts):
            w = Words(texts.slice(at, to - at), NOT_ALNUM)
            with np.errstate(over="ignore"):
                both = np.stack((w.grams(SHORT), w.grams(LONG)), axis=1).reshape(-1).view(np.int64)
            n = np.diff(w.first)
            # each document: a mark (0) of its own, then the two grams from each of its words on
            grams = np.insert(both, 2 * w.first[:-1], 0)
            ends = np.append(0, np.cumsum(2 * n + 1)).astype(np.int32)
            doc = np.repeat(np.arange(w.n), n)
            starts = np.insert((w.starts - w.offsets[doc]).astype(np.int32), w.first[1:], np.diff(w.offsets).astype(np.int32))
            text = np.where(NOT_ALNUM[w.bytes], w.bytes, np.uint8(0x20))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, to - at),
                    pa.array(n, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), w.n, [None, pa.py_buffer(w.offsets.astype(np.int32)), pa.py_buffer(text)]),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n + 1)).astype(np.int32)), pa.array(starts)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(grams)),
                ],
                ["row", "n_words", "bytes", "starts", "grams"],
            )


def template_grams(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(hash, template, at, words, gram, total): the positions of all templates' grams; template '' stands for the document's own mark."""
    rows = [(0, "", 0, 0, "", 0, False)]
    for label, text, k, whole in [*((b, a, SHORT, True) for a, b in phrases.items()), *((a, b, LONG, False) for a, b in notices.items())]:
        words = text.split()
        with np.errstate(over="ignore"):
            hashes = word_hash(words, k, NOT_ALNUM).view(np.int64).tolist()
        rows += [(h, label, i, k, " ".join(words[i : i + k]), len(hashes), whole) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "hash long, template string, at int, k int, gram string, total int, whole boolean")


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(row, doc_id, n_words, spans) for each row of docs; spans: label, base (a whole phrase), start, words, score."""
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    grams = base.select(F.struct("row", "doc_id").alias("row"), "text").mapInArrow(
        _grams, "row struct<row: long, doc_id: long>, n_words long, bytes binary, starts array<int>, grams array<long>"
    )
    hit = grams.select("*", F.posexplode("grams").alias("i", "hash")).join(F.broadcast(template_grams(spark, phrases, notices)), "hash")
    hit = hit.withColumn("pos", F.expr("int((i - 1) div 2)"))
    # words of the hit, compared byte for byte; of the two grams from a word on, each meets templates of its own length
    words = F.expr("if(template = '', '', rtrim(regexp_replace(string(substring(bytes, starts[pos] + 1, starts[least(pos + k, int(n_words))] - starts[pos])), ' +', ' ')))")
    right = F.expr(f"template = '' or (i > 0 and (i - 1) % 2 = if(k = {SHORT}, 0, 1) and pos + k <= n_words)")
    hit = hit.where(right).where(words == F.col("gram"))
    hit = hit.select("row.row", "row.doc_id", "n_words", "template", "at", "k", "total", "whole", "pos", (F.col("pos") - F.col("at")).alias("diagonal")).repartition("row")

    votes = hit.groupBy("row", "doc_id", "n_words", "template", "diagonal", "k", "total", "whole").agg(
        F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_list(F.struct("pos", "at")).alias("hits")
    )
    order = Window.partitionBy("row", "template").orderBy("low", "diagonal")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    near = (F.col("low") - reach <= GAP) & (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= SHIFT)
    votes = votes.withColumn("new", F.when(~F.col("whole") & F.coalesce(near, F.lit(False)), 0).otherwise(1))
    votes = votes.withColumn("span", F.sum("new").over(order))
    span = votes.groupBy("row", "doc_id", "n_words", "template", "k", "total", "whole", "span").agg(
        F.sum("votes").alias("votes"), F.array_sort(F.transform(F.flatten(F.collect_list("hits")), lambda h: F.struct(h["pos"].alias("pos"), (-h["at"]).alias("back")))).alias("hits")
    )
    # verification: the longest chain that rises in text and template. For each place of the template, the longest one that ends there, of those the one that begins and ends last;
    # hits of one word come with falling places, so a chain holds one of them at most
    chain = F.expr(
        "array_max(aggregate(hits, array_repeat(struct(0 as n, -1 as low, -1 as high), total), (a, h) -> transform(a, (x, i) -> if(i <> -h.back, x, greatest(x,"
        " coalesce(get(transform(filter(array(array_max(slice(a, 1, -h.back))), p -> p.n > 0), p -> struct(p.n + 1 as n, p.low as low, h.pos as high)), 0), struct(1 as n, h.pos as low, h.pos as high)))))))"
    )
    span = span.withColumn("chain", chain).withColumn("low", F.col("chain.low")).withColumn("high", F.col("chain.high"))
    score = F.col("chain.n") / F.col("total")
    found = F.when(
        (F.col("template") != "") & F.when(F.col("whole"), F.col("votes") == F.col("total")).otherwise(score >= LEAST),
        F.struct(
            F.col("template").alias("label"), F.col("whole").alias("base"), F.col("low").cast("long").alias("start"),
            (F.col("high") - F.col("low") + F.col("k")).cast("long").alias("words"), score.alias("score"),
        ),
    )
    return span.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(found)).alias("spans"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Base phrases, license notices and their places in all documents."""
    found = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        text(base).alias("base_labels"), text(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )

