"""License scan by diagonal voting.

Every run of k words of a document whose hash passes a Bloom bitmap of the templates' runs goes
to Spark, which joins it with the templates' positions on the run's hash and words. A hit votes
for its diagonal (document position minus template position). Votes are counted by document,
template and diagonal; neighbouring diagonals, as an inserted or a missing word makes them, are
merged, and a merged span counts if the template words that it covers are a large enough share.

Phrases (``mit license`` and so on) are templates of one run each; every place where one stands
is counted. Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.

Null and empty texts have no words and no labels. Repeated rows are grouped by a row number of
their own within each task, so each keeps its own result. Places with equal votes (ties) all count. Texts are read
whole, however long. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.llm import textblocks as tb

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
K = 3
MIN_COVERAGE = 0.8
DIAGONAL_GAP = 3
_BLOOM_BITS = 1 << 20


def template_rows(phrases=PHRASES, templates=TEMPLATES, k: int = K) -> list[tuple]:
    """(template, label, is_phrase, template_words, position, k, run, run's hash) of every run of words."""
    out = []
    for i, (text, label, is_phrase) in enumerate([(*p, True) for p in phrases] + [(*t, False) for t in templates]):
        words = text.split(" ")
        n = len(words) if is_phrase else min(k, len(words))
        out += [(i, label, is_phrase, len(words), j, n, " ".join(words[j : j + n])) for j in range(len(words) - n + 1)]
    return [(*row, _run_hash(row[6])) for row in out]


def _run_hash(run: str) -> int:
    raw = np.frombuffer(run.encode(), dtype=np.uint8)
    words = tb.Block(raw, np.array([0, len(raw)]), 0).words(tb.ALNUM)
    return int(words.grams(words.hashes(), len(words.starts))[0].view(np.int64)[0])


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u % np.uint64(_BLOOM_BITS)).astype(np.int64), ((u >> np.uint64(32)) % np.uint64(_BLOOM_BITS)).astype(np.int64)


def scan(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES, k: int = K, min_coverage: float = MIN_COVERAGE, diagonal_gap: int = DIAGONAL_GAP) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text): words, phrase counts and places, labels, score and verified spans."""
    spark = docs.sparkSession
    rows = template_rows(phrases, templates, k)
    lengths = sorted({r[5] for r in rows})
    bloom = np.zeros(_BLOOM_BITS, dtype=bool)
    for b in _bits(np.array([r[7] for r in rows], dtype=np.int64)):
        bloom[b] = True

    def runs(batches):
        task_rows = 0
        for batch in batches:
            for block in tb.blocks(batch, "text"):
                low = block.lower()
                words = low.words(tb.ALNUM)
                hashes, in_row = words.hashes(), words.rows()
                text = low.data.tobytes()
                found: list[list] = [[] for _ in range(block.n)]
                for n in lengths:
                    grams, first = words.grams(hashes, n)
                    a, b = _bits(grams)
                    hit = np.flatnonzero(bloom[a] & bloom[b])
                    for g, w in zip(grams[hit].view(np.int64).tolist(), first[hit].tolist(), strict=True):
                        r = int(in_row[w])
                        run = b" ".join(text[x:y] for x, y in zip(words.starts[w : w + n], words.ends[w : w + n], strict=True))
                        found[r].append({"h": g, "run": run.decode("utf-8", "replace"), "place": w - int(words.at[r])})
                ids = batch.column("doc_id").slice(block.first, block.n)
                yield pa.record_batch({
                    "doc_id": ids, "row": pa.array(np.arange(task_rows, task_rows + block.n)), "n_words": pa.array(words.counts.astype(np.int64)),
                    "runs": pa.array(found, pa.list_(pa.struct([("h", pa.int64()), ("run", pa.string()), ("place", pa.int64())]))),
                })
                task_rows += block.n

    seen = docs.select("doc_id", "text").mapInArrow(runs, "doc_id long, row long, n_words long, runs array<struct<h: long, run: string, place: long>>")
    seen = seen.withColumn("row", F.struct(F.spark_partition_id().alias("task"), "row")).select("doc_id", "row", "n_words", F.explode_outer("runs").alias("r")).select("doc_id", "row", "n_words", "r.h", "r.run", "r.place")
    # The templates are this function's arguments, a few hundred rows: they may be broadcast.
    places = spark.createDataFrame(rows, "template int, label string, is_phrase boolean, template_words int, position int, k int, run string, h long")
    hits = seen.join(F.broadcast(places), ["h", "run"], "left")
    key = ["doc_id", "row", "n_words"]
    votes = hits.groupBy(*key, "template", "label", "is_phrase", "template_words", "k", (F.col("place") - F.col("position")).alias("diagonal")).agg(
        F.count("position").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("position").alias("positions"))
    near = Window.partitionBy(*key, "template").orderBy("diagonal")
    new = F.when((F.col("diagonal") - F.lag("diagonal").over(near) <= diagonal_gap) & ~F.col("is_phrase"), 0).otherwise(1)
    merged = votes.withColumn("new", new).withColumn("band", F.sum("new").over(near))
    spans = merged.groupBy(*key, "template", "label", "is_phrase", "template_words", "k", "band").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("first_word"), (F.max("high") + F.first("k") - 1).alias("last_word"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    spans = spans.withColumn("coverage", F.when(F.col("template").isNotNull(), covered / F.col("template_words")).otherwise(F.lit(0.0)))
    phrase, verified = F.col("is_phrase"), F.coalesce(F.col("is_phrase"), F.lit(False)) | (F.col("coverage") >= min_coverage)
    labels = lambda cond: F.coalesce(F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label"))))), F.lit(""))
    return spans.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(phrase, F.col("votes"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(phrase, F.col("first_word"))).alias("first_word"),
        F.max(F.when(phrase, F.col("last_word") - F.col("k") + 1)).alias("last_word"),
        labels(phrase).alias("base_labels"), labels(verified).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct("first_word", "last_word", "label", "coverage")))).alias("spans"),
    ).drop("row")
