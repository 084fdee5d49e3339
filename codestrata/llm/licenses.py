"""License scans by diagonal voting.

Templates are base phrases and license notices, as words. All rolling K-word hashes of all documents are joined to the templates'
positions; a match of document word p with template word t votes for the diagonal p - t. Votes are summed by document, template and
diagonal; a base phrase must have every one of its votes. For a notice with votes for LEAST of its K-grams the spans are verified: these
K-grams must stand in the document in the notice's order, each once, on diagonals that slip by SLIP words at most from one to the next
(inserted or missing words), in a span of at most twice the notice and SLIP words. Hashes only find places: the words that stand there are
compared with the template's, and a place where they differ has no vote.

The template table has a fixed size (a few hundred rows), so it is sent to every executor. Nothing else is.

Defined cases: a null text is empty; a document without places has n_base 0, null first and last word, empty labels and score 0; a text that
holds several notices, or fits several equally well, has all their labels, sorted; rows are told apart by doc_id and text, so repeated rows
get equal results; a null doc_id is carried; texts of any length are scanned whole, and verified in time linear in their places; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import materialize, text_or_empty

K = 2
#: Share of a notice's K-grams that must stand in order in a span, and how far a diagonal may be from the one before.
LEAST, SLIP = 0.6, 8

# Base phrases, label: words.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
# Beginnings of published license notices, label: text.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
    "apache": "you may not use this file except in compliance with the license. You may obtain a copy of the license at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def content_words(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


def _tag(text: str | None) -> int:
    return int.from_bytes(blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _grams(text: str) -> tuple[np.ndarray, list[bytes]]:
    """The hashes of all K words in a row, and the words."""
    w = content_words(text)
    return words.grams(words.hash_words(w), K).view(np.int64), w


def _every() -> list[tuple[str, bool, str]]:
    return [(k, True, v) for k, v in PHRASES.items()] + [(k, False, v) for k, v in NOTICES.items()]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tag (a hash of the text), the hash of every K words in order, and the places whose hash is a template's and whose words aren't."""
    meant = {h: w[i : i + K] for _, _, t in _every() for g, w in [_grams(t)] for i, h in enumerate(g.tolist())}
    known = np.array(sorted(meant), np.int64)
    for rb in batches:
        for at in range(0, rb.num_rows, 512):
            part = rb.slice(at, 512)
            texts, own, other = part.column(1).to_pylist(), [], []
            for t in texts:
                g, w = _grams(t)
                own.append(g)
                hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g).tolist()
                other.append([i for i in hits if w[i : i + K] != meant[int(g[i])]])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_tag(t) for t in texts], pa.int64()), lists, pa.array(other, pa.list_(pa.int32()))], names=["doc_id", "tag", "hashes", "other"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        texts = rb.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([_tag(t) for t in texts], pa.int64()), pa.array([len(content_words(t)) for t in texts], pa.int64())], names=["doc_id", "tag", "n_words"])


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, size (K-grams), at, hash: a row for each K-gram of each template."""
    rows = []
    for n, (label, base, text) in enumerate(_every()):
        h = _grams(text)[0].tolist()
        rows += [(n, label, base, len(h), at, x) for at, x in enumerate(h)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, at int, hash long")


def chain(places: list[tuple[int, int]], size: int) -> tuple[int, int]:
    """places: document position and template position of matches. The most in order within a span, and where these start."""
    places = sorted(places)
    most, width = (0, 0), 2 * size + SLIP
    # for each match: start of the latest-starting chain of each length that ends there
    ends: list[dict[int, int]] = []
    first = 0
    for i, (p, at) in enumerate(places):
        own = {1: p}
        while p - places[first][0] > size + SLIP:
            first += 1
        for j in range(first, i):
            q, before = places[j]
            if q < p and before < at and abs((p - at) - (q - before)) <= SLIP:
                for n, start in ends[j].items():
                    if p - start <= width and own.get(n + 1, -1) < start:
                        own[n + 1] = start
        ends.append(own)
        n = max(own)
        if n > most[0]:
            most = n, own[n]
    return most


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        held = [chain([(m["p"], m["at"]) for m in own], size) for own, size in zip(rb.column(3).to_pylist(), rb.column(2).to_pylist(), strict=True)]
        n, start = ([x[k] for x in held] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(2), pa.array(n, pa.int64()), pa.array(start, pa.int32())], names=["_key", "label", "size", "votes", "start"])


def places(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Verified spans: key (doc_id, tag), label, base, start, share of the template's votes."""
    hashed = docs.mapInArrow(_hashes, "doc_id long, tag long, hashes array<long>, other array<int>")
    grams = hashed.select("doc_id", "tag", "other", F.posexplode("hashes").alias("p", "hash"))
    votes = grams.join(F.broadcast(templates(docs.sparkSession)), "hash").where(~F.array_contains("other", F.col("p")))
    # rows that are repeated vote alike: a template's position counts once on a diagonal
    key = ["doc_id", "tag", "template", "label", "base", "size"]
    on = materialize(votes.groupBy(*key, (F.col("p") - F.col("at")).alias("diagonal"), "at").agg(F.lit(1).alias("one")), "diagonals").withColumn("_key", F.struct("doc_id", "tag"))
    full = on.where("base").groupBy("_key", "template", "label", "size", "diagonal").agg(F.count("*").alias("votes")).where("votes = size")
    base = full.select("_key", "label", F.lit(True).alias("base"), F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    likely = on.where("NOT base").groupBy("_key", "template", "label", "size").agg(F.collect_set("at").alias("_seen"), F.collect_list(F.struct((F.col("diagonal") + F.col("at")).alias("p"), "at")).alias("matches"))
    likely = likely.where(F.size("_seen") >= LEAST * F.col("size")).select("_key", "label", "size", "matches")
    held = likely.mapInArrow(_verify, "_key struct<doc_id:bigint,tag:bigint>, label string, size int, votes long, start int")
    notices = held.where(F.col("votes") >= LEAST * F.col("size")).select("_key", "label", F.lit(False).alias("base"), "start", (F.col("votes") / F.col("size")).alias("share"))
    return base.unionByName(notices)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = places(source)
    label = F.when(F.col("base"), F.col("label"))
    by = found.groupBy("_key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    own = source.mapInArrow(_sizes, "doc_id long, tag long, n_words long").withColumn("_key", F.struct("doc_id", "tag"))
    return own.join(by, own["_key"].eqNullSafe(by["_key"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
