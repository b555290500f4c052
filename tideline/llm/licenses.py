"""License scan by diagonal voting, with DataFrame functions alone.

Every run of k consecutive words of a document is hashed and joined to the positions of the same run in the license
templates: runs of 2 words for short phrases, of K for notices and whole license texts. The join also compares the words
themselves, so a hit is a verified run. A hit votes for the diagonal (position in the document less position in the
template). A short phrase or a line that grants a license stands where a diagonal has all its votes. For longer templates, diagonals that lie close
together are merged, which lets words be missing or added in between, and the span is verified by the share of the
template's runs that it holds and by their density; a text of which much is lost counts as the template it has most of.

A text is split once. Hashes that no template has are dropped before the rows leave their task, so only hits move, and
the skinny table of documents with their hits is written and read again. The templates are a fixed list, so their table
is broadcast and their hashes are a set of constants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import stored
from .license_texts import TEXTS

#: Words of a run in notices and texts, and in phrases.
K, PAIR = 4, 2
#: The phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening sentences of published license notices (in lower case, punctuation counts as space).
NOTICES = {
    "agpl-notice": "it under the terms of the gnu affero general public license as published by the free software foundation",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-notice": "this is free and unencumbered software released into the public domain",
}
#: Lines that grant a license, of four words or more; every word has to stand.
GRANTS = {
    "agpl-3.0-grant": "licensed under the gnu affero general public license version 3",
    "apache-2.0-grant": "licensed under the apache license version 2 0",
    "bsd-2-clause-grant": "licensed under the bsd 2 clause license",
    "bsd-3-clause-grant": "licensed under the bsd 3 clause license",
    "cc-by-4.0-grant": "licensed under cc by 4 0",
    "cc-by-nc-4.0-grant": "licensed under cc by nc 4 0",
    "cc-by-nc-sa-4.0-grant": "licensed under cc by nc sa 4 0",
    "cc-by-sa-4.0-grant": "licensed under cc by sa 4 0",
    "gpl-2.0-grant": "licensed under the gnu general public license version 2",
    "gpl-3.0-grant": "licensed under the gnu general public license version 3",
    "isc-grant": "licensed under the isc license",
    "lgpl-3.0-grant": "licensed under the gnu lesser general public license version 3",
    "mit-grant": "licensed under the mit license",
    "mit-release": "released under the mit license",
    "mpl-2.0-grant": "licensed under the mozilla public license version 2 0",
    "public-domain-grant": "released into the public domain",
}
#: Diagonals at most this far apart are merged; a notice needs this share of its pairs within twice its length.
DRIFT = 3
SHARE = 0.6
#: A notice or text with less than that, but this share of its runs, counts where no other template has more runs.
LEAST_SHARE = 0.3

#: Notices and whole texts.
TEMPLATES = NOTICES | TEXTS

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str], grants: dict[str, str]) -> DataFrame:
    """(template, label, is_phrase, exact, k, width, tpos, gram, h): every run of words of every template; h hashes the
    words' hashes. Phrases and grants are exact: all their runs have to stand on one diagonal."""
    rows = []
    named = lambda table: ((text, label) for label, text in table.items())
    for base, exact, k, source in ((True, True, PAIR, phrases.items()), (False, True, K, named(grants)), (False, False, K, named(notices))):
        for text, label in source:
            words = [w for w in re.split(_BREAK, text.translate(str.maketrans(_UPPER, _LOWER))) if w]
            if len(words) < k:
                raise ValueError(f"a template needs {k} words at least: {text!r}")
            rows += [(label if not base else text, label, base, exact, k, len(words), i, words[i : i + k]) for i in range(len(words) - k + 1)]
    schema = "template string, label string, is_phrase boolean, exact boolean, k int, width int, tpos int, run array<string>"
    run = lambda k: F.xxhash64(*[F.xxhash64(F.get("run", F.lit(j))) for j in range(k)])
    table = spark.createDataFrame(rows, schema).withColumn("h", F.when(F.col("k") == PAIR, run(PAIR)).otherwise(run(K)))
    return table.withColumn("gram", F.array_join("run", " ")).drop("run")


def _hits(words: Column, hashes: Column, k: int, known: list[int]) -> Column:
    """(k, pos, h, gram) of the runs of k words whose hash a template has."""
    runs = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0))), lambda h, i: F.struct(i.alias("pos"), F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)]).alias("h")))
    met = F.filter(runs, lambda r: r["h"].isin(known))
    return F.transform(met, lambda r: F.struct(F.lit(k).alias("k"), r["pos"].alias("pos"), r["h"].alias("h"), F.array_join(F.slice(words, r["pos"] + 1, k), " ").alias("gram")))


def scanned(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, hits) of each row, written to a scratch table; no words but those of hits."""
    known = {k: [r["h"] for r in table.where(F.col("k") == k).select("h").distinct().collect()] for k in (PAIR, K)}  # a constant of the templates
    body = lambda w: _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*[_hits(w, h, k, hs or [0]) for k, hs in known.items()]).alias("hits")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _let(words_of(F.col("text")), body).alias("x"))
    return stored(rows.select("doc_id", "text_hash", "x.n_words", "x.hits"), "license-hits")


def spans(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, is_phrase, start, end, score): all verified places in scanned rows, words counted from 0.

    Rows with equal id and text give one set of spans. score is the share of the template's runs that were found.
    """
    grams = rows.where(F.size("hits") > 0).select("doc_id", "text_hash", F.explode("hits").alias("x")).select("doc_id", "text_hash", "x.*")
    hits = grams.join(F.broadcast(table), ["k", "h", "gram"]).select("doc_id", "text_hash", "template", "label", "is_phrase", "exact", "k", "width", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
    key = ["doc_id", "text_hash", "template", "label", "is_phrase", "exact", "k", "width"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("tpos").alias("seen")).withColumn("votes", F.size("seen"))
    base = votes.where(F.col("exact") & (F.col("votes") == F.col("width") - (F.col("k") - 1)))
    base = base.select("doc_id", "text_hash", "label", "is_phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("width")).alias("end"), F.lit(1.0).alias("score"))
    # A lone run of common words is no evidence: a diagonal takes part once two of its runs agree.
    near = votes.where(~F.col("exact") & (F.col("votes") >= 2))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    run = near.withColumn("gap", (F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT).withColumn("run", F.sum(F.coalesce(F.col("gap").cast("int"), F.lit(0))).over(order))
    merged = run.groupBy(*key, "run").agg(
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("seen") + K).alias("end"),
    )
    share = F.size("seen") / (F.col("width") - (K - 1))
    long = merged.withColumn("score", share).withColumn("found", F.size("seen")).where((F.col("score") >= LEAST_SHARE) & (F.col("end") - F.col("start") <= 2 * F.col("width")))
    other = long.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "start", "end", "found")])
    above = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("_start") < F.col("end")) & (F.col("start") < F.col("_end")) & (F.col("_found") > F.col("found"))
    weak = long.where(F.col("score") < SHARE).join(other, above, "left_anti")
    return base.unionByName(long.where(F.col("score") >= SHARE).select(*base.columns)).unionByName(weak.select(*base.columns))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, grants: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, a row for each row of docs.

    A null or empty text has no words and no labels (empty strings). Null ids form rows of their own; rows with equal
    id and text get equal results. Columns other than doc_id and text are ignored. score is the best share of a
    template found, 0 without labels.
    """
    table = templates(docs.sparkSession, PHRASES if phrases is None else phrases, TEMPLATES if notices is None else notices, GRANTS if grants is None else grants)
    rows = scanned(docs, table)
    found = spans(rows, table)
    base = lambda value: F.when(F.col("is_phrase"), value)
    per_doc = found.groupBy("doc_id", "text_hash").agg(
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("start"))).cast("long").alias("first_word"),
        F.max(base(F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base(F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    per_doc = per_doc.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    counted = rows.select("doc_id", "text_hash", "n_words")
    joined = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast(T.LongType())).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
