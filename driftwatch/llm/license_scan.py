"""Licence scan by diagonal voting.

Templates (short fixed phrases and licence notices) are cut into word k-grams; every
rolling word k-gram of every document is matched to the template positions with the
same hash, each match votes for its offset diagonal (document position minus template
position), neighbouring diagonals are merged, and the spans are verified.

The template table has one row per template k-gram position.  It is built from
``TEMPLATES`` alone, so its size does not depend on the data; it is broadcast after
its row count is checked against ``MAX_TEMPLATE_ROWS``.  Grams whose hash is in no
template are dropped inside the row that holds the text, so only possible matches are
exploded, joined and shuffled.

Defined results: null or empty text gives n_words 0, n_base 0, null positions, empty
label strings and score 0; repeated rows get equal rows; an empty table gives no rows;
extra columns are ignored; a text of any length is handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_key, land

#: (label, template text).  Base phrases first, then short licence notices (fixed values).
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

#: Words a gram; a shorter template is one gram of all its words.
K = 3
MAX_TEMPLATE_ROWS = 100_000
#: Diagonals at most this far apart belong to one alignment (a few words inserted or lost).
DIAGONAL_GAP = 2
#: Share of a notice's k-grams that must be found for its label.
MIN_COVERAGE = 0.6

_NON_WORD = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, n_grams, k, tpos, gram, h: one row per template k-gram."""
    rows = []
    for n, (label, text) in enumerate([*BASE, *NOTICES]):
        words = text.split()
        k = min(K, len(words))
        rows += [(n, label, n < len(BASE), len(words) - k + 1, k, i, words[i:i + k]) for i in range(len(words) - k + 1)]
    if len(rows) > MAX_TEMPLATE_ROWS:
        raise ValueError(f"{len(rows)} template k-grams; the broadcast table holds {MAX_TEMPLATE_ROWS} at most")
    df = spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, k int, tpos int, "
                                     "gram array<string>")
    return df.withColumn("h", _hash_of("gram"))


def _hash_of(gram: str) -> Column:
    """Hash of an array of 1 to K words."""
    cases = " ".join(f"when {k} then xxhash64({', '.join(f'{gram}[{j}]' for j in range(k))})" for k in range(1, K + 1))
    return F.expr(f"case size({gram}) {cases} end")


def candidates(docs: DataFrame, tmpl: DataFrame) -> DataFrame:
    """doc_id, text hash, n_words and the k-grams whose hash occurs in a template."""
    sets = {r["k"]: r["hs"] for r in tmpl.groupBy("k").agg(F.collect_set("h").alias("hs")).collect()}
    words = f"array_remove(split(lower(coalesce(text, '')), '{_NON_WORD}'), '')"
    found = []
    for k, hs in sorted(sets.items()):
        gram = ", ".join(f"w[i+{j}]" for j in range(k))
        test = f"xxhash64({gram}) in ({', '.join(f'{h}L' for h in sorted(hs))})"
        found.append(f"if(size(w) < {k}, cast(array() as array<struct<pos:int,gram:array<string>>>), transform("
                     f"filter(sequence(0, size(w) - {k}), i -> {test}), i -> named_struct('pos', i, 'gram', array({gram}))))")
    body = f"named_struct('n', cast(size(w) as bigint), 'c', concat({', '.join(found)}))"
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("u"),
                       F.expr(f"transform(array({words}), w -> {body})[0]").alias("m")).select(
        "doc_id", "u", F.col("m.n").alias("n_words"), F.col("m.c").alias("grams"))


def spans(cand: DataFrame, tmpl: DataFrame) -> DataFrame:
    """Verified spans: d, u, template, label, base, first, last (word positions), coverage."""
    hits = (cand.select(id_key().alias("d"), "u", F.explode("grams").alias("g"))
            .select("d", "u", "g.pos", "g.gram").distinct().withColumn("h", _hash_of("gram"))
            .join(F.broadcast(tmpl.withColumnRenamed("gram", "tgram")), "h")
            .where(F.col("gram") == F.col("tgram")))                       # verify the words, not the hash
    votes = (hits.withColumn("diag", F.col("pos") - F.col("tpos"))
             .groupBy("d", "u", "template", "label", "base", "n_grams", "k", "diag")
             .agg(F.min("pos").alias("first"), F.max("pos").alias("last"),
                  F.sort_array(F.collect_set("tpos")).alias("tposs")))     # at most n_grams entries
    w = Window.partitionBy("d", "u", "template").orderBy("diag")
    near = F.col("diag") - F.lag("diag").over(w) <= F.when(F.col("base"), 0).otherwise(DIAGONAL_GAP)
    runs = votes.withColumn("run", F.sum(F.when(near, 0).otherwise(1)).over(w))
    merged = runs.groupBy("d", "u", "template", "label", "base", "n_grams", "k", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("tposs")))).alias("found"))
    cov = merged.withColumn("coverage", F.col("found") / F.col("n_grams"))
    return cov.where(F.col("base") & (F.col("coverage") == 1.0) | ~F.col("base") & (F.col("coverage") >= MIN_COVERAGE))


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-document result, verified spans)."""
    spark = docs.sparkSession
    tmpl = templates(spark)
    cand = land(candidates(docs, tmpl), "licence-candidates")
    sp = spans(cand, tmpl)
    first_base = F.when(F.col("base"), F.col("first"))
    per_doc = sp.groupBy("d", "u").agg(
        F.sum(F.col("base").cast("bigint")).alias("n_base"), F.min(first_base).cast("bigint").alias("first_word"),
        F.max(first_base).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    out = (cand.select("doc_id", id_key().alias("d"), "u", "n_words").join(per_doc, ["d", "u"], "left")
           .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
                   F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                   F.coalesce("score", F.lit(0.0)).alias("score")))
    return out, sp


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)[0]
