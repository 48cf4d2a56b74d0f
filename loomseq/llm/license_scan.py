"""License scan with a positional index of rare words, with DataFrame functions only.

Templates are the notices and headers of licenses, each with a key phrase that must
stand in full. The index holds the places of each template's rarest words, by
document frequency over all documents. A file is looked up by the rarest word of
each key phrase; where one is verified, the file's own rare license words meet
the template's postings, and those at about the same relative position as the
key phrase add up their inverse document frequencies. Words that the file lacks,
before its start or behind its end as well, lower the score and refuse nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import join_small, words, written

#: rarest words of a template that the index holds
RARE = 6
#: words by which relative positions may differ, about
SLACK = 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def key_at(self) -> int:
        whole, part = self.text.split(), self.key.split()
        return next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)


# The phrases that count as base, with their labels.
BASE_TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
_GNU = ("this program is free software you can redistribute it and or modify it under the terms of the %s "
        "as published by the free software foundation")
# How well-known licenses name themselves.
TEMPLATES = BASE_TEMPLATES + (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    Template("mit", "this project is released under the mit license see the license file for details", "mit license"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
             "the license", "apache license version 2"),
    Template("gpl-2", _GNU % "gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", _GNU % "gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", _GNU % "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", _GNU % "gnu affero general public license version 3", "gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
             "distributed with this file you can obtain one", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met", "redistribution and use in source and binary forms"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
) + tuple(Template(label, f"spdx license identifier {name}", f"license identifier {name}") for label, name in (
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl"), ("agpl-3", "agpl 3 0"),
    ("mpl-2", "mpl 2 0"), ("bsd", "bsd")))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, label, base, whole, part, key_at): a row per template, from literals."""
    rows = [F.struct(
        F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _strings(t.text.split()).alias("whole"),
        _strings(t.key.split()).alias("part"), F.lit(t.key_at).alias("key_at")) for i, t in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Index:
    """Small tables: ``anchors`` (word, template, part, key_at, offset) find keys, ``postings`` (word, template, place, idf)
    and ``totals`` (template, total) weigh what stands around them."""

    anchors: DataFrame
    postings: DataFrame
    totals: DataFrame


def rare_word_index(texts: DataFrame, templates: tuple[Template, ...]) -> Index:
    """The index for ``texts`` (ws): inverse document frequencies come from all of them."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    # the empty word stands for the document itself
    seen = texts.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.filter("ws", lambda w: w.isin(vocabulary))))).alias("word"))
    counts = written(seen.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "license-words")
    documents = (counts.where("word = ''").first() or [0, 0])[1]
    table = template_table(texts.sparkSession, templates)
    of_word = counts.where("word <> ''")
    idf = F.floor(1000 * F.log(F.lit(documents + 1.0) / (F.col("df") + 1.0))).cast("bigint") + 1

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(of_word), "word", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("bigint"))).withColumn("idf", idf)

    places = table.select("template", F.posexplode("whole").alias("place", "word"))
    rarest = Window.partitionBy("template").orderBy("df", "word")
    held = weighed(places.select("template", "word").distinct()).withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= RARE)
    postings = written(places.join(held.select("template", "word", "idf"), ["template", "word"]), "postings")
    totals = held.groupBy("template").agg(F.sum("idf").alias("total"))
    first = Window.partitionBy("template").orderBy("df", "word", "offset")
    anchors = weighed(table.select("template", "label", "base", "part", "key_at", F.posexplode("part").alias("offset", "word")))
    anchors = anchors.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "df", "idf")
    return Index(written(anchors, "key-anchors"), postings, written(totals, "template-totals"))


def _listed(table: DataFrame) -> list[str]:
    return [r[0] for r in table.select("word").distinct().collect()]  # words of templates


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Key phrases found in the texts, and the documents themselves.

    Rows (doc_id, print, n_words, template, label, base, start, share): each document has
    one row with n_words and a null template, and one per place of a key phrase, ``start``,
    with the share of the template's rare words, by weight, that stand about it.
    """
    key = ["doc_id", "print"]
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "print", F.xxhash64("text"))
    rows = named.select(*key, words(F.col("text")).alias("ws"))
    index = rare_word_index(rows, templates)

    # place 0 stands for the document itself
    placed = rows.select(*key, "ws", F.posexplode(F.concat(F.array(F.lit("")), "ws")).alias("at", "word"))
    placed = placed.where((F.col("at") == 0) | F.col("word").isin(_listed(index.anchors)))
    met = placed.join(F.broadcast(index.anchors), "word", "left").withColumn("start", F.col("at") - 1 - F.col("offset"))
    there = (F.col("start") >= 0) & F.when(
        F.col("start") >= 0, F.slice("ws", F.col("start") + 1, F.size("part")) == F.col("part"))
    found = written(met.where((F.col("at") == 0) | there).select(
        *key, F.when(F.col("at") == 0, F.size("ws")).cast("bigint").alias("n_words"), "template", "label", "base",
        F.col("start").cast("bigint").alias("start"), (F.col("start") - F.col("key_at")).alias("rel")), "license-keys")

    # the rare words of files that have a key
    keys = found.where("template IS NOT NULL").distinct()
    files = written(keys.select("print").distinct(), "licensed")
    texts = join_small(named.select("print", "text"), files, ["print"], "left_semi").dropDuplicates(["print"])
    spots = texts.select("print", F.posexplode(words(F.col("text"))).alias("at", "word")).where(F.col("word").isin(_listed(index.postings)))
    window = 2 * SLACK
    near = spots.join(F.broadcast(index.postings), "word").withColumn("bucket", F.floor((F.col("at") - F.col("place")) / window))
    # a bucket reaches over the next one too, so a relative position lies well inside one of two
    near = near.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1)))
    sums = near.select("print", "template", "bucket", "word", "idf").distinct().groupBy("print", "template", "bucket").agg(F.sum("idf").alias("got"))
    centred = keys.withColumn("bucket", F.floor((F.col("rel") + SLACK) / window))
    scored = centred.join(sums, ["print", "template", "bucket"], "left").join(F.broadcast(index.totals), "template")
    places = scored.select(*key, F.lit(None).cast("bigint").alias("n_words"), "template", "label", "base", "start",
                           (F.coalesce("got", F.lit(0)) / F.col("total")).alias("share"))
    documents = found.where("template IS NULL").select(
        *key, "n_words", "template", "label", "base", "start", F.lit(None).cast("double").alias("share"))
    return documents.unionByName(places)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licenses that each text of ``docs`` (doc_id, text) names.

    One row per input row: doc_id, n_words, n_base (places of base phrases), first_word
    and last_word (their smallest and largest start, else null), base_labels, labels
    (distinct, sorted, comma-joined), score (largest share of a template's rare words,
    by weight, about one of its key phrases; 0 without any). A license is named where a
    key phrase stands in full, wherever the text begins or ends. Null and empty texts
    have no words. Repeated rows each get their row; other columns are ignored.
    """
    found = written(find_licenses(docs, templates), "licenses")
    documents = found.where("template IS NULL").select("doc_id", "print", "n_words")
    places = found.where("template IS NOT NULL").drop("n_words")
    base_start = F.when(F.col("base"), F.col("start"))
    per = places.groupBy("doc_id", "print").agg(
        F.count(base_start).alias("n_base"), F.min(base_start).alias("first_word"), F.max(base_start).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("share").alias("score"))
    same = documents["doc_id"].eqNullSafe(per["doc_id"]) & (documents["print"] == per["print"])
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return documents.join(per, same, "left").select(
        documents["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        joined("base_labels").alias("base_labels"), joined("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
