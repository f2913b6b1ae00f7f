"""License scans: phrases by position, and a positional index of rare license words.

The index keeps, for each license template, the places of its rarest words; how
rare a word is follows from its document frequency over all documents. A file's
highest-IDF license words are looked up; each hit says where the template would
begin in the file, and a template whose postings meet at one beginning is
verified there by its mandatory phrase. All of this is column expressions on
the row; only the word counts (at most as many as the templates have words) are
collected. A null text is empty; rows are judged one by one, so repeats and
null ids need no care; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import let, whole_text

# Base phrases and labels of the contract.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label, notice, mandatory phrase (words that must stand in their places).
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
]


@dataclass(frozen=True)
class Settings:
    """rare_words: postings a template keeps, its rarest words; file_words: license words looked up of a file, its rarest;
    least_share: share of a template's postings that must meet at one beginning."""

    rare_words: int = 6
    file_words: int = 64
    least_share: float = 0.6


def normalised(text: Column) -> Column:
    """The text's words (runs of digits, letters and characters beyond ASCII), lower-cased, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def spaced(words: Column) -> Column:
    """Normalised text with a blank on either side of each word, so that neighbours never share one."""
    return F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))


def _count_words(piece: Column) -> Column:
    return (F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2


def phrase_places(text: Column, phrase: str) -> Column:
    """(count, first, last) of the places where the phrase's words stand consecutively in ``spaced`` text."""
    wanted = "".join(f" {w} " for w in phrase.split())
    count = (F.length(text) - F.length(F.replace(text, F.lit(wanted), F.lit("")))) / len(wanted)
    first = _count_words(F.substring_index(text, wanted, 1))
    last = _count_words(text) - _count_words(F.substring_index(text, wanted, -1)) - len(phrase.split())
    there = F.contains(text, F.lit(wanted))
    return F.when(there, F.struct(
        count.cast("long").alias("count"), first.cast("long").alias("first"), last.cast("long").alias("last"),
    ))


def word_rarity(documents: DataFrame) -> list[str]:
    """All template words, from the one in the fewest documents to the one in the most; ties by the word."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    # explode_outer: a plain explode would add a filter that computes the words once more
    found = documents.select(F.explode_outer(F.array_intersect(known, F.split(normalised(whole_text()), " ", -1))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _index(rarity: list[str], settings: Settings) -> list[tuple[int, str, int]]:
    """Postings (template, word, place): every place of a template's rarest words."""
    rank = {w: i for i, w in enumerate(rarity)}
    postings = []
    for k, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        rare = set(sorted(set(words), key=rank.__getitem__)[: settings.rare_words])
        postings += [(k, w, i) for i, w in enumerate(words) if w in rare]
    return postings


def _at(words: Column, place: Column) -> Column:
    """The word at a place, null outside the text."""
    return F.when(place >= 0, F.get(words, place))


def matches(words: Column, rarity: list[str], settings: Settings) -> Column:
    """Array of (template, start, share): templates found, where they begin and the share of their words that stand there.

    ``words`` must be a column, so that it is computed once.
    """
    postings = _index(rarity, settings)
    indexed = [w for w in rarity if any(w == p[1] for p in postings)]
    posting_rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(w).alias("word"), F.lit(i).alias("place")) for k, w, i in postings])

    def template_row(k: int) -> Column:
        _, notice, phrase = TEMPLATES[k]
        own = [p for p in postings if p[0] == k]
        begins = notice.split()
        parts = phrase.split()
        at = next(i for i in range(len(begins)) if begins[i : i + len(parts)] == parts)
        word_place = lambda pairs: F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("place")) for w, i in pairs])
        return F.struct(
            word_place([(w, i) for _, w, i in own]).alias("postings"), word_place([(w, at + i) for i, w in enumerate(parts)]).alias("phrase"),
            word_place([(w, i) for i, w in enumerate(begins)]).alias("all"),
        )

    templates = F.array(*[template_row(k) for k in range(len(TEMPLATES))])
    span = 1 << 40

    def standing(pairs: Column, start: Column) -> Column:
        """Of (word, place) pairs, how many stand in their place if the template begins at ``start``."""
        return F.size(F.filter(pairs, lambda p: _at(words, (start + p["place"]).cast("int")) == p["word"]))

    def verified(top: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(top, w), i)), lambda i: i.isNotNull())
        starts = F.flatten(F.transform(places, lambda i: F.transform(
            F.filter(posting_rows, lambda p: p["word"] == F.get(words, i)),
            lambda p: p["template"].cast("long") * span + (i - p["place"] + span // 2),
        )))
        tried = F.transform(F.array_distinct(starts), lambda s: F.struct(
            F.floor(s / span).cast("int").alias("template"), (s % span - span // 2).alias("start"),
        ))

        def holds(c: Column) -> Column:
            t = F.element_at(templates, c["template"] + 1)
            return (standing(t["postings"], c["start"]) >= F.ceil(F.size(t["postings"]) * settings.least_share)) & (
                standing(t["phrase"], c["start"]) == F.size(t["phrase"])
            )

        return F.transform(F.filter(tried, holds), lambda c: F.struct(
            c["template"].alias("template"), c["start"].alias("start"),
            (standing(F.element_at(templates, c["template"] + 1)["all"], c["start"])
             / F.size(F.element_at(templates, c["template"] + 1)["all"])).alias("share"),
        ))

    # in the order of rarity, so the first are the file's highest-IDF license words
    top = F.slice(F.array_intersect(F.array(*[F.lit(w) for w in indexed]), words), 1, settings.file_words)
    none = F.array().cast("array<struct<template:int,start:bigint,share:double>>")
    return let(top, lambda t: F.when(F.size(t) > 0, verified(t)).otherwise(none))


def scan(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row with ``n_words``, ``places`` (phrase, count, first, last) and ``licenses`` (label, start, share)."""
    rarity = word_rarity(documents)
    rows = documents.withColumn("_text", normalised(whole_text()))
    rows = rows.withColumn("_words", F.split("_text", " ", -1))
    places = F.filter(F.array(*[
        F.when(F.contains("_text", F.lit(phrase)), F.struct(F.lit(label).alias("label"), phrase_places(spaced(F.col("_text")), phrase).alias("place")))
        for phrase, label in BASE_PHRASES.items()
    ]), lambda x: x["place"].isNotNull())
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    rows = rows.withColumns({
        "n_words": F.when(F.col("_text") == "", 0).otherwise(F.size("_words")).cast("long"), "places": places,
        "_found": matches(F.col("_words"), rarity, settings),
    })
    licenses = F.transform("_found", lambda m: F.struct(
        F.element_at(labels, m["template"] + 1).alias("label"), m["start"].alias("start"), m["share"].alias("share"),
    ))
    return rows.withColumn("licenses", licenses).drop("_text", "_words", "_found")


def report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's row per document; score: the best share of a template found, at least 0.5 if a base phrase stands in the text."""
    rows = scan(documents.select("doc_id", "text"), settings)
    base = F.transform("places", lambda p: p["label"])
    best = F.coalesce(F.array_max(F.transform("licenses", lambda m: m["share"])), F.lit(0.0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words",
        F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["place"]["count"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["place"]["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["place"]["last"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("licenses", lambda m: m["label"]))).alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
