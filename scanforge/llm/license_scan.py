"""Licence notices in text: base phrases, and text blocks that hold most of a notice template's words.

The second is an exact set-similarity join between text blocks and templates, on Spark alone. The words of all templates
are put in one global order, the rarest in the corpus first. A block that shares `need` of a template's words must hold one
of its first size - need + 1 words in that order (prefix filter), must hold `need` template words at all (length filter), and
behind the first word they share both must have enough words left (positional filter). Only what passes is compared.

A text block is a window of a document's words. Windows come in sizes, each for templates of up to half a window, and half
overlap, so that a notice stands whole in one of them however its lines are broken.

The texts are read once. That pass counts words, finds the phrases, and keeps the texts that hold what some template needs at
all, as words or in them; the order of words, the blocks and the join are those of the kept texts, as no other text can match.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, written

#: A word, before A-Z are lower-cased, and what is between words. Java tests a class of what belongs to a word many times faster than
#: the same class told by what does not.
WORD, _GAP = r"[0-9A-Za-z\x80-\x{10FFFF}]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Template sizes (distinct words) that share a window size: up to each of these.
CLASSES = (8, 16, 32, 64)
#: Rows of matches up to which they are broadcast to the documents.
SMALL_MATCHES = 200_000

#: Notices as they are commonly worded: (label, words that a block must hold in any case, text).
TEMPLATES = (
    ("mit", "mit", "released under the mit license"),
    ("mit", "permission sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("apache-2", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache", "licensed under the apache license you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0"),
    ("gpl", "gnu general", "licensed under the gnu general public license version"),
    ("gpl", "gpl", "released under the gpl license version"),
    ("gpl", "gnu general", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser", "licensed under the gnu lesser general public license version"),
    ("agpl", "gnu affero", "licensed under the gnu affero general public license version"),
    ("bsd", "bsd", "released under the bsd license"),
    ("bsd", "redistributions binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "commons noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "commons sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0", "cc0 1 0 universal public domain dedication"),
)


def templates(rows: tuple = TEMPLATES) -> list[tuple[str, frozenset[str], frozenset[str]]]:
    """(label, needed words, all words) of each template."""
    out = [(label, frozenset(need.split()), frozenset(text.split())) for label, need, text in rows]
    if any(len(words) > CLASSES[-1] or not words or need - words for _, need, words in out):
        raise ValueError(f"a template has 1 to {CLASSES[-1]} distinct words and needs none but its own")
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _holds(lowered: Column, words) -> Column:
    """Whether a text has all words somewhere in it, as words or in them."""
    return reduce(and_, (lowered.contains(w) for w in sorted(words, key=lambda w: (-len(w), w))))


def _need(words, share: float) -> int:
    """How many of a template's words a block must hold."""
    return math.ceil(share * len(words) - 1e-9)


def may_match(lowered: Column, share: float = CONTAINMENT, rows: tuple = TEMPLATES) -> Column:
    """Whether a text in lower case has what some template needs: the words it names, and as many of its words as a block must hold.

    Words in words count too, and the whole text stands for its blocks, so no text with a match is passed over.
    """

    def of(must, words) -> Column:
        others = sum((lowered.contains(w).cast("int") for w in sorted(words - must)), F.lit(0)) >= _need(words, share) - len(must)
        return _holds(lowered, must) & others if must else others

    return reduce(or_, (of(must, words) for _, must, words in templates(rows)))


def phrase_places(text: Column, lowered: Column) -> Column:
    """struct of struct<n,first,last> for each base phrase: its places, and the least and greatest start in words from 0.

    No phrase begins as it or another one ends, so places do not overlap. lowered: the text in lower case, to pass over most texts.
    """
    none = "struct<n:int,first:int,last:int>"
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    def places(line: Column, phrase: str) -> Column:
        pieces = F.split(line, f" {phrase}(?= )", -1)  # the blank behind also opens the next word
        last = blanks(line) - blanks(F.element_at(pieces, -1)) - len(phrase.split())
        return F.struct((F.size(pieces) - 1).alias("n"), blanks(F.get(pieces, F.lit(0))).alias("first"), last.alias("last"))

    def of(line: Column) -> Column:
        return F.struct(*[F.when(line.contains(f" {p} "), places(line, p)).cast(none).alias(f"p{i}") for i, p in enumerate(PHRASES)])

    # every word stands between two single blanks
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), _GAP, " ")), F.lit(" "))
    maybe = reduce(or_, (_holds(lowered, p.split()) for p in PHRASES))
    return F.when(maybe, F.element_at(F.transform(F.array(line), of), 1))


def word_order(docs: DataFrame, rows: tuple = TEMPLATES) -> dict[str, int]:
    """The place of each template word in the global order: rarest in the texts of docs, those that are joined, first, ties by the word.

    Only template words are counted, some hundreds, however many documents there are. Any order gives the same matches.
    """
    known = sorted(set().union(*(words for _, _, words in templates(rows))))
    table = docs.sparkSession.createDataFrame([(w,) for w in known], "word string")
    each = docs.select(F.explode(words_of(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w")).select(F.lower("w").alias("word"))
    counted = each.join(F.broadcast(table), "word").groupBy("word").agg(F.count("*").alias("n"))  # broadcast: the words of the templates
    counts = {r["word"]: r["n"] for r in counted.collect()}  # a row for each of them at most
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}


def _index(order: dict[str, int], share: float, rows: tuple) -> list[tuple]:
    """(template, label, width, ids, prefix, need, must): ids are places of its words in the order, ascending; width is half a window."""
    out = []
    for number, (label, must, words) in enumerate(templates(rows)):
        ids = sorted(order[w] for w in words)
        need = _need(ids, share)
        out.append((number, label, next(c for c in CLASSES if len(ids) <= c), ids, ids[: len(ids) - need + 1], need, sorted(order[w] for w in must)))
    return out


def blocks(texts: DataFrame, order: dict[str, int]) -> DataFrame:
    """Rows (key, width, block, ids): the template words of each window of a text, ascending in the global order.

    texts: key, text. Block k of a width holds words k * width to (k + 2) * width - 1. Windows without template words have no row.
    """
    table = texts.sparkSession.createDataFrame(list(order.items()), "word string, id int")
    placed = texts.select("key", F.posexplode(words_of(ascii_lower(F.col("text")))).alias("at", "word")).join(F.broadcast(table), "word")  # the words of the templates
    wide = placed.select("key", "at", "id", F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("width"))
    last = F.floor(F.col("at") / F.col("width")).cast("int")
    both = wide.select("key", "width", "id", F.explode(F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))).alias("block"))
    return both.groupBy("key", "width", "block").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # the words of one window


def matches(texts: DataFrame, order: dict[str, int], share: float = CONTAINMENT, rows: tuple = TEMPLATES) -> DataFrame:
    """Rows (key, width, block, template, label, score): every block that holds `share` of a template's words, and those it must hold.

    score: the share that it holds.
    """
    index = texts.sparkSession.createDataFrame(_index(order, share, rows), "template int, label string, width int, template_ids array<int>, prefix array<int>, need int, must array<int>")
    prefixes = index.select("*", F.explode("prefix").alias("id")).drop("prefix")  # some words of each template
    held = blocks(texts, order).select("*", F.size("ids").alias("size"), F.explode("ids").alias("id"))
    hits = held.join(F.broadcast(prefixes), ["width", "id"]).where(F.col("size") >= F.col("need"))
    behind = lambda ids: F.size(ids) - F.array_position(ids, F.col("id"))
    hits = hits.where(1 + F.least(behind("ids"), behind("template_ids")) >= F.col("need"))
    both = F.array_intersect("ids", "template_ids")
    # a pair met at several prefix words counts once, at the first word that both have
    judged = hits.withColumn("both", both).where((F.get("both", F.lit(0)) == F.col("id")) & (F.size("both") >= F.col("need")) & (F.size(F.array_except("must", "ids")) == 0))
    return judged.select("key", "width", "block", "template", "label", (F.size("both") / F.size("template_ids")).alias("score"))


def scan(docs: DataFrame, share: float = CONTAINMENT, rows: tuple = TEMPLATES) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of docs (doc_id, text).

    base_labels come from the phrases; labels also from the templates that a block of the text holds. score: 1 with a
    base phrase, else the largest share of a template that a matching block holds, 0 without any. Null texts count as
    empty: no words, no labels, score 0. Each row is judged by its text alone, whatever its doc_id and however often it is there;
    other columns are not read. Empty tables give no rows.
    """
    text, low, maybe = F.col("text"), F.col("low"), F.col("maybe")
    lowered = docs.select("doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    # texts that may match are keyed by what they say, the others lie apart from each other
    key = F.when(maybe, F.sha2("text", 256)).otherwise(F.hex(F.xxhash64("doc_id", "text")))
    read = written(
        lowered.withColumn("maybe", may_match(low, share, rows))
        .select("doc_id", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), phrase_places(text, low).alias("base"), F.when(maybe, text).alias("text"))
    )
    kept, per_doc = read.where(text.isNotNull()).select("key", "text"), read.drop("text")
    found = matches(kept, word_order(kept, rows), share, rows)
    per_text = cut(found.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("score").alias("best")))
    small = per_text.count() <= SMALL_MATCHES
    out = per_doc.join(F.broadcast(per_text) if small else per_text, "key", "left")
    held = [F.col(f"base.p{i}") for i in range(len(PHRASES))]
    own = F.filter(F.array(*[F.when(h.isNotNull(), F.lit(label)) for h, label in zip(held, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n = sum((F.coalesce(h["n"], F.lit(0)) for h in held), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n.alias("n_base"), F.least(*[h["first"] for h in held]).cast("long").alias("first_word"), F.greatest(*[h["last"] for h in held]).cast("long").alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def scan_sql(docs: str = "documents", share: float = CONTAINMENT, rows: tuple = TEMPLATES) -> str:
    """The same in DuckDB, by counting the words that each window shares with each template."""
    of = [(i, label, next(c for c in CLASSES if len(words) <= c), len(words), math.ceil(share * len(words) - 1e-9), len(must), w, w in must) for i, (label, must, words) in enumerate(templates(rows)) for w in sorted(words)]
    values = ", ".join(f"({i}, '{label}', {width}, {size}, {need}, {musts}, '{w}', {m})" for i, label, width, size, need, musts, w, m in of)
    phrases = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + {len(p.split())}] = {p.split()})) AS start FROM d" for p, label in PHRASES.items()
    )
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {docs}),
  w AS (SELECT r, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM d), t(template, label, width, size, need, musts, word, must) AS (VALUES {values}),
  hit AS (SELECT r, template, label, size, need, musts, must, w.word, unnest([place // width, place // width - 1]) AS k FROM w JOIN t USING (word)),
  m AS (SELECT r, label, count(DISTINCT word) / any_value(size) AS score FROM hit WHERE k >= 0 GROUP BY r, template, label, k HAVING count(DISTINCT word) >= any_value(need) AND count(DISTINCT word) FILTER (must) = any_value(musts)),
  b AS ({phrases}), base AS (SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word FROM b GROUP BY r),
  l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label, true AS base FROM b UNION ALL SELECT r, label, false FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce((SELECT max(score) FROM m WHERE m.r = d.r), 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN l USING (r)"""
