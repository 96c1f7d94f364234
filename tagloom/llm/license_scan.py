"""License scan: base phrases, and a set-similarity join of word windows with license templates.

A block is any run of as many consecutive words as a template has, over line breaks or not.
The tokens of all templates are ordered by how often the corpus holds them, rarest first. A
block that holds a share t of a template's n tokens must hold one of its n - ceil(t n) + 1
rarest (prefix filter): these make up an inverted index that the words of all texts are
joined with. A text of fewer than ceil(t n) words is left out (length filter), and of the
rest only the blocks around a place of the index word are counted (positional filter).
Everything is DataFrame expressions; texts are never shuffled, only what the join finds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, table

# Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# A phrase of each license notice that the join looks for.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
]
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but none of them into A-Z: the two
    characters that would are handled letter by letter."""
    return F.when(text.contains("\u212a") | text.contains("\u0130"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, t, ws): a key of each row, its lower-cased text and its words. The key is
    made of the row's doc_id and text alone, so that every scan gives the same one; rows that
    share it have the same result."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.md5(text.cast("binary")).alias("text"))
    rows = docs.select(key.alias("row"), "doc_id", _lower(text).alias("t"))
    return rows.select("row", "doc_id", "t", F.array_remove(F.split("t", NOT_WORD), "").alias("ws"))


def frequency_order(rows: DataFrame, templates=TEMPLATES) -> list[str]:
    """All template tokens, those that the corpus holds least often first, ties by spelling.
    Counts cover all rows (with words ws); what reaches the driver is bounded by the templates."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    tokens = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    found = rows.select(F.explode("ws").alias("word")).join(F.broadcast(tokens), "word")
    counts = {r[0]: r[1] for r in found.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_matches(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, labels, share): labels of the templates of which a block of the row's words
    reaches the threshold, and the largest share."""
    order = {w: i for i, w in enumerate(frequency_order(rows, templates))}
    index = []
    for label, template in templates:
        tokens = sorted(set(template.split()), key=order.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        index += [(word, label, tokens, need, len(template.split())) for word in tokens[: len(tokens) - need + 1]]
    index = rows.sparkSession.createDataFrame(index, "word string, label string, tokens array<string>, need int, length int")
    found = rows.select("row", "ws", F.posexplode("ws").alias("i", "word")).join(F.broadcast(index), "word").where(F.size("ws") >= F.col("need"))
    starts = F.sequence(F.greatest(F.col("i") - F.col("length") + 1, F.lit(0)), F.col("i"))
    held = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("ws", s + 1, F.col("length")), "tokens"))))
    found = found.select("row", "label", F.size("tokens").alias("n"), held.alias("held"), "need")
    # the threshold is asked for within the aggregate: a filter would become a condition of the
    # join, which could then not be compiled together with the explode, and every exploded
    # word would take all words of its text along
    near, share = F.when(F.col("held") >= F.col("need"), F.col("label")), F.when(F.col("held") >= F.col("need"), F.col("held") / F.col("n"))
    return found.groupBy("row").agg(F.collect_set(near).alias("near"), F.max(share).alias("share")).where("share is not null")


def _starts(words: list[str]) -> Column:
    """Where the words stand consecutively in the array ws."""
    return F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.slice("ws", i + 1, len(words)) == _strings(words))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the largest share of a template's distinct words that a run of
    words as long as the template holds where it reaches the threshold, 1 where a base phrase
    is found, else 0).

    A null or empty text gives zero counts, null positions and empty labels. Rows are
    independent, so repeated rows and ids are kept; other columns are not read; an empty table
    gives an empty result."""
    rows = _rows(docs)
    with scratch(docs.sparkSession) as keep:
        near = keep(template_matches(rows, templates, threshold), "license-near")
    places, base = [], []
    for phrase, label in phrases.items():
        words = phrase.split()
        maybe = F.lit(True)
        for w in sorted(words, key=len, reverse=True):
            maybe = maybe & F.col("t").contains(w)
        at = F.when(maybe & (F.size("ws") > 0), _starts(words)).otherwise(F.array().cast("array<int>"))
        places.append(at)
        base.append(label)
    rows = rows.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), F.array(*places).alias("by"))
    found = F.array_compact(F.array(*[F.when(F.size(F.col("by")[k]) > 0, F.lit(label)) for k, label in enumerate(base)]))
    rows = rows.select("row", "doc_id", "n_words", F.flatten("by").alias("places"), found.alias("base"))
    out = rows.join(near, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("near", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({sorted(set(t.split()))!r}, '{label}', {len(t.split())}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)})" for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, {low} AS t, {words.format(low)} AS w FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) x(ph, label)),
tm AS (SELECT * FROM (VALUES {templates}) x(tk, label, long, need)),
hits AS (SELECT doc_id, label, i FROM d, p, unnest(range(len(w))) r(i) WHERE w[i + 1:i + len(ph)] = ph),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM hits GROUP BY 1),
wd AS (SELECT doc_id, w, i FROM d, unnest(range(len(w))) r(i)),
m AS (SELECT doc_id, label, held / len(tk) AS share FROM (SELECT doc_id, label, tk, need, len(list_intersect(list_distinct(w[i + 1:i + long]), tk)) AS held FROM wd JOIN tm ON list_contains(tk, w[i + 1])) WHERE held >= need),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY 1),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT doc_id, label FROM hits) GROUP BY 1),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(bl.l, '') AS base_labels, coalesce(al.l, '') AS labels, (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)"""


ORACLE = {"op7_license_scan": _oracle()}
