"""Substring search of many terms in many texts by an inverted index of short grams.

A text contains a term only if it contains each of the term's grams. So each term looks at
the texts of one gram, the one that the fewest texts hold, and these are verified. Terms of
fewer than GRAM letters have the whole term as gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All substrings of a size; none if the text is shorter."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(gram, id, text) of texts(id, text), one row for each gram of sizes 1 to GRAM, or of
    those named, that a text holds."""
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), k) for k in sizes or range(1, GRAM + 1)])))
    return texts.where("text is not null").select(F.explode(grams).alias("gram"), "id", "text")


def containing(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, id) for terms(term) and texts(id, text): the text contains the term, as it is
    spelt (fold the case of both before). Each distinct term is searched once; an empty term
    is in every text, a null one in none. No text meets a term by other than an equal gram."""
    asked = terms.select("term").where("term is not null").distinct()
    real = asked.where("term <> ''").withColumn("size", F.least(F.length("term"), F.lit(GRAM)))
    sizes = [r[0] for r in real.select("size").distinct().collect()]  # GRAM values at most
    everything = texts.where("text is not null").select("id").withColumn("term", F.lit("")).join(asked.where("term = ''"), "term", "left_semi").select("term", "id")
    if not sizes:
        return everything
    index = postings(texts.select("id", "text"), sizes)
    # written, so that Spark knows how small the tables of terms are and does not shuffle the
    # postings of all texts to meet them; many terms are joined by shuffle
    wanted = real.select("term", F.explode(F.array_distinct(F.when(F.col("size") == 1, _grams(F.col("term"), 1)).when(F.col("size") == 2, _grams(F.col("term"), 2)).otherwise(_grams(F.col("term"), GRAM)))).alias("gram"))
    wanted = stage(wanted, "wanted-grams")
    held = index.select("gram").join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(held, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    rarest = stage(rarest, "rarest-grams")
    found = index.join(rarest, "gram").where(F.contains("text", "term")).select("term", "id")
    return found.unionAll(everything)
