"""Language identification by word-first backoff.

A word that the training texts hold adds its log frequency in each language. For an unseen
word the longest character n-grams of which at least one is known stand in, from long to
short. Every task holds the frequent words of each language; all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, stage, table

CACHED_WORDS = 200_000  # frequent words that every task holds, shared out equally among the languages
GRAM = 3
_FLUSH = 400_000


class _Letters(dict):
    """For str.translate: letters stay, all else is a space. Filled as characters turn up."""

    def __missing__(self, c: int) -> int:
        self[c] = out = c if chr(c).isalpha() else 32
        return out


_LETTERS = _Letters()


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, in lower case; digits and other numerals are no letters."""
    return (text or "").lower().translate(_LETTERS).split()


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts by language and word, given out whenever they fill memory."""
    counts: dict[str, Counter] = {}

    def out() -> pd.DataFrame:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.lang, batch.text):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > _FLUSH:
            yield out()
    yield out()


def _grams(word: str) -> Column:
    """All n-grams of a word between two spaces, as often as they occur."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def of(k: int) -> Column:  # a lambda with k as its second parameter would get the position as k
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (k - 1)), lambda i: F.substring(padded, i, F.lit(k)))

    return F.flatten(F.array(*[of(k) for k in range(1, GRAM + 1)]))


def _least_levels(counts: DataFrame, langs: list[str], most: int) -> Column:
    """Whether a row of (lang, n) is among the most // len(langs) frequent of its language.
    The bound comes from a histogram, so nothing is sorted."""
    level = F.floor(F.log2("n") * 16).cast("int")
    hist = counts.groupBy("lang", level.alias("level")).count().orderBy("lang", F.desc("level")).collect()
    seen: dict[str, int] = dict.fromkeys(langs, 0)
    least: dict[str, int] = dict.fromkeys(langs, 0)
    full = set()
    for h in hist:
        seen[h["lang"]] += h["count"]
        if seen[h["lang"]] > most // len(langs) and h["lang"] not in full:
            full.add(h["lang"])
            least[h["lang"]] = h["level"] + 1
    out = F.lit(False)
    for x in langs:
        out = F.when(F.col("lang") == x, level >= least[x]).otherwise(out)
    return out


def learn(docs: DataFrame, cached: int = CACHED_WORDS) -> tuple[list[str], DataFrame | None, DataFrame | None]:
    """Languages, all words (word, cached, v) and all n-grams (gram, v); v holds the log
    frequency in each language. Counts cover every training row and none is left out."""
    train = docs.where("not crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 and lang is not null and text is not null").select("lang", "text")
    words = stage(train.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    langs = sorted(r[0] for r in train.select("lang").distinct().collect())
    if not langs:
        return langs, None, None
    grams = words.select("lang", "n", F.explode(_grams("word")).alias("gram"))
    grams = stage(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")

    def logs(counts: DataFrame, key: str, size: Column, frequent: Column) -> DataFrame:
        total = {(r[0], r[1]): r[2] for r in counts.groupBy("lang", size.alias("size")).agg(F.sum("n")).collect()}
        sizes = sorted({k for _, k in total})
        by_key = counts.withColumn("frequent", frequent).groupBy(key).agg(F.max("frequent").alias("cached"), *[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)])
        by_key = stage(by_key, f"lang-{key}-counts")
        kinds = by_key.count()

        def of(i: int, x: str) -> Column:
            whole = F.lit(0)
            for k in sizes:
                whole = F.when(size == k, F.lit(total.get((x, k), 0))).otherwise(whole)
            return F.log((F.col(f"n{i}") + 0.5) / (whole + 0.5 * kinds + 1)).cast("float")

        return by_key.select(key, "cached", F.array(*[of(i, x) for i, x in enumerate(langs)]).alias("v"))

    return langs, logs(words, "word", F.lit(0), _least_levels(words, langs, cached)), logs(grams, "gram", F.length("gram"), F.lit(False)).drop("cached")


def _unseen(unseen: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """(word, v): the mean over the longest n-grams of each word of which any is known."""
    found = unseen.select("word", F.explode(_grams("word")).alias("gram")).join(grams, "gram")
    means = found.groupBy("word", F.length("gram").alias("k")).agg(F.array(*[F.avg(F.col("v")[i]) for i in range(n)]).alias("v"))
    return means.groupBy("word").agg(F.max_by("v", "k").cast("array<float>").alias("v"))


def language_id(docs: DataFrame, cached: int = CACHED_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    score is the posterior of the predicted language under equal priors. A null text or one
    without a letter gives `und` and 0, as do all rows when nothing was learned. Ties go to
    the first language by spelling. Repeated rows are predicted alike; of the other
    columns only lang of training rows is read. About ``cached`` words are held by every
    task; the counts of all others come by a join on the word, so the bound changes the
    speed and not the result."""
    held = held_out(F.col("doc_id"), 3, 1).alias("held_out")
    langs, words, grams = learn(docs, cached)
    if not langs:
        return docs.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    n = len(langs)
    kept = words.where("cached").select("word", "v").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((list(kept.word), np.array(kept.v.tolist(), np.float32).reshape(-1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        ids, none = {w: i for i, w in enumerate(names)}, len(names)
        matrix = np.vstack([matrix, np.zeros((1, n), np.float32)]).astype(np.float64)
        row = TaskContext.get().partitionId() << 33  # the rows are written once, so this names them
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                found = words_of(text)
                at = np.fromiter(map(ids.get, found, [none] * len(found)), np.int64, len(found))
                cols[0].append(row)
                cols[1].append(len(found))
                cols[2].append(matrix[at].sum(axis=0).tolist())
                cols[3].append([found[i] for i in np.flatnonzero(at == none)])
                row += 1
            made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "row", "n", "own", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, row long, n long, own array<double>, rare array<string>"), "lang-scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    others = words.where("not cached").select("word", "v")
    unseen = stage(rare.select("word").distinct().join(others, "word", "left_anti"), "lang-unseen")
    vectors = others.unionByName(_unseen(unseen, grams, n))
    more = rare.join(vectors, "word").groupBy("row").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(n)]).alias("more"))
    out = scored.select("doc_id", "row", "n", "own").join(more, "row", "left")
    out = out.withColumn("t", F.when(F.col("more").isNull(), F.col("own")).otherwise(F.zip_with("own", "more", lambda a, b: a + b)))
    best = F.array_max("t")
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("t", best).cast("int"))
    share = 1 / F.aggregate(F.transform("t", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    some = F.col("n") > 0
    return out.select("doc_id", held, F.when(some, lang).otherwise("und").alias("lang_pred"), F.when(some, share).otherwise(0.0).alias("score"))


def op9_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
