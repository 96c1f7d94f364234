"""Language-model scoring of whole texts with a gated recurrent network.

Word counts cover every training text and grow with the corpus. Words of the model's
vocabulary are predicted by the network; the network also predicts that some other word
comes, and the corpus counts then say which (add-one estimate, one share for all words
never seen). The product is a proper probability of the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import held_out, stage, table

VOCABULARY = 2048  # words that the network predicts one by one
BROADCAST = 150_000  # frequent words whose counts every task holds; all others are joined
ROUNDS = 4  # parts of the training texts; after each the models are averaged and go on from there
WORKER_TOKENS = 1_000_000  # about so many tokens of a part for each model that is trained side by side
BRANCH = 16  # models that are averaged in one task
TEXTS = 1 << 20  # tokens that one call of the training sees
END = b""
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FLUSH = 300_000


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then the end."""
    return [*text.translate(_FOLD).split(), END]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of docs, by partial counts in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in _bytes(batch.column(0)):
                counts.update(tokens(text))
                if len(counts) > _FLUSH:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words down to the least count at which at most ``most`` (and all
    words of one count together) fit; most frequent first, ties by bytes."""
    level = F.floor(F.log2("n") * 32).cast("int")
    least, seen = 0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        seen += r["count"]
        if seen > most:
            least = r["level"] + 1
            break
    rows = counts.where(level >= least).toPandas()
    return sorted(zip(map(bytes, rows.word), map(int, rows.n)), key=lambda x: (-x[1], x[0]))


def _averaged(models: DataFrame) -> DataFrame:
    """The mean of (n, p) weighted by n, by a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = 0, 0.0
        for batch in batches:
            for n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, mean = total + n, mean + np.frombuffer(p, np.float32).astype(np.float64) * n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([(mean / total).astype(np.float32).tobytes()], pa.binary())], ["n", "p"])

    return models.mapInArrow(run, "n long, p binary")


def _fit(docs: DataFrame, frequent: list[tuple[bytes, int]], total: int, rounds: int, worker_tokens: int) -> tuple[dict, int]:
    """The network trained on all texts, and how many tokens it learned from. The texts are dealt to rounds and within a round to as many
    models as the corpus needs; each round starts from the mean of the models before it."""
    spark = docs.sparkSession
    ids = {w: i for i, (w, _) in enumerate(frequent)}
    counts = np.array([n for _, n in frequent], np.int64)
    model = gru.init(counts, total - int(counts.sum()), ids.get(END, 0))
    rounds = max(1, min(rounds, total // worker_tokens))
    workers = 1 + total // rounds // worker_tokens
    names, learned = [n for n in model if n not in ("end", "k")], 0

    for part in range(rounds):
        shared = spark.sparkContext.broadcast((ids, model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, p = shared.value
            p, cache, n, held, size = {k: v.copy() for k, v in p.items()}, {}, 0, [], 0
            other = len(ids)
            for batch in batches:
                for text in _bytes(batch.column(0)):
                    words = tokens(text)
                    held.append(np.fromiter(map(ids.get, words, [other] * len(words)), np.int64, len(words)))
                    size += len(words)
                    if size >= TEXTS:
                        gru.train(p, held, cache)
                        n, held, size = n + size, [], 0
            gru.train(p, held, cache)
            n += size
            flat = np.concatenate([p[k].ravel() for k in names]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "p"])

        chosen = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(rounds)) == part).repartition(workers, "doc_id", F.length("text")).sortWithinPartitions("doc_id", "text")
        models = stage(chosen.select("text").mapInArrow(run, "n long, p binary"), "lm-models")
        left = workers
        while left > BRANCH:
            left = -(-left // BRANCH)
            models = stage(_averaged(models.repartition(left)), "lm-means")
        got = sorted((r.n, bytes(r.p)) for r in models.collect() if r.n)
        if got:
            seen = sum(n for n, _ in got)
            learned += seen
            mean = sum(np.frombuffer(p, np.float32) * np.float32(n / seen) for n, p in got)
            at = 0
            for k in names:
                model[k] = mean[at:at + model[k].size].reshape(model[k].shape)
                at += model[k].size
        shared.unpersist()
    return model, learned


def lm_score(docs: DataFrame, vocabulary: int = VOCABULARY, broadcast: int = BROADCAST, rounds: int = ROUNDS, worker_tokens: int = WORKER_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Learns from rows whose crc32(doc_id) mod 7 is not 2. A null or empty text is the end
    token alone. Without training rows nothing is known and every token is an unseen one.
    Repeated rows are scored alike and rows of one doc_id are kept apart; other columns are
    not read. Counts of words outside the broadcast table come by a join on the word, which
    holds one row per text and word; such words are rare by construction, so no key is hot."""
    train = docs.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = stage(token_counts(train), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = _frequent(counts, broadcast)
    in_model = sum(n for _, n in frequent[:vocabulary])
    others, other_kinds = total - in_model, distinct - len(frequent[:vocabulary])
    model, _ = _fit(train, frequent[:vocabulary], total, rounds, worker_tokens)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, model))
    base_log, other_log = math.log10(total + distinct + 1), math.log10(others + other_kinds + 1)
    schema = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        frequent, model = shared.value
        k = int(model["k"])
        ids = {w: i for i, (w, _) in enumerate(frequent)}
        logs = np.log10(np.array([n + 1 for _, n in frequent] + [1.0]))
        own = uuid4().hex
        n_rows = 0
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            texts = []
            for text in _bytes(batch.column(1)):
                words = tokens(text)
                at = np.fromiter(map(ids.get, words, [-1] * len(words)), np.int64, len(words))
                rare = [w for w, i in zip(words, at) if i < 0] if (at < 0).any() else []
                texts.append(np.where((at < 0) | (at >= k), k, at))
                known = at[at >= 0]
                plain = known[known >= k]
                cols[0].append(f"{own}-{n_rows}")
                cols[1].append(len(words))
                cols[2].append(len(known))
                cols[3].append(float(logs[known].sum()) - base_log * len(words))
                cols[4].append(float(logs[plain].sum()) - other_log * (len(plain) + len(rare)))
                cols[5].append(rare)
                n_rows += 1
            own_score = gru.log_prob(model, texts) / math.log(10) if frequent else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), batch.column(0), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(np.array(cols[4]) + own_score), pa.array(cols[5], pa.list_(pa.binary()))], schema=schema)

    ddl = "row string, doc_id long, n_tokens long, n_known long, base double, model double, rare array<binary>"
    scored = stage(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ddl), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    known = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("l"))
    out = scored.select("row", "doc_id", "n_tokens", "n_known", "base", "model").join(known, "row", "left")
    zero = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    return out.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", (F.col("n_known") + zero("k", 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("l", 0.0)).alias("base_score"), (F.col("model") + zero("l", 0.0)).alias("score"))


def op8_lm_scoring(spark, sf_dir):
    return lm_score(table(spark, sf_dir, "documents"))
