"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e edits is cut into e + 1 pieces; a passage within e edits
holds one of them unchanged. One Aho-Corasick pass over a text finds all piece hits; around
each, Myers' bit-parallel algorithm decides whether the item occurs within its budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ERROR_SHARE = 0.08
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, share: float) -> int:
    return int(share * len(item))


def pieces(item: str, e: int) -> list[tuple[int, str]]:
    """e + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * k // (e + 1) for k in range(e + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_distance(peq: dict[str, int], m: int, window: str) -> int:
    """Smallest edit distance between a pattern of length m and any substring of window."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best = score
    return best


class Matcher:
    """All items of a block: finds {item index: distance} in a normalised text."""

    def __init__(self, items: list[str], share: float):
        self.items, self.budgets = items, [budget(x, share) for x in items]
        self.peq, where = [], {}
        for k, (item, e) in enumerate(zip(items, self.budgets)):
            masks: dict[str, int] = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            self.peq.append(masks)
            for at, piece in pieces(item, e):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        spans: dict[int, list[list[int]]] = {}
        if not self.items:
            return {}
        for end, (n, uses) in self.automaton.iter(text):
            for k, at in uses:
                e = self.budgets[k]
                start = end + 1 - n - at
                a, b = max(0, start - e), start + len(self.items[k]) + e
                known = spans.setdefault(k, [])
                if known and a <= known[-1][1]:
                    known[-1][1] = max(b, known[-1][1])
                    known[-1][0] = min(a, known[-1][0])
                else:
                    known.append([a, b])
        found = {}
        for k, windows in spans.items():
            best = min(best_distance(self.peq[k], len(self.items[k]), text[a:b]) for a, b in windows)
            if best <= self.budgets[k]:
                found[k] = best
        return found


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks that fit the driver and a broadcast, whatever their number."""
    rows = items.where("item_id is not null").select("item_id", "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // block_chars
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else rows
        yield [(i, t) for i, t in ((r[0], normal(r[1])) for r in part.collect()) if t]


def benchmark_hits(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and benchmark item that occurs in it within
    int(share * item length) edits: doc_id, item_id, distance.

    Texts are compared lower-cased with runs of white space as one space. Null or empty
    items match nothing, null or empty texts hold nothing; of repeated items each gives a
    row, and so does each of repeated documents. Documents or items without an id give no
    row (without_benchmark judges documents without an id too). Other columns are not read. Documents are never shuffled."""
    out = None
    for block in _blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matcher = [i for i, _ in shared.value], Matcher([t for _, t in shared.value], share)
            for batch in batches:
                rows = [(d, ids[k], e) for d, t in zip(batch.doc_id, batch.text) for k, e in matcher.find(normal(t)).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance"])

        part = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, item_id long, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def _clean(shared, share: float):
    """A test for texts in which no item of the broadcast block occurs."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher([t for _, t in shared.value], share)
        for texts in batches:
            yield pd.Series([not matcher.find(normal(t)) for t in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")


def without_benchmark(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no benchmark item occurs, with their columns."""
    for block in _blocks(items, block_chars):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(block), share)(F.coalesce("text", F.lit(""))))
    return docs


def op2_decontamination(spark, sf_dir):
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
