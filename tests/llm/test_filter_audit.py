"""The filter audit against a plain loop over documents and orders."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from tagloom.llm import filter_audit
from tagloom.llm.filter_audit import Transducer

SCHEMA = "doc_id long, text string, lang string, source string, n int, mask int, good boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def some_texts(seed=1):
    rng = random.Random(seed)
    many = [" ".join("".join(rng.choice("abAé日#") for _ in range(rng.randrange(1, 4))) for _ in range(n)) for n in (1, 3, 199, 200, 201, 400)]
    few = " ".join(rng.choice(["ab", "cd"]) for _ in range(300))
    wide = " ".join(f"w{i}" for i in range(200))
    return [None, "", " \t\n\x0b\x0c\r ", "a", "  a  ", "\x1ca\x85b a", *many, few, wide, wide + " X Y Z", wide + " & x", few.upper(), wide, wide, "x" * 3000, "end \n"]


@pytest.mark.parametrize("bits", [64, 3, 0])  # with few bits all words collide and the bytes decide
def test_transducer(bits):
    texts = [(t or "") for t in some_texts()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    texts_short = [t for t in texts if len(t) < 900] if bits == 0 else texts
    if bits == 0:
        data, offsets = np.frombuffer("".join(texts_short).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts_short])
    assert Transducer(hash_bits=bits).read(data, offsets).tolist() == [plain(t) for t in texts_short]
    for size in (1, 7, 64):
        for t in ("", "ab cd ab  " * 30, "x" * 300 + " y", " é日 " * 20):
            assert Transducer(size).read_long(np.frombuffer(t.encode(), np.uint8)).tolist() == plain(t)


def brute(docs, labels):
    out = {}
    first = {}
    for d in docs:
        if d[0] is not None:
            first[d[1] or ""] = min(first.get(d[1] or "", d[0]), d[0])
    judged = []
    for d in docs:
        text = d[1] or ""
        words, distinct, capitals, points, symbols = plain(text)
        fails = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 3 * points, "D": symbols > 0, "E": d[0] is not None and first[text] < d[0]}
        own = [x for x in labels if x[0] == d[0] and d[0] is not None]
        judged.append((d[2] or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                lost = [j for j in left if j[1][f]]
                earlier = [j for j in mine if j[1][f] and j not in left]
                left = [j for j in left if not j[1][f]]
                removed_in_all[f] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(1 for j in mine if j[1][f]) - len(lost), sum(1 for j in mine if j[1][f] and sum(j[1].values()) == 1), sum(j[2] for j in lost), sum(j[3] for j in lost), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = removed_in_all[row[6]]
    return out


def test_against_loop(spark):
    rng = random.Random(2)
    texts = some_texts()
    docs = [(i, t, rng.choice(["en", "de", None, ""]), "s", 1, 5, True) for i, t in enumerate(texts + texts[5:15])]
    docs += [(None, texts[-2], "en", "s", 1, 5, True), (None, texts[-2], "en", "s", 1, 5, True), (3, "a", "en", "s", 1, 5, True), (3, "a", "en", "s", 1, 5, True), (2, texts[10], "en", "s", 1, 5, True)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 30, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as n")
    frame = spark.createDataFrame(docs, SCHEMA)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.filter_audit(frame, lab).collect()}
    assert got == brute(docs, labels)
    assert filter_audit.filter_audit(frame.limit(0), lab).count() == 0
    assert filter_audit.filter_audit(frame, lab.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
