"""Token counts against the library's own encoding of whole texts."""

import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagloom.llm import token_counts

SCHEMA = "doc_id long, text string, n int, row long, token string, pieces long"
TEXTS = [
    None, "", " ", "\n", "a", "it's we'll 'S don''t", "  two  blanks \n\n x\t\ty ", "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|> ", "<|endoftext|", "x" * 5000, "日本語のテキスト 日本", "ÄÖ ß 123 ١٢٣ ½ x²", "😀 😀😀 👩‍👩‍👧 \U0001fae8 ՘",
    "tab\there\r\nline nbsp em　wide​zero\x85next", "word " * 3000 + "'s", "same text", "same text",
]


def load(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("name,frequent", [("byte_bpe_50k.json", 50_000), ("byte_bpe_50k.json", 3)])
def test_equals_library(spark, name, frequent):
    ids = [None, *range(1, len(TEXTS) - 1), len(TEXTS) - 2]  # a null id, and one that occurs twice
    docs = spark.createDataFrame([(i, t, 1, 7, "x", 9) for i, t in zip(ids, TEXTS)], SCHEMA)
    lib = Tokenizer.from_str(load(name))
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in zip(ids, TEXTS))
    got = token_counts.token_counts(docs, load(name), limit=20, frequent=frequent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), load(name)).count() == 0


def test_own_pattern_agrees_on_settled_characters():
    cut, count = token_counts.cutter(load("byte_bpe_50k.json"))
    pre = Tokenizer.from_str(load("byte_bpe_50k.json")).pre_tokenizer
    chars = [c for c in map(chr, range(1, 0x30000)) if not "\ud800" <= c <= "\udfff" and unicodedata.ucd_3_2_0.category(c) != "Cn"]
    for at in range(0, len(chars), 3000):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in chars[at:at + 3000])
        found = {}
        for _, (a, b) in pre.pre_tokenize_str(text):
            found[text[a:b]] = found.get(text[a:b], 0) + 1
        assert cut(text) == (0, found)


def test_parts_change_nothing():
    import regex

    find = regex.compile(token_counts.PATTERN).findall
    for text in ("a b  c\n d 'll e's f ! ?   g 12 3 " * 9, "no_place" * 20, " " * 50, "a  b  c"):
        for size in (1, 2, 3, 7, 20):
            got = list(token_counts.parts(text, size))
            assert "".join(got) == text
            assert [x for p in got for x in find(p)] == find(text)


def test_lower_casing_tokenizer():
    spec = load("word_bpe_49k.json")
    lib = Tokenizer.from_str(spec)
    try:
        cut, count = token_counts.cutter(spec)
    except ValueError:
        return
    for text in ("Hello World it's 42", "ÄÖ  x", ""):
        n, found = cut(text)
        assert n + sum(count(k) * v for k, v in found.items()) == len(lib.encode(text, add_special_tokens=False).ids)
