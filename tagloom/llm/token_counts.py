"""Token counts by distinct pre-token.

A tokenizer merges bytes within a pre-token only, so a text's count is the sum over its
pre-tokens of their numbers of pieces. Texts are cut into pre-tokens once; each distinct
pre-token of the corpus is then merged once, and its number of pieces is joined to the
frequencies of the documents. No list of ids is made for a text.

Frequent pre-tokens are in most documents: the FREQUENT commonest short ones meet the
frequencies in a broadcast of bounded size, all others by a shuffle on the pre-token.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, table

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
FREQUENT, FREQUENT_CHARS = 200_000, 32  # bound of the broadcast: about 12 MB
ROWS_A_BATCH, TEXT_PART = 256, 1 << 20
# Fixed value: the pattern by which byte-level vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FREQS = pa.list_(pa.struct([("token", pa.string()), ("freq", pa.int64())]))
_PREPARED = "doc_id long, n_bytes long, special long, tokens array<struct<token:string,freq:long>>"


def load(spec: str):
    """A tokenizer from its JSON text."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def parts(text: str, size: int = TEXT_PART) -> Iterator[str]:
    """A long text in parts of about ``size`` characters, cut only before a single blank
    between two other characters. No pre-token of PATTERN crosses such a place, whatever
    stands on either side. Without such a place the text stays whole."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find(" ", cut)) != -1 and (text[cut - 1].isspace() or text[cut + 1:cut + 2].strip() == ""):
            cut += 1
        if cut == -1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def cutter(spec: str) -> tuple[Callable[[str], tuple[int, Counter]], Callable[[str], int]]:
    """Two functions: (number of special tokens, pre-token frequencies) of a text, and the
    number of pieces of a pre-token.

    Plain byte-level tokenizers are cut by PATTERN here, which gives what the library
    gives where letters, digits and blanks are agreed on, that is for all characters of
    Unicode 3.2. Texts with a newer character, and other tokenizers, are cut by the
    library's own pre-tokenizer."""
    import regex

    known, tok = json.loads(spec), load(spec)
    pre, norm, model = tok.pre_tokenizer, tok.normalizer, tok.model
    kind = known.get("pre_tokenizer") or {}
    plain = norm is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    added = known.get("added_tokens") or []
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a.get("normalized") for a in added):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    special = regex.compile("|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
    find, old, agreed = regex.compile(PATTERN).findall, unicodedata.ucd_3_2_0.category, set()

    def settled(text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - agreed
        agreed.update(c for c in new if old(c) != "Cn")
        return new <= agreed

    def cut(text: str) -> tuple[int, Counter]:
        n, found = 0, Counter()
        segments = [text]
        if special and special.search(text):
            segments = special.split(text)
            n = len(segments) - 1
        for segment in segments:
            if plain and settled(segment):
                for part in parts(segment):
                    found.update(find(part))
            elif segment:
                for part in parts(segment) if plain else [segment]:
                    found.update(mapped(part))
        return n, found

    def mapped(text: str) -> list[str]:
        text = norm.normalize_str(text) if norm else text
        return [x for x, _ in pre.pre_tokenize_str(text)] if pre else [text]

    def by_library(text: str) -> list[str]:  # in the form that the plain path uses
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    if plain:
        mapped = by_library
        return cut, lambda token: sum(len(model.tokenize(x)) for x, _ in pre.pre_tokenize_str(token))
    return cut, lambda token: len(model.tokenize(token))


def frequencies(docs: DataFrame, spec: str) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, special, tokens (pre-token, frequency)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("special", pa.int64()), ("tokens", _FREQS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, _ = cutter(spec)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                sizes, specials, offsets, tokens, freqs = [], [], [0], [], []
                for text in batch.column(1).to_pylist():
                    n, found = cut(text)
                    sizes.append(len(text.encode()))
                    specials.append(n)
                    tokens.extend(found.keys())
                    freqs.extend(found.values())
                    offsets.append(len(tokens))
                pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(freqs, pa.int64())], fields=list(_FREQS.value_type))
                cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(specials, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(_FREQS)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _PREPARED)


def pieces(vocab: DataFrame, spec: str) -> DataFrame:
    """(token, n, pieces) of vocab(token, n): each token is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, count = cutter(spec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count(x) for x in batch.column(0).to_pylist()], pa.int64())], names=["token", "n", "pieces"])

    return vocab.select("token", "n").mapInArrow(run, "token string, n long, pieces long")


def _commonest(vocab: DataFrame, frequent: int) -> DataFrame:
    """(token, pieces) of at most ``frequent`` short tokens that the most documents hold: all
    of at least so many documents, by a histogram of 8 classes for each power of two."""
    short = vocab.where((F.length("token") <= FREQUENT_CHARS) & (F.col("n") > 1)).withColumn("class", F.floor(8 * F.log2(F.col("n"))))
    least, total = None, 0
    for r in sorted(short.groupBy("class").agg(F.count("*").alias("k")).collect(), reverse=True):
        total += r.k
        if total > frequent:
            break
        least = r["class"]
    return short.where(F.lit(False) if least is None else F.col("class") >= least).select("token", "pieces")


def token_counts(docs: DataFrame, spec: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``spec`` is the JSON text of the tokenizer. Nothing is added, cut off or padded;
    strings of added tokens inside a text are that token, as the library does by default.
    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated doc_ids keep one row
    for each of their rows; other columns are not read; an empty table gives an empty
    result. Long texts are cut into parts, so that what a task holds at a time is bounded
    by its documents' distinct pre-tokens."""
    with scratch(docs.sparkSession) as keep:
        counts = stage(frequencies(docs, spec).withColumn("row", F.monotonically_increasing_id()), "tokens-freqs")  # the numbers are data from here on
        pairs = counts.select("row", F.explode("tokens").alias("t")).select("row", "t.token", "t.freq")
        vocab = stage(pieces(pairs.groupBy("token").agg(F.count("*").alias("n")), spec), "tokens-vocab")
        common = stage(_commonest(vocab, frequent), "tokens-common")
        known = pairs.join(F.broadcast(common), "token")
        rare = pairs.join(F.broadcast(common), "token", "left_anti").join(vocab.join(common, "token", "left_anti"), "token")
        nothing = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_bytes")]
        summands = [part.select("row", *nothing, (F.col("freq") * F.col("pieces")).alias("n")) for part in (known, rare)]
        every = counts.select("row", "doc_id", "n_bytes", F.col("special").alias("n")).unionByName(summands[0]).unionByName(summands[1])
        out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
        return keep(out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token-counts")


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return token_counts(table(spark, sf_dir, "documents"), f.read())
