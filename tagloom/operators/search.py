"""Search over files and tags: all terms must hold.

A term is a dict: kind (tag, name, logical, any), negated, regex, text."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.scalars import LOWER, UPPER, java_pattern, matches_regex, matches_substring
from ..sources.staging import stage, steps
from .graph import files_of_tags, subtags
from .reads import alive, list_files, list_tags
from .shortid import resolve_tag_tokens
from .textindex import containing

PATTERNS = 500  # regex patterns of a batch that are tried in one pass over the listing


def _matches(col: str, term: dict):
    return matches_regex(col, term["text"]) if term.get("regex") else matches_substring(col, term["text"])


def tag_set(cat: dict, term: dict, deleted: str) -> DataFrame:
    """root: the tags that a term's text names."""
    return resolve_tag_tokens(cat["tags"], [(term["text"], bool(term.get("regex")))], deleted).select(F.col("id").alias("root")).distinct()


def search_files(cat: dict, terms: list[dict], include_subtags: bool = False, deleted: str = "exclude") -> DataFrame:
    """Listing rows for which every term holds; no terms, all rows.

    Tag terms come first, as semi- and anti-joins, before the text filters. Ids without a
    listed row vanish. deleted="only" looks among all and keeps the deleted ones."""
    pool = "exclude" if deleted == "exclude" else "include"
    out = list_files(cat, pool)
    for t in sorted(terms, key=lambda t: (t["kind"] != "tag", t.get("negated", False))):
        no = t.get("negated", False)
        if t["kind"] == "tag":
            ids = files_of_tags(cat, tag_set(cat, t, pool), include_subtags).select(F.col("file_id").alias("id")).distinct()
            out = out.join(ids, "id", "left_anti" if no else "left_semi")
        elif t["kind"] in ("name", "logical"):
            hit = _matches("logical_path", t)
            out = out.where(~hit if no else hit)
        elif t["kind"] == "any":
            ids = files_of_tags(cat, tag_set(cat, t, pool), include_subtags).select(F.col("file_id").alias("id")).distinct().withColumn("tagged", F.lit(True))
            hit = _matches("logical_path", t) | F.coalesce("tagged", F.lit(False))
            out = out.join(ids, "id", "left").where(~hit if no else hit).drop("tagged")
        else:
            raise ValueError(f"unknown kind of term: {t['kind']}")
    return out.where("deleted") if deleted == "only" else out


def search_tags(cat: dict, terms: list[dict], include_subtags: bool = False, deleted: str = "exclude") -> DataFrame:
    """As search_files, on tags: a tag term asks for subtags of the set, name terms look at
    the tag's name, and any logical term, even a negated one, leaves nothing."""
    pool = "exclude" if deleted == "exclude" else "include"
    out = list_tags(cat, pool)
    for t in sorted(terms, key=lambda t: (t["kind"] != "tag", t.get("negated", False))):
        no = t.get("negated", False)
        if t["kind"] == "logical":
            return out.limit(0)
        if t["kind"] == "name":
            hit = _matches("name", t)
            out = out.where(~hit if no else hit)
            continue
        ids = subtags(cat, tag_set(cat, t, pool), include_subtags).select(F.col("node").alias("id")).distinct()
        if t["kind"] == "tag":
            out = out.join(ids, "id", "left_anti" if no else "left_semi")
        else:
            hit = _matches("name", t) | F.coalesce("tagged", F.lit(False))
            out = out.join(ids.withColumn("tagged", F.lit(True)), "id", "left").where(~hit if no else hit).drop("tagged")
    return out.where("deleted") if deleted == "only" else out


KINDS = ("tag", "name", "logical", "any")


def search_batch(cat: dict, terms: DataFrame, include_subtags: bool = False, deleted: str = "exclude") -> DataFrame:
    """(query_id, id) for a table of file searches (query_id, pos, kind, negated, regex, text).

    Distinct terms are evaluated once. Plain texts are a table and meet the paths and tag
    names by the gram index; patterns, which no index serves, are tried in the plan in
    blocks of PATTERNS. A row is a hit where it meets as many positive terms as the query has
    and no negated one. A null flag counts as false, a null text as one that nothing meets.
    A kind that is not in KINDS raises an error. A query whose only row has null in place
    of a kind has no terms and gives every row."""
    spark = terms.sparkSession
    with steps(spark) as keep:
        flat = terms.select("query_id", "kind", F.coalesce("negated", F.lit(False)).alias("negated"), F.coalesce("regex", F.lit(False)).alias("regex"), "text")
        unknown = flat.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*KINDS)).select("kind").first()
        if unknown:
            raise ValueError(f"unknown kind of term: {unknown.kind}")
        pool = "exclude" if deleted == "exclude" else "include"
        rows = list_files(cat, pool)
        rows = stage((rows.where("deleted") if deleted == "only" else rows).select("id", F.col("logical_path").alias("text")), "listed")
        asked = stage(flat.where("kind is not null").select("kind", "regex", "text").distinct(), "asked")
        by_text = asked.where("kind <> 'tag'").select("regex", "text").distinct()
        paths = _meeting(by_text, rows)
        by_tag = asked.where("kind in ('tag', 'any')").select("regex", "text").distinct()
        roots = stage(tags_named(alive(cat["tags"], pool), by_tag), "roots")
        files = files_of_tags(cat, roots.select("root"), include_subtags).join(roots, "root").select("regex", "text", F.col("file_id").alias("id"))
        tagged = files.join(rows.select("id"), "id", "left_semi").select("regex", "text", "id")
        ways = {"tag": [tagged], "name": [paths], "logical": [paths], "any": [paths, tagged]}
        hits = reduce(DataFrame.unionAll, [part.join(asked.where(F.col("kind") == kind), ["regex", "text"]).select("kind", "regex", "text", "id") for kind, parts in ways.items() for part in parts])
        hits = stage(hits.distinct(), "hits")
        term = ["kind", "regex", "text"]
        need = flat.where("kind is not null and not negated").select("query_id", *term).distinct()
        wanted = stage(flat.select("query_id").distinct().join(need.groupBy("query_id").agg(F.count("*").alias("need")), "query_id", "left").fillna(0, ["need"]), "wanted")
        positive = hits.join(need, term).groupBy("query_id", "id").agg(F.count("*").alias("n"))
        some = positive.join(wanted, "query_id").where("n = need").select("query_id", "id")
        # a query without positive terms starts from all rows: that is its answer, less what is barred
        free = [r.query_id for r in wanted.where("need = 0").select("query_id").toLocalIterator()]
        ids = F.array(*[F.lit(q) for q in free]).cast(ArrayType(flat.schema["query_id"].dataType))
        every = rows.select(F.explode(ids).alias("query_id"), "id") if free else some.limit(0)
        bars = flat.where("kind is not null and negated").select("query_id", *term).distinct()
        barred = hits.join(bars, term).select("query_id", "id")
        return keep(some.unionAll(every.select("query_id", "id")).join(barred, ["query_id", "id"], "left_anti"), "search")


def _meeting(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """(regex, text, id) for terms(regex, text) that rows(id, text) meet."""
    plain = terms.where("not regex").select("text", F.lower("text").alias("term"))
    found = containing(plain, rows.select("id", F.lower("text").alias("text"))).join(plain, "term").select(F.lit(False).alias("regex"), "text", "id")
    patterns = [r.text for r in terms.where("regex and text is not null").select("text").distinct().orderBy("text").collect()]
    for k in range(0, len(patterns), PATTERNS):
        met = [F.when(matches_regex("text", p), F.lit(p)) for p in patterns[k : k + PATTERNS]]
        found = found.unionAll(rows.select(F.lit(True).alias("regex"), F.explode(F.array_compact(F.array(*met))).alias("hit"), "id"))
    return found


def tags_named(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """(regex, text, root) for terms(regex, text): the tags that a token names, by part of
    the name (case of ASCII letters aside) or prefix of the id; a regex by name only."""
    fold = lambda c: F.translate(c, UPPER, LOWER)
    plain = terms.where("not regex and text is not null").select("text", fold("text").alias("term"), F.lower(F.replace("text", F.lit("-"))).alias("prefix"))
    named = containing(plain, tags.select("id", fold("name").alias("text"))).join(plain, "term").select(F.lit(False).alias("regex"), "text", F.col("id").alias("root"))
    ids = plain.where(F.col("prefix").rlike("^[0-9a-f]{1,32}$")).select("text", "prefix").distinct()
    lengths = [r[0] for r in ids.select(F.length("prefix")).distinct().collect()]  # 32 at most
    starts = F.explode(F.array(*[F.substring("id", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>"))
    by_id = tags.select("id", starts.alias("prefix")).join(ids, "prefix").select(F.lit(False), "text", "id")
    by_pattern = _meeting(terms.where("regex"), tags.select("id", F.col("name").alias("text")))
    return named.unionAll(by_id).unionAll(by_pattern).distinct()


def token_terms(tokens: DataFrame) -> DataFrame:
    """(query_id, search, pos, kind, negated, regex, text) for tokens(search, tokens): the
    search strings as a table of terms. Tokens that name a physical path are left out, as no
    search looks there; a string without other tokens keeps one row without a kind."""
    numbered = tokens.select(F.md5("search").alias("query_id"), "search", F.filter("tokens", lambda t: t.kind != "physical").alias("tokens"))
    return numbered.select("query_id", "search", F.posexplode_outer("tokens").alias("pos", "t")).select("query_id", "search", F.coalesce("pos", F.lit(0)).alias("pos"), "t.kind", "t.negated", "t.regex", "t.text")


def search_log(log: DataFrame, col: str, cat: dict, include_subtags: bool = False, deleted: str = "exclude") -> DataFrame:
    """(search, id) for each distinct string of a search log: from strings to rows. A string
    without a token asks for nothing and gives every row."""
    with steps(log.sparkSession) as keep:
        terms = stage(token_terms(tokenize_searches(log, col)), "terms")
        hits = search_batch(cat, terms, include_subtags, deleted)
        return keep(hits.join(terms.select("query_id", "search").distinct(), "query_id").select("search", "id"), "search-log")


# The marks of a search string and what they ask for.
MARKS = {"/t": "tag", "/n": "name", "/l": "logical", "/p": "physical"}


_WORD = re.compile(r"\S+")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)


def _tokens(query: str) -> list[dict]:
    """A search string as tokens.

    Marks are words of their own: ``!`` negates the next token, others name its kind. A second
    negation or a second kind spoils the marks so far. The text is a bare word, "quoted" with
    \\" and \\\\ as escapes, or a %regex%; either may be empty. Marks without a text are dropped,
    and so is all after a quote or % that does not end."""
    out, at, marks = [], 0, []
    while word := _WORD.search(query, at):
        at, text, regex = word.start(), word.group(), False
        if text == "!" or text in MARKS:
            twice = any((m == "!") == (text == "!") for m in marks)
            marks, at = [] if twice else [*marks, text], word.end()
            continue
        if text[0] == '"':
            quoted = _QUOTED.match(query, at)
            if not quoted:
                break
            text, at = re.sub(r"\\(.)", lambda m: m[1] if m[1] in '"\\' else m[0], quoted[1], flags=re.S), quoted.end()
        elif text[0] == "%":
            end = query.find("%", at + 1)
            if end < 0:
                break
            text, regex, at = query[at + 1:end], True, end + 1
        else:
            at = word.end()
        out.append({"kind": next((MARKS[m] for m in marks if m != "!"), "any"), "negated": "!" in marks, "regex": regex, "text": text})
        marks = []
    return out


def tokenize_searches(df: DataFrame, col: str) -> DataFrame:
    """(search, tokens) for each distinct string of a search log."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"search": b.search, "tokens": [_tokens(q) for q in b.search]})

    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("search")).distinct().mapInPandas(run, "search string, tokens array<struct<kind:string,negated:boolean,regex:boolean,text:string>>")


def search_log_report(tokens: DataFrame, cat: dict) -> DataFrame:
    """(kind, negated, regex, n, unresolved, invalid_regex): use of each kind of token, how
    many plain tag tokens name no live tag, and how many patterns are invalid. Each distinct
    token meets the names and ids of live tags once, by the gram index."""
    flat = tokens.select(F.explode("tokens").alias("t")).select("t.*")
    words = flat.where("kind = 'tag' and not regex").select("regex", "text").distinct()
    with steps(tokens.sparkSession) as keep:
        known = keep(tags_named(alive(cat["tags"]), words).select("text").distinct().withColumn("known", F.lit(True)), "known-words")

    def invalid(batches):
        for b in batches:
            yield b[[java_pattern(p) is None for p in b.text]]

    bad = flat.where("regex").select("text").distinct().mapInPandas(invalid, "text string").withColumn("bad", F.lit(True))
    lost = (F.col("kind") == "tag") & ~F.col("regex") & F.col("known").isNull()
    return flat.join(known, "text", "left").join(bad, "text", "left").groupBy("kind", "negated", "regex").agg(F.count("*").alias("n"), F.count_if(lost).alias("unresolved"), F.count_if(F.col("regex") & F.col("bad").isNotNull()).alias("invalid_regex"))


def search_deleted_split(cat: dict, terms: DataFrame) -> DataFrame:
    """(query_id, deleted, n): hits among all rows by their state."""
    hits = search_batch(cat, terms, deleted="include")
    return hits.join(cat["files"].select("id", "deleted"), "id").groupBy("query_id", "deleted").agg(F.count("*").alias("n"))
