"""Column expressions: ids, paths, text matching and content kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Extensions by kind of content.
KINDS = {
    "image": ["bmp", "gif", "ico", "jpeg", "jpg", "png", "tif", "tiff", "webp"],
    "pdf": ["pdf"],
    "video": ["3gp", "avi", "flv", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ogv", "webm", "wmv"],
    "text": [
        "bash", "c", "cc", "cfg", "conf", "cpp", "css", "csv", "dart", "go", "h", "hpp", "htm", "html", "ini", "java", "js", "json", "jsx", "kt", "log", "lua", "markdown", "md",
        "php", "pl", "py", "rb", "rs", "sh", "sql", "swift", "toml", "ts", "tsv", "tsx", "txt", "xml", "yaml", "yml", "zsh",
    ],
}
# Fixed value: the colour of a tag that names none.
DEFAULT_COLOR = "#F44336"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_id_prefix(c) -> Column:
    """Hyphens out, lower case; null unless what is left is hexadecimal and not empty."""
    plain = F.regexp_replace(_c(c), "-", "")
    return F.when(plain.rlike("^[0-9A-Fa-f]+\\z"), F.lower(plain))


def path_error(c) -> Column:
    """The first rule that a relative path breaks, or null. One trailing slash is allowed."""
    c = _c(c)
    parts = F.split(F.regexp_replace(c, "/\\z", ""), "/")
    bad = F.try_element_at(F.filter(parts, lambda x: x.isin("", ".", "..")), F.lit(1))
    return (
        F.when(c == "", "empty")
        .when(F.instr(c, "\x00") > 0, "nul")
        .when(c.startswith("/"), "absolute")
        .when(bad == "", "empty component")
        .when(bad == ".", "current directory")
        .when(bad == "..", "parent directory")
    )


def basename(c) -> Column:
    """The last component that is not empty, or an empty string."""
    return F.coalesce(F.try_element_at(F.filter(F.split(_c(c), "/"), lambda x: x != ""), F.lit(-1)), F.when(_c(c).isNotNull(), F.lit("")))


def extension(c) -> Column:
    """Lower-case extension of the last component; none for a dotfile or a final dot."""
    return F.nullif(F.lower(F.regexp_extract(basename(c), r"^.+\.([^.]+)\z", 1)), F.lit(""))


def matches_substring(c, text) -> Column:
    """Literal substring, Unicode case-insensitive."""
    return F.contains(F.lower(_c(c)), F.lower(text if isinstance(text, Column) else F.lit(text)))


def java_pattern(pattern: str) -> str | None:
    """The pattern in Java's dialect, or None if it is invalid: ``$`` is the very end, and
    look-around, back-references and possessive or atomic groups do not exist."""
    if re.search(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+", re.sub(r"\\\\", "", pattern)):
        return None
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append("\\z" if ch == "$" and not in_class else ch)
        i += 1
    try:
        re.compile(re.sub(r"\\z", r"\\Z", re.sub(r"\(\?-i\)", "", pattern)))
    except re.error:
        return None
    return "".join(out)


def matches_regex(c, pattern: str, ignore_case: bool = True) -> Column:
    """Regex search. An invalid pattern matches nothing and never fails the job."""
    java = java_pattern(pattern)
    return F.lit(False) if java is None else _c(c).rlike(("(?iU)" if ignore_case else "(?U)") + java)


def name_like_ascii(c, text: str) -> Column:
    """Literal substring that ignores the case of ASCII letters only."""
    return F.contains(F.translate(_c(c), UPPER, LOWER), F.lit(text.translate(str.maketrans(UPPER, LOWER))))


def kind_by_extension(c) -> Column:
    ext, out = extension(c), None
    for kind, names in KINDS.items():
        out = F.when(ext.isin(names), kind) if out is None else out.when(ext.isin(names), kind)
    return out


def _valid_prefix(b: Column) -> Column:
    """The longest prefix of the bytes, at most three bytes shorter, that is UTF-8; else null."""
    return F.coalesce(*[_utf8(b, k) for k in range(4)])


def _utf8(b: Column, less: int) -> Column:
    return F.try_validate_utf8(F.substr(b, F.lit(1), F.greatest(F.length(b) - less, F.lit(0))).cast("string"))


def looks_like_text(b) -> Column:
    """Empty, or: no NUL in the first 1024 bytes, and of what is UTF-8 before the first bytes
    that are not, under 5 % of the characters are control characters other than newline,
    return, tab. What starts with bytes that are not UTF-8 is no text."""
    head = F.substr(_c(b), F.lit(1), F.lit(1024))
    raw = head.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.substring_index(F.make_valid_utf8(raw), "\ufffd", 1))
    control = F.regexp_count(text, F.lit("[\\p{Cc}&&[^\\n\\r\\t]]"))
    return F.when(F.length(head) == 0, True).otherwise(F.coalesce((F.instr(F.make_valid_utf8(raw), "\x00") == 0) & (control * 20 < F.length(text)), F.lit(False)))


def text_snippet(b, size: int = 256) -> Column:
    """The first bytes up to a whole character, without control characters but \\n \\r \\t."""
    return F.regexp_replace(_valid_prefix(F.substr(_c(b), F.lit(1), F.lit(size))), "[\\p{Cc}&&[^\\n\\r\\t]]", "")


def format_size(c) -> Column:
    """Bytes for people: whole below 1 KiB, else one decimal and the largest unit up to PiB."""
    c = _c(c)
    out = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = out.when(c < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", c / F.lit(float(1024**k))))
    return out.otherwise(F.format_string("%.1f PiB", c / F.lit(float(1024**5))))


def validate_tags(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a blank name is bad; a blank or missing colour becomes the default."""
    blank = F.coalesce(F.trim("name") == "", F.lit(True))
    good = df.where(~blank).withColumn("color", F.when(F.coalesce(F.trim("color"), F.lit("")) == "", F.lit(DEFAULT_COLOR)).otherwise(F.col("color")))
    return good, df.where(blank)
