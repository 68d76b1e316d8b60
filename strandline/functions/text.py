"""String, hash and token functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.schemas import NODE_PREFIX, SYM_PREFIX

BOM = "﻿"
#: Words that the file search does not index.
STOP_WORDS = sorted(
    "was were what when which who why with you via used uses use two this they them that the set see run per out one not new "
    "may loc lines its into how his her have has get from for files file each code can but are any and also all add".split()
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_lf(c) -> Column:
    return F.replace(col(c), F.lit("\r\n"), F.lit("\n"))


def canonicalize(c) -> Column:
    """One leading byte-order mark goes, then CRLF becomes LF."""
    c = col(c)
    return normalize_lf(F.when(c.startswith(BOM), F.substring(c, 2, 2147483647)).otherwise(c))


def hash_prefix(c, n: int) -> Column:
    """First n hex digits of SHA-256."""
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, n)


def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[ \t\n\r\f\x0b]+", " "))


def first_paragraph(c) -> Column:
    return collapse_ws(F.element_at(F.split(F.trim(col(c)), r"\n[ \t\r]*\n", 2), 1))


def truncate(c, most: int) -> Column:
    """White space collapsed, cut to most characters, the last an ellipsis."""
    flat = collapse_ws(c)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def tokens_rounded(n) -> Column:
    """Token estimate of the file engine: chars / 4, halves up."""
    return F.floor(col(n) / 4 + 0.5).cast("long")


def tokens_ceiled(n) -> Column:
    """Token estimate of the symbol engine: chars / 4, up."""
    return F.ceil(col(n) / 4).cast("long")


def round4(x) -> Column:
    return F.floor(col(x) * 10000 + 0.5) / 10000


def file_id(t, k) -> Column:
    """Node id of the file graph: i<number> for issues, else a type letter and 6 hex digits."""
    t, k = col(t), col(k)
    letter = F.lit(None).cast("string")
    for kind, prefix in NODE_PREFIX.items():
        letter = F.when(t == kind, prefix).otherwise(letter)
    return F.when(t == "issue", F.concat(F.lit("i"), k)).otherwise(F.concat(letter, hash_prefix(F.concat_ws(":", t, k), 6)))


def symbol_id(kind, path, name, sl, sb, el, eb, sig_hash) -> Column:
    """Node id of the symbol graph: kind prefix and 12 hex digits of place, name and signature."""
    prefix = F.lit("sym")
    for k, p in SYM_PREFIX.items():
        prefix = F.when(col(kind) == k, p).otherwise(prefix)
    span = F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in (col(sl), ":", col(sb), "-", col(el), ":", col(eb))])
    return F.concat(prefix, F.lit(":"), hash_prefix(F.concat_ws("|", col(path), col(name), span, col(sig_hash)), 12))


def let(value: Column, body) -> Column:
    """body(value), the value computed once: what stands several times within a higher-order function is computed as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized_body(c) -> Column:
    """Canonical text, lines right-trimmed, blank edges dropped, the common indent removed.

    Whole texts are rewritten, not lines one by one: a right-trimmed blank line is
    empty, so blank edges are runs of line breaks.
    """
    trimmed = F.btrim(F.regexp_replace(canonicalize(c), r"(?<![ \t\r\f])[ \t\r\f]++(?=\n|\z)", ""), F.lit("\n"))
    indents = lambda t: F.regexp_extract_all(t, F.lit(r"(?<![^\n])([ \t]*+)(?=[^\n])"), F.lit(1))
    least = lambda t: F.array_min(F.transform(indents(t), lambda x: F.length(x)))
    cut = lambda t: let(least(t), lambda n: F.when(n > 0, F.regexp_replace(t, F.concat(F.lit("(?<![^\\n])[ \\t]{"), n.cast("string"), F.lit("}")), F.lit(""))).otherwise(t))
    return F.coalesce(let(trimmed, cut), F.lit(""))


def source_key(sig_hash, body) -> Column:
    """Key of a note: 16 hex digits of signature hash and normalised body."""
    return hash_prefix(F.concat_ws("|", col(sig_hash), normalized_body(body)), 16)


def display_key(key) -> Column:
    return F.concat(F.lit("src:"), col(key))


def _camel(c: Column) -> Column:
    """A blank between a lower-case letter or digit and a capital, and before the last capital of a run."""
    c = F.regexp_replace(c, r"([\p{Lower}\d])(\p{Upper})", "$1 $2")
    return F.regexp_replace(c, r"(\p{Upper}+)(\p{Upper}\p{Lower})", "$1 $2")


def tokenize_key(c) -> Column:
    """Distinct lower-case tokens of a path-like key: its parts and their camel parts of 2 or more, and the base name below a directory."""
    c = col(c)
    parts = F.split(c, r"[/._#: \t\n\r-]+")
    camel = F.flatten(F.transform(parts, lambda x: F.split(_camel(x), " ")))
    base = F.when(F.contains(c, F.lit("/")), F.array(F.regexp_extract(c, r"([^/]*)$", 1))).otherwise(F.array().cast("array<string>"))
    long = F.filter(F.concat(parts, camel), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.transform(F.concat(F.filter(base, lambda x: x != ""), long), lambda x: F.lower(x)))


def tokenize_text(c) -> Column:
    """Distinct lower-case words of 3 or more characters of [A-Za-z0-9_$], and camel parts, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(col(c), F.lit("[A-Za-z0-9_$]{3,}"), F.lit(0)))

    def with_parts(own):
        humped = F.filter(own, lambda x: x.rlike(r"[\p{Lower}\d]\p{Upper}|\p{Upper}{2}\p{Lower}"))  # only these have parts of their own
        camel = F.filter(F.flatten(F.transform(humped, lambda x: F.split(_camel(x), " "))), lambda x: F.length(x) >= 3)
        return F.array_distinct(F.transform(F.concat(own, camel), lambda x: F.lower(x)))

    return F.filter(let(words, with_parts), lambda x: ~x.isin(*STOP_WORDS))


def tokenize_bm25(c) -> Column:
    """Distinct lower-case tokens, split at camel humps and between letters and digits; the whole word last when it has no blank."""
    c = F.coalesce(col(c), F.lit(""))
    chunks = F.filter(F.split(c, r"[^A-Za-z0-9]+"), lambda x: x != "")
    digits = lambda x: F.regexp_replace(F.regexp_replace(_camel(x), r"(\p{Alpha})(\d)", "$1 $2"), r"(\d)(\p{Alpha})", "$1 $2")
    parts = F.flatten(F.transform(chunks, lambda x: F.split(digits(x), " ")))
    flat = F.trim(c)
    whole = F.when(flat.rlike("[A-Za-z0-9]") & ~flat.rlike(r"[ \t\n\r]"), F.array(flat)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(parts, whole), lambda x: F.lower(x)))


def path_mentions(c) -> Column:
    """Distinct mentions in a text: file paths, ADR numbers, numbered document prefixes."""
    c = col(c)
    paths = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+)"), 1)
    adrs = F.regexp_extract_all(c, F.lit(r"(ADR[- ]?[0-9]{1,4})"), 1)
    docs = F.regexp_extract_all(c, F.lit(r"(?:^|[^A-Za-z0-9])([0-9]{2,4}-[a-z][a-z0-9-]+)"), 1)
    return F.array_distinct(F.concat(paths, adrs, docs))


def issue_numbers(c) -> Column:
    """Every #N of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(r"#([0-9]+)"), 1), lambda x: x.cast("int")))


def closing_numbers(c) -> Column:
    """Every #N that a closing key word precedes."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?i)(?:closed|closes|close|fixed|fixes|fix|resolved|resolves|resolve)[ \t]*:?[ \t]+#([0-9]+)"), 1)
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def listed_after(c, words: str) -> Column:
    """Issue numbers on the lines that begin with the words, such as Blocked by: #4, #5."""
    lines = F.regexp_extract_all(col(c), F.lit(rf"(?im)(?:{words})[ \t]*:?[ \t]*((?:#[0-9]+(?:[ \t]*(?:,|and)[ \t]*)?)+)"), 1)
    return issue_numbers(F.array_join(lines, " "))


def escape_json_island(c) -> Column:
    """JSON that can stand inside an HTML script element."""
    return F.replace(col(c), F.lit("<"), F.lit("\\u003c"))


def structural_summary(doc, loc, used_by, imports, exports, most: int = 200) -> Column:
    """doc — loc · used by · imports · exports: each further part stands while the whole fits."""
    parts = F.array(
        F.concat(col(loc).cast("string"), F.lit(" loc")),
        F.when(col(used_by) > 0, F.concat(F.lit("used by "), col(used_by).cast("string"))),
        F.when(F.size(col(imports)) > 0, F.concat(F.lit("imports "), F.array_join(col(imports), ", "))),
        F.when(F.size(col(exports)) > 0, F.concat(F.lit("exports "), F.array_join(col(exports), ", "))),
    )
    start = F.coalesce(truncate(doc, most), F.lit(""))

    def add(acc, part):
        glue = F.when(acc == "", "").when(acc == start, " — ").otherwise(" · ")
        longer = F.concat(acc, glue, part)
        return F.when(part.isNotNull() & (F.length(longer) <= most), longer).otherwise(acc)

    return F.aggregate(parts, start, add)


def short_name(key) -> Column:
    """Display name: the base name, with its directory before barrels such as index.ts."""
    key = col(key)
    base = F.element_at(F.split(key, "/"), -1)
    barrel = base.rlike(r"^(index|main|mod|__init__)\.[a-z]+$") & F.contains(key, F.lit("/"))
    return F.when(barrel, F.array_join(F.slice(F.split(key, "/"), -2, 2), "/")).otherwise(base)
