"""Tokenizers, indexes, rankers, note keys and line operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as t
from strandline.functions.paths import glob_regex, matches_globs
from strandline.operators import search, view
from strandline.plans import bindings as b
from strandline.plans.registry import query


def _camel(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '([[:lower:][:digit:]])([[:upper:]])', '\\1 \\2', 'g'), '([[:upper:]]+)([[:upper:]][[:lower:]])', '\\1 \\2', 'g')"


KEY = "'part/' || p_brand || '/' || p_name || '_' || p_partkey"
STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)


def _key_tokens(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '[/._#: \\t\\n\\r-]+')"
    camel = f"regexp_split_to_array({_camel(f"regexp_replace({x}, '[/._#: \\t\\n\\r-]+', ' ', 'g')")}, ' +')"
    base = f"CASE WHEN contains({x}, '/') THEN [regexp_extract({x}, '([^/]*)$', 1)] ELSE [] END"
    return f"list_distinct(list_transform(list_concat(list_filter({base}, lambda z: z <> ''), list_filter(list_concat({parts}, {camel}), lambda z: length(z) >= 2)), lambda z: lower(z)))"


def _text_tokens(x: str) -> str:
    words = f"regexp_split_to_array({x}, '[^A-Za-z0-9_$]+')"
    camel = f"regexp_split_to_array({_camel(f"regexp_replace({x}, '[^A-Za-z0-9_$]+', ' ', 'g')")}, ' +')"
    return f"list_filter(list_distinct(list_transform(list_filter(list_concat({words}, {camel}), lambda z: length(z) >= 3), lambda z: lower(z))), lambda z: z NOT IN ({STOP}))"


def _bm25_tokens(x: str) -> str:
    plain = f"regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')"
    cut = f"regexp_replace(regexp_replace({_camel(plain)}, '([[:alpha:]])([[:digit:]])', '\\1 \\2', 'g'), '([[:digit:]])([[:alpha:]])', '\\1 \\2', 'g')"
    whole = f"CASE WHEN regexp_matches(trim({x}), '[A-Za-z0-9]') AND NOT regexp_matches(trim({x}), '[ \\t\\n\\r]') THEN [trim({x})] ELSE [] END"
    return f"list_distinct(list_transform(list_concat(list_filter(string_split({cut}, ' '), lambda z: z <> ''), {whole}), lambda z: lower(z)))"


@query("tokenize_key", f"SELECT p_partkey, unnest({_key_tokens(KEY)}) AS term FROM part")
def tokenize_key(spark, sf_dir):
    """X20."""
    return b.table(spark, sf_dir, "part").select("p_partkey", F.explode(t.tokenize_key(F.expr("concat('part/', p_brand, '/', p_name, '_', p_partkey)"))).alias("term"))


@query("tokenize_text", f"SELECT doc_id, unnest({_text_tokens('text')}) AS term FROM documents")
def tokenize_text(spark, sf_dir):
    """X21."""
    return b.table(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokenize_text("text")).alias("term"))


@query("tokenize_bm25", f"SELECT doc_id, unnest({_bm25_tokens('text')}) AS term FROM documents")
def tokenize_bm25(spark, sf_dir):
    """X22."""
    return b.table(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokenize_bm25("text")).alias("term"))


TERMS = f"""
pn AS (SELECT 'p' || p_partkey AS id, {KEY} AS k, p_type AS s, p_brand AS g, CASE WHEN p_size % 10 = 0 THEN 'stale' ELSE 'ok' END AS st, p_size % 5 + 1 AS w FROM part),
tm AS (SELECT id, term, max(weight) AS weight FROM (
  SELECT id, unnest({_key_tokens('k')}) AS term, 3.0 AS weight FROM pn UNION ALL SELECT id, unnest({_key_tokens('g')}), 2.0 FROM pn
  UNION ALL SELECT id, unnest({_text_tokens('s')}), 1.0 FROM pn) GROUP BY id, term),
tags AS (SELECT DISTINCT unnest({_key_tokens('g')}) AS term FROM pn),
dfs AS (SELECT term, count(*) AS df FROM tm GROUP BY term),
cut AS (SELECT * FROM dfs WHERE term IN (SELECT term FROM tags) OR df <= greatest(20, floor(0.15 * (SELECT count(*) FROM pn)))),
po AS (SELECT term, id, CAST(weight AS DOUBLE) AS weight, df, least(df, 64) AS n_posted FROM (
  SELECT tm.*, df, row_number() OVER (PARTITION BY tm.term ORDER BY w DESC, tm.id) AS r FROM tm JOIN cut ON cut.term = tm.term JOIN pn ON pn.id = tm.id) WHERE r <= 64)
"""


@query("term_df", f"WITH {TERMS} SELECT term, df FROM dfs")
def term_df(spark, sf_dir):
    """A23, X23."""
    return search.node_terms(b.part_nodes(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


@query("posting_cap", f"WITH {TERMS} SELECT * FROM po")
def posting_cap(spark, sf_dir):
    """R1, A23, W3."""
    nodes = b.part_nodes(spark, sf_dir)
    return search.capped_postings(search.node_terms(nodes), nodes)


@query(
    "search_ranked",
    f"""WITH {TERMS}, q AS (SELECT unnest(['brand', 'steel', 'promo', 'economy', 'part', '7']) AS term), nq AS (SELECT count(*) AS n FROM q WHERE length(term) >= 2),
    h AS (SELECT id, sum(ln(1 + (SELECT count(*) FROM pn) / CAST(n_posted AS DOUBLE)) * weight) AS base, count(*) AS matched FROM po JOIN q USING (term) WHERE length(term) >= 2 GROUP BY id)
    SELECT id, 'file' AS t, k, round(base * (0.5 + 0.5 * matched / (SELECT n FROM nq)) * (1 + 0.1 * (w - 1)) * CASE WHEN st = 'stale' THEN 0.8 ELSE 1.0 END, 6) AS score, matched
    FROM h JOIN pn USING (id) ORDER BY score DESC, id LIMIT 10""",
)
def search_ranked(spark, sf_dir):
    """R2, T1, F14."""
    nodes = b.part_nodes(spark, sf_dir)
    return search.search(nodes, search.build_index(nodes), "brand steel promo economy part 7")


BM = f"""
f AS (SELECT 'name' AS field, p_partkey AS doc, {_bm25_tokens('p_name')} AS terms FROM part UNION ALL SELECT 'sig', p_partkey, {_bm25_tokens('p_type')} FROM part
  UNION ALL SELECT 'summary', p_partkey, {_bm25_tokens('p_brand')} FROM part),
st AS (SELECT field, count(*) AS n, avg(len(terms)) AS avgdl FROM f GROUP BY field),
p AS (SELECT field, doc, len(terms) AS len, unnest(terms) AS term FROM f),
d AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
q AS (SELECT unnest(['brand', '1', 'promo', 'steel']) AS term)
"""


@query(
    "bm25_locate",
    f"""WITH {BM}, s AS (SELECT doc, CASE field WHEN 'name' THEN 3.0 WHEN 'sig' THEN 1.0 ELSE 0.6 END * ln((n + 1) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len / avgdl)) AS s
      FROM p JOIN q USING (term) JOIN d USING (field, term) JOIN st USING (field))
    SELECT doc AS id, round(sum(s), 6) AS score FROM s GROUP BY doc ORDER BY score DESC, id LIMIT 100""",
)
def bm25_locate(spark, sf_dir):
    """R3, A24, T2."""
    p = b.table(spark, sf_dir, "part").selectExpr("p_partkey id", "p_name name", "p_type sig", "p_brand summary")
    return search.locate(p, "brand 1 promo steel", 100)


@query("field_lengths", f"WITH {BM} SELECT field, n, round(avgdl, 6) AS avgdl FROM st")
def field_lengths(spark, sf_dir):
    """A24."""
    p = b.table(spark, sf_dir, "part").selectExpr("p_partkey id", "p_name name", "p_type sig", "p_brand summary")
    return search.bm25_index(p)[1].select("field", "n", F.round("avgdl", 6).alias("avgdl"))


LINES = "list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '[ \\t\\r\\f]+$', ''))"
BODY = f"""
l AS (SELECT doc_id, {LINES} AS ls FROM (SELECT doc_id, '  ' || replace(text, chr(10), chr(10) || '    ') || chr(10) || chr(10) AS text FROM documents)),
x AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda z: z <> ''), true) AS a, len(ls) + 1 - list_position(list_transform(list_reverse(ls), lambda z: z <> ''), true) AS z FROM l),
y AS (SELECT doc_id, ls[a:z] AS bl FROM x),
w AS (SELECT doc_id, bl, list_min(list_transform(list_filter(bl, lambda q: q <> ''), lambda q: length(q) - length(ltrim(translate(q, chr(9), ' '), ' ')))) AS ind FROM y),
nb AS (SELECT doc_id, coalesce(array_to_string(list_transform(bl, lambda q: CASE WHEN q = '' THEN q ELSE substr(q, ind + 1) END), chr(10)), '') AS body FROM w)
"""


def _indented(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\n    ")), F.lit("\n\n")).alias("text"))


@query("normalized_body", f"WITH {BODY} SELECT doc_id, body FROM nb")
def normalized_body(spark, sf_dir):
    """X6, over texts indented and padded for the purpose."""
    return _indented(spark, sf_dir).select("doc_id", t.normalized_body("text").alias("body"))


@query("source_keys", f"WITH {BODY} SELECT doc_id, 'src:' || substr(sha256(substr(sha256(lang), 1, 16) || '|' || body), 1, 16) AS key FROM nb JOIN documents USING (doc_id)")
def source_keys(spark, sf_dir):
    """Text and language from one scan, as doc_id is the table's key."""
    return _indented(spark, sf_dir).select("doc_id", t.display_key(t.source_key(t.hash_prefix("lang", 16), "text")).alias("key"))


@query("slice_lines", "SELECT doc_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i BETWEEN 2 AND 4")
def slice_lines(spark, sf_dir):
    """SRC26, G33: lines two to four of each text."""
    return view.source_lines(b.table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("content")), ["doc_id"]).filter("line_no BETWEEN 2 AND 4")


@query("collapse_and_truncate", "SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 79), ' ') || '…' END AS s FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS c FROM documents)")
def collapse_and_truncate(spark, sf_dir):
    """X8, X9."""
    return b.table(spark, sf_dir, "documents").select("doc_id", t.truncate("text", 80).alias("s"))


GLOBS = ["**/supplier_*", "ASIA/*/customer_1*", "part/Brand#1?/**"]


@query("glob_match", f"WITH {b.FILE_NODES} SELECT id FROM fn WHERE " + " OR ".join(f"regexp_matches(k, '{glob_regex(g)}') OR regexp_matches(regexp_extract(k, '([^/]*)$', 1), '{glob_regex(g)}')" for g in GLOBS).replace("\\#", "#"))
def glob_match(spark, sf_dir):
    """F1."""
    return b.file_nodes(spark, sf_dir).filter(matches_globs("k", GLOBS)).select("id")


@query(
    "fold_symbols",
    f"""WITH {b.FILE_NODES}, sy AS (SELECT 'y' || l_partkey || '_' || l_suppkey AS id, 'p' || l_partkey AS file, count(*) AS degree FROM lineitem GROUP BY l_partkey, l_suppkey)
    SELECT sy.id, 'sym' AS t, fn.id AS file, CAST(least(6, 1 + floor(degree / 3.0)) AS BIGINT) AS w FROM sy JOIN fn ON fn.id = sy.file WHERE degree > 1""",
)
def fold_symbols(spark, sf_dir):
    """Connected symbols become nodes of their file, weighted by degree."""
    from strandline.operators.fold import folded_nodes

    li = b.table(spark, sf_dir, "lineitem")
    y = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("degree"))
    syms = y.selectExpr("concat('y', l_partkey, '_', l_suppkey) id", "concat('p', l_partkey) file", "degree")
    return folded_nodes(syms.filter("degree > 1"), b.file_nodes(spark, sf_dir))


@query(
    "fold_degree",
    "SELECT 'p' || p AS id, count(*) AS degree FROM (SELECT l_partkey AS p FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag <> 'N') GROUP BY p",
)
def fold_degree(spark, sf_dir):
    """A2: both ends of every edge row that is not containment."""
    from strandline.operators.fold import symbol_degree

    li = b.table(spark, sf_dir, "lineitem")
    e = li.selectExpr("concat('p', l_partkey) src", "concat('p', l_suppkey) dst", "if(l_returnflag = 'N', 'contains', 'call') type")
    return symbol_degree(e)


@query("bounded_view")
def bounded_view(spark, sf_dir):
    """Selection under a byte budget; phases depend on each other, so invariants are tested instead."""
    e = b.typed_chain(spark, sf_dir).select(F.concat(F.lit("fn:"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("fn:"), F.col("dst").cast("string")).alias("dst"), "type")
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumns({"kind": F.lit("function"), "span_size": F.lit(10).cast("long"), "bytes": F.lit(90).cast("long")})
    return view.bounded_view(n, e.withColumn("bytes", F.lit(60).cast("long")), 20_000)


@query(
    "runner_first_marker",
    """WITH m AS (SELECT 'src' || doc_id % 7 || '/' || ['pyproject.toml', 'package.json', 'go.mod', 'Cargo.toml'][1 + doc_id % 4] AS path FROM documents),
    r AS (SELECT path, CASE regexp_extract(path, '([^/]*)$', 1) WHEN 'Cargo.toml' THEN 'cargo-test' WHEN 'go.mod' THEN 'go-test' WHEN 'pyproject.toml' THEN 'pytest' END AS runner FROM m)
    SELECT runner, min(path) AS path FROM r WHERE runner IS NOT NULL GROUP BY runner""",
)
def runner_first_marker(spark, sf_dir):
    """SRC28: the first marker of each runner by path."""
    from strandline.sources.project import marker_runners

    d = b.table(spark, sf_dir, "documents")
    name = F.element_at(F.array(*map(F.lit, ("pyproject.toml", "package.json", "go.mod", "Cargo.toml"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return marker_runners(d.select(F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), name).alias("path")).withColumn("content", F.lit("{}")))
