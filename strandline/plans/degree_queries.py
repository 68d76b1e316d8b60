"""Degrees, counts, sets, budgets and edge maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.text import file_id, hash_prefix, symbol_id, tokens_ceiled, tokens_rounded
from strandline.operators import fold, graph, traversal
from strandline.plans import bindings as b
from strandline.plans.registry import query

FLOW = f"WITH {b.FILE_EDGES}, {b.FILE_NODES}, fl AS (SELECT DISTINCT src, dst FROM fe WHERE type IN ('imports', 'calls'))"


@query(
    "fanin_quintile",
    """
    WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
    d AS (SELECT dst AS part, count(*) AS fan_in FROM e GROUP BY dst)
    SELECT part, fan_in,
           CAST(least(5, 1 + floor(cume_dist() OVER (ORDER BY fan_in) * 5)) AS INTEGER) AS weight
    FROM d
    """,
)
def fanin_quintile(spark, sf_dir):
    """W1 over supplier -> part imports; two columns reach the scan."""
    e = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    deg = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    return deg.join(graph.fan_in_weights(deg), "id").select(F.col("id").alias("part"), F.col("n_in").alias("fan_in"), F.col("w").alias("weight"))


@query(
    "degree_in_out",
    FLOW + """
    SELECT fn.id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM fn
    LEFT JOIN (SELECT dst, count(*) AS n FROM fl GROUP BY dst) i ON i.dst = fn.id
    LEFT JOIN (SELECT src, count(*) AS n FROM fl GROUP BY src) o ON o.src = fn.id""",
)
def degree_in_out(spark, sf_dir):
    """A1: distinct neighbours on the flow graph."""
    return traversal.degrees(b.file_nodes(spark, sf_dir), traversal.flow_edges(b.file_edges(spark, sf_dir)))


@query(
    "top_fanin",
    f"WITH {b.FILE_EDGES} SELECT dst AS id, count(DISTINCT src) AS n_in FROM fe WHERE type = 'imports' GROUP BY dst ORDER BY n_in DESC, id LIMIT 8",
)
def top_fanin(spark, sf_dir):
    """The eight most depended-on nodes."""
    e = b.file_edges(spark, sf_dir).filter("type = 'imports'")
    return graph.top_fan_in(e, 8)


@query("total_degree", f"WITH {b.FILE_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM fe WHERE type <> 'part-of' UNION ALL SELECT dst FROM fe WHERE type <> 'part-of') GROUP BY id")
def total_degree(spark, sf_dir):
    """A2, A3: edge rows at both ends, containment left out."""
    e = b.file_edges(spark, sf_dir).filter("type != 'part-of'")
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


@query("import_spec_counts", "SELECT 's' || l_suppkey AS id, count(*) AS n_specs, count(DISTINCT l_partkey) AS n_targets FROM lineitem GROUP BY l_suppkey")
def import_spec_counts(spark, sf_dir):
    """A4: resolved specs, not distinct targets."""
    li = b.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id")).agg(F.count("*").alias("n_specs"), F.countDistinct("l_partkey").alias("n_targets"))


@query("node_type_counts", f"WITH {b.FILE_NODES} SELECT t, count(*) AS n FROM fn GROUP BY t")
def node_type_counts(spark, sf_dir):
    """A6."""
    return b.file_nodes(spark, sf_dir).groupBy("t").agg(F.count("*").alias("n"))


@query("edge_type_counts", f"WITH {b.FILE_EDGES} SELECT type, count(*) AS n FROM fe GROUP BY type")
def edge_type_counts(spark, sf_dir):
    """A6."""
    return b.file_edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("count_by_key", "SELECT coalesce(lang, '?') AS lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1")
def count_by_key(spark, sf_dir):
    """A5."""
    return graph.count_by(b.table(spark, sf_dir, "documents"), "lang")


@query(
    "lang_breakdown",
    """WITH n AS (SELECT lang, source AS path, 'd' || doc_id AS id FROM documents),
    e AS (SELECT l_suppkey % 20 AS k, l_linestatus FROM lineitem),
    o AS (SELECT DISTINCT lang, path FROM n),
    x AS (SELECT o.lang, count(*) AS edges, count(*) FILTER (l_linestatus = 'O') AS exact, count(*) FILTER (l_linestatus <> 'O') AS heuristic
          FROM e JOIN o ON o.path = 'src' || e.k GROUP BY o.lang)
    SELECT n.lang, count(DISTINCT path) AS files, count(*) AS nodes, coalesce(any_value(edges), 0) AS edges, coalesce(any_value(exact), 0) AS exact,
           coalesce(any_value(heuristic), 0) AS heuristic, CAST(0 AS BIGINT) AS rough FROM n LEFT JOIN x ON n.lang = x.lang GROUP BY n.lang""",
)
def lang_breakdown(spark, sf_dir):
    """Documents as nodes of their source file, line items as edges of that origin."""
    nodes = b.table(spark, sf_dir, "documents").select("lang", F.col("source").alias("path"), F.lit("exact").alias("confidence"))
    edges = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("f"), F.when(F.col("l_linestatus") == "O", "exact").otherwise("heuristic").alias("confidence"))
    return graph.symbol_stats(nodes, edges)


@query("module_counts", f"WITH {b.FILE_EDGES} SELECT dst AS module, count(*) AS n FROM fe WHERE type = 'part-of' AND src NOT LIKE 'n%' GROUP BY dst")
def module_counts(spark, sf_dir):
    """Members of each module."""
    e = b.file_edges(spark, sf_dir).filter("type = 'part-of' AND src NOT LIKE 'n%'")
    return e.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("n"))


@query(
    "module_tested_pct",
    f"""WITH {b.FILE_EDGES}, m AS (SELECT src AS id, dst AS module FROM fe WHERE type = 'part-of' AND src LIKE 's%'),
    t AS (SELECT DISTINCT dst AS id FROM fe WHERE type = 'tested-by')
    SELECT module, count(*) AS files, CAST(floor(100.0 * count(t.id) / count(*) + 0.5) AS BIGINT) AS tested_pct,
           CAST(least(8, 1 + floor(count(*) / 4.0)) AS BIGINT) AS weight
    FROM m LEFT JOIN t USING (id) GROUP BY module""",
)
def module_tested_pct(spark, sf_dir):
    """Files and share of tested files of each module, halves rounded up."""
    e = b.file_edges(spark, sf_dir)
    member = e.filter("type = 'part-of' AND src LIKE 's%'").select(F.col("src").alias("id"), F.col("dst").alias("module"))
    tested = e.filter("type = 'tested-by'").select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(1))
    n = F.count("*")
    return member.join(tested, "id", "left").groupBy("module").agg(
        n.alias("files"), F.floor(100.0 * F.count("hit") / n + 0.5).cast("long").alias("tested_pct"), F.least(F.lit(8), 1 + F.floor(n / 4.0)).cast("long").alias("weight")
    )


@query(
    "provenance",
    f"""WITH {b.FILE_NODES}, sy AS (SELECT DISTINCT 'p' || l_partkey AS id FROM lineitem WHERE l_returnflag = 'A')
    SELECT CASE WHEN fn.id IS NULL THEN 'symbols' WHEN sy.id IS NULL THEN 'files' ELSE 'both' END AS origin, count(*) AS n
    FROM (SELECT id FROM fn WHERE t = 'file') fn FULL JOIN sy ON fn.id = sy.id GROUP BY 1""",
)
def provenance(spark, sf_dir):
    """Nodes that one engine or both know."""
    files = b.file_nodes(spark, sf_dir).filter("t = 'file'").select("id", F.lit(True).alias("f"))
    syms = b.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")).distinct().withColumn("s", F.lit(True))
    origin = F.when(F.col("f").isNull(), "symbols").when(F.col("s").isNull(), "files").otherwise("both")
    return files.join(syms, "id", "full").groupBy(origin.alias("origin")).agg(F.count("*").alias("n"))


@query(
    "overview_sections",
    f"""WITH {b.FILE_EDGES}, {b.FILE_NODES},
    m AS (SELECT 'module' AS section, k AS key, n FROM (SELECT dst AS id, count(*) AS n FROM fe WHERE type = 'part-of' GROUP BY dst) JOIN fn USING (id) WHERE t = 'mod' ORDER BY n DESC, k LIMIT 6),
    e AS (SELECT 'entry' AS section, k AS key, n FROM (SELECT src AS id, count(DISTINCT dst) AS n FROM fe WHERE type = 'imports' GROUP BY src) JOIN fn USING (id) WHERE t = 'entry' ORDER BY n DESC, k LIMIT 6)
    SELECT 'node' AS section, t AS key, count(*) AS n FROM fn GROUP BY t UNION ALL SELECT 'edge', type, count(*) FROM fe GROUP BY type
    UNION ALL SELECT * FROM m UNION ALL SELECT * FROM e""",
)
def overview_sections(spark, sf_dir):
    """A20, T4."""
    return graph.overview(b.file_nodes(spark, sf_dir).withColumn("st", F.lit("ok")), b.file_edges(spark, sf_dir))


@query(
    "distinct_neighbors",
    f"WITH {b.FILE_EDGES} SELECT type, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM fe GROUP BY type",
)
def distinct_neighbors(spark, sf_dir):
    """Exact distinct counts."""
    return b.file_edges(spark, sf_dir).groupBy("type").agg(F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query("orphan_edges", f"WITH {b.FILE_EDGES}, {b.FILE_NODES} SELECT src, type, dst FROM fe WHERE src NOT IN (SELECT id FROM fn WHERE id NOT LIKE '%7') OR dst NOT IN (SELECT id FROM fn WHERE id NOT LIKE '%7')")
def orphan_edges(spark, sf_dir):
    """Edges of nodes whose id ends in 7, which the pruned graph lacks."""
    return graph.orphan_edges(b.file_edges(spark, sf_dir), b.file_nodes(spark, sf_dir).filter("id NOT LIKE '%7'"))


@query(
    "replace_owned_edges",
    f"""WITH {b.FILE_EDGES} SELECT src, type, dst FROM fe WHERE type NOT IN ('documents', 'tested-by', 'imports', 'part-of')
    UNION SELECT src, type, dst FROM fe WHERE type = 'imports' AND src LIKE 's%'""",
)
def replace_owned_edges(spark, sf_dir):
    """U4: a scan that finds suppliers' imports alone takes the place of all scan-owned edges."""
    e = b.file_edges(spark, sf_dir)
    return graph.replace_owned(e, e.filter("type = 'imports' AND src LIKE 's%'"))


@query(
    "edge_dedupe_confidence",
    """SELECT src, dst, type, label, CASE WHEN bool_or(confidence = 'exact') THEN 'exact' ELSE 'heuristic' END AS confidence, arg_min(f, seq) AS f FROM (
      SELECT l_suppkey AS src, l_partkey AS dst, 'call' AS type, l_linestatus AS label, CASE WHEN l_returnflag = 'A' THEN 'exact' ELSE 'heuristic' END AS confidence,
             l_orderkey || ':' || l_linenumber AS f, l_orderkey || ':' || l_linenumber || ':' || l_quantity AS seq FROM lineitem) GROUP BY src, dst, type, label""",
)
def edge_dedupe_confidence(spark, sf_dir):
    """First writer's origin, exact upgrades."""
    li = b.table(spark, sf_dir, "lineitem")
    at = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    e = li.select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("call").alias("type"), F.col("l_linestatus").alias("label"),
        F.when(F.col("l_returnflag") == "A", "exact").otherwise("heuristic").alias("confidence"), at.alias("f"), F.concat_ws(":", at, F.col("l_quantity").cast("string")).alias("seq"),
    )
    return graph.dedupe_confidence(e)


@query("valid_edges", f"WITH {b.FILE_EDGES} SELECT DISTINCT src, type, dst FROM fe WHERE src <> dst")
def valid_edges(spark, sf_dir):
    """Known types, no self-edges, one a triple."""
    e = b.file_edges(spark, sf_dir)
    return graph.valid_edges(e.unionByName(e.limit(5)).unionByName(e.withColumn("type", F.lit("unknown"))))


STATE = "CASE event_type WHEN 'error' THEN 'conflicted' WHEN 'purchase' THEN 'modified' WHEN 'click' THEN 'staged' WHEN 'view' THEN 'unpushed' ELSE 'untracked' END"
RANK = "CASE state WHEN 'pushed' THEN 0 WHEN 'unpushed' THEN 1 WHEN 'staged' THEN 2 WHEN 'modified' THEN 3 WHEN 'untracked' THEN 4 ELSE 5 END"


def _states(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.expr(STATE).alias("state"))


@query("worst_state", f"SELECT path, arg_max(state, {RANK}) AS state FROM (SELECT 'u' || user_id AS path, {STATE} AS state FROM events) GROUP BY path")
def worst_state(spark, sf_dir):
    """A14."""
    return graph.worst_state(_states(spark, sf_dir))


@query(
    "state_counters",
    f"""WITH s AS (SELECT path, arg_max(state, {RANK}) AS state FROM (SELECT 'u' || user_id AS path, {STATE} AS state FROM events) GROUP BY path)
    SELECT state, count(*) AS n FROM s GROUP BY state UNION ALL SELECT 'pushed', greatest(0, 5000 - (SELECT count(*) FROM s WHERE state <> 'untracked'))""",
)
def state_counters(spark, sf_dir):
    """A15, for 5000 tracked files."""
    return graph.state_counters(graph.worst_state(_states(spark, sf_dir)), 5000)


@query("worst_check_state", "SELECT 'u' || user_id AS path, arg_max(state, r) AS state, count(*) AS n FROM (SELECT *, CASE event_type WHEN 'error' THEN 'drift' WHEN 'purchase' THEN 'dangling' ELSE 'orphan' END AS state, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS r FROM events) GROUP BY user_id")
def worst_check_state(spark, sf_dir):
    """A18."""
    e = b.table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "drift").when(F.col("event_type") == "purchase", "dangling").otherwise("orphan")
    return graph.worst_check(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), state.alias("state")))


@query(
    "node_ids",
    f"""WITH {b.FILE_NODES} SELECT k, CASE t WHEN 'mod' THEN 'm' WHEN 'entry' THEN 'e' ELSE 'f' END || substr(sha256(t || ':' || k), 1, 6) AS file_id,
    'fn:' || substr(sha256(k || '|' || t || '|1:0-2:10|' || substr(sha256(k), 1, 16)), 1, 12) AS sym_id FROM fn""",
)
def node_ids(spark, sf_dir):
    """X3, X4, X5."""
    n = b.file_nodes(spark, sf_dir).withColumn("sig", hash_prefix("k", 16))
    return n.select("k", file_id("t", "k").alias("file_id"), symbol_id(F.lit("function"), "k", "t", F.lit(1), F.lit(0), F.lit(2), F.lit(10), "sig").alias("sym_id"))


@query(
    "id_collisions",
    """WITH h AS (SELECT t, k, sha256(t || ':' || k) AS h FROM (SELECT 'file' AS t, CAST(l_orderkey * 7 + l_linenumber AS VARCHAR) AS k FROM lineitem) GROUP BY t, k),
    p AS (SELECT *, row_number() OVER (PARTITION BY substr(h, 1, 6) ORDER BY k) AS r FROM h)
    SELECT t, a.k, 'f' || substr(a.h, 1, CAST(5 + (SELECT min(n) FROM range(1, 16) g(n) WHERE NOT EXISTS (SELECT 1 FROM p b WHERE substr(b.h, 1, 6) = substr(a.h, 1, 6) AND b.k < a.k AND substr(b.h, 1, CAST(5 + n AS BIGINT)) = substr(a.h, 1, CAST(5 + n AS BIGINT)))) AS BIGINT)) AS id
    FROM p a WHERE a.r > 1
    UNION ALL SELECT t, k, 'f' || substr(h, 1, 6) FROM p WHERE r = 1""",
)
def id_collisions(spark, sf_dir):
    """Colliding six-digit ids grow."""
    li = b.table(spark, sf_dir, "lineitem").select(F.lit("file").alias("t"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).cast("string").alias("k"))
    return graph.assign_ids(li)


@query("token_estimates", "SELECT doc_id, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS rounded, CAST(ceil(length(text) / 4.0) AS BIGINT) AS ceiled FROM documents")
def token_estimates(spark, sf_dir):
    """Both roundings, of code points."""
    return b.table(spark, sf_dir, "documents").select("doc_id", tokens_rounded(F.length("text")).alias("rounded"), tokens_ceiled(F.length("text")).alias("ceiled"))


@query("oversize_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 200")
def oversize_filter(spark, sf_dir):
    """F15."""
    return b.table(spark, sf_dir, "documents").filter(F.length("text") > 200).select("doc_id", "n_chars")


@query(
    "prefix_budget_cut",
    """SELECT lang, doc_id, CAST(spent AS BIGINT) AS spent FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) WHERE spent <= 100000""",
)
def prefix_budget_cut(spark, sf_dir):
    """Ranked rows of each language within a running budget."""
    d = b.table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return graph.prefix_budget(d, [F.desc("n_chars"), F.col("doc_id")], "n_chars", 100_000, ["lang"]).select("lang", "doc_id", "spent")


@query(
    "greedy_skip_budget",
    """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
    g(source, r, doc_id, n_chars, spent, kept) AS (
      SELECT source, r, doc_id, n_chars, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END, n_chars <= 20000 FROM d WHERE r = 1
      UNION ALL SELECT d.source, d.r, d.doc_id, d.n_chars, CASE WHEN g.spent + d.n_chars <= 20000 THEN g.spent + d.n_chars ELSE g.spent END, g.spent + d.n_chars <= 20000
        FROM g JOIN d ON d.source = g.source AND d.r = g.r + 1)
    SELECT source, doc_id, n_chars FROM g WHERE kept""",
)
def greedy_skip_budget(spark, sf_dir):
    """Rows that still fit when they come up."""
    d = b.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return graph.greedy_budget(d, "source", ["doc_id"], "n_chars", 20_000)


@query("anchor_cap", "SELECT l_partkey AS part, l_orderkey AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE r <= 40")
def anchor_cap(spark, sf_dir):
    """Merged anchors by line, the first forty."""
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").cast("int").alias("line"), F.lit("x").alias("name")).distinct()
    files = li.select(F.col("file").alias("id")).distinct().withColumn("a", F.lit(None).cast("array<struct<name:string,line:int>>"))
    return fold.merge_anchors(files, li).select(F.col("id").alias("part"), F.explode("a").alias("x")).select("part", F.col("x.line").cast("long").alias("line"))


@query("next_line_span", "SELECT doc_id, lang, CAST(coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) - 1, 1000000) AS BIGINT) AS end_line FROM documents")
def next_line_span(spark, sf_dir):
    """A symbol ends on the line before the next one's."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return b.table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce(F.lead("doc_id").over(w) - 1, F.lit(1_000_000)).cast("long").alias("end_line"))


@query("first_wins", "SELECT l_partkey AS name, min(l_suppkey) AS first_def FROM lineitem GROUP BY l_partkey")
def first_wins(spark, sf_dir):
    """W4."""
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("first_def"))
    return graph.first_wins(li, ["name"], [F.col("first_def")])


@query("last_wins", "SELECT l_partkey AS name, max(l_suppkey) AS binding FROM lineitem GROUP BY l_partkey")
def last_wins(spark, sf_dir):
    """W5."""
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("binding"))
    return graph.last_wins(li, ["name"], [F.col("binding")])


@query("def_keys", "SELECT doc_id, 'd' || row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS key FROM documents")
def def_keys(spark, sf_dir):
    """W6."""
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.row_number().over(w).cast("string")).alias("key"))


@query("unique_name_link", "SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)")
def unique_name_link(spark, sf_dir):
    """Only keys of one owner link."""
    return graph.unique_only(b.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key")), "key").select("doc_id", "source")


@query("dir_file_counts", f"""WITH {b.PAGE_FILES}, p AS (SELECT path, string_split(path, '/') AS s FROM pf), d AS (SELECT path, array_to_string(s[1:i], '/') AS dir, i = len(s) - 1 AS own FROM p, range(1, 50) g(i) WHERE i < len(s))
    SELECT dir, count(*) FILTER (own) AS direct, count(*) AS nested FROM d GROUP BY dir""")
def dir_file_counts(spark, sf_dir):
    """Files directly in, and anywhere below, each directory."""
    from strandline.functions.paths import ancestors, dirname, has_parent

    f = b.page_files(spark, sf_dir).filter(has_parent("path")).select(F.explode(ancestors("path")).alias("dir"), dirname("path").alias("own"))
    return f.groupBy("dir").agg(F.count_if(F.col("dir") == F.col("own")).alias("direct"), F.count("*").alias("nested"))


CUSTOMER_PATHS = "cp AS (SELECT r_name || '/' || n_name || '/' || c_mktsegment || '/c' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
#: Depth by depth from the deepest, as paths are four parts long.
MODULES = f"""{CUSTOMER_PATHS}, s AS (SELECT string_split(path, '/') AS s FROM cp),
    d AS (SELECT array_to_string(s[1:i], '/') AS dir, i, count(*) FILTER (i = len(s) - 1) AS direct, count(*) AS nested FROM s, range(1, 4) g(i) GROUP BY ALL),
    m3 AS (SELECT *, CAST(0 AS BIGINT) AS kids FROM d WHERE i = 3 AND nested >= 2 AND direct >= 1),
    k2 AS (SELECT regexp_replace(dir, '/[^/]*$', '') AS dir, count(*) AS kids FROM m3 GROUP BY 1),
    m2 AS (SELECT d.*, coalesce(kids, 0) AS kids FROM d LEFT JOIN k2 USING (dir) WHERE i = 2 AND nested >= 2 AND (direct >= 1 OR coalesce(kids, 0) >= 2)),
    k1 AS (SELECT regexp_replace(dir, '/[^/]*$', '') AS dir, count(*) AS kids FROM m2 GROUP BY 1),
    m1 AS (SELECT d.*, coalesce(kids, 0) AS kids FROM d LEFT JOIN k1 USING (dir) WHERE i = 1 AND nested >= 2 AND (direct >= 1 OR coalesce(kids, 0) >= 2)),
    mods AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


def _customer_paths(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    nation = b.table(spark, sf_dir, "nation").join(b.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return c.join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr("concat(r_name, '/', n_name, '/', c_mktsegment, '/c', c_custkey) path")


@query("infer_modules", f"WITH {MODULES} SELECT dir, direct, nested, kids AS child_modules FROM mods")
def infer_modules(spark, sf_dir):
    """G17."""
    return graph.infer_modules(_customer_paths(spark, sf_dir))


@query("nearest_module", f"WITH {MODULES}, c AS (SELECT cp.path, dir FROM cp LEFT JOIN mods ON starts_with(cp.path, dir || '/')) SELECT path, arg_max(dir, length(dir)) AS module FROM c GROUP BY path")
def nearest_module(spark, sf_dir):
    """J10."""
    paths = _customer_paths(spark, sf_dir)
    return graph.nearest_module(paths, graph.infer_modules(paths))


@query(
    "longest_prefix_match",
    """WITH n AS (SELECT DISTINCT p_type AS fqn FROM part), idx AS (SELECT DISTINCT array_to_string(string_split(p_type, ' ')[1:2], ' ') AS pre FROM part WHERE p_size > 25)
    SELECT fqn, arg_max(pre, length(pre)) AS class FROM n LEFT JOIN idx ON fqn = pre OR starts_with(fqn, pre || ' ') GROUP BY fqn""",
)
def longest_prefix_match(spark, sf_dir):
    """A dotted name cut from the right until an indexed class stands."""
    from strandline.operators.resolve import longest_prefix

    p = b.table(spark, sf_dir, "part")
    names = p.select(F.col("p_type").alias("fqn")).distinct()
    index = p.filter("p_size > 25").select(F.array_join(F.slice(F.split("p_type", " "), 1, 2), " ").alias("pre")).distinct()
    return longest_prefix(names, index, " ").select("fqn", F.col("match").alias("class"))


@query(
    "smallest_enclosing",
    """WITH d AS (SELECT l_suppkey AS path, l_linenumber * 10 AS sb, l_linenumber * 10 + CAST(l_quantity AS INTEGER) * 3 AS eb, l_orderkey AS key FROM lineitem),
    q AS (SELECT DISTINCT l_suppkey AS path, l_orderkey % 97 AS pos FROM lineitem),
    j AS (SELECT q.path, q.pos, key, row_number() OVER (PARTITION BY q.path, q.pos ORDER BY eb - sb, sb, key) AS r FROM q JOIN d ON q.path = d.path AND sb <= pos AND pos < eb)
    SELECT path, pos, key FROM j WHERE r = 1""",
)
def smallest_enclosing(spark, sf_dir):
    """The smallest span that holds a position, within one file."""
    from strandline.operators.resolve import smallest_enclosing as join

    li = b.table(spark, sf_dir, "lineitem")
    spans = li.selectExpr("l_suppkey path", "l_linenumber * 10 sb", "l_linenumber * 10 + int(l_quantity) * 3 eb", "l_orderkey key")
    places = li.selectExpr("l_suppkey path", "l_orderkey % 97 pos").distinct()
    return join(places, spans).select("path", "pos", "key")


@query(
    "interface_satisfaction",
    """WITH t AS (SELECT DISTINCT l_suppkey AS type, l_partkey AS method FROM lineitem), i AS (SELECT DISTINCT l_orderkey AS iface, l_partkey AS method FROM lineitem),
    n AS (SELECT iface, count(*) AS need FROM i GROUP BY iface)
    SELECT t.type, i.iface FROM t JOIN i USING (method) JOIN n USING (iface) GROUP BY t.type, i.iface, need HAVING count(*) = need""",
)
def interface_satisfaction(spark, sf_dir):
    """Relational division; suppliers that supply every part of an order."""
    from strandline.operators.resolve import satisfies

    li = b.table(spark, sf_dir, "lineitem")
    types = li.selectExpr("l_suppkey type", "l_partkey method").distinct()
    ifaces = li.selectExpr("l_orderkey iface", "l_partkey method").distinct()
    return satisfies(types, ifaces)


@query("importers_of", f"WITH {b.FILE_EDGES}, {b.FILE_NODES} SELECT fn.id, fn.k FROM fe JOIN fn ON fe.src = fn.id WHERE fe.type = 'imports' AND fe.dst = (SELECT min(dst) FROM fe WHERE type = 'imports')")
def importers_of(spark, sf_dir):
    """J2, SRC27."""
    e = b.file_edges(spark, sf_dir).filter("type = 'imports'")
    target = e.agg(F.min("dst").alias("dst"))
    return e.join(target, "dst").join(b.file_nodes(spark, sf_dir), F.col("src") == F.col("id")).select("id", "k")


@query("path_join_fold", f"WITH {b.FILE_NODES}, sy AS (SELECT 'part/' || p_brand || '/' || p_name || '_' || p_partkey AS path, p_partkey FROM part WHERE p_size < 20) SELECT fn.id, sy.p_partkey AS sym FROM fn JOIN sy ON fn.k = sy.path")
def path_join_fold(spark, sf_dir):
    """Symbols meet file nodes on their path."""
    syms = b.table(spark, sf_dir, "part").filter("p_size < 20").selectExpr("concat('part/', p_brand, '/', p_name, '_', p_partkey) path", "p_partkey sym")
    return syms.join(b.file_nodes(spark, sf_dir), F.col("k") == F.col("path")).select("id", "sym")


PAIRED = f"{b.SNAPSHOTS}, pr AS (SELECT path, name, max(sig_hash) FILTER (l_linestatus = 'O') AS old_h, max(sig_hash) FILTER (l_linestatus = 'F') AS new_h FROM sn GROUP BY path, name)"


@query("stale_nodes", f"WITH {PAIRED} SELECT path || '/' || name AS id, CASE WHEN new_h IS NULL THEN 'dead' WHEN new_h <> old_h THEN 'stale' ELSE 'ok' END AS st FROM pr WHERE old_h IS NOT NULL")
def stale_nodes(spark, sf_dir):
    """Verify against current hashes."""
    old, new = b.snapshots(spark, sf_dir)
    key = F.concat_ws("/", "path", "name")
    return graph.verify(old.select(key.alias("id"), key.alias("k"), F.col("sig_hash").alias("h")), new.select(key.alias("k"), F.col("sig_hash").alias("h")))


@query(
    "two_phase_dead",
    f"""WITH {PAIRED}, p AS (SELECT *, name LIKE '%3' AS was_dead, name LIKE '%5' AND old_h <> new_h AS pinned FROM pr)
    SELECT path || '/' || name AS id, CASE WHEN new_h IS NULL THEN 'dead' WHEN pinned THEN 'stale' ELSE 'ok' END AS st,
           CASE WHEN new_h IS NULL OR pinned THEN old_h ELSE new_h END AS h
    FROM p WHERE NOT (new_h IS NULL AND was_dead)""",
)
def two_phase_dead(spark, sf_dir):
    """G19, ST2, ST3: vanished nodes die, dead ones that stay away go, agents' changed nodes are stale."""
    old, new = b.snapshots(spark, sf_dir)
    key = F.concat_ws("/", "path", "name").alias("id")
    o = old.select(key, F.col("sig_hash").alias("h"), F.when(F.col("name").endswith("3"), "dead").otherwise("ok").alias("st"), F.when(F.col("name").endswith("5"), "agent").otherwise("scan").alias("by"))
    return graph.reconcile(o, new.select(key, F.col("sig_hash").alias("h")))
