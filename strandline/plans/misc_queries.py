"""Predicates, candidates, notes and overlays over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import paths as P
from strandline.functions import text as T
from strandline.operators import fold, graph, notes, resolve, view
from strandline.plans import bindings as b
from strandline.plans.registry import query
from strandline.sources import files, git

EXT = "['ts', 'test.ts', 'py', 'go', 'md', 'min.js', 'png', 'zig'][1 + CAST(p_partkey % 8 AS BIGINT)]"
TREE = f"tr AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 11 = 0 THEN 'node_modules/' WHEN p_partkey % 13 = 0 THEN '.hid/' ELSE '' END || 'src/' || replace(p_brand, '#', '') || '/f' || p_partkey || '.' || {EXT} AS path FROM part)"


def _tree(spark, sf_dir):
    """Parts as paths of a source tree, with ignored directories and several extensions."""
    ext = F.element_at(F.array(*map(F.lit, ("ts", "test.ts", "py", "go", "md", "min.js", "png", "zig"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    top = F.when(F.col("p_partkey") % 11 == 0, "node_modules/").when(F.col("p_partkey") % 13 == 0, ".hid/").otherwise("")
    path = F.concat(top, F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), path.alias("path"))


@query(
    "file_classes",
    f"""WITH {TREE} SELECT path, CASE WHEN path LIKE '%.ts' THEN 'ts' WHEN path LIKE '%.js' THEN 'js' WHEN path LIKE '%.py' THEN 'py' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.md' THEN 'md' ELSE 'text' END AS lang,
    path LIKE '%.test.ts' AS is_test, CASE WHEN path LIKE '%.test.ts' THEN regexp_extract(path, '([^/]*)\\.test\\.ts$', 1) END AS subject FROM tr""",
)
def file_classes(spark, sf_dir):
    """F3, F5, F6."""
    return _tree(spark, sf_dir).select("path", P.file_lang("path").alias("lang"), P.is_test_file("path").alias("is_test"), P.test_subject("path").alias("subject"))


@query("symbol_walk", f"WITH {TREE} SELECT path FROM tr WHERE NOT (path LIKE 'node_modules/%' OR path LIKE '.hid/%' OR path LIKE '%.min.js' OR path LIKE '%.png' OR path LIKE '%.md')")
def symbol_walk(spark, sf_dir):
    """SRC3, F4."""
    return _tree(spark, sf_dir).filter(P.keeps_source("path")).select("path")


@query(
    "drop_reasons",
    f"""WITH {TREE} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN path LIKE 'src/Brand1%' AND starts_with(path, 'src/Brand11/') THEN 'skill' WHEN path LIKE 'node_modules/%' OR path LIKE '%.min.%' THEN 'ignored'
    WHEN n % 17 = 0 THEN 'gone' WHEN n * 400 > 524288 THEN 'big' END AS reason FROM tr) WHERE reason IS NOT NULL GROUP BY reason""",
)
def drop_reasons(spark, sf_dir):
    """SRC1, SRC2: the first reason in order stands."""
    size = F.when(F.col("n") % 17 != 0, F.col("n") * 400)
    reason = P.drop_reason("path", size, F.lit(b""), ["src/Brand11"], list(files.IGNORE_GLOBS))
    return _tree(spark, sf_dir).select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "scan_jobs",
    """WITH w AS (SELECT p_partkey AS k, p_size AS size, p_brand AS lang FROM part WHERE p_partkey % 7 <> 0), p AS (SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS size, p_brand AS lang FROM part WHERE p_partkey % 3 <> 0)
    SELECT 'f' || coalesce(w.k, p.k) AS path, CASE WHEN w.k IS NULL THEN 'vanished' WHEN w.size = p.size AND w.k % 4 <> 0 THEN 'reuse' ELSE 'scan' END AS job FROM w FULL JOIN p ON w.k = p.k""",
)
def scan_jobs(spark, sf_dir):
    """SRC8, ST1."""
    part = b.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("size"), F.lit(0.0).alias("mtime_ms"), F.col("p_brand").alias("lang"))
    walked = part.filter("p_partkey % 7 != 0").drop("p_partkey")
    prior = part.filter("p_partkey % 3 != 0").withColumn("size", F.col("size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).withColumns({"hash": F.lit("h"), "facts_hash": F.when(F.col("p_partkey") % 4 == 0, "g").otherwise("h")})
    return files.scan_jobs(walked, prior)


@query("first_candidate", "SELECT l_suppkey AS src, l_partkey AS spec, CASE WHEN l_partkey % 3 = 0 THEN 'a' || l_partkey WHEN l_partkey % 5 = 0 THEN 'b' || l_partkey END AS path FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_partkey % 3 = 0 OR l_partkey % 5 = 0")
def first_candidate(spark, sf_dir):
    """Of three candidate paths in order, the first that is known."""
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("spec")).distinct()
    n = F.col("p_partkey").cast("string")
    part = b.table(spark, sf_dir, "part")
    known = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("a"), n).alias("path")).unionByName(part.filter("p_partkey % 5 = 0").select(F.concat(F.lit("b"), n).alias("path")))
    s = F.col("spec").cast("string")
    return resolve.first_existing(li.withColumn("paths", F.array(F.concat(F.lit("a"), s), F.concat(F.lit("x"), s), F.concat(F.lit("b"), s))), known, ["src", "spec"])


@query(
    "barrel_lookup",
    """WITH RECURSIVE hop AS (SELECT DISTINCT p_partkey AS path, p_partkey + 3 AS target FROM part WHERE p_partkey % 4 <> 0), lim AS (SELECT max(p_partkey) AS m FROM part),
    w(file, cur, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT file, target, depth + 1 FROM w JOIN hop ON hop.path = w.cur WHERE depth < 5 AND target <= (SELECT m FROM lim))
    SELECT file, min(depth) AS depth, arg_min(cur, depth) AS def_file FROM w WHERE cur % 4 = 0 GROUP BY file""",
)
def barrel_lookup(spark, sf_dir):
    """Names seen through re-exports, five deep; a file divisible by four defines the name."""
    p = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    defs = p.filter("k % 4 = 0").select(F.col("k").alias("path"), F.lit("x").alias("name"), F.col("k").cast("string").alias("id"), F.lit(0).alias("ord"))
    top = p.agg(F.max("k")).first()[0]
    none = F.lit(None).cast("string")
    hops = p.filter("k % 4 != 0").select(F.col("k").alias("path"), F.lit(0).alias("ord"), (F.col("k") + 3).alias("target"), none.alias("exported"), none.alias("origin")).filter(F.col("target") <= top)
    return resolve.lookup(p.select(F.col("k").alias("file"), F.lit("x").alias("name")), defs, hops).filter("id IS NOT NULL").select("file", "depth", "def_file")


@query(
    "ref_counts",
    f"""WITH {b.TYPED_CHAIN}, z AS (SELECT min(src) AS id FROM tc) SELECT side, count(*) AS n, count(*) FILTER (confidence = 'exact') AS exact, count(*) FILTER (confidence <> 'exact') AS heuristic
    FROM (SELECT CASE WHEN dst = (SELECT id FROM z) THEN 'up' WHEN src = (SELECT id FROM z) THEN 'down' END AS side, confidence FROM tc) WHERE side IS NOT NULL GROUP BY side""",
)
def ref_counts(spark, sf_dir):
    """A8."""
    e = b.typed_chain(spark, sf_dir)
    return view.ref_counts(e, e.agg(F.min("src")).first()[0])


@query(
    "enrich_next",
    f"WITH {b.FILE_EDGES}, {b.FILE_NODES} SELECT fn.id, fn.k, count(DISTINCT fe.src) AS n_in FROM fe JOIN fn ON fe.dst = fn.id WHERE fe.type = 'imports' AND fn.t = 'file' GROUP BY fn.id, fn.k ORDER BY n_in DESC, fn.id LIMIT 8",
)
def enrich_next(spark, sf_dir):
    """Most depended-on files without an agent's summary."""
    from strandline.operators.traversal import degrees, flow_edges

    nodes = b.file_nodes(spark, sf_dir)
    return graph.enrich_next(nodes.withColumn("by", F.lit("scan")), degrees(nodes, flow_edges(b.file_edges(spark, sf_dir))))


@query("overlay_default", "SELECT 'c' || c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'untracked' ELSE 'pushed' END AS state FROM customer")
def overlay_default(spark, sf_dir):
    """G41."""
    c = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("k"), "c_custkey")
    state = F.when(F.col("c_custkey") % 4 == 0, "modified").when(F.col("c_custkey") % 4 == 1, "untracked")
    return git.state_of(c, c.select(F.col("k").alias("path"), state.alias("state")).filter("state IS NOT NULL"))


@query(
    "concept_links",
    """WITH n AS (SELECT 'p' || p_partkey AS id, 'part' || (p_partkey - CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) || '.ts' AS name FROM part), u AS (SELECT name, min(id) AS id FROM n GROUP BY name HAVING count(*) = 1)
    SELECT DISTINCT 'c' || s_suppkey AS src, 'mentions' AS type, id AS dst FROM supplier JOIN u ON name = 'part' || s_suppkey || '.ts'""",
)
def concept_links(spark, sf_dir):
    """A file name links only where one node bears it; every third shares its neighbour's."""
    nodes = b.table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) id", "'file' t", "concat('src/part', p_partkey - if(p_partkey % 3 = 0, 1, 0), '.ts') k")
    concepts = b.table(spark, sf_dir, "supplier").selectExpr("concat('c', s_suppkey) id", "concat('see part', s_suppkey, '.ts for more') s")
    return fold.link_concepts(concepts, nodes)


@query(
    "attached_notes",
    """SELECT 'p' || p_partkey AS id, 'n' || (p_partkey + 1) AS text, p_partkey % 3 = 0 AS stale FROM part WHERE p_partkey % 2 = 0""",
)
def attached_notes(spark, sf_dir):
    """Notes on path#name, stale where the key is an orphan."""
    p = b.table(spark, sf_dir, "part")
    nodes = p.selectExpr("concat('p', p_partkey) id", "concat('f', p_partkey, '#g') k")
    own = p.filter("p_partkey % 2 = 0").selectExpr("concat('k', p_partkey) key", "concat('f', p_partkey) path", "'g' name", "concat('n', p_partkey + 1) text")
    return fold.attach_notes(own, nodes, p.filter("p_partkey % 3 = 0").selectExpr("concat('k', p_partkey) key"))


@query(
    "collapsed_modules",
    """WITH m AS (SELECT 'r' AS id, NULL AS parent, 1 AS n_files UNION ALL SELECT 'n' || n_nationkey, 'r', n_nationkey % 2 FROM nation UNION ALL SELECT 'x' || n_nationkey, 'n' || n_nationkey, 1 FROM nation)
    SELECT id, CASE WHEN id LIKE 'x%' AND CAST(substr(id, 2) AS INTEGER) % 2 = 0 THEN 'r' ELSE parent END AS parent FROM m WHERE NOT (id LIKE 'n%' AND n_files = 0)""",
)
def collapsed_modules(spark, sf_dir):
    """Pass-through modules go, their children move up."""
    n = b.table(spark, sf_dir, "nation")
    m = n.selectExpr("concat('n', n_nationkey) id", "'r' parent", "n_nationkey % 2 n_files").unionByName(n.selectExpr("concat('x', n_nationkey) id", "concat('n', n_nationkey) parent", "1 n_files"))
    root = spark.range(1).selectExpr("'r' id", "cast(null as string) parent", "1 n_files")
    return graph.collapse_pass_through(root.unionByName(m)).select("id", "parent")


@query("issue_references", "SELECT number, CAST(u AS INTEGER) AS ref, 'closes' AS kind FROM (SELECT o_orderkey AS number, o_custkey AS u FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT o_orderkey, CAST(o_custkey AS INTEGER), 'mentions' FROM orders WHERE o_orderkey % 2 = 1")
def issue_references(spark, sf_dir):
    """X27, SRC21: closing key words against bare numbers."""
    o = b.table(spark, sf_dir, "orders")
    said = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Fixes #").otherwise("see #"), F.col("o_custkey").cast("string"))
    both = o.select(F.col("o_orderkey").alias("number"), T.closing_numbers(said).alias("c"), T.issue_numbers(said).alias("m"))
    closes = both.select("number", F.explode("c").alias("ref"), F.lit("closes").alias("kind"))
    return closes.unionByName(both.select("number", F.explode(F.array_except("m", "c")).alias("ref"), F.lit("mentions").alias("kind")))


@query(
    "network_refs",
    """WITH t AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '<a href="' || url || '">' WHEN 1 THEN 'new WebSocket(u)' WHEN 2 THEN 'fetch (u)' WHEN 3 THEN '<img src="//' || url || '">' WHEN 4 THEN '@importance prefetch(u)' ELSE '' END || html AS content FROM pages)
    SELECT CAST(page_id AS VARCHAR) AS path FROM t WHERE regexp_matches(content, '(?i)\\bhttps?://|\\bsrc\\s*=\\s*["'']//|\\bfetch\\s*\\(|\\bXMLHttpRequest\\b|\\bWebSocket\\b|\\bEventSource\\b|\\bsendBeacon\\b|@import\\b|\\burl\\(\\s*["'']?//|\\bimportScripts\\b')""",
)
def network_refs(spark, sf_dir):
    """pages whose markup reaches out, after a line of a kind that follows from the page's number."""
    made = F.expr("""CASE page_id % 6 WHEN 0 THEN concat('<a href="', url, '">') WHEN 1 THEN 'new WebSocket(u)' WHEN 2 THEN 'fetch (u)'
        WHEN 3 THEN concat('<img src="//', url, '">') WHEN 4 THEN '@importance prefetch(u)' ELSE '' END""")
    t = b.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.concat(made, F.col("html")).alias("content"))
    return view.network_refs(t).select("path").distinct()


@query("edge_note_status", "SELECT user_id AS note, CASE WHEN bool_or(event_type = 'error') THEN 'ambiguous' WHEN bool_or(event_type = 'purchase') THEN 'orphan' WHEN bool_or(event_type = 'click') THEN 'rebind' ELSE 'bound' END AS status FROM events GROUP BY user_id")
def edge_note_status(spark, sf_dir):
    """An edge note is as sound as its worse end."""
    e = b.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "ambiguous").when(F.col("event_type") == "purchase", "orphan").when(F.col("event_type") == "click", "rebind").otherwise("bound")
    ends = e.select(F.col("user_id").alias("note"), status.alias("status"))
    return notes.rebind_edges(ends.select("note").distinct(), ends)
