"""Traversal, impact and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import notes, traversal
from strandline.plans import bindings as b
from strandline.plans.registry import query


def _walk(edges: str, seed: str = "SELECT min(src) FROM pc", most: int = 64) -> str:
    """Levels from the seed along (a, b) pairs: a recursion with set semantics over (id, hop)."""
    return f"""
WITH RECURSIVE {b.TYPED_CHAIN}, st AS ({edges}),
bf(id, hop) AS (SELECT ({seed}), 0 UNION SELECT st.b, bf.hop + 1 FROM bf JOIN st ON st.a = bf.id WHERE bf.hop < {most})
"""


DOWN, UP = "SELECT src AS a, dst AS b FROM pc", "SELECT dst AS a, src AS b FROM pc"
BOTH = f"{DOWN} UNION {UP}"
ROOTS = f"""
WITH RECURSIVE {b.PART_CHAIN}, ids AS (SELECT src AS id FROM pc UNION SELECT dst FROM pc),
bf(id, hop) AS (SELECT id, 0 FROM ids WHERE id NOT IN (SELECT dst FROM pc) OR id % 70 = 0
  UNION SELECT dst, hop + 1 FROM bf JOIN pc ON src = id WHERE hop < 64)
"""


def _chain_nodes(edges):
    """Endpoints of the chain; keys divisible by 70 are entries."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.withColumn("t", F.when(F.col("id") % 70 == 0, "entry").otherwise("file"))


@query("flow_roots", f"WITH {b.PART_CHAIN}, ids AS (SELECT src AS id FROM pc UNION SELECT dst FROM pc) SELECT id FROM ids WHERE id NOT IN (SELECT dst FROM pc) OR id % 70 = 0")
def flow_roots(spark, sf_dir):
    """G1."""
    e = b.part_chain(spark, sf_dir)
    return traversal.flow_roots(_chain_nodes(e), e)


@query("flow_depth", ROOTS + "SELECT ids.id, min(hop) AS depth FROM ids LEFT JOIN bf USING (id) GROUP BY ids.id")
def flow_depth(spark, sf_dir):
    """G2."""
    e = b.part_chain(spark, sf_dir)
    return traversal.flow_depth(_chain_nodes(e), e, traversal.UNTIL_EMPTY)


@query("reach_down", _walk(DOWN) + "SELECT id, min(hop) AS hop FROM bf GROUP BY id HAVING min(hop) > 0")
def reach_down(spark, sf_dir):
    """G3."""
    e = b.part_chain(spark, sf_dir)
    return traversal.reachable(e, b.seed(e), "down", traversal.UNTIL_EMPTY)


@query("reach_up", _walk(UP, "SELECT max(dst) FROM pc") + "SELECT id, min(hop) AS hop FROM bf GROUP BY id HAVING min(hop) > 0")
def reach_up(spark, sf_dir):
    """G3."""
    e = b.part_chain(spark, sf_dir)
    return traversal.reachable(e, e.agg(F.max("dst").alias("id")).filter("id IS NOT NULL"), "up", traversal.UNTIL_EMPTY)


@query(
    "neighbors_d2",
    f"""WITH {b.TYPED_CHAIN}, s AS (SELECT dst AS id, src AS via, type, 'out' AS dir, 0 AS ord FROM tc UNION ALL SELECT src, dst, type, 'in', 1 FROM tc),
    z AS (SELECT min(src) AS id FROM tc),
    l1 AS (SELECT s.id, arg_min({{'via': via, 'type': type, 'dir': dir}}, (ord, via, type, dir)) AS m FROM s JOIN z ON s.via = z.id WHERE s.id NOT IN (SELECT id FROM z) GROUP BY s.id),
    l2 AS (SELECT s.id, arg_min({{'via': via, 'type': type, 'dir': dir}}, (ord, via, type, dir)) AS m FROM s JOIN l1 ON s.via = l1.id WHERE s.id NOT IN (SELECT id FROM l1) AND s.id NOT IN (SELECT id FROM z) GROUP BY s.id)
    SELECT id, 1 AS hop, m.via AS via, m.type AS type, m.dir AS dir FROM l1 UNION ALL SELECT id, 2, m.via, m.type, m.dir FROM l2""",
)
def neighbors_d2(spark, sf_dir):
    """G4."""
    e = b.typed_chain(spark, sf_dir)
    return traversal.neighbors(e, b.seed(e), 2, "both")


@query("shortest_path_len", _walk(BOTH, most=12) + "SELECT (SELECT max(dst) FROM pc) AS goal, min(hop) AS n_edges FROM bf WHERE id = (SELECT max(dst) FROM pc) HAVING min(hop) IS NOT NULL")
def shortest_path_len(spark, sf_dir):
    """The length of a shortest path between the smallest source and the largest target."""
    e = b.part_chain(spark, sf_dir)
    start, goal = e.agg(F.min("src"), F.max("dst")).first()
    p = traversal.shortest_path(e, start, goal)
    return p.groupBy().agg(F.max("step").alias("n_edges")).filter("n_edges IS NOT NULL").select(F.lit(goal).cast("long").alias("goal"), "n_edges")


@query(
    "explanatory_chain",
    """WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS p FROM orders),
    e AS (SELECT src, dst FROM (SELECT lead(id) OVER (PARTITION BY c ORDER BY id) AS src, id AS dst FROM o UNION SELECT lead(id) OVER (PARTITION BY c, p ORDER BY id), id FROM o) WHERE src IS NOT NULL),
    w(path) AS (SELECT [min(id)] FROM o WHERE c = (SELECT c FROM o GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) UNION ALL SELECT list_prepend(e.src, path) FROM w JOIN e ON e.dst = path[1] WHERE len(path) < 12 AND NOT list_contains(path, e.src)),
    s AS (SELECT path, CAST(len(path) + CASE WHEN path[1] % 7 = 0 THEN 1000 ELSE 0 END AS INTEGER) AS score FROM w ORDER BY score DESC, path LIMIT 1)
    SELECT score, CAST(i AS INTEGER) AS step, path[i + 1] AS id FROM s, range(0, len(path)) r(i)""",
)
def explanatory_chain(spark, sf_dir):
    """The best chain of callers of the first order of the busiest customer; an order calls its customer's last one, and the last of its priority."""
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    calls = lambda *by: o.select(F.lead("o_orderkey").over(Window.partitionBy(*by).orderBy("o_orderkey")).alias("src"), F.col("o_orderkey").alias("dst"))
    e = calls("o_custkey").unionByName(calls("o_custkey", "o_orderpriority")).filter("src IS NOT NULL").distinct()
    target = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("id")).orderBy(F.desc("n"), "o_custkey").first()["id"]
    best = traversal.longest_up_path(e, target, o.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id")))
    return best.select("score", F.posexplode("path").alias("step", "id"))


EXACT = "SELECT src AS a, dst AS b FROM tc WHERE confidence = 'exact'"


def _impact(pairs: str, exact: str, seed: str, most: int) -> str:
    return f"""
WITH RECURSIVE {b.TYPED_CHAIN}, st AS ({pairs}), sx AS ({exact}),
bf(id, hop) AS (SELECT ({seed}), 0 UNION SELECT st.b, hop + 1 FROM bf JOIN st ON st.a = bf.id WHERE hop < {most}),
bx(id, hop) AS (SELECT ({seed}), 0 UNION SELECT sx.b, hop + 1 FROM bx JOIN sx ON sx.a = bx.id WHERE hop < {most})
SELECT id, min(hop) AS hop, CASE WHEN id IN (SELECT id FROM bx) THEN 'exact' ELSE 'heuristic' END AS confidence FROM bf GROUP BY id HAVING min(hop) > 0
"""


@query("impact_down", _impact("SELECT src AS a, dst AS b FROM tc", EXACT, "SELECT min(src) FROM tc", 32))
def impact_down(spark, sf_dir):
    """G8, A12, X28."""
    e = b.typed_chain(spark, sf_dir)
    return traversal.impact(e, b.seed(e), "down")


@query("impact_both", _impact("SELECT src AS a, dst AS b FROM tc UNION SELECT dst, src FROM tc", EXACT + " UNION SELECT dst, src FROM tc WHERE confidence = 'exact'", "SELECT min(src) FROM tc", 32))
def impact_both(spark, sf_dir):
    """G8, undirected at every step."""
    e = b.typed_chain(spark, sf_dir)
    return traversal.impact(e, b.seed(e), "both")


@query(
    "impact_up_tests",
    f"""WITH RECURSIVE {b.TYPED_CHAIN}, bf(id, hop) AS (SELECT (SELECT max(dst) FROM tc), 0 UNION SELECT src, hop + 1 FROM bf JOIN tc ON dst = id WHERE hop < 32)
    SELECT 's' || l_suppkey AS path, CASE WHEN bool_or(l_linestatus = 'F') THEN 'exact' ELSE 'heuristic' END AS confidence
    FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT id FROM bf) GROUP BY l_suppkey""",
)
def impact_up_tests(spark, sf_dir):
    """Tests of the affected, the strongest edge of each."""
    e = b.typed_chain(spark, sf_dir)
    seeds = e.agg(F.max("dst").alias("id"))
    hit = traversal.reachable(e, seeds, "up", 32).select("id").unionByName(seeds)
    li = b.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    tests = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_partkey").alias("dst"), F.lit("tests").alias("type"),
        F.when(F.col("l_linestatus") == "F", "exact").otherwise("heuristic").alias("confidence"),
    )
    return traversal.impacted_tests(tests, hit)


@query("importers_by_hop", f"WITH RECURSIVE {b.TYPED_CHAIN}, bf(id, hop) AS (SELECT (SELECT min(dst) FROM tc WHERE type = 'import'), 0 UNION SELECT src, hop + 1 FROM bf JOIN tc ON dst = id AND type = 'import' WHERE hop < 32) SELECT id, min(hop) AS hop FROM bf GROUP BY id HAVING min(hop) > 0")
def importers_by_hop(spark, sf_dir):
    """G9."""
    e = b.typed_chain(spark, sf_dir).withColumn("type", F.when(F.col("type") == "import", "imports").otherwise("calls"))
    return traversal.importers_by_hop(e, e.filter("type = 'imports'").agg(F.min("dst").alias("id")).filter("id IS NOT NULL"))


@query(
    "cross_check_delta",
    f"""WITH {b.FILE_EDGES}, t AS (SELECT min(dst) AS dst FROM fe WHERE type = 'imports'),
    c AS (SELECT DISTINCT 'c' || o_custkey AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE 'p' || l_partkey = (SELECT dst FROM t) AND l_linestatus = 'O')
    SELECT DISTINCT src AS path FROM fe WHERE type = 'imports' AND dst = (SELECT dst FROM t) AND src NOT IN (SELECT path FROM c)""",
)
def cross_check_delta(spark, sf_dir):
    """Importers that the symbol side does not cover."""
    e = b.file_edges(spark, sf_dir).filter("type = 'imports'")
    target = e.agg(F.min("dst")).first()[0]
    li = b.table(spark, sf_dir, "lineitem").filter(F.concat(F.lit("p"), F.col("l_partkey").cast("string")) == target).filter("l_linestatus = 'O'")
    covered = li.join(b.table(spark, sf_dir, "orders"), F.expr("o_orderkey = l_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"))
    return traversal.cross_check(e.filter(F.col("dst") == target).select(F.col("src").alias("path")), covered, target)


@query(
    "two_tier_impact",
    f"""WITH RECURSIVE {b.FILE_EDGES}, st AS (SELECT src AS b, dst AS a FROM fe WHERE type = 'imports' AND src LIKE 's%' UNION SELECT dst, src FROM fe WHERE type = 'part-of'),
    bf(id, hop) AS (SELECT (SELECT min(dst) FROM fe WHERE type = 'imports'), 0 UNION SELECT st.b, hop + 1 FROM bf JOIN st ON st.a = bf.id WHERE hop < 32)
    SELECT id, min(hop) AS hop FROM bf GROUP BY id HAVING min(hop) > 0""",
)
def two_tier_impact(spark, sf_dir):
    """Up through imports and from members to what holds them."""
    e = b.file_edges(spark, sf_dir).filter("(type = 'imports' AND src LIKE 's%') OR type = 'part-of'")
    seeds = e.filter("type = 'imports'").agg(F.min("dst").alias("id"))
    return traversal.two_tier_impact(e, seeds)


@query(
    "context_counts",
    f"""WITH RECURSIVE {b.PART_CHAIN}, s AS (SELECT min(src) AS id FROM pc),
    d(id, hop) AS (SELECT id, 0 FROM s UNION SELECT dst, hop + 1 FROM d JOIN pc ON src = id WHERE hop < 64),
    u(id, hop) AS (SELECT id, 0 FROM s UNION SELECT src, hop + 1 FROM u JOIN pc ON dst = id WHERE hop < 64)
    SELECT 'down' AS dir, count(*) FILTER (h = 1) AS direct, count(*) AS transitive FROM (SELECT id, min(hop) AS h FROM d GROUP BY id HAVING min(hop) > 0)
    UNION ALL SELECT 'up', count(*) FILTER (h = 1), count(*) FROM (SELECT id, min(hop) AS h FROM u GROUP BY id HAVING min(hop) > 0)""",
)
def context_counts(spark, sf_dir):
    """Direct and transitive counts on both sides."""
    e = b.part_chain(spark, sf_dir)
    side = lambda d: traversal.reachable(e, b.seed(e), d, traversal.UNTIL_EMPTY).agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count("*").alias("transitive")).select(F.lit(d).alias("dir"), "direct", "transitive")
    return side("down").unionByName(side("up"))


@query("siblings", f"WITH {b.FILE_EDGES} SELECT a.src AS id, b.src AS sibling FROM fe a JOIN fe b ON a.dst = b.dst AND a.src <> b.src WHERE a.type = 'part-of' AND b.type = 'part-of' AND a.src = (SELECT min(src) FROM fe WHERE type = 'part-of')")
def siblings(spark, sf_dir):
    """Members of the same module."""
    e = b.file_edges(spark, sf_dir).filter("type = 'part-of'")
    me = e.join(e.agg(F.min("src").alias("src")), "src").select(F.col("src").alias("id"), "dst")
    return me.join(e.select(F.col("src").alias("sibling"), "dst"), "dst").filter("id != sibling").select("id", "sibling")


@query(
    "topo_layers",
    f"""WITH RECURSIVE {b.FILE_EDGES}, fw AS (SELECT DISTINCT src, dst FROM fe WHERE type IN ('imports', 'part-of')), ids AS (SELECT src AS id FROM fw UNION SELECT dst FROM fw),
    l(id, layer) AS (SELECT id, 0 FROM ids UNION SELECT dst, layer + 1 FROM l JOIN fw ON src = id)
    SELECT id, max(layer) AS layer FROM l GROUP BY id""",
)
def topo_layers(spark, sf_dir):
    """Longest-path layers of imports and containment, which have no cycle here."""
    e = b.file_edges(spark, sf_dir).filter("type IN ('imports', 'part-of')").select("src", "dst").distinct()
    return traversal.mutual_reach_layers(e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())


@query("ledger_latest", f"WITH {b.LEDGER} SELECT key, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM lg) WHERE r = 1 AND op <> 'del'")
def ledger_latest(spark, sf_dir):
    """W7, SRC24."""
    return notes.latest(b.ledger(spark, sf_dir)).select("key", "seq", "text")


@query(
    "ledger_rebind_orphan_ambiguous",
    """WITH live AS (SELECT doc_id AS id, substr(sha256(text), 1, 16) AS key FROM documents WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id AS note, doc_id AS node, CASE WHEN doc_id % 5 = 0 THEN substr(sha256(text || 'x'), 1, 16) ELSE substr(sha256(text), 1, 16) END AS key FROM documents),
    c AS (SELECT key, count(*) AS n, min(id) AS only_id FROM live GROUP BY key),
    j AS (SELECT n.note, n.node, l.key = n.key AS same, c.n, c.only_id FROM n LEFT JOIN live l ON l.id = n.node LEFT JOIN c ON c.key = n.key)
    SELECT note, CASE WHEN coalesce(same, false) THEN 'bound' WHEN n = 1 THEN 'rebind' WHEN n > 1 THEN 'ambiguous' ELSE 'orphan' END AS status,
           CASE WHEN coalesce(same, false) THEN node WHEN n = 1 THEN only_id END AS node FROM j""",
)
def ledger_rebind_orphan_ambiguous(spark, sf_dir):
    """Documents as notes; a third of the nodes are gone, a fifth of the keys changed."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    key = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    live = d.filter("doc_id % 3 != 0").select(F.col("doc_id").alias("id"), key(F.col("text")).alias("key"))
    own = F.when(F.col("doc_id") % 5 == 0, key(F.concat("text", F.lit("x")))).otherwise(key(F.col("text")))
    return notes.rebind(d.select(F.col("doc_id").alias("note"), F.col("doc_id").alias("node"), own.alias("key")), live)


@query("note_counts", "SELECT id, count(*) AS n FROM (SELECT event_id, user_id AS id FROM events UNION SELECT event_id, event_id % 100 FROM events WHERE event_type = 'click') GROUP BY id")
def note_counts(spark, sf_dir):
    """An edge note counts at both ends."""
    e = b.table(spark, sf_dir, "events")
    other = F.when(F.col("event_type") == "click", F.col("event_id") % 100)
    return notes.note_counts(e.select(F.col("user_id").alias("nodeId"), other.alias("fromNodeId"), F.lit(None).cast("long").alias("toNodeId")))


HASHES = f"{b.SNAPSHOTS}, oh AS (SELECT name AS path, string_agg(path || sig_hash, ',' ORDER BY path) AS hash FROM old_s GROUP BY name), nh AS (SELECT name AS path, string_agg(path || sig_hash, ',' ORDER BY path) AS hash FROM new_s GROUP BY name)"


def _hashes(snap):
    return snap.groupBy(F.col("name").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(F.concat("path", "sig_hash"))), ",").alias("hash"))


@query("dirty_classes", f"WITH {HASHES} SELECT coalesce(oh.path, nh.path) AS path, CASE WHEN nh.path IS NULL THEN 'deleted' WHEN oh.path IS NULL THEN 'added' ELSE 'edited' END AS class FROM oh FULL JOIN nh ON oh.path = nh.path WHERE oh.hash IS DISTINCT FROM nh.hash")
def dirty_classes(spark, sf_dir):
    """G14, SRC8."""
    old, new = b.snapshots(spark, sf_dir)
    return notes.dirty_classes(_hashes(old), _hashes(new))


@query("drift_changed", f"WITH {b.SNAPSHOTS} SELECT path, name FROM sn GROUP BY path, name HAVING min(sig_hash) <> max(sig_hash)")
def drift_changed(spark, sf_dir):
    """G11, J19."""
    return notes.drifted(*b.snapshots(spark, sf_dir))


@query("drift_dependents")
def drift_dependents(spark, sf_dir):
    """Dependents of all changed nodes in one walk; brute force in the tests."""
    old, new = b.snapshots(spark, sf_dir)
    changed = notes.drifted(old, new).select(F.substring("name", 2, 20).cast("long").alias("id")).distinct()
    return notes.drift_dependents(b.typed_chain(spark, sf_dir), changed)


REFS = f"""{b.SNAPSHOTS}, gone AS (SELECT o.path, o.name FROM old_s o WHERE NOT EXISTS (SELECT 1 FROM new_s n WHERE n.path = o.path AND n.name = o.name)),
refs AS (SELECT DISTINCT l_orderkey % 100 AS caller, l_suppkey % 20 AS sp, l_partkey FROM lineitem WHERE l_linestatus = 'O'),
nrefs AS (SELECT DISTINCT l_orderkey % 100 AS caller, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
bad AS (SELECT DISTINCT caller, 'p' || l_partkey AS name FROM refs JOIN gone ON gone.path = 's' || sp AND gone.name = 'p' || l_partkey)"""


def _dangling_args(spark, sf_dir):
    """Orders as callers, supplier files as paths, parts as names; old of open lines, new of filled ones."""
    li = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linestatus")
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    path = F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string"))
    who = F.concat(F.lit("o"), (F.col("l_orderkey") % 100).cast("string"))
    out = []
    for status in ("O", "F"):
        own = li.filter(F.col("l_linestatus") == status)
        callees = own.select(F.concat_ws("/", path, name).alias("id"), path.alias("path"), name.alias("name"), F.lit("function").alias("kind"))
        callers = own.select(who.alias("id"), F.concat(F.lit("callers/"), who).alias("path"), who.alias("name"), F.lit("function").alias("kind"))
        out.append((callees.unionByName(callers).distinct(), own.select(who.alias("src"), F.concat_ws("/", path, name).alias("dst"), F.lit("call").alias("type")).distinct()))
    (old, old_e), (new, new_e) = out
    return old_e, old, new, new_e, old.select("path").distinct()


@query("dangling_refs", f"WITH {REFS} SELECT 'o' || caller AS src_name, name FROM bad WHERE (caller, name) NOT IN (SELECT (caller, 'p' || l_partkey) FROM nrefs)")
def dangling_refs(spark, sf_dir):
    """G12, J17."""
    return notes.dangling(*_dangling_args(spark, sf_dir)).select("src_name", "name")


@query("healed_refs", f"WITH {REFS} SELECT 'o' || caller AS src_name, name FROM bad WHERE (caller, name) IN (SELECT (caller, 'p' || l_partkey) FROM nrefs)")
def healed_refs(spark, sf_dir):
    """References that point at a live node of the same name elsewhere."""
    old_e, old, new, new_e, dirty = _dangling_args(spark, sf_dir)
    all_refs = notes.dangling(old_e, old, new, new_e.limit(0), dirty)
    return all_refs.join(notes.dangling(old_e, old, new, new_e, dirty), ["src_name", "name"], "left_anti").select("src_name", "name")


OPEN = "ob AS (SELECT i.number, count(*) AS open_blockers FROM iss i LEFT JOIN iss k ON k.number = i.blocker WHERE i.blocker IS NOT NULL AND coalesce(k.state, 'open') = 'open' GROUP BY i.number)"


@query("issue_frontier", f"WITH {b.ISSUES}, {OPEN} SELECT number FROM iss LEFT JOIN ob USING (number) WHERE state = 'open' AND open_blockers IS NULL AND NOT assigned")
def issue_frontier(spark, sf_dir):
    """G32."""
    return notes.issue_frontier(*b.issues(spark, sf_dir)).filter("frontier").select("number")


@query("open_blockers", f"WITH {b.ISSUES}, {OPEN} SELECT number, coalesce(open_blockers, 0) AS open_blockers FROM iss LEFT JOIN ob USING (number)")
def open_blockers(spark, sf_dir):
    """G32."""
    return notes.issue_frontier(*b.issues(spark, sf_dir)).select("number", "open_blockers")


@query("blocks_edges", f"WITH {b.ISSUES} SELECT 'i' || blocker AS src, 'blocks' AS type, 'i' || number AS dst FROM iss WHERE blocker IS NOT NULL")
def blocks_edges(spark, sf_dir):
    """G32."""
    _, blocks = b.issues(spark, sf_dir)
    rows = blocks.groupBy("number").agg(F.collect_list("blocker").alias("blockedBy")).withColumn("subs", F.array().cast("array<bigint>"))
    return notes.issue_edges(rows)


@query("ttl_window", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 120 MINUTES")
def ttl_window(spark, sf_dir):
    """ST4, SNK10."""
    e = b.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return notes.ttl(e, F.lit(now)).select("event_id", "user_id")
