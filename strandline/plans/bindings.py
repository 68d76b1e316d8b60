"""The driver's tables read as graphs: loaders, and the same relations as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.storage import exchanged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return exchanged(spark.read.parquet(path), path)


def part_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> part imports: parts of consecutive lines of an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return li.join(nxt, ["l_orderkey", "l_linenumber"]).filter("l_partkey != dst").select(F.col("l_partkey").alias("src"), "dst").distinct()


PART_CHAIN = """
pc AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a
       JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
       WHERE a.l_partkey <> b.l_partkey)
"""


def typed_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_chain as symbol edges: call if src < dst else import, exact unless src + dst is divisible by 3."""
    return part_chain(spark, sf_dir).select(
        "src", "dst", F.when(F.col("src") < F.col("dst"), "call").otherwise("import").alias("type"),
        F.when((F.col("src") + F.col("dst")) % 3 == 0, "heuristic").otherwise("exact").alias("confidence"),
    )


TYPED_CHAIN = (
    PART_CHAIN
    + """, tc AS (SELECT src, dst, CASE WHEN src < dst THEN 'call' ELSE 'import' END AS type,
       CASE WHEN (src + dst) % 3 = 0 THEN 'heuristic' ELSE 'exact' END AS confidence FROM pc)
"""
)


def seed(edges: DataFrame) -> DataFrame:
    """The smallest source, as one seed row."""
    return edges.agg(F.min("src").alias("id")).filter("id IS NOT NULL")


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole graph with string ids: supplier and customer -> part imports, part -> supplier tests, part-of.

    Each kind is made distinct by its numbers, before ids are strings; kinds share no
    edge, as each has its own type and letters.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def edge(rows, p, a, q, z, kind):
        return rows.select(a, z).distinct().select(node(p, a).alias("src"), F.lit(kind).alias("type"), node(q, z).alias("dst"))

    parts = [
        edge(li, "s", "l_suppkey", "p", "l_partkey", "imports"),
        edge(li.join(orders, "l_orderkey"), "c", "o_custkey", "p", "l_partkey", "imports"),
        edge(li.filter("l_returnflag = 'R'"), "p", "l_partkey", "s", "l_suppkey", "tested-by"),
        edge(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "part-of"),
        edge(table(spark, sf_dir, "customer"), "c", "c_custkey", "n", "c_nationkey", "part-of"),
        edge(table(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "part-of"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FILE_EDGES = """
fe AS (SELECT DISTINCT * FROM (
  SELECT 's' || l_suppkey AS src, 'imports' AS type, 'p' || l_partkey AS dst FROM lineitem
  UNION ALL SELECT 'c' || o_custkey, 'imports', 'p' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'p' || l_partkey, 'tested-by', 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 's' || s_suppkey, 'part-of', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'part-of', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'part-of', 'r' || n_regionkey FROM nation))
"""


def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, k): regions and nations are modules, suppliers entries, customers and parts files."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("dir"))
    part = table(spark, sf_dir, "part")
    rows = [
        table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) id", "'mod' t", "r_name k"),
        nation.selectExpr("concat('n', n_nationkey) id", "'mod' t", "dir k"),
        table(spark, sf_dir, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr("concat('s', s_suppkey) id", "'entry' t", "concat(dir, '/supplier_', s_suppkey) k"),
        table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr("concat('c', c_custkey) id", "'file' t", "concat(dir, '/customer_', c_custkey) k"),
        part.selectExpr("concat('p', p_partkey) id", "'file' t", "concat('part/', p_brand, '/', p_name, '_', p_partkey) k"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


FILE_NODES = """
nd AS (SELECT n_nationkey, r_name || '/' || n_name AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
fn AS (SELECT 'r' || r_regionkey AS id, 'mod' AS t, r_name AS k FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'mod', dir FROM nd
  UNION ALL SELECT 's' || s_suppkey, 'entry', dir || '/supplier_' || s_suppkey FROM supplier JOIN nd ON s_nationkey = n_nationkey
  UNION ALL SELECT 'c' || c_custkey, 'file', dir || '/customer_' || c_custkey FROM customer JOIN nd ON c_nationkey = n_nationkey
  UNION ALL SELECT 'p' || p_partkey, 'file', 'part/' || p_brand || '/' || p_name || '_' || p_partkey FROM part)
"""


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as indexable nodes: key, brand tag, type as summary, size as weight."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("file").alias("t"),
        F.concat_ws("/", F.lit("part"), "p_brand", F.concat_ws("_", "p_name", F.col("p_partkey").cast("string"))).alias("k"),
        F.col("p_type").alias("s"), F.array("p_brand").alias("g"), F.lit(None).cast("array<struct<name:string,line:int>>").alias("a"),
        F.when(F.col("p_size") % 10 == 0, "stale").otherwise("ok").alias("st"), (F.col("p_size") % 5 + 1).cast("int").alias("w"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new): (path, name, sig_hash); paths are suppliers, names parts, old of open and new of filled lines."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus", "l_extendedprice", "l_quantity")
    both = li.groupBy("l_linestatus", F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("path"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name")).agg(
        F.min((F.col("l_quantity") % 3).cast("int")).alias("q")
    )
    sig = both.select("l_linestatus", "path", "name", F.substring(F.sha2(F.col("q").cast("string"), 256), 1, 16).alias("sig_hash"))
    return sig.filter("l_linestatus = 'O'").drop("l_linestatus"), sig.filter("l_linestatus = 'F'").drop("l_linestatus")


SNAPSHOTS = """
sn AS (SELECT l_linestatus, 's' || (l_suppkey % 20) AS path, 'p' || l_partkey AS name,
       substr(sha256(CAST(min(CAST(l_quantity % 3 AS INTEGER)) AS VARCHAR)), 1, 16) AS sig_hash
       FROM lineitem GROUP BY l_linestatus, l_suppkey % 20, l_partkey),
old_s AS (SELECT path, name, sig_hash FROM sn WHERE l_linestatus = 'O'),
new_s AS (SELECT path, name, sig_hash FROM sn WHERE l_linestatus = 'F')
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only ledger: (key, seq, op, text); an error event deletes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "del").otherwise("set").alias("op"), F.col("event_type").alias("text")
    )


LEDGER = """
lg AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op, event_type AS text FROM events)
"""


def issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(issues(number, state, assigned), blocks(number, blocker)): a customer's earlier order blocks the next one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.withColumn("blocker", F.lag("o_orderkey").over(before))
    states = rows.select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.col("o_orderpriority").startswith("1").alias("assigned"))
    return states, rows.filter("blocker IS NOT NULL").select(F.col("o_orderkey").alias("number"), "blocker")


ISSUES = """
iss AS (SELECT o_orderkey AS number, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
        starts_with(o_orderpriority, '1') AS assigned, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS blocker FROM orders)
"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as file paths: host and path without scheme and query."""
    return table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path")).distinct()


PAGE_FILES = """
pf AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
"""
