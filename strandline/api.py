"""Commands as functions over DataFrames: files.* for the file graph, symbols.* for the symbol graph, and the front end."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.paths import file_lang
from strandline.functions.text import canonicalize
from strandline.operators import filegraph, fold, graph, notes, resolve, search, traversal, view
from strandline.sources import analyze, extract, files, git, project


def scan_files(spark: SparkSession, root: str, globs: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, drop counts) of the tree below a root, with its own package, path and module metadata."""
    kept, dropped = files.scan_listing(files.tree_listing(spark, root), globs)
    text = kept.select("path", file_lang("path").alias("lang"), canonicalize(F.decode("content", "UTF-8")).alias("content"))
    meta = {r["path"]: r["content"] for r in text.filter(F.col("path").rlike(r"(^|/)(package\.json|tsconfig[^/]*\.json|go\.mod)$")).select("path", "content").collect()}  # manifests only
    folder = lambda p: p.rpartition("/")[0]
    manifests = {folder(p): t for p, t in meta.items() if p.endswith("package.json")}
    entries = sorted({e for d, t in manifests.items() for e in project.package_entries(d, t)})
    rules = project.ts_path_rules({p: t for p, t in meta.items() if "tsconfig" in p})
    go = next((project.go_module(t) for p, t in sorted(meta.items()) if p.endswith("go.mod")), None)
    nodes, edges = filegraph.build_file_graph(analyze.analyze_files(text), entries, go, rules or None, project.workspace_packages(manifests) or None)
    return nodes, edges, dropped


def scan_symbols(spark: SparkSession, root: str, ignored: list[str] | None = None, go_module: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counters) of the symbol graph of the tree below a root."""
    return resolve.build_symbol_graph(extract.extract(files.source_files(files.listing(spark, root), ignored)), go_module)


def impact(sym_nodes: DataFrame, sym_edges: DataFrame, file_nodes: DataFrame, file_edges: DataFrame, name: str, depth: int = 32) -> DataFrame:
    """(via, path, hop, confidence): the symbol graph's impact of a name, and importers that only the file graph knows.

    A name that no symbol bears is looked up as a file, whose importers answer.
    """
    try:
        target = search.resolve_target(sym_nodes, name)
    except LookupError:
        seeds = file_nodes.filter(F.col("k") == name).select("id")
        if seeds.isEmpty():
            raise
        hit = traversal.importers_by_hop(file_edges, seeds, depth).join(file_nodes.select("id", "k"), "id")
        return hit.select(F.lit("file").alias("via"), F.col("k").alias("path"), "hop", F.lit(None).cast("string").alias("confidence"))
    path = target.first()["path"]
    found = traversal.impact(sym_edges, target.select("id"), "up", depth).join(sym_nodes.select("id", "path"), "id")
    own = found.groupBy("path").agg(F.min("hop").alias("hop"), F.max(traversal.confidence_rank("confidence")).alias("r"))
    out = own.select(F.lit("symbol").alias("via"), "path", "hop", F.when(F.col("r") == 2, "exact").otherwise("heuristic").alias("confidence"))
    me = file_nodes.filter(F.col("k") == path).select(F.col("id").alias("dst"))
    importers = file_edges.filter("type = 'imports'").join(me, "dst").join(file_nodes.select(F.col("id").alias("src"), F.col("k").alias("path")), "src").select("path")
    missed = traversal.cross_check(importers, own, path)
    return out.unionByName(missed.select(F.lit("file").alias("via"), "path", F.lit(1).alias("hop"), F.lit(None).cast("string").alias("confidence")))


def context(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 32) -> DataFrame:
    """(section, key, n): direct and transitive counts up and down by module, tests, documents, issues, concepts, siblings."""
    spark = nodes.sparkSession
    me = spark.createDataFrame([(node,)], "id string")
    flow = traversal.flow_edges(edges)
    home = edges.filter("type = 'part-of'").select(F.col("src").alias("id"), F.col("dst").alias("module"))
    out = None
    for side in ("up", "down"):
        hit = traversal.reachable(flow, me, side, depth)
        both = hit.agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count("*").alias("transitive"))
        rows = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in ("direct", "transitive")])).alias("x")).select(F.lit(side).alias("section"), "x.key", "x.n")
        by_module = hit.join(home, "id").groupBy("module").agg(F.count("*").alias("n")).select(F.lit(side + " by module").alias("section"), F.col("module").alias("key"), "n")
        rows = rows.unionByName(by_module)
        out = rows if out is None else out.unionByName(rows)
    links = {"tests": ("tested-by", "src", "dst"), "documents": ("documents", "dst", "src"), "issues": ("closes", "src", "dst"), "concepts": ("mentions", "dst", "src")}
    for section, (kind, mine, other) in links.items():
        rows = edges.filter((F.col("type") == kind) & (F.col(mine) == node)).groupBy(F.col(other).alias("key")).agg(F.count("*").alias("n"))
        out = out.unionByName(rows.select(F.lit(section).alias("section"), "key", "n"))
    mates = home.join(home.filter(F.col("id") == node).select("module"), "module", "left_semi").filter(F.col("id") != node)
    return out.unionByName(mates.select(F.lit("siblings").alias("section"), F.col("id").alias("key"), F.lit(1).cast("long").alias("n")))


def resolve_node(nodes: DataFrame, ref: str) -> str:
    """Id of a reference: an exact id, else an exact key, else a unique key suffix; raises otherwise."""
    for hit in (nodes.filter(F.col("id") == ref), nodes.filter(F.col("k") == ref), nodes.filter(F.col("k").endswith("/" + ref))):
        rows = hit.select("id").distinct().limit(2).collect()
        if len(rows) == 1:
            return rows[0]["id"]
        if rows:
            raise LookupError(f"{ref} is ambiguous")
    raise LookupError(f"no node {ref}")


files_api = SimpleNamespace(
    scan=scan_files, index=search.build_index, query=search.query_report, search=search.search, context=context, neighbors=traversal.neighbors, path=traversal.shortest_path,
    expand=filegraph.expand, verify=graph.verify, prune=graph.prune, stats=graph.overview, enrich_next=graph.enrich_next, note=filegraph.agent_writes,
    git_overlay=git.overlay, issues=notes.issue_edges, frontier=notes.issue_frontier, graph_html=view.html_page, resolve=resolve_node, save=files.save_graph, load=files.load_graph,
)
symbols_api = SimpleNamespace(
    scan=scan_symbols, build=resolve.build_symbol_graph, locate=search.locate, impact=traversal.impact, slice=view.slice_of, brief=view.brief, check=notes.check,
    note=notes.append, stats=graph.symbol_stats, view=view.bounded_view, runners=project.marker_runners,
)
front = SimpleNamespace(impact=impact, view=fold.fold, map=graph.overview, status=graph.overview, cross_check=traversal.cross_check)
