"""Folding the symbol graph into the file graph, concept links and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import issue_numbers
from strandline.operators.graph import unique_only

ANCHOR_CAP = 40
EDGE_MAP = {"call": "calls", "extends": "implements", "implements": "implements"}


def symbol_degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edge rows at either end, containment left out."""
    own = edges.filter("type != 'contains'")
    return own.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def folded_nodes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, t, file, w): connected symbols of known files; w = min(6, 1 + degree / 3).

    symbols: id, file, degree; files: id.
    """
    known = files.select(F.col("id").alias("file"))
    return symbols.join(known, "file").select("id", F.lit("sym").alias("t"), "file", F.least(F.lit(6), 1 + F.floor(F.col("degree") / 3.0)).cast("long").alias("w"))


def merge_anchors(files: DataFrame, folded: DataFrame) -> DataFrame:
    """files with the anchors of unconnected symbols merged in, by line, the first forty.

    files: id, a; folded: file, name, line. No more than forty of a file are gathered.
    """
    few = folded.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("line", "name"))).filter(F.col("r") <= ANCHOR_CAP)
    extra = few.groupBy(F.col("file").alias("id")).agg(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), "name")).alias("more"))
    have = F.transform(F.coalesce("a", F.array().cast("array<struct<name:string,line:int>>")), lambda x: F.struct(x["line"].alias("line"), x["name"].alias("name")))
    merged = F.slice(F.array_sort(F.concat(have, F.coalesce("more", F.array().cast("array<struct<line:int,name:string>>")))), 1, ANCHOR_CAP)
    return files.join(extra, "id", "left").withColumn("a", F.transform(merged, lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line")))).drop("more")


def fold(file_nodes: DataFrame, file_edges: DataFrame, sym_nodes: DataFrame, sym_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts by origin): both graphs as one.

    Symbols meet live files and entries on their path. Those with a degree become
    sym nodes with a part-of edge, the others anchors of their file. Calls map to
    calls, inheritance to implements; tests turn round to tested-by between
    modules; missing imports between files are added.
    """
    live = file_nodes.filter(F.col("t").isin("file", "entry") & (F.coalesce("st", F.lit("ok")) != "dead")).select(F.col("id").alias("file"), F.col("k").alias("path"))
    placed = sym_nodes.join(live, "path").join(symbol_degree(sym_edges), "id", "left").fillna(0, ["degree"])
    inner = placed.filter("kind != 'module'")
    connected = inner.filter("degree > 0")
    new = connected.select(
        "id", F.lit("sym").alias("t"), F.concat_ws("#", "path", "name").alias("k"), F.coalesce("summary", "sig").alias("s"),
        F.least(F.lit(6), 1 + F.floor(F.col("degree") / 3)).cast("int").alias("w"), F.lit("scan").alias("by"), F.lit("ok").alias("st"),
    ).join(file_nodes.select("id"), "id", "left_anti").join(file_nodes.select("k"), "k", "left_anti")
    anchors = inner.filter("degree = 0").select("file", "name", F.col("span.sl").alias("line"))
    nodes = merge_anchors(file_nodes, anchors).unionByName(new, allowMissingColumns=True)
    owner = placed.select(F.col("id").alias("sid"), "file", (F.col("kind") == "module").alias("is_module"))
    ends = sym_edges.join(owner.select(F.col("sid").alias("src"), F.col("file").alias("sf"), F.col("is_module").alias("sm")), "src").join(
        owner.select(F.col("sid").alias("dst"), F.col("file").alias("df"), F.col("is_module").alias("dm")), "dst"
    )
    at = lambda s, f, m: F.when(F.col(m), F.col(f)).otherwise(F.col(s))
    mapped = None
    for kind, to in EDGE_MAP.items():
        part = ends.filter(F.col("type") == kind).select(at("src", "sf", "sm").alias("src"), F.lit(to).alias("type"), at("dst", "df", "dm").alias("dst"))
        mapped = part if mapped is None else mapped.unionByName(part)
    mapped = (
        mapped.unionByName(ends.filter("type = 'tests'").select(F.col("df").alias("src"), F.lit("tested-by").alias("type"), F.col("sf").alias("dst")))
        .unionByName(ends.filter("type = 'import'").select(F.col("sf").alias("src"), F.lit("imports").alias("type"), F.col("df").alias("dst")))
        .unionByName(connected.select(F.col("id").alias("src"), F.lit("part-of").alias("type"), F.col("file").alias("dst")))
        .filter("src != dst")
    )
    edges = file_edges.unionByName(mapped, allowMissingColumns=True).dropDuplicates(["src", "type", "dst"])
    sides = placed.select("file").distinct().withColumn("s", F.lit(True)).join(live.select("file", F.lit(True).alias("f")), "file", "full")
    origin = F.when(F.col("s") & F.col("f"), "both").when(F.col("f"), "files").otherwise("symbols")
    return nodes, edges, sides.groupBy(origin.alias("origin")).agg(F.count("*").alias("n"))


def link_concepts(concepts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, type, dst) mentions from concept texts: #N, file names, identifiers of five characters or more.

    concepts: id, s; nodes: id, t, k. A name that two nodes bear links nowhere.
    """
    mine = concepts.select(F.col("id").alias("src"), F.coalesce("s", F.lit("")).alias("s"))
    num = mine.select("src", F.explode(issue_numbers("s")).alias("n")).join(nodes.filter("t = 'issue'").select(F.col("id").alias("dst"), F.col("k").cast("int").alias("n")), "n")
    base = lambda c: F.element_at(F.split(c, "[/#]"), -1)
    names = unique_only(nodes.filter(F.col("t").isin("file", "entry", "sym")).select(F.col("id").alias("dst"), base(F.col("k")).alias("name")), "name")
    files = F.regexp_extract_all("s", F.lit(r"(\w[\w-]*[.]\w{1,5})"), 1)
    idents = F.filter(F.regexp_extract_all("s", F.lit(r"([A-Za-z_][A-Za-z0-9_]{4,})"), 1), lambda x: x.rlike("[a-z][A-Z]|_"))
    words = mine.select("src", F.explode(F.array_distinct(F.concat(files, idents))).alias("name")).join(names, "name")
    return num.select("src", F.lit("mentions").alias("type"), "dst").unionByName(words.select("src", F.lit("mentions").alias("type"), "dst")).filter("src != dst").distinct()


def attach_notes(notes: DataFrame, nodes: DataFrame, orphans: DataFrame) -> DataFrame:
    """(id, text, stale): the latest note of each path#name on its node; stale where its key is an orphan.

    notes: key, path, name, text (already the last of each key); orphans: key.
    """
    placed = notes.withColumn("k", F.concat_ws("#", "path", "name")).join(nodes.select("id", "k"), "k")
    return placed.join(orphans.select("key").distinct().withColumn("lost", F.lit(True)), "key", "left").select("id", "text", F.coalesce("lost", F.lit(False)).alias("stale"))
