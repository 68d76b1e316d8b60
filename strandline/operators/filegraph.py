"""Building the file graph: nodes, modules and edges from analyses of files; symbol expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.paths import TS_EXTENSIONS, basename, dirname, is_adr, is_test_file, join_posix, node_type, tags, test_subject
from strandline.functions.text import structural_summary
from strandline.operators.graph import assign_ids, fan_in_weights, infer_modules, nearest_module, unique_only
from strandline.operators.resolve import first_existing, python_candidates, ts_candidates
from strandline.storage import materialize


def resolve_specs(found: DataFrame, go_module: str | None = None, ts_rules: list[tuple] | None = None, packages: list[tuple] | None = None) -> DataFrame:
    """(path, spec, target, is_dir): what each import spec of an analysis means.

    found: path, lang, specs. Candidates in order, by language; TypeScript bare
    specifiers try tsconfig rules of the nearest directory, then workspace
    packages. Java and C# names link by their file name, if only one file has it.
    A Go import means the directory of its package.
    """
    spark = found.sparkSession
    specs = found.select("path", "lang", F.explode("specs").alias("spec"))
    known = found.select("path")
    p, s, rest = F.col("path"), F.col("spec"), F.regexp_replace("spec", r"^\.+", "")
    level = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    python = F.when(level > 0, python_candidates(p, rest, level)).otherwise(
        F.concat(python_candidates(p, s, F.lit(0)), python_candidates(p, s, F.lit(1)))
    )
    module = F.substring_index(s, ":", -1)
    segs = F.filter(F.split(s, "::"), lambda x: ~x.isin("crate", "self", "super"))
    cut = F.transform(F.sequence(F.size(segs), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(segs, 1, n), "/"))
    used = F.flatten(F.transform(cut, lambda x: F.array(F.concat(F.lit("src/"), x, F.lit(".rs")), F.concat(F.lit("src/"), x, F.lit("/mod.rs")), F.concat(x, F.lit(".rs")))))
    beside = F.array(join_posix(dirname(p), F.concat(module, F.lit(".rs"))), join_posix(dirname(p), F.concat(module, F.lit("/mod.rs"))))
    paths = (
        F.when(F.col("lang").isin("ts", "js"), ts_candidates(p, s)).when(F.col("lang") == "py", python)
        .when((F.col("lang") == "rs") & s.startswith("mod:"), beside).when((F.col("lang") == "rs") & (F.size(segs) > 0), used).otherwise(F.array().cast("array<string>"))
    )
    hit = first_existing(specs.select(p.alias("from"), "spec", paths.alias("paths")), known, ["from", "spec"]).select(F.col("from").alias("path"), "spec", F.col("path").alias("target"), F.lit(False).alias("is_dir"))
    bare = specs.filter(F.col("lang").isin("ts", "js") & ~s.startswith("."))
    ext = F.array(*map(F.lit, ("", *TS_EXTENSIONS, *("/index" + e for e in TS_EXTENSIONS))))
    if ts_rules:
        rules = F.broadcast(spark.createDataFrame(ts_rules, "dir string, pre string, suf string, to string, ord int"))  # a project's own rules
        m = bare.join(rules, s.startswith(F.col("pre")) & s.endswith(F.col("suf")) & ((F.col("dir") == "") | p.startswith(F.concat("dir", F.lit("/")))))
        star = F.substr(s, F.length("pre") + 1, F.length(s) - F.length("pre") - F.length("suf"))
        tried = m.select(p.alias("from"), "spec", F.length("dir").alias("near"), "ord", F.transform(ext, lambda e: F.concat(F.replace(F.col("to"), F.lit("*"), star), e)).alias("paths"))
        aimed = first_existing(tried, known, ["from", "spec", "near", "ord"]).groupBy("from", "spec").agg(F.max_by("path", F.struct("near", -F.col("ord"))).alias("target"))
        hit = hit.unionByName(aimed.select(F.col("from").alias("path"), "spec", "target", F.lit(False).alias("is_dir")))
    if packages:
        pk = F.broadcast(spark.createDataFrame(packages, "name string, dir string, sub string, to string"))
        full = F.when(F.col("sub") == ".", F.col("name")).otherwise(F.concat("name", F.substring("sub", 2, 1000)))
        m = bare.join(pk, full == s).select(p.alias("from"), "spec", F.array("to", F.regexp_replace("to", r"(^|/)(dist|build|lib|out)/", "$1src/"), F.regexp_replace(F.regexp_replace("to", r"(^|/)(dist|build|lib|out)/", "$1src/"), r"\.[cm]?js$", ".ts")).alias("paths"))
        linked = first_existing(m, known, ["from", "spec"]).select(F.col("from").alias("path"), "spec", F.col("path").alias("target"), F.lit(False).alias("is_dir"))
        hit = hit.unionByName(linked.join(hit.select("path", "spec"), ["path", "spec"], "left_anti"))
    stems = unique_only(found.filter(F.col("lang").isin("java", "cs")).select(F.col("path").alias("target"), F.concat_ws(":", "lang", F.regexp_replace(basename("path"), r"\.\w+$", "")).alias("stem")), "stem")
    by_name = specs.filter(F.col("lang").isin("java", "cs")).withColumn("stem", F.concat_ws(":", "lang", F.element_at(F.split("spec", "[.]"), -1))).join(stems, "stem")
    hit = hit.unionByName(by_name.select("path", "spec", "target", F.lit(False).alias("is_dir")))
    if go_module:
        folders = found.select(dirname("path").alias("target")).distinct()
        go = specs.filter((F.col("lang") == "go") & s.startswith(go_module)).withColumn("target", F.regexp_replace(F.substr(s, F.lit(len(go_module) + 1)), "^/", ""))
        hit = hit.unionByName(go.join(folders, "target").select("path", "spec", "target", F.lit(True).alias("is_dir")))
    return hit


def build_file_graph(found: DataFrame, entries: list[str] | None = None, go_module: str | None = None, ts_rules: list[tuple] | None = None, packages: list[tuple] | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree from its analyses (sources.analyze).

    Files, entries and decision records, and the directories that are modules.
    imports never point at their own file; part-of goes to the nearest module;
    tested-by links a test's subject in its directory, else the only file of that
    stem; documents runs from prose to code whichever side mentions the other.
    """
    found = materialize(found, "analyses")
    files = found.select("path")
    mods = materialize(infer_modules(files), "modules")
    targets = materialize(resolve_specs(found, go_module, ts_rules, packages).filter("is_dir OR path != target"), "file-targets")
    near = materialize(nearest_module(files, mods), "near-modules")
    kind = node_type("path", entries)
    deg = targets.filter("NOT is_dir").groupBy(F.col("target").alias("path")).agg(F.countDistinct("path").alias("n_in"))
    keys = found.select(kind.alias("t"), F.col("path").alias("k")).unionByName(mods.select(F.lit("mod").alias("t"), F.col("dir").alias("k")))
    every = materialize(assign_ids(keys), "file-ids")
    ids = every.filter("t != 'mod'").select(F.col("k").alias("path"), "t", "id")
    mod_ids = every.filter("t = 'mod'").select(F.col("k").alias("dir"), "id")
    weights = fan_in_weights(ids.join(deg, "path", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in")))
    brief = targets.groupBy("path").agg(F.slice(F.array_sort(F.collect_set(basename("target"))), 1, 3).alias("imports"))
    rich = found.join(ids, "path").join(weights, "id").join(deg, "path", "left").join(brief, "path", "left")
    exports = F.slice(F.transform(F.filter("anchors", lambda a: a["exported"]), lambda a: a["name"]), 1, 4)
    nodes = rich.select(
        "id", "t", F.col("path").alias("k"),
        structural_summary("doc", "loc", F.coalesce("n_in", F.lit(0)), F.coalesce("imports", F.array().cast("array<string>")), exports).alias("s"),
        tags("path", F.col("lang"), depth).alias("g"), "h", F.slice(F.transform("anchors", lambda a: F.struct(a["name"].alias("name"), a["line"].alias("line"))), 1, 8).alias("a"),
        F.lit("ok").alias("st"), "w", F.lit("scan").alias("by"), F.lit(None).cast("bigint").alias("ts"),
    )
    mod_nodes = mods.join(mod_ids, "dir").select(
        "id", F.lit("mod").alias("t"), F.col("dir").alias("k"), F.concat(F.col("nested").cast("string"), F.lit(" files")).alias("s"),
        F.array().cast("array<string>").alias("g"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("array<struct<name:string,line:int>>").alias("a"), F.lit("ok").alias("st"), F.lit(1).alias("w"), F.lit("scan").alias("by"), F.lit(None).cast("bigint").alias("ts"),
    )
    at = ids.select("path", "id")
    dst = at.select(F.col("path").alias("target"), F.col("id").alias("dst"))
    src = at.select("path", F.col("id").alias("src"))
    mod_id = mod_ids.select(F.col("dir").alias("module"), F.col("id").alias("dst"))
    edge = lambda d, t: d.select("src", F.lit(t).alias("type"), "dst")
    edges = edge(targets.filter("NOT is_dir").join(src, "path").join(dst, "target"), "imports")
    edges = edges.unionByName(edge(targets.filter("is_dir").withColumnRenamed("target", "module").join(src, "path").join(mod_id, "module"), "imports"))
    edges = edges.unionByName(edge(near.join(src, "path").join(mod_id, "module"), "part-of"))
    up = nearest_module(mods.select(F.col("dir").alias("path")), mods).filter("module IS NOT NULL").join(mod_ids.select(F.col("dir").alias("path"), F.col("id").alias("src")), "path")
    edges = edges.unionByName(edge(up.join(mod_id, "module"), "part-of"))
    edges = edges.unionByName(edge(pair_tests(files).join(at.select(F.col("path").alias("test"), F.col("id").alias("dst")), "test").join(at.select(F.col("path").alias("subject"), F.col("id").alias("src")), "subject"), "tested-by"))
    told = link_mentions(found).join(at.select(F.col("path").alias("doc"), F.col("id").alias("src")), "doc").join(at.select(F.col("path").alias("code"), F.col("id").alias("dst")), "code")
    edges = edges.unionByName(edge(told, "documents")).filter("src != dst").distinct().withColumn("meta", F.lit(None).cast("map<string,string>"))
    return materialize(nodes.unionByName(mod_nodes), "file-nodes"), materialize(edges, "file-edges")


def pair_tests(files: DataFrame) -> DataFrame:
    """(test, subject): the file of the test's stem in its own directory (the first by path), else the only one anywhere."""
    code = files.filter(test_subject("path").isNull()).select(F.col("path").alias("subject"), dirname("path").alias("dir"), F.regexp_replace(basename("path"), r"\.\w+$", "").alias("stem"))
    tests = files.select(F.col("path").alias("test"), dirname("path").alias("dir"), test_subject("path").alias("stem")).filter("stem IS NOT NULL")
    beside = tests.join(code, ["dir", "stem"]).groupBy("test").agg(F.min("subject").alias("subject"))
    alone = tests.join(beside, "test", "left_anti").join(unique_only(code, "stem").drop("dir"), "stem").select("test", "subject")
    return beside.unionByName(alone)


def link_mentions(found: DataFrame) -> DataFrame:
    """(doc, code) pairs: a mention that names a path exactly, or exactly one numbered document."""
    said = found.select("path", "lang", F.explode("mentions").alias("m"))
    exact = said.join(found.select(F.col("path").alias("hit")), F.col("m") == F.col("hit")).select("path", "lang", "hit")
    number = F.lpad(F.regexp_extract("m", r"^ADR[- ]?(\d+)$", 1), 4, "0")
    docs = found.filter("lang = 'md'").select(F.col("path").alias("hit"), F.regexp_extract(basename("path"), r"^(\d{4})", 1).alias("num"), F.regexp_replace(basename("path"), r"\.\w+$", "").alias("stem"), is_adr("path").alias("adr"))
    by_adr = said.filter("m LIKE 'ADR%'").withColumn("num", number).join(unique_only(docs.filter("adr AND num != ''").select("hit", "num"), "num"), "num").select("path", "lang", "hit")
    by_stem = said.join(unique_only(docs.select("hit", "stem"), "stem"), F.col("m") == F.col("stem")).select("path", "lang", "hit")
    every = exact.unionByName(by_adr).unionByName(by_stem).filter("path != hit").distinct()
    is_md = F.col("hit").rlike(r"\.mdx?$")
    prose = every.filter("lang = 'md'").select(F.col("path").alias("doc"), F.col("hit").alias("code"))
    return prose.unionByName(every.filter((F.col("lang") != "md") & is_md).select(F.col("hit").alias("doc"), F.col("path").alias("code"))).distinct()


def expand(found: DataFrame, contents: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbol nodes, edges) of files: anchors as symbols that end before the next, exports, and calls within a file.

    Exports start at the ids that the nodes (id, k) of the file graph have, or without
    nodes at those that the files found have among themselves.
    A name told more than once in a file is one symbol, at its first line; keys
    whose ids collide at six digits get longer ones, so none is dropped.
    A symbol calls another of its file if the other's name, with an opening
    bracket, stands in its lines: bodies are read once for their called names,
    which meet the file's symbols by equality. Names that are no identifier, few
    if any, are sought one by one.
    """
    order = Window.partitionBy("path").orderBy("line", "name")
    a = found.select("path", "loc", F.explode("anchors").alias("x")).select("path", "loc", "x.*")
    a = a.groupBy("path", "loc", "name").agg(F.min("line").alias("line"), F.bool_or("exported").alias("exported"))
    spans = a.withColumn("end", F.coalesce(F.lead("line").over(order) - 1, F.col("loc"))).withColumn("k", F.concat_ws("#", "path", "name"))
    spans = materialize(spans, "spans")
    spans = materialize(spans.join(assign_ids(spans.select(F.lit("sym").alias("t"), "k")).select("k", "id"), "k"), "symbols")
    body = spans.join(contents.select("path", "content"), "path").select("path", "id", "name", F.array_join(F.slice(F.split("content", "\n"), F.col("line"), F.greatest(F.lit(1), F.col("end") - F.col("line") + 1)), "\n").alias("body"))
    other = spans.select("path", F.col("id").alias("dst"), F.col("name").alias("callee"))
    plain = F.col("callee").rlike(r"^[A-Za-z0-9_$]+$")
    said = body.select("path", "id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z0-9_$]+)[ \t]*\("), F.lit(1)))).alias("callee"))
    by_name = said.join(other.filter(plain), ["path", "callee"]).select("id", "dst")
    odd = body.join(other.filter(~plain), "path").filter(F.expr(r"regexp(body, concat('(?<![A-Za-z0-9_$])\\Q', callee, '\\E[ \\t]*\\('))")).select("id", "dst")
    called = by_name.unionByName(odd).filter("id != dst")
    if nodes is None:
        nodes = assign_ids(found.select(node_type("path").alias("t"), F.col("path").alias("k")))
    owner = found.select("path").join(nodes.select(F.col("k").alias("path"), F.col("id").alias("file")), "path")
    exports = spans.filter("exported").join(owner, "path").select(F.col("file").alias("src"), F.lit("exports").alias("type"), F.col("id").alias("dst"))
    symbols = spans.select("id", F.lit("sym").alias("t"), "k", "line", "end")
    return symbols, exports.unionByName(called.select(F.col("id").alias("src"), F.lit("calls").alias("type"), "dst")).distinct()


def untested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Code nodes that no test covers."""
    return nodes.filter(F.col("t").isin("file", "entry") & ~is_test_file("k")).join(edges.filter("type = 'tested-by'").select(F.col("src").alias("id")), "id", "left_anti")


def agent_writes(nodes: DataFrame, writes: DataFrame) -> DataFrame:
    """nodes with agents' summaries laid over them: the last of each id stands, by is agent, stale ends, h is pinned.

    writes: seq, id, s, h; summaries over 200 characters are refused.
    """
    from strandline.operators.graph import last_wins

    if writes.filter(F.length("s") > 200).limit(1).count():
        raise ValueError("a summary has more than 200 characters")
    own = last_wins(writes, ["id"], [F.col("seq")]).select("id", F.col("s").alias("ws"), F.col("h").alias("wh"))
    hit = F.col("ws").isNotNull()
    both = nodes.join(own, "id", "left").withColumns({"s": F.coalesce("ws", "s"), "h": F.coalesce("wh", "h"), "by": F.when(hit, "agent").otherwise(F.col("by")), "st": F.when(hit, "ok").otherwise(F.col("st"))})
    return both.select(*nodes.columns)


def empty_edges(spark: SparkSession) -> DataFrame:
    from strandline.schemas import FILE_EDGES

    return spark.createDataFrame([], FILE_EDGES)
