"""Joins of name resolution: longest prefix, smallest span, division, candidates, barrels; and the symbol graph build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import materialize


def longest_prefix(names: DataFrame, index: DataFrame, sep: str = ".") -> DataFrame:
    """(fqn, match): the longest whole-part prefix of fqn that the index has, null if none.

    names: fqn; index: pre. Prefixes explode and meet by equality, so there is no
    inequality join.
    """
    parts = F.split("fqn", "[" + sep + "]" if sep != " " else " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    own = names.select("fqn", F.explode(prefixes).alias("pre"))
    return own.join(index.select("pre", F.col("pre").alias("m")), "pre", "left").groupBy("fqn").agg(F.max_by("m", F.length("m")).alias("match"))


def smallest_enclosing(places: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, pos, key): the smallest [sb, eb) of the same path that holds pos; ties to the first span.

    An equality join on the path, then a filter: files bound the pairs. Spans are
    ranked within their file first, so a place keeps one number while the pairs
    pass; they are neither sorted nor kept.
    """
    order = Window.partitionBy("path").orderBy(F.col("eb") - F.col("sb"), "sb", "key")
    ranked = spans.select("path", "sb", "eb", "key", F.row_number().over(order).alias("rank"))
    least = places.join(ranked, "path").filter("sb <= pos AND pos < eb").groupBy("path", "pos").agg(F.min("rank").alias("rank"))
    return least.join(ranked.select("path", "rank", "key"), ["path", "rank"]).select("path", "pos", "key")


def satisfies(types: DataFrame, ifaces: DataFrame) -> DataFrame:
    """(type, iface) pairs where the type has every method of the interface.

    types: type, method; ifaces: iface, method, both distinct. Each interface asks
    only the types that have its rarest method; of those, the ones that have the
    second rarest too are held against the other methods. So a method that every
    type has makes no pairs, and pairs that fail at once meet one method, not all.
    """
    common = types.groupBy("method").agg(F.count("*").alias("bearers"))
    order = Window.partitionBy("iface").orderBy(F.coalesce("bearers", F.lit(0).cast("long")), "method")
    asked = materialize(ifaces.join(common, "method", "left").select("iface", "method", F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy("iface")).alias("need")), "satisfy-methods")
    first = asked.filter("r = 1").select("iface", "need", F.col("method").alias("m1"))
    second = asked.filter("r = 2").select("iface", F.col("method").alias("m2"))
    heads = first.join(second, "iface", "left")
    maybe = materialize(heads.join(types.withColumnRenamed("method", "m1"), "m1").select("type", "iface", "need", "m2"), "satisfy-candidates")
    held = maybe.filter("need > 1").join(types.withColumnRenamed("method", "m2"), ["type", "m2"], "left_semi")
    held = materialize(held.select("type", "iface", "need"), "satisfy-held")
    left = held.filter("need > 2").join(asked.filter("r > 2").select("iface", "method"), "iface").join(types, ["type", "method"], "left_semi")
    whole = left.groupBy("type", "iface", "need").agg(F.count("*").alias("have")).filter("have = need - 2").select("type", "iface")
    return maybe.filter("need = 1").select("type", "iface").unionByName(held.filter("need = 2").select("type", "iface")).unionByName(whole)


def first_existing(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys and path: of each key's candidate paths, in order, the first that is known.

    candidates: keys, paths array<string>; known: path. All candidates are probed by
    one equality join, and the smallest ordinal stands.
    """
    every = candidates.select(*keys, F.posexplode("paths").alias("_place", "path"))
    return every.join(known.select("path").distinct(), "path").groupBy(*keys).agg(F.min_by("path", "_place").alias("path"))


MAX_BARREL = 5
TS_LANGS = ("typescript", "tsx", "javascript")


def ts_candidates(path: Column, spec: Column) -> Column:
    """Paths a relative TypeScript import may mean, in order: as written, with each extension, as an index."""
    from strandline.functions.paths import TS_EXTENSIONS, dirname, join_posix

    base = join_posix(dirname(path), spec)
    bases = F.array_distinct(F.array(base, F.regexp_replace(base, r"\.[cm]?jsx?$", "")))
    ext = F.array(*map(F.lit, TS_EXTENSIONS))
    more = lambda b: F.concat(F.array(b), F.transform(ext, lambda e: F.concat(b, e)), F.transform(ext, lambda e: F.concat(b, F.lit("/index"), e)))
    return F.when(spec.startswith("."), F.flatten(F.transform(bases, more))).otherwise(F.array().cast("array<string>"))


def python_candidates(path: Column, spec: Column, level: Column) -> Column:
    """Paths a Python import may mean: from the root and src, or from the package that the level names."""
    from strandline.functions.paths import join_posix

    parts = F.split(path, "/")
    own = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - level)), "/")
    tail = F.replace(spec, F.lit("."), F.lit("/"))
    bases = F.when(level == 0, F.array(F.lit(""), F.lit("src"))).otherwise(F.array(own))

    def more(b):
        full = join_posix(b, tail)
        init = F.when(full == "", F.lit("__init__.py")).otherwise(F.concat(full, F.lit("/__init__.py")))
        return F.when(tail == "", F.array(init)).otherwise(F.array(F.concat(full, F.lit(".py")), F.concat(full, F.lit(".pyi")), init))

    return F.flatten(F.transform(bases, more))


def rust_candidates(path: Column, segs: Column) -> Column:
    """Paths a Rust use path may mean, the longest module prefix first; heads other than crate, self and super mean none."""
    from strandline.functions.paths import dirname

    head = F.element_at(segs, 1)
    parts = F.split(path, "/")
    base = F.when(head == "crate", F.lit("src")).when(head == "self", dirname(path)).when(head == "super", F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 2)), "/"))
    rest = F.filter(segs, lambda s: ~s.isin("crate", "self", "super"))
    at = lambda n: F.concat_ws("/", F.when(base != "", base), F.array_join(F.slice(rest, 1, n), "/"))
    deep = F.filter(F.array(F.size(rest), F.size(rest) - 1), lambda n: n > 0)
    tries = F.flatten(F.transform(deep, lambda n: F.array(F.concat(at(n), F.lit(".rs")), F.concat(at(n), F.lit("/mod.rs")))))
    root = F.when(head == "crate", F.array(F.lit("src/lib.rs"), F.lit("src/main.rs"))).otherwise(F.array(F.concat_ws("/", base, F.lit("mod.rs"))))
    return F.when(base.isNotNull(), F.concat(tries, root)).otherwise(F.array().cast("array<string>"))


def import_targets(facts: DataFrame, go_module: str | None = None) -> DataFrame:
    """(path, ord, target): the files each import means; several for packages and namespaces."""
    from strandline.functions.paths import dirname, is_test_file

    imp = facts.select("path", "lang", F.posexplode("imports").alias("ord", "i")).select("path", "lang", "ord", "i.*")
    known = facts.select("path")
    p, s = F.col("path"), F.col("spec")
    lists = (
        F.when(F.col("lang").isin(*TS_LANGS), ts_candidates(p, s)).when(F.col("lang") == "python", python_candidates(p, s, F.coalesce("level", F.lit(0))))
        .when(F.col("lang") == "rust", rust_candidates(p, F.col("segments"))).otherwise(F.array().cast("array<string>"))
    )
    tried = imp.select(F.col("path").alias("from"), "ord", lists.alias("paths"))
    out = first_existing(tried, known, ["from", "ord"]).select(F.col("from").alias("path"), "ord", F.col("path").alias("target"))
    if go_module:
        pre = F.lit(go_module)
        folder = F.when(s == pre, F.lit("")).when(s.startswith(go_module + "/"), F.substr(s, F.lit(len(go_module) + 2)))
        package = facts.filter((F.col("lang") == "go") & ~is_test_file("path")).select(dirname("path").alias("dir"), F.col("path").alias("target"))
        out = out.unionByName(imp.filter("lang = 'go'").withColumn("dir", folder).join(package, "dir").select("path", "ord", "target"))
    java = facts.filter("lang = 'java' AND packageName IS NOT NULL").select("packageName", F.col("path").alias("target"), F.explode("defs").alias("d"))
    index = java.filter("d.ownerKey IS NULL AND d.kind IN ('class', 'interface', 'enum')").groupBy(F.concat_ws(".", "packageName", "d.name").alias("pre")).agg(F.min("target").alias("target"))
    named = imp.filter("lang = 'java' AND NOT wildcard")
    found = longest_prefix(named.select(F.col("spec").alias("fqn")).distinct(), index.select("pre")).filter("match IS NOT NULL")
    single = named.join(found, F.col("spec") == F.col("fqn")).join(index, F.col("match") == F.col("pre")).select("path", "ord", "target")
    packages = facts.filter("lang = 'java'").select(F.col("packageName").alias("spec"), F.col("path").alias("target"))
    wild = imp.filter("lang = 'java' AND wildcard").join(packages, "spec").select("path", "ord", "target")
    spaces = facts.filter("lang = 'csharp'").select(F.col("namespace").alias("spec"), F.col("path").alias("target"))
    using = imp.filter("lang = 'csharp'").join(spaces, "spec").select("path", "ord", "target")
    return out.unionByName(single).unionByName(wild).unionByName(using).filter("path != target").distinct()


def lookup(requests: DataFrame, defs: DataFrame, hops: DataFrame) -> DataFrame:
    """(file, name, id, def_file, depth, overflow, last): a name seen through re-export barrels.

    requests: file, name; defs: path, name, id, ord; hops: path, ord, target,
    exported, origin (null exported: a wildcard). A direct definition ends the
    search; else re-exports are followed in order, five deep, and the first in
    that order that finds a definition stands. Beyond, overflow names the last file.
    """
    first = defs.groupBy("path", "name").agg(F.min_by("id", "ord").alias("id"))
    none = F.array().cast("array<int>")
    level = materialize(requests.distinct().select(F.col("file").alias("rf"), F.col("name").alias("rn"), F.col("file").alias("at"), F.col("name").alias("want"), none.alias("way")), "lookup")
    found, lost = None, None
    for depth in range(MAX_BARREL + 1):
        probe = level.join(first.select(F.col("path").alias("at"), F.col("name").alias("want"), "id"), ["at", "want"], "left")
        hit = probe.filter("id IS NOT NULL").select("rf", "rn", "id", F.col("at").alias("def_file"), F.lit(depth).alias("depth"), "way")
        found = hit if found is None else found.unionByName(hit)
        step = probe.filter("id IS NULL").join(hops, F.col("at") == F.col("path")).filter(F.col("exported").isNull() | (F.col("exported") == F.col("want")))
        grown = step.select("rf", "rn", F.col("target").alias("next"), F.coalesce("origin", "want").alias("want"), F.concat("way", F.array("ord")).alias("way"))
        level = materialize(grown.select("rf", "rn", F.col("next").alias("at"), "want", "way"), "lookup")
        if level.isEmpty():
            break
    else:
        lost = level.groupBy("rf", "rn").agg(F.min_by("at", "way").alias("last"))
    best = found.groupBy("rf", "rn").agg(F.min_by(F.struct("id", "def_file", "depth"), "way").alias("b"))
    out = requests.distinct().select(F.col("file").alias("rf"), F.col("name").alias("rn")).join(best, ["rf", "rn"], "left")
    out = out.join(lost, ["rf", "rn"], "left") if lost is not None else out.withColumn("last", F.lit(None).cast("string"))
    over = F.col("b").isNull() & F.col("last").isNotNull()
    return out.select(F.col("rf").alias("file"), F.col("rn").alias("name"), "b.id", "b.def_file", "b.depth", over.alias("overflow"), "last")


def build_symbol_graph(facts: DataFrame, go_module: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counters) of the symbol graph from per-file facts.

    Nodes: a module a file, definitions, routes. Edges: contains, import, call,
    extends, implements, route, tests. Calls resolve by a fixed cascade: self
    dispatch up the owner's class; the head's import binding, unless shadowed; a
    definition of the same file (heuristic); else they are dropped. The last import
    of a local name binds it. Unresolved imports count once.
    """
    from strandline.functions.paths import convention_test_target, is_test_file, module_id
    from strandline.functions.text import hash_prefix, symbol_id
    from strandline.operators.graph import dedupe_confidence

    facts = materialize(facts, "facts")
    name = module_id("path", F.col("lang"))
    mod_sig = hash_prefix(name, 16)
    modules = facts.select(
        symbol_id(F.lit("module"), "path", name, F.lit(1), F.lit(0), "lineCount", "size", mod_sig).alias("id"), F.lit("module").alias("kind"), "lang", "path", name.alias("name"),
        F.struct(F.lit(1).alias("sl"), F.lit(0).alias("sb"), F.col("lineCount").alias("el"), F.col("size").cast("int").alias("eb")).alias("span"), mod_sig.alias("sigHash"),
        F.when(F.col("lang") == "unknown", "rough").otherwise("exact").alias("confidence"), name.alias("sig"), F.lit(True).alias("exported"),
        F.array().cast("array<string>").alias("decorators"), F.col("moduleSummary").alias("summary"),
    )
    d = facts.select("path", "lang", F.posexplode("defs").alias("ord", "d")).select("path", "lang", "ord", "d.*")
    defs = materialize(
        d.withColumn("id", symbol_id("kind", "path", "name", "sl", "sb", "el", "eb", "sigHash")), "defs"
    )
    def_nodes = defs.select(
        "id", "kind", "lang", "path", "name", F.struct("sl", "sb", "el", "eb").alias("span"), "sigHash",
        F.when(F.col("lang") == "unknown", "rough").when(F.col("lang") == "python", "exact").otherwise("heuristic").alias("confidence"), "sig", "exported", "decorators", "summary",
    )
    r = facts.select("path", "lang", F.explode("routes").alias("r")).select("path", "lang", "r.verb", F.col("r.path").alias("route"), "r.sl", "r.sb", "r.el", "r.eb", "r.confidence", "r.defKey")
    rname = F.concat_ws(" ", "verb", "route")
    routes = r.withColumn("name", rname).withColumn("sigHash", hash_prefix("name", 16)).withColumn("id", symbol_id(F.lit("route"), "path", "name", "sl", "sb", "el", "eb", "sigHash"))
    route_nodes = routes.select(
        "id", F.lit("route").alias("kind"), "lang", "path", "name", F.struct("sl", "sb", "el", "eb").alias("span"), "sigHash", "confidence", F.col("name").alias("sig"),
        F.lit(True).alias("exported"), F.array().cast("array<string>").alias("decorators"), F.lit(None).cast("string").alias("summary"),
    )
    nodes = modules.unionByName(def_nodes).unionByName(route_nodes).dropDuplicates(["id"])
    mod = modules.select("path", F.col("id").alias("mod"))
    key = defs.select("path", F.col("key").alias("k"), F.col("id").alias("kid"))

    def edge(df: DataFrame, kind: str, src, dst, confidence="exact", f="path", seq="path") -> DataFrame:
        conf = F.lit(confidence) if isinstance(confidence, str) else confidence
        return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("label"), conf.alias("confidence"), F.col(f).alias("f"), F.col(seq).cast("string").alias("seq"))

    owned = defs.join(mod, "path").join(key.withColumnRenamed("k", "ownerKey"), ["path", "ownerKey"], "left").withColumn("owner", F.coalesce("kid", "mod"))
    edges = edge(owned, "contains", "owner", "id")
    placed = routes.join(mod, "path").join(key.withColumnRenamed("k", "defKey"), ["path", "defKey"], "left").withColumn("owner", F.coalesce("kid", "mod"))
    edges = edges.unionByName(edge(placed, "contains", "owner", "id")).unionByName(edge(placed, "route", "owner", "id", F.col("confidence")))

    targets = materialize(import_targets(facts, go_module), "import-targets")
    tmod = mod.select(F.col("path").alias("target"), F.col("mod").alias("tmod"))
    edges = edges.unionByName(edge(targets.join(mod, "path").join(tmod, "target"), "import", "mod", "tmod"))
    imp = facts.select("path", "lang", F.posexplode("imports").alias("ord", "i")).select("path", "lang", "ord", "i.*")
    unresolved = imp.join(targets.select("path", "ord").distinct(), ["path", "ord"], "left_anti").count()

    one = targets.groupBy("path", "ord").agg(F.min("target").alias("target"), F.sort_array(F.collect_set("target")).alias("targets"))
    bound = imp.join(one, ["path", "ord"])
    named = bound.select("path", "lang", "ord", "target", F.posexplode("names").alias("n", "x")).select("path", "lang", "ord", "n", "target", F.col("x.name").alias("want"), F.coalesce("x.alias", "x.name").alias("local"))
    default = bound.filter("defaultAlias IS NOT NULL").select("path", "lang", "ord", F.lit(-1).alias("n"), "target", F.lit("default").alias("want"), F.col("defaultAlias").alias("local"))
    last = F.element_at("segments", -1)
    paths = bound.filter("lang IN ('rust', 'java') AND NOT wildcard").select("path", "lang", "ord", F.lit(-1).alias("n"), "target", last.alias("want"), F.coalesce("ns", last).alias("local"))
    wants = materialize(named.unionByName(default).unionByName(paths), "import-names")
    re_ = facts.select("path", "lang", F.posexplode("reexports").alias("ord", "x")).select("path", "lang", "ord", "x.*")
    known = facts.select("path")
    re_targets = first_existing(re_.filter(F.col("lang").isin(*TS_LANGS)).select(F.col("path").alias("from"), "ord", ts_candidates(F.col("path"), F.col("spec")).alias("paths")), known, ["from", "ord"])
    re_at = re_.join(re_targets.select(F.col("from").alias("path"), "ord", F.col("path").alias("target")), ["path", "ord"])
    hops = re_at.filter("wildcard").select("path", "ord", "target", F.lit(None).cast("string").alias("exported"), F.lit(None).cast("string").alias("origin"))
    hops = hops.unionByName(re_at.select("path", "ord", "target", F.explode("entries").alias("e")).select("path", "ord", "target", "e.exported", "e.origin"))
    hops = hops.unionByName(wants.filter("lang = 'python'").select("path", (F.col("ord") + 10_000).alias("ord"), "target", F.col("local").alias("exported"), F.col("want").alias("origin")))
    hops = materialize(hops, "reexport-hops")
    sub = wants.filter("lang = 'python' AND target LIKE '%__init__.py'").select("path", "ord", "n", "local", F.regexp_replace("target", r"__init__\.py$", "").alias("dir"), "want")
    sub = first_existing(sub.select(F.col("path").alias("from"), "ord", "n", "local", F.array(F.concat("dir", "want", F.lit(".py")), F.concat("dir", "want", F.lit("/__init__.py"))).alias("paths")), known, ["from", "ord", "n", "local"])
    submods = sub.select(F.col("from").alias("path"), "ord", "n", "local", F.col("path").alias("sub"))

    look = defs.select("path", "name", "id", "ord")
    resolved = lookup(wants.select(F.col("target").alias("file"), F.col("want").alias("name")), look, hops)
    symbols = wants.join(resolved.select(F.col("file").alias("target"), F.col("name").alias("want"), "id", "def_file", "overflow", "last"), ["target", "want"], "left").join(submods, ["path", "ord", "n", "local"], "left")
    whole = F.col("want").isin("default") | F.col("lang").isin("rust", "java")
    kind = F.when(F.col("sub").isNotNull(), "namespace").when(F.col("id").isNotNull(), "symbol").when(F.col("overflow"), "fallback").when(whole, "namespace").otherwise("unresolved")
    table = symbols.select("path", "ord", "n", "local", kind.alias("kind"), F.coalesce("sub", F.when(F.col("id").isNotNull(), F.col("def_file")), "last", "target").alias("file"), F.when(F.col("sub").isNull(), F.col("id")).alias("id"), F.lit(None).cast("array<string>").alias("files"))
    spaces = bound.filter("ns IS NOT NULL AND lang NOT IN ('go', 'rust', 'java', 'csharp')").select("path", "ord", F.lit(-2).alias("n"), F.col("ns").alias("local"), F.lit("namespace").alias("kind"), F.col("target").alias("file"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<string>").alias("files"))
    plain = bound.filter("lang = 'python' AND ns IS NULL AND size(names) = 0 AND NOT wildcard").select("path", "ord", F.lit(-2).alias("n"), F.col("spec").alias("local"), F.lit("namespace").alias("kind"), F.col("target").alias("file"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<string>").alias("files"))
    package = facts.filter("lang = 'go'").select(F.col("path").alias("target"), "packageName")
    go = bound.filter("lang = 'go'").join(package, "target", "left").select("path", "ord", F.lit(-2).alias("n"), F.coalesce("ns", "packageName", F.element_at(F.split("spec", "/"), -1)).alias("local"), F.lit("gopackage").alias("kind"), F.col("target").alias("file"), F.lit(None).cast("string").alias("id"), F.col("targets").alias("files"))
    every = table.unionByName(spaces).unionByName(plain).unionByName(go)
    bindings = every.groupBy("path", "local").agg(F.max_by(F.struct("kind", "file", "id", "files"), F.struct("ord", "n")).alias("b"))

    types = defs.filter("ownerKey IS NULL AND kind IN ('class', 'interface', 'enum')").select(F.col("path").alias("target"), F.col("name").alias("local"), "id", "ord")
    packages = facts.filter("lang = 'java' AND packageName IS NOT NULL").select("packageName", "path")
    mates = packages.join(packages.withColumnRenamed("path", "target"), "packageName").filter("path != target").select("path", "target")
    wide = bound.filter("lang = 'csharp' OR (lang = 'java' AND wildcard)").select("path", F.explode("targets").alias("target"))
    visible = mates.unionByName(wide).distinct().join(types, "target").groupBy("path", "local").agg(F.min_by(F.struct(F.lit("symbol").alias("kind"), F.col("target").alias("file"), "id", F.lit(None).cast("array<string>").alias("files")), F.struct("target", "ord")).alias("v"))
    bindings = materialize(bindings.join(visible, ["path", "local"], "full").select("path", "local", F.coalesce("b", "v").alias("b")).select("path", "local", "b.*"), "bindings")

    c = facts.select("path", F.posexplode("calls").alias("seq", "c")).select("path", "seq", "c.*").filter("defKey IS NOT NULL")
    caller = defs.select("path", F.col("key").alias("defKey"), F.col("id").alias("caller"), "paramTokens", "ownerKey")
    first_local = facts.select("path", F.explode("locals").alias("l")).groupBy("path", F.col("l.name").alias("head")).agg(F.min("l.sb").alias("first_local"))
    calls = c.join(caller, ["path", "defKey"]).join(first_local, ["path", "head"], "left")
    calls = materialize(calls.withColumn("shadowed", F.coalesce(F.col("first_local") < F.col("sb"), F.lit(False)) | F.array_contains("paramTokens", F.col("head"))), "calls")
    chain = defs.select("path", "key", F.col("ownerKey").alias("up"), "kind")
    selfs = calls.filter("selfRef AND prop IS NOT NULL").withColumn("cls", F.coalesce("ownerKey", "defKey"))
    members = defs.filter("ownerKey IS NOT NULL").groupBy("path", F.col("ownerKey").alias("cls"), F.col("name").alias("prop")).agg(F.min_by("id", "ord").alias("target"))
    level, found = selfs.select("path", "seq", "caller", "prop", "cls"), None
    for _ in range(4):  # as deep as definitions nest
        probe = level.join(members, ["path", "cls", "prop"], "left")
        hit = probe.filter("target IS NOT NULL").select("path", "seq", "caller", "target")
        found = hit if found is None else found.unionByName(hit)
        level = probe.filter("target IS NULL").drop("target").join(chain.select("path", F.col("key").alias("cls"), "up"), ["path", "cls"]).filter("up IS NOT NULL").select("path", "seq", "caller", "prop", F.col("up").alias("cls"))
    edges = edges.unionByName(edge(found, "call", "caller", "target", "heuristic", seq="seq"))

    open_ = calls.filter("NOT selfRef AND NOT shadowed").join(bindings.withColumnRenamed("local", "head"), ["path", "head"], "left")
    spaced = open_.filter("kind = 'namespace' AND prop IS NOT NULL")
    via = lookup(spaced.select("file", F.col("prop").alias("name")), look, hops).select("file", F.col("name").alias("prop"), F.col("id").alias("target"), "overflow")
    by_space = spaced.join(via, ["file", "prop"]).filter("target IS NOT NULL")
    first_def = look.groupBy(F.col("path").alias("file"), F.col("name").alias("prop")).agg(F.min_by("id", "ord").alias("member"))
    by_symbol = open_.filter("kind = 'symbol'").join(first_def, ["file", "prop"], "left").withColumn("target", F.coalesce("member", "id"))
    in_package = open_.filter("kind = 'gopackage'").select("path", "seq", "caller", "prop", "file", F.explode("files").alias("pf")).join(first_def.withColumnRenamed("file", "pf"), ["pf", "prop"], "left")
    by_package = in_package.groupBy("path", "seq", "caller", "file").agg(F.min_by("member", F.when(F.col("member").isNotNull(), F.col("pf"))).alias("member")).join(mod.withColumnRenamed("path", "file"), "file").withColumn("target", F.coalesce("member", "mod"))
    fallback = open_.filter("kind = 'fallback'").join(mod.withColumnRenamed("path", "file"), "file").withColumn("target", F.col("mod"))
    same = open_.filter("kind IS NULL").join(first_def.select(F.col("file").alias("path"), F.col("prop").alias("head"), F.col("member").alias("target")), ["path", "head"])
    for part, conf in ((by_space, "exact"), (by_symbol, "exact"), (by_package, "exact"), (fallback, "heuristic"), (same, "heuristic")):
        edges = edges.unionByName(edge(part, "call", "caller", "target", conf, seq="seq"))

    h = facts.select("path", F.posexplode("heritage").alias("seq", "h")).select("path", "seq", "h.*").join(caller.select("path", "defKey", "caller"), ["path", "defKey"])
    h = h.withColumns({"head": F.element_at(F.split("name", "[.]"), 1), "prop": F.element_at(F.split("name", "[.]"), -1)})
    hb = h.join(bindings.withColumnRenamed("local", "head"), ["path", "head"], "left").join(first_def, ["file", "prop"], "left").join(first_def.select(F.col("file").alias("path"), F.col("prop").alias("head"), F.col("member").alias("own")), ["path", "head"], "left")
    target = F.when(F.col("kind") == "symbol", F.when(F.col("head") != F.col("prop"), F.coalesce("member", "id")).otherwise(F.col("id"))).when(F.col("kind") == "namespace", F.col("member")).when(F.col("kind").isNull(), F.col("own"))
    inherited = hb.withColumn("target", target).filter("target IS NOT NULL AND target != caller").withColumn("conf", F.when(F.col("kind").isNull(), "heuristic").otherwise("exact"))
    for rel in ("extends", "implements"):
        edges = edges.unionByName(edge(inherited.filter(F.col("rel") == rel), rel, "caller", "target", F.col("conf"), seq="seq"))

    is_test = is_test_file("path") | (F.col("lang").isin("csharp") & F.coalesce("testFramework", F.lit(False)))
    tests = facts.filter(is_test).select("path", "lang")
    seen = tests.join(bindings.filter("kind IN ('symbol', 'namespace', 'gopackage')"), "path").select("path", F.col("file").alias("target"), F.lit("exact").alias("conf"))
    by_name = tests.select("path", convention_test_target("path", F.col("lang")).alias("target")).join(known.withColumnRenamed("path", "target"), "target").select("path", "target", F.lit("heuristic").alias("conf"))
    go_mates = _go_mates(facts)
    aimed = seen.unionByName(by_name).unionByName(go_mates).filter("path != target").join(mod, "path").join(tmod, "target")
    edges = edges.unionByName(edge(aimed, "tests", "mod", "tmod", F.col("conf")))

    recv = defs.filter("lang = 'go' AND receiverType IS NOT NULL").select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), "receiverType", F.col("name").alias("method")).distinct()
    owner = defs.filter("lang = 'go' AND kind = 'class'").select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.col("name").alias("receiverType"), F.col("id").alias("type"), F.col("path").alias("tpath"))
    ifs = defs.filter("lang = 'go' AND kind = 'interface' AND size(ifaceMethods) > 0").select(F.col("id").alias("iface"), F.col("path").alias("ipath"), F.regexp_replace("path", r"/?[^/]*$", "").alias("idir"), F.explode("ifaceMethods").alias("method"))
    sat = satisfies(recv.join(owner, ["dir", "receiverType"]).select("type", "method").distinct(), ifs.select("iface", "method").distinct())
    where = sat.join(owner.select("type", "tpath", "dir").distinct(), "type").join(ifs.select("iface", "ipath", "idir").distinct(), "iface")
    sees = where.join(targets.select(F.col("path").alias("tpath"), F.col("target").alias("ipath"), F.lit(True).alias("imported")).distinct(), ["tpath", "ipath"], "left").filter((F.col("dir") == F.col("idir")) | F.col("imported"))
    edges = edges.unionByName(edge(sees, "implements", "type", "iface", "heuristic", f="tpath", seq="tpath"))

    kept = dedupe_confidence(edges.filter("src != dst")).select("src", "dst", "type", "label", "confidence", "f")
    counters = facts.sparkSession.createDataFrame([("unresolvedImports", unresolved), ("barrelOverflows", bindings.filter("kind = 'fallback'").count())], "counter string, n long")
    return materialize(nodes, "sym-nodes"), materialize(kept, "sym-edges"), counters


def _go_mates(facts: DataFrame) -> DataFrame:
    """(path, target, conf): Go tests aim at the files of their directory and package."""
    from strandline.functions.paths import dirname, is_test_file

    go = facts.filter("lang = 'go'").select("path", dirname("path").alias("dir"), F.regexp_replace("packageName", "_test$", "").alias("package"))
    code = go.filter(~is_test_file("path")).withColumnRenamed("path", "target")
    return go.filter(is_test_file("path")).join(code, ["dir", "package"]).select("path", "target", F.lit("heuristic").alias("conf"))
