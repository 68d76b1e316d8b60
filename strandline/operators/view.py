"""Bounded subgraph selection, slices, briefs and their renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import escape_json_island, tokens_ceiled
from strandline.operators.graph import greedy_budget, prefix_budget
from strandline.operators.traversal import confidence_rank
from strandline.storage import materialize

VIEW_BYTES, MARGIN, NODE_SHARE, NOTE_BYTES = 1_500_000, 4_096, 0.62, 65_536
CAPS = {"drift": 250, "dangling": 250, "orphan": 150, "ambiguous": 100, "tests": 120, "rebind": 50, "deps": 12}
IMPACT_TOKENS, SLICE_TOKENS, BRIEF_TOKENS, CHECK_TOKENS = 600, 1_200, 150, 200
NETWORK = (
    r"(?i)\bhttps?://", r"(?i)\bsrc\s*=\s*[\"']//", r"(?i)\bfetch\s*\(", r"(?i)\bXMLHttpRequest\b", r"(?i)\bWebSocket\b", r"(?i)\bEventSource\b",
    r"(?i)\bsendBeacon\b", r"(?i)@import\b", r"(?i)\burl\(\s*[\"']?//", r"(?i)\bimportScripts\b",
)


def source_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no (from 1), line of each content, after one byte-order mark and CRLF are normalised."""
    from strandline.functions.text import canonicalize

    return files.select(*keys, F.posexplode(F.split(canonicalize("content"), "\n")).alias("i", "line")).select(*keys, (F.col("i") + 1).alias("line_no"), "line")


def slice_of(files: DataFrame, path: str, first: int, last: int, most: int = SLICE_TOKENS) -> DataFrame:
    """The lines of a range, clamped to the file; raises where they exceed the token limit."""
    lines = source_lines(files.filter(F.col("path") == path), ["path"]).filter(F.col("line_no").between(max(1, min(first, last)), max(first, last)))
    size = lines.agg(F.sum(F.length("line") + 1)).first()[0] or 0
    if -(-size // 4) > most:
        raise ValueError(f"{-(-size // 4)} tokens are over the limit of {most}; narrow the range")
    return lines


def container_above(nodes: DataFrame, path: str, sl: int, el: int) -> DataFrame:
    """The smallest definition that holds lines [sl, el] and is not equal to them, ties by id."""
    span = nodes.filter((F.col("path") == path) & (F.col("kind") != "module") & (F.col("span.sl") <= sl) & (F.col("span.el") >= el) & ~((F.col("span.sl") == sl) & (F.col("span.el") == el)))
    return span.orderBy(F.col("span.el") - F.col("span.sl"), "id").limit(1)


def file_section(nodes: DataFrame, path: str, sl: int, el: int) -> DataFrame:
    """(first, last): lines between the definitions next above and next below a range."""
    own = nodes.filter((F.col("path") == path) & (F.col("kind") != "module"))
    return own.agg((F.coalesce(F.max(F.when(F.col("span.el") < sl, F.col("span.el"))), F.lit(0)) + 1).alias("first"), (F.coalesce(F.min(F.when(F.col("span.sl") > el, F.col("span.sl"))), F.lit(2147483647)) - 1).alias("last"))


def ref_counts(edges: DataFrame, node) -> DataFrame:
    """(side, n, exact, heuristic): references to (up) and from (down) a node, containment left out."""
    side = F.when(F.col("dst") == node, "up").when(F.col("src") == node, "down")
    own = edges.filter("type NOT IN ('contains')").withColumn("side", side).filter("side IS NOT NULL")
    return own.groupBy("side").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "exact").alias("exact"), F.count_if(F.col("confidence") != "exact").alias("heuristic"))


def brief(nodes: DataFrame, edges: DataFrame, files: DataFrame, node: str, preview: int = 3) -> str:
    """A card of at most 150 tokens: place, signature, references, two tests, the first lines."""
    row = nodes.filter(F.col("id") == node).first()
    if row is None:
        raise LookupError(node)
    refs = {r["side"]: r for r in ref_counts(edges, node).collect()}
    tests = [r["src"] for r in edges.filter((F.col("type") == "tests") & (F.col("dst") == node)).select("src").distinct().orderBy("src").limit(2).collect()]
    body = [r["line"] for r in source_lines(files.filter(F.col("path") == row["path"]), ["path"]).filter(F.col("line_no").between(row["span"]["sl"], min(row["span"]["el"], row["span"]["sl"] + preview - 1))).orderBy("line_no").collect()]
    out = [f"{row['kind']} {row['name']} {row['path']}:{row['span']['sl']}-{row['span']['el']}", row["sig"] or ""]
    out += [f"{s} {refs[s]['n']} ({refs[s]['exact']} exact)" for s in ("up", "down") if s in refs] + [f"test {t}" for t in tests] + body
    text = ""
    for line in filter(None, out):
        if -(-(len(text) + len(line) + 1) // 4) > BRIEF_TOKENS:
            break
        text += line + "\n"
    return text


def bounded_view(nodes: DataFrame, edges: DataFrame, total: int = VIEW_BYTES) -> DataFrame:
    """(kind_of_row, id, src, dst, type): nodes and edges that fit a byte budget.

    nodes: id, kind, span_size, bytes; edges: src, dst, type, bytes. Nodes rank by
    degree, span and id and take 62 % of the budget; edges between them rank by
    their hub and take what is left; route and test edges to a node outside then
    pull it in while both fit; remaining space goes to further nodes. Only rows
    that can fit at all reach the unpartitioned windows: a budget bounds their number.
    """
    budget = total - MARGIN
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = nodes.join(degree, "id", "left").fillna(0, ["degree"])
    order = [F.desc("degree"), F.desc("span_size"), F.col("id")]
    least = nodes.agg(F.min("bytes")).first()[0]
    if least is None:
        return edges.select(F.lit("edge").alias("row"), F.col("src").alias("id"), "src", "dst", "type").limit(0)
    able = ranked.orderBy(*order).limit(int(budget // max(1, least)) + 1)
    picked = materialize(prefix_budget(able, order, "bytes", budget * NODE_SHARE), "view-nodes")
    spent = picked.agg(F.sum("bytes")).first()[0] or 0
    ids = picked.select("id")
    hub = ranked.select("id", "degree")
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    scored = both.join(hub.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(hub.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    smallest = edges.agg(F.min("bytes")).first()[0] or 1
    e_order = [F.desc(F.greatest("ds", "dd")), F.col("src"), F.col("dst"), F.col("type")]
    able_e = scored.withColumn("h", F.greatest("ds", "dd")).orderBy(*e_order).limit(int((budget - spent) // max(1, smallest)) + 1)
    kept_e = materialize(prefix_budget(able_e, e_order, "bytes", budget - spent), "view-edges")
    spent += kept_e.agg(F.sum("bytes")).first()[0] or 0
    half = edges.filter(F.col("type").isin("route", "tests"))
    known = ids.withColumn("in", F.lit(True))
    pulls = (
        half.join(known.select(F.col("id").alias("src"), F.col("in").alias("s")), "src", "left").join(known.select(F.col("id").alias("dst"), F.col("in").alias("d")), "dst", "left")
        .filter("(s IS NULL) != (d IS NULL)").withColumn("id", F.when(F.col("s").isNull(), F.col("src")).otherwise(F.col("dst")))
        .join(nodes.select("id", F.col("bytes").alias("nb")), "id").withColumn("cost", F.col("bytes") + F.col("nb")).withColumn("g", F.lit(1))
    )
    room = pulls.orderBy("src", "dst", "type").limit(int((budget - spent) // max(1, smallest)) + 1)
    drawn = materialize(greedy_budget(room.select("g", "src", "dst", "type", "id", "cost"), "g", ["src", "dst", "type", "id"], "cost", int(budget - spent)), "view-pulls")
    spent += drawn.agg(F.sum("cost")).first()[0] or 0
    rest = able.join(ids, "id", "left_anti").join(drawn.select("id"), "id", "left_anti")
    more = prefix_budget(rest, order, "bytes", budget - spent)
    rows = [
        picked.select(F.lit("node").alias("row"), "id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("kind").alias("type")),
        more.select(F.lit("node").alias("row"), "id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("kind").alias("type")),
        drawn.join(nodes.select("id", "kind"), "id").select(F.lit("node").alias("row"), "id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("kind").alias("type")).distinct(),
        kept_e.select(F.lit("edge").alias("row"), F.lit(None).cast("string").alias("id"), "src", "dst", "type"),
        drawn.select(F.lit("edge").alias("row"), F.lit(None).cast("string").alias("id"), "src", "dst", "type"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def clip(rows: DataFrame, section: str, order: list[Column]) -> tuple[DataFrame, int]:
    """The rows a section may show, and how many more there are."""
    most = CAPS[section]
    return rows.orderBy(*order).limit(most), max(0, rows.count() - most)


def impact_report(found: DataFrame, modules: DataFrame) -> DataFrame:
    """(section, module, id, confidence): members by section and module that fit 600 tokens, too long lines skipped.

    found: id, hop, confidence; modules: id, module.
    """
    rows = found.join(modules, "id", "left").select(
        F.lit("impact").alias("report"), F.when(F.col("hop") == 1, 0).otherwise(1).alias("part"), F.coalesce("module", F.lit("")).alias("module"),
        (-confidence_rank("confidence")).alias("r"), F.col("id").cast("string").alias("id"), "confidence",
    ).withColumn("cost", tokens_ceiled(F.length(F.concat_ws(" ", "module", "id", "confidence")) + 1))
    first = rows.orderBy("part", "module", "r", "id").limit(IMPACT_TOKENS)  # each line costs a token or more
    kept = greedy_budget(first, "report", ["part", "module", "r", "id", "confidence"], "cost", IMPACT_TOKENS)
    return kept.select(F.when(F.col("part") == 0, "direct").otherwise("transitive").alias("section"), "module", "id", "confidence")


def entrypoints(nodes: DataFrame) -> DataFrame:
    """Routes, and things named main that are not modules."""
    return nodes.filter((F.col("kind") == "route") | ((F.col("name") == "main") & (F.col("kind") != "module")))


def network_refs(texts: DataFrame) -> DataFrame:
    """(path, pattern): the network references that each text holds."""
    hits = F.array(*[F.when(F.col("content").rlike(p), F.lit(p)) for p in NETWORK])
    return texts.select("path", F.explode(F.array_compact(hits)).alias("pattern"))


def bounded_notes(counts: DataFrame, shown: DataFrame, most: int = NOTE_BYTES) -> DataFrame:
    """Note counts of shown ids, largest first, within 64 KiB of JSON."""
    rows = counts.join(shown.select("id"), "id", "left_semi").withColumn("bytes", F.length(F.to_json(F.struct("id", "n"))).cast("long"))
    w = Window.partitionBy().orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.orderBy(F.desc("n"), "id").limit(most // 10).withColumn("spent", F.sum("bytes").over(w)).filter(F.col("spent") <= most).select("id", "n")


def html_page(nodes: DataFrame, edges: DataFrame, title: str = "graph", most: int = VIEW_BYTES) -> str:
    """A self-contained page of a bounded graph: its JSON inside a script element, < escaped, no network use.

    Raises where the finished page has more than the given bytes: bound the graph first, see bounded_view().
    """
    as_json = lambda d: [r[0] for r in d.select(escape_json_island(F.to_json(F.struct("*")))).collect()]  # noqa: E731  callers pass a bounded view
    page = "<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{t}</title></head><body><script type=\"application/json\" id=\"data\">{{\"nodes\":[{n}],\"edges\":[{e}]}}</script></body></html>"
    out = page.format(t=title.replace("<", ""), n=",".join(as_json(nodes)), e=",".join(as_json(edges)))
    if (size := len(out.encode("utf-8"))) > most:
        raise ValueError(f"the page has {size} bytes of {most}; show a smaller part")
    return out


def replace_section(text: str, name: str, body: str) -> str:
    """Text with the part between a section's marks replaced, or the section added; other prose stays."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = f"{start}\n{body}\n{end}"
    if start in text and end in text:
        head, _, rest = text.partition(start)
        return head + block + rest.partition(end)[2]
    return text.rstrip("\n") + ("\n\n" if text.strip() else "") + block + "\n"
