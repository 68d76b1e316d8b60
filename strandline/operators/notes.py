"""Note ledger, snapshot drift and issue state."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import closing_numbers, issue_numbers, source_key
from strandline.operators.graph import last_wins
from strandline.operators.traversal import confidence_rank, nearest_sources
from strandline.schemas import IMPACT_TYPES


def latest(ledger: DataFrame, deletes: bool = True) -> DataFrame:
    """The last record of each key by seq; keys whose last record deletes are gone."""
    kept = last_wins(ledger, ["key"], [F.col("seq")])
    return kept.filter("op != 'del'") if deletes else kept


class LedgerLocked(RuntimeError):
    """Another writer holds the ledger; nothing was written."""


def _made(spark: SparkSession, filesystem, path) -> bool:
    """Whether this call made the file. create() of the local file system looks first and writes then, so that two can pass it; the JVM's createNewFile() is one step."""
    try:
        if filesystem.getUri().getScheme() == "file":
            return spark.sparkContext._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        filesystem.create(path, False).close()
    except Py4JJavaError:
        return False
    return True


def _drop_abandoned(spark: SparkSession, filesystem, lock, after_ms: int) -> None:
    """Drop a lock of that age. One looks and drops at a time: a second one would drop the lock that the first has since taken."""
    turn = lock.suffix(".steal")
    if not _made(spark, filesystem, turn):
        return
    try:
        if filesystem.exists(lock) and time.time() * 1000 - filesystem.getFileStatus(lock).getModificationTime() > after_ms:
            filesystem.delete(lock, False)
    except Py4JJavaError:  # released meanwhile
        pass
    finally:
        filesystem.delete(turn, False)


@contextmanager
def ledger_lock(spark: SparkSession, ledger_path: str, attempts: int = 160, delay_ms: int = 25, steal_after_ms: int = 10_000):
    """Hold a ledger alone: a lock file beside it that only one writer can create. An old one is taken for abandoned; while it is held it is kept young."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    lock = jvm.org.apache.hadoop.fs.Path(ledger_path.rstrip("/") + ".lock")
    folder, filesystem = lock.getParent(), lock.getFileSystem(conf)
    filesystem.mkdirs(folder)
    lock = jvm.org.apache.hadoop.fs.Path(filesystem.resolvePath(folder), lock.getName())  # behind a mount table
    filesystem = lock.getFileSystem(conf)
    for _ in range(attempts):
        if _made(spark, filesystem, lock):
            break
        if steal_after_ms > 0:
            try:
                old = time.time() * 1000 - filesystem.getFileStatus(lock).getModificationTime() > steal_after_ms
            except Py4JJavaError:  # released meanwhile
                continue
            if old:
                _drop_abandoned(spark, filesystem, lock, steal_after_ms)
        time.sleep(delay_ms / 1000)
    else:
        raise LedgerLocked(f"{ledger_path} is held by another writer ({attempts} attempts)")
    released = threading.Event()

    def keep_young():
        while not released.wait(steal_after_ms / 4000):
            try:
                filesystem.setTimes(lock, int(time.time() * 1000), -1)
            except Exception:  # the next turn may do it  # noqa: BLE001
                pass

    keeper = threading.Thread(target=keep_young, daemon=True)
    if steal_after_ms > 0:
        keeper.start()
    try:
        yield
    finally:
        released.set()
        if keeper.ident:
            keeper.join()
        filesystem.delete(lock, False)


def append(ledger_path: str, records: DataFrame) -> int:
    """Append records under the ledger's lock, their seq following on the last one's; gives the first seq written."""
    spark = records.sparkSession
    with ledger_lock(spark, ledger_path):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        last = spark.read.parquet(ledger_path).agg(F.max("seq")).first()[0] if there else None
        first = 0 if last is None else last + 1
        numbered = records.withColumn("seq", (F.row_number().over(Window.orderBy("key")) - 1 + first).cast("long"))  # a call's few records
        numbered.write.mode("append").parquet(ledger_path)
    return first


def source_keys(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, key): source key of each node from its file's lines.

    nodes: id, path, sigHash, span; files: path, content.
    """
    lines = F.split(F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n")), "\n")
    body = F.array_join(F.slice(lines, F.col("span.sl"), F.col("span.el") - F.col("span.sl") + 1), "\n")
    return nodes.join(files, "path").select("id", source_key("sigHash", body).alias("key"))


def symbol_note(node_id, key, path, text, span) -> Column:
    """A ledger record of kind symbol."""
    return F.struct(F.lit(1).alias("v"), F.lit("set").alias("op"), F.lit("symbol").alias("kind"), key.alias("key"), node_id.alias("nodeId"), path.alias("path"), text.alias("text"), span.alias("span"))


def edge_note(from_key, to_key, text) -> Column:
    """A ledger record of kind edge; its key joins both source keys."""
    key = F.concat_ws(">", from_key, to_key)
    return F.struct(F.lit(1).alias("v"), F.lit("set").alias("op"), F.lit("edge").alias("kind"), key.alias("key"), from_key.alias("fromKey"), to_key.alias("toKey"), text.alias("text"))


def rebind(notes: DataFrame, live: DataFrame) -> DataFrame:
    """(note, status, node): bound, rebind, orphan or ambiguous against the live nodes' keys.

    notes: note, key, node; live: id, key. A note stays bound while its node still
    has its key; else one node of that key rebinds it, none orphans it, several
    make it ambiguous.
    """
    counts = live.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    own = live.select(F.col("id").alias("node"), F.col("key").alias("key_now"))
    j = notes.join(own, "node", "left").join(counts, "key", "left")
    bound = F.coalesce(F.col("key_now") == F.col("key"), F.lit(False))
    status = F.when(bound, "bound").when(F.col("n") == 1, "rebind").when(F.col("n") > 1, "ambiguous").otherwise("orphan")
    return j.select("note", status.alias("status"), F.when(bound, F.col("node")).when(F.col("n") == 1, F.col("only")).alias("node"))


def rebind_edges(notes: DataFrame, ends: DataFrame) -> DataFrame:
    """(note, status) of edge notes from their ends' statuses: ambiguous, then orphan, then rebind, else bound.

    ends: note, status, a row for each end.
    """
    has = lambda s: F.bool_or(F.col("status") == s)
    worst = F.when(has("ambiguous"), "ambiguous").when(has("orphan"), "orphan").when(has("rebind"), "rebind").otherwise("bound")
    return notes.select("note").join(ends.groupBy("note").agg(worst.alias("status")), "note")


def note_counts(notes: DataFrame) -> DataFrame:
    """(id, n): notes of each node; an edge note counts at both ends. notes: nodeId, fromNodeId, toNodeId."""
    ends = F.array_compact(F.array_distinct(F.array("nodeId", "fromNodeId", "toNodeId")))
    return notes.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def dirty_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, class): edited, deleted or added, by content hash. Unchanged paths are left out."""
    j = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full")
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "edited")
    return j.select("path", kind.alias("class")).filter("class IS NOT NULL")


def drifted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name): names on both sides whose sets of signature hashes differ, among exported ones.

    old, new: path, name, sig_hash and, in new, optionally exported.
    """
    sets = lambda d, c: d.groupBy("path", "name").agg(F.sort_array(F.collect_set("sig_hash")).alias(c))
    live = new.filter("exported") if "exported" in new.columns else new
    both = sets(old, "was").join(sets(new, "now"), ["path", "name"]).filter("was != now").select("path", "name")
    return both.join(live.select("path", "name").distinct(), ["path", "name"], "left_semi")


def dangling(old_edges: DataFrame, old: DataFrame, new: DataFrame, new_edges: DataFrame, dirty: DataFrame) -> DataFrame:
    """(src_path, src_name, type, name): old calls and imports of names that are gone from their dirty path.

    old, new: id, path, name, kind; edges: src, dst, type; dirty: path. A reference
    is healed when its source, matched by path and name, now points at a live node
    of that name. Sources match by place, as ids change with every edit above them.
    """
    gone = old.join(dirty.select("path").distinct(), "path", "left_semi").join(new.select("path", "name").distinct(), ["path", "name"], "left_anti")
    src = old.select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.col("name").alias("src_name"))
    refs = (
        old_edges.filter(F.col("type").isin("call", "import")).join(gone.select(F.col("id").alias("dst"), "name"), "dst").join(src, "src")
        .select("src_path", "src_name", "type", "name").distinct()
    )
    now = new.select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.col("name").alias("src_name"))
    healed = (
        new_edges.filter(F.col("type").isin("call", "import", "route", "extends", "implements"))
        .join(new.select(F.col("id").alias("dst"), "name"), "dst").join(now, "src").select("src_path", "src_name", "name").distinct()
    )
    return refs.join(healed, ["src_path", "src_name", "name"], "left_anti").select("src_path", "src_name", "type", "name")


def merge_dependents(found: DataFrame) -> DataFrame:
    """(id, hop, confidence): strongest confidence and nearest hop of each dependent over all sources."""
    best = found.groupBy("id").agg(F.min("hop").alias("hop"), F.max(confidence_rank("confidence")).alias("r"))
    return best.select("id", "hop", F.when(F.col("r") == 2, "exact").otherwise("heuristic").alias("confidence"))


def check(old_nodes, new_nodes, old_edges, new_edges, old_files, new_files, notes=None) -> DataFrame:
    """(state, path, name, detail): drift, dangling references and unbound notes of a snapshot pair.

    nodes: id, path, name, kind, sigHash, exported; files: path, hash; notes: note, key,
    node with live keys in new_nodes.key. Findings are a diff of two snapshots; nothing
    is re-baselined behind the caller.
    """
    dirty = dirty_classes(old_files, new_files)
    edited = dirty.filter("class = 'edited'").select("path")
    sig = lambda d: d.filter("kind != 'module'").join(edited, "path", "left_semi").withColumnRenamed("sigHash", "sig_hash")
    changed = drifted(sig(old_nodes), sig(new_nodes))
    out = changed.select(F.lit("drift").alias("state"), "path", "name", F.lit(None).cast("string").alias("detail"))
    refs = dangling(old_edges, old_nodes, new_nodes, new_edges, dirty)
    out = out.unionByName(refs.select(F.lit("dangling").alias("state"), F.col("src_path").alias("path"), F.col("src_name").alias("name"), F.concat_ws(" ", "type", "name").alias("detail")))
    if notes is not None:
        lost = rebind(notes, new_nodes.select("id", "key")).filter(F.col("status").isin("orphan", "ambiguous"))
        out = out.unionByName(lost.select(F.col("status").alias("state"), F.lit(None).cast("string").alias("path"), F.col("note").cast("string").alias("name"), F.lit(None).cast("string").alias("detail")))
    return out


def drift_dependents(edges: DataFrame, changed: DataFrame, depth: int = 32) -> DataFrame:
    """(id, hop, confidence): merged upward impact of a set of changed node ids.

    hop counts from the nearest changed node other than the dependent itself, and a
    dependent is exact if an all-exact path from such a node leads to it. So two
    nearest sources of each node suffice, over all edges and over exact ones.
    """
    own = edges.filter(F.col("type").isin(*IMPACT_TYPES))
    others = lambda e: nearest_sources(e, changed, depth).filter("source != id").groupBy("id").agg(F.min("hop").alias("hop"))
    sure = others(own.filter("confidence = 'exact'")).select("id", F.lit(True).alias("sure"))
    return others(own).join(sure, "id", "left").select("id", "hop", F.when(F.col("sure"), "exact").otherwise("heuristic").alias("confidence"))


def issue_frontier(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """(number, open_blockers, frontier): open, unassigned and without an open blocker.

    issues: number, state, assigned; blocks: number, blocker. A blocker of unknown
    state counts as open.
    """
    state = issues.select(F.col("number").alias("blocker"), F.col("state").alias("blocker_state"))
    open_ = blocks.join(state, "blocker", "left").filter(F.coalesce("blocker_state", F.lit("open")) == "open").groupBy("number").agg(F.count("*").alias("open_blockers"))
    n = F.coalesce("open_blockers", F.lit(0).cast("long"))
    return issues.join(open_, "number", "left").select("number", n.alias("open_blockers"), ((F.col("state") == "open") & (n == 0) & ~F.col("assigned")).alias("frontier"))


def issue_edges(issues: DataFrame, commits: DataFrame | None = None, known_files: DataFrame | None = None) -> DataFrame:
    """(src, type, dst): blocks, part-of, closes and mentions.

    issues: number, body, blockedBy, subs; commits: subject, body, files. A commit's files
    close the issues that a key word names and mention the others; files must be known.
    """
    iid = lambda c: F.concat(F.lit("i"), c.cast("string"))
    me = iid(F.col("number"))
    out = issues.select(F.explode("blockedBy").alias("b"), "number").select(iid(F.col("b")).alias("src"), F.lit("blocks").alias("type"), me.alias("dst"))
    out = out.unionByName(issues.select(F.explode("subs").alias("s"), "number").select(iid(F.col("s")).alias("src"), F.lit("part-of").alias("type"), me.alias("dst")))
    if commits is not None:
        text = F.concat_ws("\n", "subject", "body")
        named = commits.select(F.explode("files").alias("path"), closing_numbers(text).alias("c"), issue_numbers(text).alias("m"))
        kinds = F.array(F.struct(F.lit("closes").alias("type"), F.col("c").alias("n")), F.struct(F.lit("mentions").alias("type"), F.array_except("m", "c").alias("n")))
        links = named.select("path", F.explode(kinds).alias("x")).select("path", "x.type", F.explode("x.n").alias("number"))
        links = links.join(issues.select("number").distinct(), "number", "left_semi")
        if known_files is not None:
            links = links.join(known_files.select(F.col("k").alias("path"), F.col("id").alias("src")), "path").select("src", "type", me.alias("dst"))
        else:
            links = links.select(F.col("path").alias("src"), "type", me.alias("dst"))
        out = out.unionByName(links)
    return out.distinct()


def relations_from_body(issues: DataFrame) -> DataFrame:
    """issues with blockedBy and a parent read from the body's conventions, where the API gave none."""
    from strandline.functions.text import listed_after

    blocked = F.when(F.size(F.coalesce("blockedBy", F.array().cast("array<int>"))) > 0, F.col("blockedBy")).otherwise(listed_after("body", "blocked by"))
    return issues.withColumn("blockedBy", blocked).withColumn("parent", F.get(listed_after("body", "part of"), 0))


def ttl(log: DataFrame, now, minutes: int = 120) -> DataFrame:
    """Log rows younger than the time to live."""
    return log.filter(F.col("ts") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))
