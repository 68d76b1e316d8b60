"""Source trees, JSON Lines stores, posting files and logs as DataFrames, and their writers."""

from __future__ import annotations

import json
import os
import subprocess
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.paths import drop_reason, is_binary, keeps_source, symbol_lang
from strandline.functions.text import canonicalize

FILE_KB, SOURCE_BYTES = 512, 1_048_576
IGNORE_GLOBS = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/vendor/**", "**/target/**", "**/__pycache__/**", "**/*.min.*", "**/*.lock")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ms, content binary) below a root, by Spark's own reader, so any file system will do.

    Filters on path and size reach the scan; content is read only where it is selected.
    The reader skips hidden files and directories.
    """
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), "^.*?" + _quoted(base.partition("://")[2] or base) + "/", "")
    return df.select(rel.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), "content")


def tracked_paths(root: str) -> tuple[list[str], bool]:
    """(paths, degraded) of a working tree: tracked and untracked files that git does not ignore, hidden ones too.

    Without git the tree is walked, version-control folders left out, and degraded is true.
    """
    asked = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=False)
    if asked.returncode == 0:
        return sorted({os.fsdecode(p) for p in asked.stdout.split(b"\0") if p}), False
    found = []
    for top, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d != ".git"]
        found += [os.path.relpath(os.path.join(top, n), root) for n in names if os.path.isfile(os.path.join(top, n))]
    return sorted(found), True


def tracked_listing(spark: SparkSession, root: str, most_kb: int = FILE_KB) -> DataFrame:
    """(path, size, mtime_ms, content) of a working tree by git's own listing; root is a path all executors see.

    Names come from git on the driver; tasks look the files up. A file that is gone
    has null size; content is read only up to the size gate, else null.
    """
    paths, _ = tracked_paths(root)
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 2000))

    def look(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for p in batch.column(0).to_pylist():
                full, size, stamp, content = os.path.join(root, p), None, None, None
                try:
                    st = os.stat(full)
                    if os.path.isfile(full):
                        size, stamp = st.st_size, st.st_mtime * 1000
                        if size <= most_kb * 1024:
                            with open(full, "rb") as f:
                                content = f.read()
                except OSError:  # it went between the listing and now
                    size = None
                for col, x in zip(rows, (p, size, stamp, content)):
                    col.append(x)
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["path", "size", "mtime_ms", "content"])

    return names.mapInArrow(look, "path string, size long, mtime_ms double, content binary")


def tree_listing(spark: SparkSession, root: str, most_kb: int = FILE_KB) -> DataFrame:
    """A local tree by git's listing, any other by Spark's reader."""
    local = root.removeprefix("file://") if root.startswith("file://") or "://" not in root else None
    return listing(spark, root) if local is None else tracked_listing(spark, local, most_kb)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def skill_dirs(paths: DataFrame) -> list[str]:
    """Directories below the root that hold a SKILL.md: few, so they reach the driver."""
    found = paths.filter(F.col("path").rlike("(^|/)SKILL\\.md$")).select(F.regexp_replace("path", "/?SKILL\\.md$", "").alias("dir")).distinct().collect()
    return sorted(r["dir"] for r in found if r["dir"])


def scan_listing(files: DataFrame, globs: list[str] | None = None, most_kb: int = FILE_KB) -> tuple[DataFrame, DataFrame]:
    """(kept files, counts by drop reason); the first reason in the order skill, ignored, gone, big, binary stands."""
    reason = drop_reason("path", "size", "content", skill_dirs(files), list(IGNORE_GLOBS if globs is None else globs), most_kb)
    marked = files.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def source_files(files: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """(path, lang, size, mtime_ms, content string) of the symbol walk: gates on metadata come before the content is read."""
    kept = files.filter(F.col("size") <= SOURCE_BYTES).filter(keeps_source("path", ignored)).filter(~is_binary("content", 8192))
    return kept.select("path", symbol_lang("path").alias("lang"), "size", "mtime_ms", canonicalize(F.decode("content", "UTF-8")).alias("content"))


def scan_jobs(walked: DataFrame, prior: DataFrame, force: bool = False) -> DataFrame:
    """(path, job): vanished, oversize, reuse or scan, by size, time, language and content hash of the last run.

    walked: path, size, mtime_ms, lang; prior: path, size, mtime_ms, lang, hash, facts_hash.
    """
    p = prior.select("path", *[F.col(c).alias("p_" + c) for c in ("size", "mtime_ms", "lang", "hash", "facts_hash")])
    same = F.col("size").eqNullSafe(F.col("p_size")) & F.col("mtime_ms").eqNullSafe(F.col("p_mtime_ms")) & F.col("lang").eqNullSafe(F.col("p_lang")) & (F.col("p_hash") == F.col("p_facts_hash"))
    job = F.when(F.col("size").isNull(), "vanished").when(F.col("size") > SOURCE_BYTES, "oversize").when(F.coalesce(same, F.lit(False)) & F.lit(not force), "reuse").otherwise("scan")
    return walked.select("path", "size", "mtime_ms", "lang").join(p, "path", "full").select("path", job.alias("job"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON Lines with a declared schema. Strict raises on a bad line; else bad lines stay in _corrupt_record."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        return reader.option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema + ", _corrupt_record string").json(path)
    return reader.schema(schema).json(path)


def load_graph(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, warnings) of a tolerant store: rows without id, t and k, or bad lines, become warnings."""
    from strandline.schemas import FILE_EDGES, FILE_NODES

    raw = read_jsonl(spark, nodes_path, FILE_NODES, strict=False).cache()
    bad = F.col("_corrupt_record").isNotNull() | F.col("id").isNull() | F.col("t").isNull() | F.col("k").isNull()
    defaults = {"st": F.coalesce("st", F.lit("ok")), "w": F.coalesce("w", F.lit(1)), "by": F.coalesce("by", F.lit("scan"))}
    edges = read_jsonl(spark, edges_path, FILE_EDGES, strict=False).cache()
    bad_edge = F.col("_corrupt_record").isNotNull() | F.col("src").isNull() | F.col("type").isNull() | F.col("dst").isNull()
    warn = raw.filter(bad).select(F.lit("nodes").alias("store"), "_corrupt_record").unionByName(edges.filter(bad_edge).select(F.lit("edges").alias("store"), "_corrupt_record"))
    return raw.filter(~bad).drop("_corrupt_record").withColumns(defaults), edges.filter(~bad_edge).drop("_corrupt_record"), warn


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, as_json: bool = False) -> None:
    """Nodes by id and edges by triple; as sparse JSON Lines where asked, defaults left out."""
    if as_json:
        sparse = nodes.withColumns({"st": F.nullif("st", F.lit("ok")), "w": F.nullif("w", F.lit(1)), "by": F.nullif("by", F.lit("scan"))})
        line = lambda d: d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))
        line(sparse.orderBy("id")).write.mode("overwrite").text(f"{path}/nodes")
        line(edges.orderBy("src", "type", "dst")).write.mode("overwrite").text(f"{path}/edges")
        return
    nodes.orderBy("id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.orderBy("src", "type", "dst").write.mode("overwrite").parquet(f"{path}/edges")


def save_snapshot(tables: dict[str, DataFrame], root: str, snapshot: str, version: int = 1) -> None:
    """Tables of one snapshot, published by its meta row.

    Each call writes tables of its own and the meta row last, which names their
    folder: until then readers see the earlier publication whole, and a crash
    leaves it in place.
    """
    spark, run = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/snapshot={snapshot}/run-{run}/{name}")
    meta = json.dumps({"snapshot": snapshot, "schemaVersion": version, "tables": sorted(tables), "run": run})
    publish(spark, f"{root}/snapshot={snapshot}/meta.json", meta)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A file written under another name and moved into place, so that it is there whole or not at all.

    The move replaces an earlier file where the file system can do so in one step;
    elsewhere the earlier file goes first.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    filesystem = there.getFileSystem(conf)
    out = filesystem.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), conf)
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), "OVERWRITE")
        context.rename(draft, there, options)
    except Exception:  # noqa: BLE001  no such file context for this scheme
        filesystem.delete(there, False)
        if not filesystem.rename(draft, there):
            raise


def read_snapshot(spark: SparkSession, root: str, snapshot: str, name: str, version: int = 1) -> DataFrame:
    """A table of a published snapshot; raises where it has no meta or a newer schema version."""
    meta = spark.read.schema("schemaVersion int, run string").json(f"{root}/snapshot={snapshot}/meta.json").first()
    if meta["schemaVersion"] > version:
        raise ValueError(f"snapshot {snapshot} has schema version {meta['schemaVersion']}; this engine reads up to {version}")
    return spark.read.parquet(f"{root}/snapshot={snapshot}/run-{meta['run']}/{name}")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, id) of a tab-separated posting file."""
    rows = spark.read.option("sep", "\t").schema("term string, ids string").csv(path)
    return rows.select("term", F.explode(F.split("ids", ",")).alias("id"))


def write_postings(postings: DataFrame, path: str) -> None:
    """term, tab, ids in order: lists are capped, so a row stays short."""
    rows = postings.groupBy("term").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    rows.select(F.concat_ws("\t", "term", "ids").alias("value")).write.mode("overwrite").text(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    from strandline.schemas import LEDGER

    return read_jsonl(spark, path, LEDGER)


def record_impact(log: DataFrame, path: str, now_ms: int, minutes: int = 120) -> DataFrame:
    """The impact log with one more path, rows beyond the time to live dropped. log: ts_ms, path."""
    fresh = log.filter(F.col("ts_ms") >= now_ms - minutes * 60_000)
    return fresh.unionByName(log.sparkSession.createDataFrame([(now_ms, path)], "ts_ms bigint, path string"))


def parse_impact_log(lines: DataFrame) -> DataFrame:
    """(ts_ms, path) of lines `<epoch ms> <path>`; other lines are left out."""
    ts = F.regexp_extract("value", r"^(\d+) (.+)$", 1)
    return lines.select(F.try_to_number(ts, F.lit("9" * 18)).cast("bigint").alias("ts_ms"), F.regexp_extract("value", r"^(\d+) (.+)$", 2).alias("path")).filter("path != ''")


def read_soft(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A strict JSON Lines table, or an empty one where it is missing or corrupt: the baseline of a check."""
    try:
        found = read_jsonl(spark, path, schema)
        found.count()
        return found
    except Exception:  # noqa: BLE001  whatever is wrong with the file, there is no baseline
        return spark.createDataFrame([], schema)


CHECK_STATE = "version int, state string, path string, name string, detail string"


def save_check(findings: DataFrame, path: str, version: int = 1) -> None:
    """The findings of the last check, in a fixed projection."""
    findings.select(F.lit(version).alias("version"), "state", "path", "name", "detail").write.mode("overwrite").json(path)


def read_check(spark: SparkSession, path: str, version: int = 1) -> DataFrame | None:
    """The last check's findings; None where missing, corrupt or of another version."""
    found = read_soft(spark, path, CHECK_STATE)
    return None if found.isEmpty() or found.filter(F.col("version") != version).limit(1).count() else found.drop("version")


def init_store(root: str, lines: tuple[str, ...] = ("cache/", "*.tmp")) -> None:
    """Directories, an empty config and ignore lines of a local store; what is there already stays."""
    from pathlib import Path

    base = Path(root)
    for d in ("nodes", "edges", "index", "overlays"):
        (base / d).mkdir(parents=True, exist_ok=True)
    config, ignore = base / "config.json", base / ".gitignore"
    if not config.exists():
        config.write_text("{}\n")
    have = ignore.read_text().splitlines() if ignore.exists() else []
    ignore.write_text("\n".join([*have, *(x for x in lines if x not in have)]) + "\n")
