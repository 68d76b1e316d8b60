"""Project metadata: package entries, JSONC, workspaces, tsconfig paths, go.mod, test runners, ignore lists."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.paths import basename

RUNNERS = {"pyproject.toml": "pytest", "go.mod": "go-test", "Cargo.toml": "cargo-test"}
TARGET_ORDER = ("source", "import", "default", "types", "require")


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas outside strings removed."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 2 if c == "\\" else 1
            quoted = c != '"'
            continue
        if c == '"':
            quoted = True
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            continue
        elif c in "]}":
            k = len(out) - 1
            while k >= 0 and out[k].isspace():
                k -= 1
            if k >= 0 and out[k] == ",":
                del out[k]
        out.append(c)
        i += 1
    return "".join(out)


def read_jsonc(text: str):
    """Parsed JSONC, or None where it is malformed."""
    try:
        return json.loads(strip_jsonc(text.removeprefix("﻿")))
    except ValueError:
        return None


def ignore_dirs(text: str | None) -> list[str]:
    """ignoreDirs of a config file; a malformed one ignores nothing."""
    own = read_jsonc(text or "")
    found = own.get("ignoreDirs") if isinstance(own, dict) else None
    return [d for d in found if isinstance(d, str)] if isinstance(found, list) else []


def package_entries(directory: str, text: str) -> list[str]:
    """Paths that a package.json names as main, module or bin."""
    own = read_jsonc(text)
    if not isinstance(own, dict):
        return []
    bins = own.get("bin")
    found = [own.get("main"), own.get("module"), *(bins.values() if isinstance(bins, dict) else [bins])]
    return sorted({posixpath.normpath(posixpath.join(directory, f)) for f in found if isinstance(f, str)})


def _target(value) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return next((t for k in TARGET_ORDER if (t := _target(value.get(k)))), None)
    return None


def workspace_packages(manifests: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(name, dir, subpath, target) of package.json texts by directory; without exports, src/index.ts."""
    rows = []
    for directory, text in sorted(manifests.items()):
        own = read_jsonc(text)
        if not isinstance(own, dict) or not isinstance(own.get("name"), str):
            continue
        exports = own.get("exports")
        if not isinstance(exports, dict) or not any(k.startswith(".") for k in exports):
            exports = {".": _target(exports) or "src/index.ts"}
        rows += [(own["name"], directory, sub, posixpath.normpath(posixpath.join(directory, t))) for sub, v in exports.items() if (t := _target(v))]
    return rows


def ts_path_rules(configs: dict[str, str], hops: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(dir, prefix, suffix, target, order) of tsconfig texts by path; extends is followed up to 5 times.

    Rules of the deepest directory come first.
    """
    rows = []
    for path in sorted(configs, key=lambda p: (-len(posixpath.dirname(p)), p)):
        at, own, paths, base = path, read_jsonc(configs[path]), None, None
        for _ in range(hops + 1):
            options = own.get("compilerOptions", {}) if isinstance(own, dict) else {}
            if paths is None and isinstance(options.get("paths"), dict):
                paths, base = options["paths"], posixpath.join(posixpath.dirname(at), options.get("baseUrl", "."))
            up = own.get("extends") if isinstance(own, dict) else None
            if paths is not None or not isinstance(up, str):
                break
            at = posixpath.normpath(posixpath.join(posixpath.dirname(at), up if up.endswith(".json") else up + ".json"))
            own = read_jsonc(configs.get(at, ""))
        for k, (pattern, targets) in enumerate((paths or {}).items()):
            pre, _, suf = pattern.partition("*")
            rows += [(posixpath.dirname(path), pre, suf, posixpath.normpath(posixpath.join(base, t)), k) for t in targets if isinstance(t, str)]
    return rows


def go_module(text: str) -> str | None:
    """The module path of a go.mod."""
    for line in text.splitlines():
        words = line.split()
        if len(words) >= 2 and words[0] == "module":
            return words[1]
    return None


def marker_runners(markers: DataFrame, depth: int = 3) -> DataFrame:
    """(runner, path): the first marker by path of each test runner, at most three directories deep.

    markers: path, content. A package.json means vitest or jest by its
    dependencies, else npm-test if it has a test script.
    """
    own = markers.filter(F.size(F.split("path", "/")) <= depth + 1)
    name = basename("path")
    dep = lambda d: F.contains("content", F.lit(f'"{d}"'))
    runner = F.when(name == "package.json", F.when(dep("vitest"), "vitest").when(dep("jest"), "jest").when(F.get_json_object("content", "$.scripts.test").isNotNull(), "npm-test"))
    for marker, value in RUNNERS.items():
        runner = F.coalesce(runner, F.when(name == marker, value))
    return own.withColumn("runner", runner).filter("runner IS NOT NULL").groupBy("runner").agg(F.min("path").alias("path"))


def read_meta(text: str, version: int) -> dict:
    """Store metadata; a newer schema version is refused, an older one is marked for a rebuild."""
    meta = json.loads(text)
    found = int(meta.get("schemaVersion", 0))
    if found > version:
        raise ValueError(f"the store has schema version {found}; this engine reads up to {version}")
    return meta | {"status": "ok" if found == version else "rebuild"}


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
