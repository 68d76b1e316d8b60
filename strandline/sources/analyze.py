"""The file engine's analyzer: import specs, anchors, locals, header, size and mentions of each file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from strandline.sources.extract import _VIS, ID, blank_comments, canonical, comments_only, header_doc, sha16, use_tree
from strandline.storage import spread

SCHEMA = "path string, lang string, h string, loc int, doc string, specs array<string>, anchors array<struct<name:string,line:int,exported:boolean>>, locals array<string>, mentions array<string>"
_SPECS = {
    "ts": (r"(?:import|export)\s[^'\"`;]*?from\s*['\"]([^'\"]+)['\"]", r"import\s*\(?\s*['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    "py": (r"^[ \t]*from\s+([.\w]+)\s+import", r"^[ \t]*import\s+([\w.]+)"),
    "java": (r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;",),
    "cs": (r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;",),
}
_ANCHORS = {
    "ts": rf"^(?P<exp>export\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|interface|enum|type|const|let|var)\s+(?P<name>{ID})",
    "py": rf"^(?:async\s+)?(?:def|class)\s+(?P<name>{ID})",
    "go": rf"^(?:func\s*(?:\([^)]*\))?|type)\s*(?P<name>{ID})",
    "rs": rf"^(?P<exp>{_VIS})?(?:async\s+)?(?:fn|struct|enum|trait|mod|type)\s+(?P<name>{ID})",
    "java": rf"^\s*(?P<exp>public\s+)?(?:\w+\s+)*(?:class|interface|enum|record)\s+(?P<name>{ID})",
    "cs": rf"^\s*(?P<exp>public\s+)?(?:\w+\s+)*(?:class|interface|enum|record|struct)\s+(?P<name>{ID})",
    "md": r"^#{1,3}\s+(?P<name>.+?)\s*$",
}
MENTION = re.compile(r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+)|(ADR[- ]?\d{1,4})|(?<![A-Za-z0-9])(\d{2,4}-[a-z][a-z0-9-]+)")


def mentions(text: str) -> list[str]:
    return list(dict.fromkeys(next(g for g in m.groups() if g) for m in MENTION.finditer(text)))


def analyze(path: str, text: str, lang: str) -> dict:
    text = canonical(text)
    own = {"js": "ts"}.get(lang, lang)
    style = "py" if own in ("py", "yaml", "toml", "sh") else "c"
    code = text if own == "md" else blank_comments(text, style)
    specs: list[str] = []
    for pattern in _SPECS.get(own, ()):
        specs += re.findall(pattern, code, re.M)
    if own == "go":
        for block in re.findall(r"^import\s+(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"[^\"]+\")", code, re.M):
            specs += re.findall(r"\"([^\"]+)\"", block)
        specs += re.findall(r"^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", code, re.M)
    if own == "rs":
        specs += ["mod:" + x for x in re.findall(rf"^[ \t]*(?:pub\s+)?mod\s+({ID})\s*;", code, re.M)]
        specs += ["::".join(segs) for tree in re.findall(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", code, re.M) for segs, _, _ in use_tree(tree)]
    anchors = []
    if own in _ANCHORS:
        for m in re.finditer(_ANCHORS[own], code, re.M):
            g, name = m.groupdict(), m["name"].strip()
            exported = bool(g.get("exp")) if "exp" in g else name[:1].isupper() if own == "go" else not name.startswith("_")
            anchors.append({"name": name, "line": text.count("\n", 0, m.start("name")) + 1, "exported": exported})
    said = text if own == "md" else comments_only(text, style)
    return {
        "path": path, "lang": lang, "h": sha16(text)[:8], "loc": text.count("\n") + 1, "doc": header_doc(text, own), "specs": list(dict.fromkeys(specs)),
        "anchors": anchors, "locals": [a["name"] for a in anchors if not a["exported"]], "mentions": mentions(said),
    }


def analyze_files(files: DataFrame) -> DataFrame:
    """Analyses of files(path, lang, content string), dealt out over all cores first."""
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", SCHEMA)]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([analyze(p, t or "", x) for p, t, x in zip(frame["path"], frame["content"], frame["lang"])], columns=names)

    return spread(files.select("path", "content", "lang"), "path").mapInPandas(run, SCHEMA)
