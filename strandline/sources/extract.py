"""Facts of source files: Python from its syntax tree, the other grammars by scanners over blanked text.

Offsets count code points. Definitions found by scanners are heuristic: what a
scanner cannot tell apart it leaves out.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

from strandline.functions.paths import SYMBOL_LANGS
from strandline.schemas import FACTS
from strandline.storage import spread

VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
NOT_CALLS = frozenset(
    "if for while switch catch return function typeof new await yield super import with in of do else case def class lambda fn func match "
    "using lock foreach nameof sizeof when where unsafe impl pub mod use let var const elif except print assert not and or del raise".split()
)


def sha16(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def flat(text: str | None) -> str:
    return " ".join((text or "").split())


def canonical(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n")


#: Where a comment or a string may begin; what a blank takes the place of.
_OPENS = {"c": re.compile(r"[\"'`]|//|/\*"), "py": re.compile(r"[\"'`#]")}
_INK = re.compile(r"[^\n]")


def blank_comments(text: str, style: str, strings: bool = False) -> str:
    """Comments (and string bodies, if asked) turned into blanks; offsets and lines stay.

    style: c or py. Regular-expression literals are not known; a single quote
    opens a string in C style only where it also closes on the line.
    """
    out, i, n = [], 0, len(text)
    told = 0  # up to here out holds the text
    opens = _OPENS[style]

    def wipe(a: int, b: int) -> None:
        nonlocal told
        out.append(text[told:a])
        out.append(_INK.sub(" ", text[a:b]))
        told = max(told, min(b, n))

    while m := opens.search(text, i):
        i = m.start()
        c = text[i]
        if style == "c" and text.startswith("//", i) or style == "py" and c == "#":
            end = text.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end)
            i = end
        elif style == "c" and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            wipe(i, end)
            i = end
        elif c in "\"'`":
            mark = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            j = i + len(mark)
            while j < n and not text.startswith(mark, j):
                if text[j] == "\\":
                    j += 1
                elif text[j] == "\n" and len(mark) == 1 and c != "`":
                    break
                j += 1
            if j >= n or text[j] == "\n" and len(mark) == 1 and c != "`":
                i += 1  # a lifetime or an apostrophe
                continue
            if strings:
                wipe(i + len(mark), j)
            i = j + len(mark)
    out.append(text[told:])
    return "".join(out)


def comments_only(text: str, style: str) -> str:
    """The inverse: all but comments turned into blanks."""
    bare = blank_comments(text, style)
    return "".join(a if a != b or a == "\n" else " " for a, b in zip(text, bare))


def header_doc(text: str, lang: str) -> str | None:
    """First paragraph of a file's header: Markdown prose, a docstring, or leading comments."""
    if lang == "md":
        for block in re.split(r"\n\s*\n", text):
            line = flat(re.sub(r"^#+[^\n]*\n?", "", block.strip()))
            if line:
                return line
        return None
    found = re.match(r"\s*(?:#![^\n]*\n)?\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|/\*+(.*?)\*/|((?:[ \t]*(?://|#)[^\n]*\n?)+))", text, re.S)
    if not found:
        return None
    body = next(g for g in found.groups() if g is not None)
    lines = [re.sub(r"^\s*(?:\*|//[/!]?|#)?\s?", "", x).rstrip() for x in body.strip("\n").split("\n")]
    return flat(re.split(r"\n\s*\n", "\n".join(lines).strip())[0]) or None


def empty_facts(text: str) -> dict:
    return {
        "lineCount": text.count("\n") + 1, "moduleSummary": None, "packageName": None, "namespace": None, "testFramework": False,
        "defs": [], "imports": [], "reexports": [], "calls": [], "heritage": [], "routes": [], "locals": [],
    }


def an_import(spec, names=(), ns=None, default=None, level=0, wildcard=False, static=False, segments=()) -> dict:
    return {"spec": spec, "level": level, "ns": ns, "defaultAlias": default, "wildcard": wildcard, "static": static, "segments": list(segments), "names": [{"name": a, "alias": b} for a, b in names]}


def a_call(chain: list[str], sb: int, new: bool = False) -> dict:
    return {"head": chain[0], "prop": chain[-1] if len(chain) > 1 else None, "selfRef": chain[0] in ("self", "this"), "isNew": new, "sb": sb, "defKey": None, "calleeText": ".".join(chain)}


def a_def(kind, name, text, sb, eb, sig, exported, decorators=(), summary=None, params="", receiver=None, methods=()) -> dict:
    return {
        "key": None, "kind": kind, "name": name, "sl": text.count("\n", 0, sb) + 1, "sb": sb, "el": text.count("\n", 0, max(sb, eb - 1)) + 1, "eb": eb, "sig": flat(sig),
        "sigHash": sha16(flat(sig)), "exported": exported, "decorators": list(decorators), "summary": summary, "paramTokens": sorted(set(re.findall(r"[A-Za-z_$][\w$]*", params or ""))),
        "ownerKey": None, "receiverType": receiver, "ifaceMethods": list(methods),
    }


def enclosing(defs: list[dict], pos: int, exclude: str | None = None) -> dict | None:
    best = None
    for d in defs:
        if d["key"] != exclude and d["sb"] <= pos < d["eb"] and (best is None or d["eb"] - d["sb"] < best["eb"] - best["sb"]):
            best = d
    return best


def finish(facts: dict) -> dict:
    """Keys d1.. in order of place, and the owner of every definition, call and route."""
    defs = sorted(facts["defs"], key=lambda d: (d["sb"], d["eb"], d["name"]))
    for i, d in enumerate(defs):
        d["key"] = f"d{i + 1}"
    for d in defs:
        up = enclosing(defs, d["sb"], d["key"])
        d["ownerKey"] = up and up["key"]
    for c in facts["calls"]:
        up = enclosing(defs, c["sb"])
        c["defKey"] = up and up["key"]
    for h in facts["heritage"]:
        h["defKey"] = next((d["key"] for d in defs if d["sb"] == h["defKey"]), None)
    for r in facts["routes"]:
        at = r.pop("at", r["sb"])
        up = enclosing(defs, at)
        r["defKey"] = up and up["key"]
    facts["defs"] = defs
    return facts


def a_route(verb, path, text, sb, eb, confidence, at=None) -> dict:
    return {"verb": verb.upper(), "path": path, "sl": text.count("\n", 0, sb) + 1, "sb": sb, "el": text.count("\n", 0, eb) + 1, "eb": eb, "confidence": confidence, "defKey": None, "at": sb if at is None else at}


def extract_python(text: str) -> dict:
    facts = empty_facts(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return facts
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw = text.split("\n")

    def at(line: int, col: int) -> int:
        return starts[line - 1] + len(raw[line - 1].encode()[:col].decode("utf-8", "ignore"))

    def first_paragraph(doc: str | None) -> str | None:
        return flat(re.split(r"\n\s*\n", doc.strip())[0]) or None if doc else None

    def chain(node) -> list[str] | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else None

    facts["moduleSummary"] = first_paragraph(ast.get_docstring(tree, clean=False))

    def visit(node, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            inside = in_class
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_fn = not isinstance(child, ast.ClassDef)
                sb, eb = at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)
                params = ast.unparse(child.args) if is_fn else ""
                sig = f"{child.name}({params})" + (f" -> {ast.unparse(child.returns)}" if is_fn and child.returns else "")
                facts["defs"].append(
                    a_def("method" if is_fn and in_class else "function" if is_fn else "class", child.name, text, sb, eb, sig, not child.name.startswith("_"), ["@" + ast.unparse(d) for d in child.decorator_list], first_paragraph(ast.get_docstring(child, clean=False)), params)
                )
                for d in child.decorator_list:
                    own = chain(d.func) if isinstance(d, ast.Call) else None
                    if own and len(own) > 1 and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        verb = own[-1].lower()
                        if verb == "route":
                            listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                            verbs = {e.value.upper() for e in getattr(listed, "elts", []) if isinstance(e, ast.Constant) and isinstance(e.value, str)} if listed is not None else {"GET"}
                            verb = verbs.pop().lower() if len(verbs) == 1 else ""  # several verbs name no single route
                        if verb in VERBS:
                            facts["routes"].append(a_route(verb, d.args[0].value, text, at(d.lineno, d.col_offset), at(d.end_lineno, d.end_col_offset), "exact", sb))
                if not is_fn:
                    inside = True
                    for base in child.bases:
                        if own := chain(base):
                            facts["heritage"].append({"defKey": sb, "rel": "extends", "name": ".".join(own)})
            elif isinstance(child, ast.Import):
                facts["imports"] += [an_import(a.name, ns=a.asname) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                star = any(a.name == "*" for a in child.names)
                facts["imports"].append(an_import(child.module or "", [(a.name, a.asname) for a in child.names if a.name != "*"], level=child.level, wildcard=star))
            elif isinstance(child, ast.Call):
                if own := chain(child.func):
                    facts["calls"].append(a_call(own, at(child.func.lineno, child.func.col_offset)))
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Store):
                facts["locals"].append({"name": child.id, "sb": at(child.lineno, child.col_offset)})
            visit(child, inside)

    visit(tree, False)
    return finish(facts)


def _close(text: str, at: int, pair: str = "{}") -> int:
    """Offset after the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == pair[0]:
            depth += 1
        elif text[i] == pair[1]:
            depth -= 1
            if not depth:
                return i + 1
    return len(text)


def _end(code: str, at: int) -> int:
    """End of a definition whose head ends at `at`: its block, or its semicolon or line."""
    m = re.compile(r"[{;\n]").search(code, at)
    while m and m[0] == "\n":
        rest = code[m.end() :].lstrip()
        if not rest.startswith("{"):
            return m.start()
        m = re.compile(r"[{;\n]").search(code, code.index("{", m.end()))
    return len(code) if not m else _close(code, m.start()) if m[0] == "{" else m.end()


ID = r"[A-Za-z_$][\w$]*"
#: Where a definition may begin: on a new line, or behind a bracket or semicolon of the same one.
_AT = r"(?:^|(?<=[;{}]))"
_GEN = r"(?:<[^>{}()]*>)?"
TS_DEFS = (
    ("function", re.compile(rf"{_AT}[ \t]*(?P<exp>export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{ID})\s*{_GEN}\s*\((?P<params>[^)]*)\)(?P<ret>\s*:\s*[^{{;\n]+)?", re.M)),
    ("function", re.compile(rf"{_AT}[ \t]*(?P<exp>export\s+)?(?:const|let|var)\s+(?P<name>{ID})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\s*\*?\s*(?:{ID})?\s*\((?P<params2>[^)]*)\)|{_GEN}\((?P<params>[^)]*)\)(?:\s*:\s*[^=\n]+)?\s*=>|(?P<params3>{ID})\s*=>)", re.M)),
    ("function", re.compile(rf"{_AT}[ \t]*(?P<exp>(?:module\.)?exports\.)(?P<name>{ID})\s*=\s*(?:async\s+)?(?:function\s*(?:{ID})?\s*)?\((?P<params>[^)]*)\)", re.M)),
    ("class", re.compile(rf"{_AT}[ \t]*(?P<exp>export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>{ID})(?P<gen>{_GEN})(?P<heads>[^{{;]*)", re.M)),
    ("interface", re.compile(rf"{_AT}[ \t]*(?P<exp>export\s+)?(?:declare\s+)?interface\s+(?P<name>{ID})(?P<gen>{_GEN})(?P<heads>[^{{;]*)", re.M)),
    ("enum", re.compile(rf"{_AT}[ \t]*(?P<exp>export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{ID})", re.M)),
    ("type", re.compile(rf"{_AT}[ \t]*(?P<exp>export\s+)?(?:declare\s+)?type\s+(?P<name>{ID})(?P<gen>{_GEN})\s*=", re.M)),
)
#: A word of each, without which the pattern finds nothing.
TS_WORDS = ("function", "=", "exports.", "class", "interface", "enum", "type")
GO_DEFS = (
    ("method", re.compile(rf"^func\s*\(\s*(?:\w+\s+)?\*?(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>{ID})\s*\((?P<params>[^)]*)\)(?P<ret>[^{{\n]*)", re.M)),
    ("function", re.compile(rf"^func\s+(?P<name>{ID})(?:\[[^\]]*\])?\s*\((?P<params>[^)]*)\)(?P<ret>[^{{\n]*)", re.M)),
    ("class", re.compile(rf"^type\s+(?P<name>{ID})(?:\[[^\]]*\])?\s+struct\b", re.M)),
    ("interface", re.compile(rf"^type\s+(?P<name>{ID})(?:\[[^\]]*\])?\s+interface\b", re.M)),
)
_VIS = r"pub\b\s*(?:\([\w\s:]+\)\s*)?"
_RPUB = rf"(?P<exp>{_VIS})?"
RUST_DEFS = (
    ("function", re.compile(rf"{_AT}[ \t]*{_RPUB}(?:(?:async|const|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+(?P<name>{ID}){_GEN}\s*\((?P<params>[^)]*)\)(?P<ret>\s*->\s*[^{{;\n]+)?", re.M)),
    ("class", re.compile(rf"{_AT}[ \t]*{_RPUB}struct\s+(?P<name>{ID})", re.M)),
    ("enum", re.compile(rf"{_AT}[ \t]*{_RPUB}enum\s+(?P<name>{ID})", re.M)),
    ("interface", re.compile(rf"{_AT}[ \t]*{_RPUB}trait\s+(?P<name>{ID})", re.M)),
    ("type", re.compile(rf"{_AT}[ \t]*{_RPUB}(?:union|type)\s+(?P<name>{ID})", re.M)),
    ("module", re.compile(rf"{_AT}[ \t]*{_RPUB}mod\s+(?P<name>{ID})\s*(?={{)", re.M)),
    ("impl", re.compile(rf"{_AT}[ \t]*(?:unsafe\s+)?impl\s*{_GEN}\s*(?:(?P<trait>[\w:]+){_GEN}\s+for\s+)?(?P<name>{ID}){_GEN}", re.M)),
)
_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly|default|synchronized|native|extern|new|unsafe)\s+)*)"
JAVA_DEFS = (
    ("class", re.compile(rf"^[ \t]*{_MODS}class\s+(?P<name>{ID})(?P<gen>{_GEN})(?P<heads>[^{{;]*)", re.M)),
    ("interface", re.compile(rf"^[ \t]*{_MODS}@?interface\s+(?P<name>{ID})(?P<gen>{_GEN})(?P<heads>[^{{;]*)", re.M)),
    ("enum", re.compile(rf"^[ \t]*{_MODS}enum\s+(?P<name>{ID})(?P<heads>[^{{;]*)", re.M)),
    ("class", re.compile(rf"^[ \t]*{_MODS}record\s+(?:struct\s+|class\s+)?(?P<name>{ID})(?P<gen>{_GEN})\s*\((?P<params>[^)]*)\)(?P<heads>[^{{;]*)", re.M)),
    ("method", re.compile(rf"^[ \t]*{_MODS}(?:{_GEN}\s*[\w.]+{_GEN}(?:\[\])*\??\s+)?(?P<name>{ID})\s*{_GEN}\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w.,\s]+|where\s+[^{{;]+)?(?=\{{|;|=>)", re.M)),
)
CSHARP_DEFS = (*JAVA_DEFS, ("class", re.compile(rf"^[ \t]*{_MODS}struct\s+(?P<name>{ID})(?P<gen>{_GEN})(?P<heads>[^{{;]*)", re.M)))
_METHOD = re.compile(rf"{_AT}[ \t]*(?P<mods>(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*)\*?\s*(?P<name>#?{ID})\s*{_GEN}\((?P<params>[^)]*)\)(?P<ret>\s*:\s*[^{{;\n]+)?\s*(?=\{{)", re.M)


def _head_names(heads: str, lang: str) -> list[tuple[str, str]]:
    """(relation, name) pairs of a class head."""
    if lang == "csharp":
        _, colon, names = heads.partition(":")
        names = re.split(r"\bwhere\b", names)[0]
        bases = [x for x in re.split(r",(?![^<]*>)", names) if x.strip()] if colon else []
        found = [re.match(r"\s*([\w.]+)", x)[1] for x in bases if re.match(r"\s*([\w.]+)", x)]
        return [("implements" if re.match(r"I[A-Z]", n.rpartition(".")[2]) else "extends", n) for n in found]
    out = []
    for rel, names in re.findall(r"\b(extends|implements)\s+(.+?)(?=\b(?:extends|implements|permits)\b|$)", " ".join(heads.split())):
        out += [(rel, m[0]) for x in re.split(r",(?![^<]*>)", names) if (m := re.search(r"[A-Za-z_$][\w$.]*", x))]
    return out


def _scan_defs(text: str, code: str, lang: str, patterns, facts: dict) -> None:
    words = TS_WORDS if patterns is TS_DEFS else ("",) * len(patterns)
    for kind, pattern in (x for x, word in zip(patterns, words) if word in code):
        for m in pattern.finditer(code):
            g = m.groupdict()
            name, sb = m["name"], m.start() + len(m[0]) - len(m[0].lstrip())
            if (name in NOT_CALLS and lang not in ("rust", "go")) or kind == "method" and lang in ("java", "csharp") and re.match(r"\s*(?:return|new|throw|else|await)\b", m[0]):
                continue
            eb = _end(code, m.end())
            params = next((g[p] for p in ("params", "params2", "params3") if g.get(p) is not None), None)
            mods, before = g.get("mods") or "", code[: m.start()]
            marks = re.search(r"((?:^[ \t]*(?:@\w[\w.]*(?:\([^)\n]*\))?|#\[[^\]\n]*\]|\[[^\]\n]*\])[ \t]*\n)+)$", before, re.M)
            decorators = [flat(x) for x in text[marks.start() : marks.end()].strip().split("\n")] if marks else []
            if lang in ("typescript", "tsx", "javascript"):
                exported, sig = bool(g.get("exp")), f"{name}{g.get('gen') or ''}" if kind in ("class", "interface", "type", "enum") else f"{name}({flat(params)}){flat(g.get('ret'))}"
            elif lang == "go":
                exported, sig = name[:1].isupper(), f"{name}({flat(params)}) {flat(g.get('ret'))}" if params is not None else name
            elif lang == "rust":
                exported, sig = bool(g.get("exp")), f"{name}({flat(params)}) {flat(g.get('ret'))}" if params is not None else f"{g['trait']} for {name}" if g.get("trait") else name
            elif lang == "java":
                exported, sig = "private" not in mods, f"{name}({flat(params)})"
            else:
                exported, sig = mods.split()[:1] != ["private"], f"{name}({flat(params)})" if params is not None else name
            methods = []
            if kind == "interface" and lang == "go":
                methods = re.findall(rf"^\s*({ID})\s*\(", code[m.end() : eb], re.M)
            doc = header_doc(text[: m.start()][-600:].rpartition("\n\n")[2] + "\n", "c") if lang != "rust" and "/**" in text[max(0, m.start() - 600) : m.start()] else None
            facts["defs"].append(a_def(kind, name, text, sb, eb, sig, exported, decorators, doc, params or "", g.get("recv"), methods))
            if g.get("heads"):
                facts["heritage"] += [{"defKey": sb, "rel": r, "name": n} for r, n in _head_names(g["heads"], lang)]
            if g.get("trait"):
                facts["heritage"].append({"defKey": sb, "rel": "implements", "name": g["trait"].rpartition("::")[2]})
            if kind == "class" and lang in ("typescript", "tsx", "javascript") and "{" in code[m.end() - 1 : eb]:
                opened = code.index("{", m.end() - 1)
                for mm in _METHOD.finditer(code, opened + 1, eb):
                    if mm["name"] in NOT_CALLS or code.count("{", opened, mm.start()) - code.count("}", opened, mm.start()) != 1:
                        continue
                    at = mm.start() + len(mm[0]) - len(mm[0].lstrip())
                    facts["defs"].append(a_def("method", mm["name"], text, at, _end(code, mm.end()), f"{mm['name']}({flat(mm['params'])}){flat(mm['ret'])}", bool(g.get("exp")), (), None, mm["params"]))


def _scan_calls(code: str, facts: dict) -> None:
    heads = {d["sb"] for d in facts["defs"]}
    for m in re.finditer(rf"(?P<new>\bnew\s+)?(?<![\w$.@])(?P<chain>{ID}(?:\s*(?:\.|::)\s*{ID})*)\s*{_GEN}\(", code):
        chain = re.split(r"\s*(?:\.|::)\s*", m["chain"])
        line = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
        named = any(d["name"] == chain[-1] and d["sb"] <= m.start("chain") < d["sb"] + 200 and "{" not in code[d["sb"] : m.start("chain")] for d in facts["defs"]) if len(chain) == 1 else False
        if chain[0] in NOT_CALLS or named or m.start("chain") in heads or re.search(r"\b(?:function|fn|func|def)\s*$|^\s*#?\[\s*$", line):
            continue
        facts["calls"].append(a_call(chain, m.start("chain"), bool(m["new"])))


def extract_ts(text: str, lang: str) -> dict:
    facts = empty_facts(text)
    code, bare = blank_comments(text, "c", strings=True), blank_comments(text, "c")
    facts["moduleSummary"] = header_doc(text, "c")
    for m in re.finditer(rf"^[ \t]*import\s+(?:type\s+)?(?:(?P<def>{ID})\s*,?\s*)?(?:\*\s*as\s+(?P<ns>{ID})|\{{(?P<names>[^}}]*)\}})?\s*(?:from\s*)?['\"](?P<spec>[^'\"]+)['\"]", bare, re.M):
        names = [(a, b or None) for a, b in re.findall(rf"(?:type\s+)?({ID})(?:\s+as\s+({ID}))?", m["names"] or "")]
        facts["imports"].append(an_import(m["spec"], names, m["ns"], m["def"]))
    required = set()
    for m in re.finditer(rf"\b(?:const|let|var)\s+(?:(?P<ns>{ID})|\{{(?P<names>[^}}]*)\}})\s*=\s*require\(\s*['\"](?P<spec>[^'\"]+)['\"]\s*\)", bare):
        names = [(a, b or None) for a, b in re.findall(rf"({ID})(?:\s*:\s*({ID}))?", m["names"] or "")]
        facts["imports"].append(an_import(m["spec"], names, m["ns"]))
        required.add(m["ns"])
    for m in re.finditer(r"^[ \t]*export\s+(?:type\s+)?(?:(?P<all>\*)(?:\s+as\s+\w+)?|\{(?P<names>[^}]*)\})\s*from\s*['\"](?P<spec>[^'\"]+)['\"]", bare, re.M):
        entries = [{"exported": b or a, "origin": a} for a, b in re.findall(rf"({ID})(?:\s+as\s+({ID}))?", m["names"] or "")]
        facts["reexports"].append({"spec": m["spec"], "wildcard": bool(m["all"]), "entries": entries})
    _scan_defs(text, code, lang, TS_DEFS, facts)
    _scan_calls(code, facts)
    facts["calls"] = [c for c in facts["calls"] if c["calleeText"] != "require"]
    for m in re.finditer(rf"\b(?:app|router|server|api|fastify)\.(?P<verb>{'|'.join(VERBS)})\(\s*['\"`](?P<path>[^'\"`]*)['\"`]", bare):
        facts["routes"].append(a_route(m["verb"], m["path"], text, m.start(), m.end(), "exact"))
    facts["locals"] = [{"name": m[1], "sb": m.start(1)} for m in re.finditer(rf"\b(?:const|let|var)\s+({ID})", code) if m[1] not in required and not any(d["name"] == m[1] and d["sb"] <= m.start() < d["eb"] for d in facts["defs"])]
    return finish(facts)


def extract_go(text: str) -> dict:
    facts = empty_facts(text)
    code, bare = blank_comments(text, "c", strings=True), blank_comments(text, "c")
    facts["moduleSummary"] = header_doc(text, "c")
    if m := re.search(r"^package\s+(\w+)", code, re.M):
        facts["packageName"] = m[1]
    for m in re.finditer(r"^import\s+(?:\((?P<block>[^)]*)\)|(?P<one>(?:[\w.]+\s+)?\"[^\"]+\"))", bare, re.M):
        for alias, spec in re.findall(r"(?:^|\s)(?:([\w.]+)\s+)?\"([^\"]+)\"", m["block"] or m["one"]):
            facts["imports"].append(an_import(spec, ns=alias or None))
    _scan_defs(text, code, "go", GO_DEFS, facts)
    _scan_calls(code, facts)
    for m in re.finditer(r"\b\w+\.(?P<verb>(?i:get|post|put|delete|patch|head|options))\(\s*\"(?P<path>/[^\"]*)\"", bare):
        facts["routes"].append(a_route(m["verb"], m["path"], text, m.start(), m.end(), "heuristic"))
    ifaces = [d for d in facts["defs"] if d["kind"] == "interface"]
    facts["calls"] = [c for c in facts["calls"] if not enclosing(ifaces, c["sb"])]
    facts["locals"] = [{"name": x.strip(), "sb": m.start()} for m in re.finditer(r"^\s*(?:var\s+)?([\w, ]+?)\s*:?=(?!=)", code, re.M) for x in m[1].split(",") if x.strip().isidentifier()]
    return finish(facts)


def use_tree(text: str) -> list[tuple[list[str], str | None, bool]]:
    """(segments, alias, wildcard) of each leaf of a Rust use tree."""
    text = " ".join(text.split())
    if m := re.match(r"^(.*?)(?:::)?\{(.*)\}$", text):
        head, depth, part, parts = m[1], 0, "", []
        for c in m[2] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(part.strip())
                part = ""
            else:
                part += c
        lead = [s for s in head.split("::") if s]
        return [(lead if seg == ["self"] else lead + seg, alias, star) for p in parts if p for seg, alias, star in use_tree(p)]
    path, _, alias = text.partition(" as ")
    segs = [s.strip() for s in path.split("::") if s.strip()]
    return [(segs[:-1], None, True)] if segs[-1:] == ["*"] else [(segs, alias.strip() or None, False)]


def extract_rust(text: str) -> dict:
    facts = empty_facts(text)
    code, bare = blank_comments(text, "c", strings=True), blank_comments(text, "c")
    for m in re.finditer(rf"^[ \t]*(?:{_VIS})?use\s+([^;]+);", code, re.M):
        for segs, alias, star in use_tree(m[1]):
            facts["imports"].append(an_import("::".join(segs), ns=alias, wildcard=star, segments=segs))
    for m in re.finditer(rf"^[ \t]*(?:{_VIS})?mod\s+({ID})\s*;", code, re.M):
        facts["imports"].append(an_import(f"self::{m[1]}", segments=["self", m[1]]))
    _scan_defs(text, code, "rust", RUST_DEFS, facts)
    _scan_calls(code, facts)
    for m in re.finditer(rf"#\[(?:\w+::)?(?P<verb>{'|'.join(VERBS)})\(\s*\"(?P<path>[^\"]*)\"", bare):
        after = re.compile(r"\bfn\s").search(code, m.end())
        facts["routes"].append(a_route(m["verb"], m["path"], text, m.start(), m.end(), "exact", after.start() if after else None))
    for m in re.finditer(rf"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?:\w+::)*(?P<verb>{'|'.join(VERBS)})\(", bare):
        facts["routes"].append(a_route(m["verb"], m["path"], text, m.start(), m.end(), "heuristic"))
    facts["locals"] = [{"name": m[1], "sb": m.start(1)} for m in re.finditer(rf"\blet\s+(?:mut\s+)?({ID})", code)]
    return finish(facts)


def extract_java(text: str) -> dict:
    facts = empty_facts(text)
    code, bare = blank_comments(text, "c", strings=True), blank_comments(text, "c")
    facts["moduleSummary"] = header_doc(text, "c")
    if m := re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M):
        facts["packageName"] = m[1]
    for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", code, re.M):
        facts["imports"].append(an_import(m[2], static=bool(m[1]), wildcard=bool(m[3]), segments=m[2].split(".")))
    _scan_defs(text, code, "java", JAVA_DEFS, facts)
    _scan_calls(code, facts)
    prefix = re.search(r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"\s*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+)?class", bare)
    for m in re.finditer(r"@(?P<verb>Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(?P<path>[^\"]*)\"[^)]*\))?", bare):
        after = re.compile(r"\w+\s*\([^)]*\)\s*(?:throws[^{]*)?\{").search(code, m.end())
        path = "/".join(["", *[p.strip("/") for p in ((prefix[1] if prefix else ""), m["path"] or "") if p.strip("/")]])
        facts["routes"].append(a_route(m["verb"], path, text, m.start(), m.end(), "exact", after.start() if after else None))
    facts["locals"] = [{"name": m[1], "sb": m.start(1)} for m in re.finditer(rf"^\s+(?:final\s+)?[\w.<>\[\]]+\s+({ID})\s*=(?!=)", code, re.M)]
    return finish(facts)


def extract_csharp(text: str) -> dict:
    facts = empty_facts(text)
    code, bare = blank_comments(text, "c", strings=True), blank_comments(text, "c")
    if m := re.search(r"^\s*namespace\s+([\w.]+)", code, re.M):
        facts["namespace"] = m[1]
    for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", code, re.M):
        facts["imports"].append(an_import(m[2], ns=m[1]))
        facts["testFramework"] |= bool(re.match(r"(?:Xunit|NUnit|Microsoft\.VisualStudio\.TestTools)\b", m[2]))
    _scan_defs(text, code, "csharp", CSHARP_DEFS, facts)
    _scan_calls(code, facts)
    owner = re.search(r"\[Route\(\s*\"([^\"]*)\"\s*\)\][^{]*?class\s+(\w+?)(?:Controller)?\b", bare)
    lead = owner[1].replace("[controller]", owner[2]) if owner else ""
    for m in re.finditer(r"\[Http(?P<verb>Get|Post|Put|Delete|Patch)(?:\(\s*\"(?P<path>[^\"]*)\"[^)]*\))?\]", bare):
        after = re.compile(rf"{ID}\s*\(").search(code, m.end())
        path = "/".join(["", *[p.strip("/") for p in (lead, m["path"] or "") if p.strip("/")]])
        facts["routes"].append(a_route(m["verb"], path, text, m.start(), m.end(), "exact", after.start() if after else None))
    for m in re.finditer(r"\.Map(?P<verb>Get|Post|Put|Delete|Patch)\(\s*\"(?P<path>[^\"]*)\"", bare):
        facts["routes"].append(a_route(m["verb"], m["path"], text, m.start(), m.end(), "exact"))
    facts["locals"] = [{"name": m[1], "sb": m.start(1)} for m in re.finditer(rf"^\s+(?:var|[\w.<>\[\]]+\??)\s+({ID})\s*=(?!=|>)", code, re.M)]
    return finish(facts)


def extract_unknown(text: str) -> dict:
    """Top-level brace blocks with a name, as rough symbols."""
    facts = empty_facts(text)
    code, at, depth = blank_comments(text, "c", strings=True), 0, 0
    for line in code.split("\n"):
        m = re.match(rf"\s*(?:(?:\w+)\s+)*?(?:(?P<kw>class|struct|interface|module|namespace|enum|trait|object|protocol|func|function|fun|def|sub|proc)\s+(?P<name>{ID})|(?P<fn>{ID})\s*\((?P<params>[^)]*)\)\s*\{{)", line)
        if not depth and m and (m["name"] or m["fn"]) not in NOT_CALLS and (m["fn"] or "{" in code[at : at + 400]):
            name = m["name"] or m["fn"]
            eb = _end(code, at + m.end() - (1 if m["fn"] else 0))
            facts["defs"].append(a_def("symbol", name, text, at, eb, f"{m['kw']} {name}" if m["kw"] else f"{name}({flat(m['params'])})", False))
        depth = max(0, depth + line.count("{") - line.count("}"))
        at += len(line) + 1
    return finish(facts)


def extract_file(path: str, text: str) -> dict:
    lang = SYMBOL_LANGS.get(path.rpartition(".")[2].lower())
    text = canonical(text)
    scanners = {"python": extract_python, "go": extract_go, "rust": extract_rust, "java": extract_java, "csharp": extract_csharp}
    facts = scanners[lang](text) if lang in scanners else extract_ts(text, lang) if lang else extract_unknown(text)
    return {"path": path, "lang": lang or "unknown", "hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "size": len(text.encode("utf-8", "surrogatepass")), **facts}


def extract(files: DataFrame) -> DataFrame:
    """Facts of each file(path, content string), the files dealt out over all cores first: their tables are small beside the work."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([extract_file(p, t or "") for p, t in zip(frame["path"], frame["content"])])[NAMES] if len(frame) else pd.DataFrame(columns=NAMES)

    return spread(files.select("path", "content"), "path").mapInPandas(run, FACTS)


NAMES = ["path", "lang", "hash", "size", "lineCount", "moduleSummary", "packageName", "namespace", "testFramework", "defs", "imports", "reexports", "calls", "heritage", "routes", "locals"]
