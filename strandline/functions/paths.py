"""Path predicates and classifications as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import col

FILE_LANGS = {
    "ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "py": "py", "go": "go",
    "rs": "rs", "java": "java", "cs": "cs", "md": "md", "mdx": "md", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "html": "html", "css": "css", "sh": "sh", "sql": "sql",
}
SYMBOL_LANGS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp",
}
TEST_FILE = (
    r"[.](?:spec|test)[.](?:c|m)?(?:js|ts)x?$", r"(?:^|/)(?:test_[^/]*|[^/]*_test)[.]py$", r"_test[.]go$", r"(?:^|/)tests/[^/]*[.]rs$",
    r"(?:^|/)src/test/java/", r"(?i)(?:^|/|[.])[^/]*tests?[.]cs$",
)
TEST_SUBJECT = (
    r"^(.+)[.](?:spec|test)[.]\w+$", r"^test_(.+)[.]py$", r"^(.+)_test[.](?:rs|py|go)$", r"^(.+)Test[.]java$",
)
ENTRY_NAMES = (
    "index.html", "main.ts", "main.js", "main.py", "main.go", "main.rs", "server.ts", "server.js", "app.ts", "app.js", "app.py", "cli.ts", "cli.js",
    "__main__.py", "manage.py", "Program.cs", "Main.java",
)
IGNORED_DIRS = ("node_modules", "vendor", "dist", "build", "target", "__pycache__")
TS_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
DATA_EXTENSIONS = (
    "json jsonl csv tsv lock map svg png jpg jpeg gif webp ico pdf zip gz tar tgz bz2 xz 7z rar woff woff2 ttf otf eot mp3 mp4 mov avi wav ogg "
    "webm bin exe dll so dylib class jar war pyc pyo wasm o a obj db sqlite sqlite3 parquet avro orc feather npy npz pkl pt onnx h5 xlsx xls docx "
    "doc pptx ppt md txt log yml yaml toml xml html css scss less"
).split()


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ** crosses directories, * and ? do not."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def basename(p) -> Column:
    return F.element_at(F.split(col(p), "/"), -1)


def dirname(p) -> Column:
    return F.regexp_replace(col(p), r"/?[^/]*$", "")


def matches_globs(p, globs: list[str]) -> Column:
    """True where the whole path or its base name matches a glob; one alternation for all of them."""
    if not globs:
        return F.lit(False)
    pattern = "|".join(glob_regex(g) for g in globs)
    return col(p).rlike(pattern) | basename(p).rlike(pattern)


def extension(p) -> Column:
    return F.lower(F.regexp_extract(basename(p), r"\.([A-Za-z0-9]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def file_lang(p) -> Column:
    return F.coalesce(_lookup(extension(p), FILE_LANGS), F.lit("text"))


def symbol_lang(p) -> Column:
    return _lookup(extension(p), SYMBOL_LANGS)


def is_test_file(p) -> Column:
    return col(p).rlike("|".join(f"(?:{x})" if not x.startswith("(?i)") else f"(?i:{x[4:]})" for x in TEST_FILE))


def test_subject(p) -> Column:
    """The stem that a test file's base name names, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(basename(p), x, 1), F.lit("")) for x in TEST_SUBJECT])


def is_adr(p) -> Column:
    return col(p).rlike(r"(?i)(^|/)(adr|adrs|decisions)/[^/]*\.mdx?$")


def node_type(p, entries: list[str] | None = None, globs: list[str] | None = None) -> Column:
    """adr, entry or file."""
    p = col(p)
    entry = basename(p).isin(*ENTRY_NAMES) | p.rlike(r"(^|/)cmd/[^/]+/main\.go$")
    if entries:
        entry = entry | p.isin(*entries)
    return F.when(is_adr(p), "adr").when(entry | matches_globs(p, globs or []), "entry").otherwise("file")


def drop_reason(p, length, head, skill_dirs: list[str], globs: list[str], most_kb: int = 512, sniff: int = 8000) -> Column:
    """Why a listed file is not scanned, the first reason that holds, or null. A null length is a file that is gone."""
    in_skill = F.lit(False)
    for d in skill_dirs:
        in_skill = in_skill | col(p).startswith(d.rstrip("/") + "/")
    return (
        F.when(in_skill, "skill").when(matches_globs(p, globs), "ignored").when(col(length).isNull(), "gone")
        .when(col(length) > most_kb * 1024, "big").when(is_binary(head, sniff), "binary")
    )


def is_binary(content, sniff: int = 8000) -> Column:
    """A NUL byte among the first bytes: 8000 for the file engine, 8192 for the symbol engine."""
    return F.contains(F.substring(col(content), 1, sniff), F.lit(b"\0"))


def keeps_source(p, ignored: list[str] | None = None) -> Column:
    """The symbol walk keeps a path: no ignored or dot directory, not minified, known extension or not a data one."""
    dirs = F.slice(F.split(col(p), "/"), 1, F.size(F.split(col(p), "/")) - 1)
    bad = F.exists(dirs, lambda d: d.isin(*IGNORED_DIRS, *(ignored or [])) | d.startswith("."))
    return ~bad & ~basename(p).rlike(r"\.min\.[A-Za-z0-9]+$") & (symbol_lang(p).isNotNull() | ~extension(p).isin(*DATA_EXTENSIONS))


def join_posix(base, rel) -> Column:
    """base directory / rel with . and .. resolved; .. at the root stays there."""
    parts = F.split(F.concat_ws("/", col(base), col(rel)), "/")

    def step(acc, x):
        return (
            F.when((x == "") | (x == "."), acc)
            .when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1))
            .when(x == "..", acc)
            .otherwise(F.concat(acc, F.array(x)))
        )

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def ancestors(p) -> Column:
    """Directories above a path, the nearest first; the root is not among them."""
    parts = F.split(col(p), "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def has_parent(p) -> Column:
    return F.contains(col(p), F.lit("/"))


def module_id(p, lang) -> Column:
    """Module name of a file: dotted for Python, a package for its __init__, else the path without extension."""
    p = col(p)
    bare = F.regexp_replace(p, r"\.[A-Za-z0-9]+$", "")
    dotted = F.regexp_replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), "/", ".")
    return F.when(col(lang) == "python", dotted).otherwise(bare)


def convention_test_target(p, lang) -> Column:
    """Path that a test file tests by name, or null."""
    p, lang = col(p), col(lang)
    java = F.regexp_replace(F.regexp_replace(p, r"(^|/)src/test/java/", "$1src/main/java/"), r"Test\.java$", ".java")
    return (
        F.when(lang.isin("typescript", "tsx", "javascript") & p.rlike(TEST_FILE[0]), F.regexp_replace(p, r"[.](?:spec|test)([.](?:c|m)?(?:js|ts)x?)$", "$1"))
        .when((lang == "python") & basename(p).rlike(r"^test_"), F.concat(F.regexp_extract(p, r"^(.*/)?", 0), F.regexp_replace(basename(p), r"^test_", "")))
        .when((lang == "python") & p.rlike(r"_test\.py$"), F.regexp_replace(p, r"_test\.py$", ".py"))
        .when((lang == "go") & p.rlike(r"_test\.go$"), F.regexp_replace(p, r"_test\.go$", ".go"))
        .when((lang == "java") & p.rlike(r"Test\.java$"), java)
        .when((lang == "csharp") & p.rlike(r"(?i)tests?\.cs$"), F.regexp_replace(p, r"(?i)\.?tests?\.cs$", ".cs"))
    )


def tags(p, lang, depth: int = 2) -> Column:
    """Sorted tags: the first directories, test, doc, and the language."""
    p = col(p)
    dirs = F.slice(F.split(p, "/"), 1, F.least(F.lit(depth), F.size(F.split(p, "/")) - 1))
    own = F.array(F.when(is_test_file(p), "test"), F.when(col(lang) == "md", "doc"), col(lang))
    return F.array_sort(F.array_distinct(F.filter(F.concat(dirs, own), lambda x: x.isNotNull() & (x != ""))))
