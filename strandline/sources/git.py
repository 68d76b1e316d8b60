"""Version-control and issue overlays: parsers, and Python data sources over command output."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.operators.graph import state_counters, worst_state
from strandline.schemas import GIT_RANK
from strandline.sources.files import publish


def porcelain_states(raw: str) -> list[tuple[str, str]]:
    """(path, state) of `git status --porcelain=v1 -z`: renames take two fields, directories are left out."""
    fields, out, i = raw.split("\0"), [], 0
    while i < len(fields):
        entry = fields[i]
        i += 1
        if len(entry) < 4:
            continue
        x, y, path = entry[0], entry[1], entry[3:]
        if x in "RC":
            i += 1
        if path.endswith("/"):
            continue
        if x + y in ("DD", "AA", "UU", "AU", "UA", "DU", "UD"):
            state = "conflicted"
        elif x + y == "??":
            state = "untracked"
        elif y not in " ":
            state = "modified"
        else:
            state = "staged"
        out.append((path, state))
    return out


def log_commits(raw: str) -> list[tuple[int, str, str, list[str]]]:
    """(seq, subject, body, files) of a log framed by NULs: subject, body, files of each commit."""
    fields = raw.split("\0")
    return [(n, s.strip(), b.strip(), sorted(f for f in files.split("\n") if f.strip())) for n, (s, b, files) in enumerate(zip(fields[0::3], fields[1::3], fields[2::3]))]


class _Repo(InputPartition):
    def __init__(self, root: str) -> None:
        super().__init__(root)


class GitStatusReader(DataSourceReader):
    """One partition a working tree: a tree is read where its files are."""

    def __init__(self, roots: list[str]) -> None:
        self.roots = roots

    def partitions(self):
        return [_Repo(r) for r in self.roots]

    def read(self, partition):
        root = partition.value
        run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=False).stdout
        for path, state in porcelain_states(run("status", "--porcelain=v1", "-z")):
            yield root, path, state
        for path in run("diff", "--name-only", "-z", "@{upstream}...HEAD").split("\0"):
            if path:
                yield root, path, "unpushed"


class GitStatusSource(DataSource):
    """Format git_status; option roots: working trees, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "git_status"

    def schema(self) -> str:
        return "root string, path string, state string"

    def reader(self, schema) -> DataSourceReader:
        return GitStatusReader([r for r in self.options["roots"].split(",") if r])


def tracking(root: str) -> dict:
    """Branch, upstream, commits ahead and behind, tracked files and notes of a working tree."""

    def run(*a):
        done = subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=False)
        return done.stdout if done.returncode == 0 else None

    if run("rev-parse", "--is-inside-work-tree") is None:
        raise ValueError(f"{root} is no working tree of git")
    branch = (run("rev-parse", "--abbrev-ref", "HEAD") or "").strip() or None
    begun = run("rev-parse", "--verify", "HEAD") is not None
    upstream = (run("rev-parse", "--abbrev-ref", "--symbolic-full-name", "@{upstream}") or "").strip() or None
    ahead = behind = 0
    remarks = []
    if not begun:
        remarks.append("no commit yet: nothing can be pushed")
    elif upstream is None:
        remarks.append("no upstream: only changes of the working tree are known")
    elif (counted := run("rev-list", "--left-right", "--count", f"{upstream}...HEAD")) is not None:
        behind, ahead = map(int, counted.split())
    tracked = sum(1 for x in (run("ls-files", "-z") or "").split("\0") if x)
    return {"branch": None if branch == "HEAD" else branch, "detached": branch == "HEAD", "upstream": upstream, "ahead": ahead, "behind": behind, "tracked": tracked, "notes": remarks}


def save_git_overlay(spark: SparkSession, worst: DataFrame, about: dict, path: str, version: int = 1) -> None:
    """One JSON file of what git adds: listed states other than pushed, counters, branch. Listed files are a working tree's changes."""
    listed = {r["path"]: r["state"] for r in worst.filter("state != 'pushed'").orderBy("path").collect()}
    counts = {r["state"]: r["n"] for r in state_counters(worst, about["tracked"]).collect()}
    own = {k: v for k, v in about.items() if k != "tracked"}
    publish(spark, path, json.dumps({"v": version, **own, "files": listed, "default": "pushed", "counts": {s: counts.get(s, 0) for s in GIT_RANK}}, indent=1))


def save_issue_overlay(issues: DataFrame, path: str) -> None:
    """Issues, one JSON line each, in order of number."""
    issues.orderBy("number").write.mode("overwrite").json(path)


def issue_relations(call, most_pages: int = 50) -> dict[int, dict] | None:
    """Blockers and sub-issues of every issue, by pages of 100; None where a page fails, so that no half answer passes for a whole one.

    call(cursor) gives a page of the tracker's GraphQL answer: pageInfo and nodes.
    """
    found, cursor = {}, None
    for _ in range(most_pages):
        page = call(cursor)
        if not page:
            return None
        for n in page.get("nodes") or []:
            blockers = (n.get("blockedBy") or {}).get("nodes") or []
            found[n["number"]] = {
                "dbid": n.get("databaseId"), "blockedBy": [x["number"] for x in blockers],
                "blockedByState": {x["number"]: str(x["state"]).lower() for x in blockers}, "subs": [x["number"] for x in (n.get("subIssues") or {}).get("nodes") or []],
            }
        info = page.get("pageInfo") or {}
        if not info.get("hasNextPage"):
            return found
        cursor = info["endCursor"]
    return found


def overlay(states: DataFrame, tracked: int) -> tuple[DataFrame, DataFrame]:
    """(worst state of each path, counters): what git adds to a file graph."""
    worst = worst_state(states.select("path", "state"))
    return worst, state_counters(worst, tracked)


def state_of(nodes: DataFrame, worst: DataFrame, default: str = "pushed") -> DataFrame:
    """(id, state) of nodes by their key, with a default."""
    return nodes.select("id", F.col("k").alias("path")).join(worst, "path", "left").select("id", F.coalesce("state", F.lit(default)).alias("state"))


class IssuePageReader(DataSourceReader):
    """Pages of an issue listing stored as JSON files: one partition a page."""

    def __init__(self, pages: list[str]) -> None:
        self.pages = pages

    def partitions(self):
        return [_Repo(p) for p in self.pages]

    def read(self, partition):
        with open(partition.value) as f:
            for x in json.load(f):
                names = lambda key, field: [y[field] if isinstance(y, dict) else y for y in x.get(key) or []]
                yield (x["number"], x.get("title"), (x.get("state") or "").lower(), names("labels", "name"), names("assignees", "login"), x.get("body"), x.get("url"), [int(b) for b in names("blockedBy", "number")], [int(b) for b in names("subs", "number")])


class IssueSource(DataSource):
    """Format issue_pages; option pages: JSON files on shared storage, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "issue_pages"

    def schema(self) -> str:
        return "number int, title string, state string, labels array<string>, assignees array<string>, body string, url string, blockedBy array<int>, subs array<int>"

    def reader(self, schema) -> DataSourceReader:
        return IssuePageReader([p for p in self.options["pages"].split(",") if p])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitStatusSource)
    spark.dataSource.register(IssueSource)


def link_issues(blocker: int, blocked: int, post) -> str:
    """Ask the tracker to record a dependency, on the driver alone; post(blocker, blocked) gives an HTTP status."""
    status = post(blocker, blocked)
    if status in (200, 201):
        return "linked"
    if status == 422:
        return "already linked"
    raise RuntimeError(f"the tracker answered {status}")
