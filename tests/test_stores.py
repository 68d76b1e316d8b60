"""Working trees, overlays, ledgers and snapshots on disk."""

import json
import os
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import notes, search
from strandline.sources import files, git


def run(root, *a):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    run(root, "init", "-q", "-b", "main")
    for name, text in {"a.py": "x = 1\n", ".hidden/b.py": "y = 2\n", "build/out.js": "z\n", ".gitignore": "build/\n", "gone.py": "g\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    run(root, "add", "-A")
    run(root, "commit", "-qm", "one")
    (root / "gone.py").unlink()
    (root / "new.py").write_text("n\n")
    (root / "big.py").write_text("b" * 600_000)
    return root


def test_trees_are_listed_as_git_sees_them(spark, repo):
    rows = {r.path: r for r in files.tracked_listing(spark, str(repo)).collect()}
    assert set(rows) == {"a.py", ".hidden/b.py", ".gitignore", "gone.py", "new.py", "big.py"}
    assert rows["gone.py"].size is None and rows["big.py"].content is None and bytes(rows["a.py"].content) == b"x = 1\n"
    kept, dropped = files.scan_listing(files.tree_listing(spark, f"file://{repo}"))
    assert {r.path for r in kept.collect()} == {"a.py", ".hidden/b.py", ".gitignore", "new.py"}
    assert dict(map(tuple, dropped.collect())) == {"gone": 1, "big": 1}


def test_a_tree_without_git_is_walked(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.py").write_text("x")
    found, degraded = files.tracked_paths(str(tmp_path))
    assert found == ["d/x.py"] and degraded


def test_tracking_and_the_overlay_file(spark, repo, tmp_path):
    bare = tmp_path / "up.git"
    run(tmp_path, "init", "-q", "--bare", str(bare))
    run(repo, "remote", "add", "origin", str(bare))
    assert git.tracking(str(repo))["upstream"] is None and git.tracking(str(repo))["notes"]
    run(repo, "push", "-qu", "origin", "main")
    (repo / "a.py").write_text("x = 2\n")
    run(repo, "commit", "-qam", "two")
    about = git.tracking(str(repo))
    assert (about["branch"], about["ahead"], about["behind"], about["tracked"], about["notes"]) == ("main", 1, 0, 3, [])
    worst, _ = git.overlay(spark.createDataFrame([("a.py", "unpushed"), ("new.py", "untracked")], "path string, state string"), about["tracked"])
    git.save_git_overlay(spark, worst, about, f"file://{tmp_path}/overlays/git.json")
    said = json.loads((tmp_path / "overlays" / "git.json").read_text())
    assert said["files"] == {"a.py": "unpushed", "new.py": "untracked"} and said["counts"]["pushed"] == 2 and said["ahead"] == 1
    with pytest.raises(ValueError):
        git.tracking(str(tmp_path))


def test_relations_are_read_page_by_page():
    pages = {None: {"nodes": [{"number": 1, "databaseId": 9, "blockedBy": {"nodes": [{"number": 2, "state": "OPEN"}]}}], "pageInfo": {"hasNextPage": True, "endCursor": "c"}}, "c": {"nodes": [{"number": 2, "subIssues": {"nodes": [{"number": 3}]}}], "pageInfo": {}}}
    got = git.issue_relations(pages.get)
    assert got[1]["blockedByState"] == {2: "open"} and got[2]["subs"] == [3] and set(got) == {1, 2}
    assert git.issue_relations({None: pages[None]}.get) is None


def test_ledgers_have_one_writer_at_a_time(spark, tmp_path):
    path, kind = f"file://{tmp_path}/ledger", "key string, text string"
    assert notes.append(path, spark.createDataFrame([("a", "x"), ("b", "y")], kind)) == 0
    both = [threading.Thread(target=notes.append, args=(path, spark.createDataFrame([(k, k)], kind))) for k in "cd"]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
    with notes.ledger_lock(spark, path), pytest.raises(notes.LedgerLocked), notes.ledger_lock(spark, path, attempts=3):
        pass
    with notes.ledger_lock(spark, path):  # a lock as old as this one is taken for abandoned
        with notes.ledger_lock(spark, path, attempts=40, steal_after_ms=1):
            pass


def test_of_writers_at_one_moment_one_gets_the_lock(spark, tmp_path):
    path, start, end = f"file://{tmp_path}/new/ledger", threading.Barrier(6), threading.Barrier(6)
    held = []

    def one(turn):
        start.wait(60)
        try:
            with notes.ledger_lock(spark, path, attempts=1):
                held.append(turn)
                end.wait(60)
        except notes.LedgerLocked:
            end.wait(60)

    for turn in range(25):
        each = [threading.Thread(target=one, args=(turn,)) for _ in range(6)]
        for t in each:
            t.start()
        for t in each:
            t.join()
    assert held == list(range(25))


def test_a_lock_in_use_is_not_taken_for_abandoned(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    with notes.ledger_lock(spark, path, steal_after_ms=2_000):
        time.sleep(2.5)
        with pytest.raises(notes.LedgerLocked), notes.ledger_lock(spark, path, attempts=20, steal_after_ms=2_000):
            pass


def test_an_abandoned_lock_goes_to_one_writer(spark, tmp_path):
    path, start, end = f"file://{tmp_path}/ledger", threading.Barrier(6), threading.Barrier(6)
    held = []

    def one(turn):
        start.wait(60)
        try:
            with notes.ledger_lock(spark, path, attempts=4, steal_after_ms=5_000):
                held.append(turn)
                end.wait(60)
        except notes.LedgerLocked:
            end.wait(60)

    for turn in range(10):
        (tmp_path / "ledger.lock").touch()
        os.utime(tmp_path / "ledger.lock", (1, 1))
        each = [threading.Thread(target=one, args=(turn,)) for _ in range(6)]
        for t in each:
            t.start()
        for t in each:
            t.join()
    assert held == list(range(10))


def test_a_snapshot_stays_whole_while_the_next_one_is_written(spark, tmp_path):
    root, one, two = f"file://{tmp_path}", spark.range(1), spark.range(2)
    files.save_snapshot({"n": one}, root, "s")
    broken = two.select(F.raise_error(F.lit("crash")).cast("long").alias("id"))
    with pytest.raises(Exception, match="crash"):
        files.save_snapshot({"a": two, "n": broken}, root, "s")
    assert files.read_snapshot(spark, root, "s", "n").count() == 1
    files.save_snapshot({"n": two}, root, "s")
    assert files.read_snapshot(spark, root, "s", "n").count() == 2
    with pytest.raises(ValueError):
        files.read_snapshot(spark, root, "s", "n", version=0)


def test_a_stored_index_gives_the_same_hits(spark, tmp_path):
    n = spark.createDataFrame([("f1", "parseThing", "def parse_thing(x)", "parses"), ("f2", "other", "def other()", "no thing"), ("f3", "z", None, None)], "id string, name string, sig string, summary string")
    index = search.bm25_index(n, f"file://{tmp_path}/i")
    here = search.locate(n, "parse thing").collect()
    assert search.locate(n, "parse thing", index=search.open_bm25_index(spark, f"file://{tmp_path}/i")).collect() == search.locate(n, "parse thing", index=index).collect() == here != []
    text = index[0].filter(F.col("term").isin(["parse"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in text or "EqualTo(term,parse)" in text
