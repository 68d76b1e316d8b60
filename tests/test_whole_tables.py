"""Registered queries against brute force over whole tables: no subset of ids, no cut of hops."""

from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from strandline.operators import traversal
from strandline.plans import bindings, registry
from tests.compare import check, tables

SF = "/root/testdata/sf0.001"


def read(sql, sf=SF):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetchall()


def pairs(sf=SF):
    """All parts of consecutive lines, by a loop over the rows."""
    parts = defaultdict(set)  # an order can hold a line number more than once
    for o, n, p in read("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem", sf):
        parts[o, n].add(p)
    return {(p, q) for (o, n), here in list(parts.items()) for p in here for q in parts.get((o, n + 1), ()) if p != q}


def bfs(edges, seeds, most=10**9):
    onward = defaultdict(set)
    for a, b in edges:
        onward[a].add(b)
    hops, level, hop = {s: 0 for s in seeds}, set(seeds), 0
    while level and hop < most:
        hop += 1
        level = {b for a in level for b in onward[a]} - set(hops)
        hops |= {x: hop for x in level}
    return hops


def test_chain_holds_all_consecutive_parts(spark):
    assert {tuple(r) for r in bindings.part_chain(spark, SF).collect()} == pairs()


def test_layers_have_no_last_round(spark):
    n = 6
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(-1, -2), (-2, -1), (-2, -3)], "src long, dst long")
    ids = spark.createDataFrame([(i,) for i in range(-3, n + 1)], "id long")
    got = {r["id"]: r["layer"] for r in traversal.mutual_reach_layers(e, ids).collect()}
    assert got == {i: max(i, 0) if i >= 0 else n + 1 for i in range(-3, n + 1)}


def test_dependents_of_all_changed_nodes(spark):
    """Two nearest sources against a walk from every source."""
    import random

    from strandline.operators import notes

    rng = random.Random(5)
    e = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    e = {(a, b, rng.choice(("exact", "heuristic"))) for a, b in e if a != b}
    for changed in ([3], [1, 2, 5, 9, 14], list(range(30))):
        want = {}
        for s in changed:
            every, sure = bfs({(b, a) for a, b, _ in e}, [s]), bfs({(b, a) for a, b, c in e if c == "exact"}, [s])
            for x, hop in every.items():
                if x != s:
                    was = want.get(x, (99, "heuristic"))
                    want[x] = (min(hop, was[0]), "exact" if x in sure or was[1] == "exact" else "heuristic")
        frame = spark.createDataFrame([(a, b, "call", c) for a, b, c in sorted(e)], "src long, dst long, type string, confidence string")
        got = notes.drift_dependents(frame, spark.createDataFrame([(x,) for x in changed], "id long")).collect()
        assert {r["id"]: (r["hop"], r["confidence"]) for r in got} == want


def test_best_chain_over_dense_and_thin_graphs(spark):
    e = {(3, 9), (9, 3), (2, 3), (7, 2), (4, 2), (2, 4), (9, 4), (1, 4), (5, 1)}
    chains, every = [(3,)], []
    while chains:
        every += chains
        chains = [(a, *c) for c in chains for a, b in e if b == c[0] and a not in c and len(c) < 6]
    frame, ids = spark.createDataFrame(sorted(e), "src long, dst long"), lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    for tops in ((9, 1), (100,)):
        want = min(every, key=lambda c: (-(1000 * (c[0] in tops) + len(c)), c))
        got = traversal.longest_up_path(frame, 3, ids(*tops), 6).first()
        assert (tuple(got["path"]), got["score"]) == (want, 1000 * (want[0] in tops) + len(want))


def test_walks_go_as_far_as_the_operators_say(spark, monkeypatch):
    line = spark.createDataFrame([(i, i + 1) for i in range(1, 41)], "src long, dst long")
    monkeypatch.setattr(bindings, "part_chain", lambda *_: line)
    far = lambda name, column="hop": max(r[column] for r in registry.queries()[name](spark, SF).collect())
    assert far("reach_down") == 40 and far("impact_down") == 32
    back = spark.createDataFrame([(i + 1, i) for i in range(1, 41)], "src long, dst long")
    monkeypatch.setattr(bindings, "part_chain", lambda *_: back)
    assert far("importers_by_hop") == 32


def test_symbols_whose_six_digits_collide(spark, tmp_path):
    """b140 and b1517 share the first six digits: neither may go."""
    pq.write_table(pa.table({"p_partkey": [140, 1517]}), tmp_path / "part.parquet")
    check(spark, tables(tmp_path), str(tmp_path), registry.queries()["expanded_symbols"], registry.oracle_sql()["expanded_symbols"])
