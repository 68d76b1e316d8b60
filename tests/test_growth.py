"""Steps whose cost at size the plan or a small case shows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.plans import registry
from tests.compare import check, tables
from tests.test_plans import plan


@pytest.fixture(scope="module")
def many_parts(tmp_path_factory):
    """Parts in a file of some MB, which Spark would still broadcast after they exploded into candidates."""
    at, n = tmp_path_factory.mktemp("parts"), 300_000
    pq.write_table(pa.table({"p_partkey": range(n), "p_name": ["n"] * n, "p_brand": ["b"] * n, "p_type": ["t"] * n, "p_size": pa.array([1] * n, pa.int32()), "p_retailprice": [1.0] * n}), at / "part.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["typescript_imports", "python_imports", "rust_imports"])
def test_candidates_of_many_imports_are_never_broadcast(spark, many_parts, name):
    assert "BroadcastExchange" not in plan(registry.queries()[name](spark, many_parts))


def test_scratch_tables_of_some_size_are_exchanged(spark):
    """The symbol graph's joins: files under the broadcast limit that hold many rows."""
    from strandline.storage import materialize

    kept = materialize(spark.range(400_000).selectExpr("id", "sha2(cast(id AS string), 256) k"), "some")
    assert "BroadcastExchange" not in plan(spark.range(10_000_000).join(kept, "id"))


def test_longer_ids_grow_one_row_a_key(spark, tmp_path):
    """Colliding keys are settled without a row for each length that an id may have."""
    n = 30_000
    pq.write_table(pa.table({"l_orderkey": range(n), "l_linenumber": pa.array([1] * n, pa.int32())}), tmp_path / "lineitem.parquet")
    assert "Generate" not in plan(registry.queries()["id_collisions"](spark, str(tmp_path)))
    check(spark, tables(tmp_path), str(tmp_path), registry.queries()["id_collisions"], registry.oracle_sql()["id_collisions"])


def test_files_whose_six_digits_collide_keep_their_edges(spark, tmp_path):
    """Parts up to the first two paths that share six digits, f840 and f7647, each importing and imported."""
    from hashlib import sha256

    seen, pair = {}, None
    for k in range(100_000):
        six = sha256(f"file:src/m{k % 10}/f{k}.ts".encode()).hexdigest()[:6]
        if six in seen:
            pair = seen[six], k
            break
        seen[six] = k
    pq.write_table(pa.table({"p_partkey": list(range(pair[1] + 11))}), tmp_path / "part.parquet")
    check(spark, tables(tmp_path), str(tmp_path), registry.queries()["file_graph"], registry.oracle_sql()["file_graph"])


def documents(at, texts):
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(x) for x in texts]}), at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["normalized_body", "source_keys"])
def test_bodies_of_many_lines_and_odd_breaks(spark, tmp_path, name):
    """A text of 30,000 lines, whose indent was once found anew for each line; blanks before U+2028 and U+0085 end no line."""
    sf = documents(tmp_path, ["a\n    b \t\n\n" * 10_000, "x   \n y \x85", "\t a\r\n\t\t b\f\n", " \n\t\n", "", "a" + " " * 50_000 + "b"])
    check(spark, tables(sf), sf, registry.queries()[name], registry.oracle_sql()[name])


def test_source_keys_move_no_text(spark, tmp_path):
    assert "Exchange" not in plan(registry.queries()["source_keys"](spark, documents(tmp_path, ["a", "b"])))


def test_words_of_a_text_are_found_once(spark, tmp_path):
    text = plan(registry.queries()["tokenize_text"](spark, documents(tmp_path, ["Some camelCase words"])))
    made = next(x for x in text.split("\n") if x.startswith("Arguments: explode("))
    assert made.count("text#") == 1


@pytest.mark.parametrize("name", ["documented_modules", "extracted_defs"])
def test_files_are_dealt_out_before_they_are_parsed(spark, tmp_path, name):
    """Parts of one small file, which one task would read and parse alone."""
    pq.write_table(pa.table({"p_partkey": range(50)}), tmp_path / "part.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_pairs_of_places_and_spans_are_not_sorted(spark):
    assert "SortAggregate" not in plan(registry.queries()["smallest_enclosing"](spark, "/root/testdata/sf0.001"))


def test_second_rarest_method_thins_the_candidates(spark, monkeypatch):
    """Fifty types share an interface's rarest method, sixty its second, two both: the others meet no third one."""
    from strandline.operators import resolve

    rows = {}
    keep = resolve.materialize

    def counted(df, label, *more):
        out = keep(df, label, *more)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(resolve, "materialize", counted)
    own = {t: {"c", "d"} | ({"a"} if t < 50 else set()) | ({"b"} if t >= 48 and t < 108 else set()) for t in range(120)}
    types = spark.createDataFrame([(t, m) for t, ms in own.items() for m in ms], "type int, method string")
    ifaces = spark.createDataFrame([(i, m) for i, ms in enumerate(("abcd", "a", "ab", "abx")) for m in ms], "iface int, method string")
    got = {tuple(r) for r in resolve.satisfies(types, ifaces).collect()}
    assert got == {(48, 0), (49, 0), (48, 2), (49, 2)} | {(t, 1) for t in range(50)}
    assert rows["satisfy-held"] == 4


def test_edges_are_distinct_by_numbers(spark):
    from strandline.plans.bindings import file_edges

    assert "hashpartitioning(src" not in plan(file_edges(spark, "/root/testdata/sf0.001"))


def test_orphans_are_found_in_one_pass(spark):
    from strandline.plans.bindings import file_edges

    sf = "/root/testdata/sf0.001"
    scans = lambda df: plan(df).count("lineitem.parquet")
    assert scans(registry.queries()["orphan_edges"](spark, sf)) == scans(file_edges(spark, sf))
