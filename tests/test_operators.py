import json

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.operators import fragments, lineage, metrics, retrieval, storage, tables
from sluice.plans import flows, registry
from sluice.sources import events
from sluice.streaming import ingest


def test_features_are_not_broadcast(spark):
    """However few texts the planner sees: their features are many times as many rows."""
    rows = spark.createDataFrame([(1, "s", 0, "some words here"), (2, "s", 1, "some words there")], "id long, scope string, sequence_no int, text string")
    index = retrieval.index(rows)
    met = retrieval.overlaps(index, index)
    assert [(r.query_id, r.candidate_id, r.overlap) for r in met.collect()] == [(2, 1, 7)]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [s#" in plan and "BroadcastHashJoin [s#" not in plan


def test_leaves_walk_and_escape(spark):
    rows = [("1", "tool_input", '{"a/b": {"c~": [1, null, "x"]}, "t": true}'), ("2", "tool_input", "nope"), ("3", "x", "[[[1.5]]]"), ("4", "x", '"s"')]
    out = fragments.leaves(spark.createDataFrame(rows, "artifact_id string, artifact_role string, text string")).collect()
    found = [(r.artifact_id, r.json_pointer, r.text) for r in out if r.fragment_kind == "payload"]
    assert found == [("1", "/a~1b/c~0/0", "1"), ("1", "/a~1b/c~0/2", "x"), ("1", "/t", "True"), ("3", "/0/0/0", "1.5")]
    assert sorted(r.artifact_id for r in out if r.fragment_kind == "artifact_root") == ["1", "2", "3", "4"]
    assert {(r.json_pointer, r.text) for r in out if r.fragment_kind == "json_key"} == {("/a~1b", "a/b"), ("/a~1b/c~0", "c~"), ("/t", "t")}


def test_lineage_takes_the_best_product_and_ends_on_cycles(spark):
    seeds = spark.createDataFrame([("s", "a", 0.9, "e0")], "source string, node string, score double, edge_id string")
    edges = [("a", "b", 0.5, "e1"), ("a", "c", 0.9, "e2"), ("c", "b", 0.9, "e3"), ("b", "a", 1.0, "e4"), ("b", "d", 0.1, "e5")]
    out = lineage.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, score double, edge_id string"))
    found = {r.node: (round(r.score, 6), r.hops, r.edge_id) for r in out.collect()}
    assert found == {"a": (0.9, 1, "e0"), "c": (0.81, 2, "e2"), "b": (0.729, 3, "e3")}


def test_lineage_goes_on_until_nothing_improves(spark):
    """A chain of more hops than frontiers are kept apart, and what new edges change in it."""
    n = lineage.MERGE_EVERY + 4
    seeds = spark.createDataFrame([("s", "n0", 1.0, "e")], "source string, node string, score double, edge_id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0, f"e{i}") for i in range(n)], "src string, dst string, score double, edge_id string")
    whole = lineage.propagate(seeds, edges)
    assert {(r.node, r.hops) for r in whole.collect()} == {(f"n{i}", i + 1) for i in range(n + 1)}
    late = edges.filter("edge_id = 'e2'")
    before = lineage.propagate(seeds, edges.filter("edge_id < 'e2' or edge_id > 'e2'"))
    changed = lineage.propagate_new(before, seeds, edges.filter("edge_id >= 'e2' or edge_id = 'e10'"))
    assert late.count() == 1 and {r.node for r in changed.collect()} == {f"n{i}" for i in range(3, n + 1)}
    walked = lineage.paths(whole, edges, whole.filter("node = 'n5'")).orderBy("step").collect()
    assert [r.node for r in walked] == ["s", *(f"n{i}" for i in range(6))]


def test_text_scalars(spark):
    row = spark.createDataFrame([("  A  b\tC ", "")], "x string, y string").select(
        T.normalize_text(F.col("x")), T.token_count(F.col("x")), T.token_count(F.col("y")), F.size(T.shingles(F.lit("abcdefa"))), T.preview(F.lit("abcdefgh"), 6)
    ).first()
    assert tuple(row) == ("a b c", 3, 0, 3, "abc...")


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_json_reader_and_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"a": 1}\nnope\n[1]\n')
    good, bad = events.read_json_events(spark, str(tmp_path / "in"))
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"no_object"}
    rows = spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id % 3) as ts, id % 3 as event_id from range(9)")
    rows.write.parquet(str(tmp_path / "log"))
    stream = ingest.first_deliveries(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log")))
    query = ingest.write_idempotent(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_manifest(spark, tmp_path):
    good = '{"schema_version": 2, "sources": [{"id": "a", "path": "x/.env", "type": "secretfile", "sensitivity": "high", "policy_tags": ["t"], "selector": {"dotenv_keys": ["K"]}}, {"id": "b", "path": "y.md", "type": "doc"}]}'
    (tmp_path / "m.json").write_text(good)
    out = {r.source_id: (r.path, r.selector_kind, r.selector_values) for r in events.read_manifest(spark, str(tmp_path / "m.json"), "w").collect()}
    assert out == {"a": ("x/.env", "dotenv_keys", ["K"]), "b": ("y.md", None, None)}
    for old, new, why in (('"b"', '"a"', "two sources"), ("y.md", "../y", "leaves"), ('"schema_version": 2', '"schema_version": 3', "not supported")):
        (tmp_path / "bad.json").write_text(good.replace(old, new))
        with pytest.raises(Exception, match=why):
            events.read_manifest(spark, str(tmp_path / "bad.json"), "w").collect()


def test_record_writes_whole_batches(spark, tmp_path):
    rows = [("stop", '{"session_id": "s", "message": "hello there"}', 1, "w"), ("stop", "no", 2, "w"), ("post_tool_use", '{"session_id": "s", "tool_response": {"ok": true}}', 3, "w")]
    log = spark.createDataFrame(rows, "phase string, payload string, sequence_no long, workspace_id string")
    log.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # without its checkpoint, the batch comes again
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        ingest.record(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination(180)
    count = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).count()
    assert [count(n) for n in ("events", "artifacts", "fragments", "outcomes")] == [2, 2, 3, 2]
    known = events.of_scope(spark.read.parquet(str(tmp_path / "out" / "events")), "w", "s", after=1, through=3)
    assert [r.sequence_no for r in known.collect()] == [3]
    new = spark.createDataFrame([("w", 1, "b"), ("w", 1, "a"), ("v", 5, "c")], "workspace_id string, arrived int, event_id string")
    out = {r.event_id: r.sequence_no for r in ingest.with_sequence(new, spark.createDataFrame([("w", 7)], "workspace_id string, last long")).collect()}
    assert out == {"a": 8, "b": 9, "c": 1}


def test_report_is_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}/reports"
    for n in (1, 2, 3):
        assert events.write_report(spark.createDataFrame([(n,)], "n int"), folder) == n
        assert events.read_report(spark, folder).first().n == n
    names = sorted(p.name for p in (tmp_path / "reports").iterdir() if not p.name.startswith("."))
    assert names == ["report-2.json", "report-3.json"]  # the one before stays, for who is reading it


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_lineage_looks_up_ends_only(spark, monkeypatch, most):
    """Edges that start where none ends are read in the first hop only; the result is the same whether or not ends are few."""
    monkeypatch.setattr(lineage, "MOST_ENDS", most, raising=False)
    made = []

    def kept(df, name="part"):
        made.append((name, df.count()))
        return storage.stored(df, name)

    monkeypatch.setattr(lineage, "stored", kept)
    seeds = spark.createDataFrame([("s", "a", 0.9, "e0"), ("s", "c", 0.2, "e9"), ("t", "c", 0.5, "e8")], "source string, node string, score double, edge_id string")
    edges = [("a", "b", 0.9, "e1"), ("x", "b", 0.9, "e2"), ("y", "c", 0.9, "e3"), ("b", "c", 1.0, "e4")]
    out = lineage.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, score double, edge_id string"))
    found = sorted((r.source, r.node, round(r.score, 6), r.hops, r.edge_id) for r in out.collect())
    assert found == [("s", "a", 0.9, 1, "e0"), ("s", "b", 0.81, 2, "e1"), ("s", "c", 0.81, 3, "e4"), ("t", "c", 0.5, 1, "e8")]
    assert [n for name, n in made if name == "edges"] == ([4, 1] if most else [4])
    assert not [n for name, n in made if name == "ends" and n != 2]


def test_lineage_without_better_paths_is_not_shuffled_again(spark):
    seeds = spark.createDataFrame([("s", "a", 0.9, "e0")], "source string, node string, score double, edge_id string")
    out = lineage.propagate(seeds, spark.createDataFrame([("a", "b", 0.9, "e1")], "src string, dst string, score double, edge_id string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 2


def test_contexts_shuffle_nothing(spark):
    """The fragments of artifacts, each with every event that has its id, without a join or a sort of texts."""
    call = json.dumps({"session_id": "s", "tool_use_id": "u", "tool_name": "Write", "tool_input": {"path": "a/b", "n": [1, {"x~y": "Z  z"}], "": "e"}, "tool_response": "Z  z"})
    said = json.dumps({"session_id": "s", "last_assistant_message": "same", "message": "same", "response": {"a": None}})
    rows = [("pre_tool_use", call, 1, "w"), ("post_tool_use", call, 2, None), ("post_tool_use", call, 3, None), ("stop", said, 4, "w"), ("other", said, 5, "w")]
    events = fragments.normalized_events(spark.createDataFrame(rows, "phase string, payload string, sequence_no long, workspace_id string"))
    out = fragments.contexts(events)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    found = fragments.artifacts(events)
    whole = fragments.fragments(found).dropDuplicates(["fragment_id"]).join(found.select("artifact_id", "event_id", "artifact_role").distinct(), "artifact_id")
    whole = whole.join(events.drop("payload", "stop_hook_active"), "event_id")
    key = lambda r: (r.sequence_no, r.fragment_id)
    assert sorted(out.collect(), key=key) == sorted(whole.select(*out.columns).collect(), key=key) and out.count() > 20


def test_work_on_each_row_is_spread(spark):
    """A small file is one task's to read, but not to work on."""
    folder = "/root/testdata/sf0.001"
    assert registry.read(spark, folder, "part").rdd.getNumPartitions() == 1
    assert flows.commands(spark, folder).rdd.getNumPartitions() == 4 and flows.payloads(spark, folder).rdd.getNumPartitions() == 4


def test_stored_tables_are_small(spark):
    """Ids of hexadecimal digits take little more than half a byte each."""
    ids = spark.range(20000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("id"))
    out = storage.stored(ids)
    place = spark._jvm.org.apache.hadoop.fs.Path(out.stored_at)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    assert size < 0.6 * 64 * 20000 and out.exceptAll(ids).isEmpty()


@pytest.mark.parametrize("most", [100, 1])
def test_values_are_searched_in_one_pass(spark, monkeypatch, most):
    monkeypatch.setattr(metrics, "MOST_VALUES", most)
    digest = "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae"  # of foo
    values = spark.createDataFrame([("a", "foo"), ("b", "foo"), ("a", "o b"), ("a", "foo bar"), ("a", ""), ("b", "none"), ("b", None), ("c", "Straße 😀")], "kind string, value string")
    reports = spark.createDataFrame([("a foo bar b",), (None,), ("",), ("x" + digest,), ("foo, Straße 😀.",)], "text string")
    found = metrics.exposures(values, reports)
    assert {tuple(r) for r in found.collect()} == {("a", 4), ("b", 1), ("c", 1), ("a_hash", 1), ("b_hash", 1)}
    if most == 100:
        assert "Contains(text" not in found._jdf.queryExecution().optimizedPlan().toString()
