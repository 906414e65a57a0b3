"""Chunks of protected sources, and hashes of JSON structure."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import flow, fragments, sources, workflow
from sluice.operators.operations import with_operations

SOURCE = "source_id string, workspace_id string, path string, type string, selector_kind string, selector_values array<string>"


def chunks(spark, path, text, kind="secretfile", selector=None, values=None):
    rows = spark.createDataFrame([("s", "w", path, kind, selector, values)], SOURCE)
    return sources.split_sources(rows, spark.createDataFrame([("w", path, text)], "workspace_id string, path string, text string")).first()


DOC = json.dumps({"b": {"x/y": "two", "~": ["three", 4, None, " "]}, "a": "one", "n": 5, "password": "p4ss"})


@pytest.mark.parametrize("path, text, kind, selector, values, want", [
    ("a.json", DOC, "secretfile", None, None, [("two", "registered_source"), ("three", "registered_source"), ("one", "registered_source"), ("p4ss", "registered_source")]),
    ("A.JSON", DOC, "secretfile", "json_pointers", ["/password", "/b/x~1y"], [("two", "selected_field"), ("p4ss", "selected_security_field")]),
    ("a.json", DOC, "secretfile", "json_pointers", ["/n"], "json_value"), ("a.json", DOC, "secretfile", "json_pointers", ["/b/~0/3"], "json_value"),
    ("a.json", DOC, "secretfile", "json_pointers", ["/zzz"], "json_missing"), ("a.json", DOC, "secretfile", "dotenv_keys", ["a"], "json_kind"),
    ("a.json", "{", "secretfile", "json_pointers", ["/a"], "json_text"), ("a.json", "not json\n\nat all", "secretfile", None, None, [("not json", "registered_source"), ("at all", "registered_source")]),
    (".env.local", "A='x y'\nexport TOKEN=\"t\\n1\" # c\nB=", "secretfile", None, None, [("x y", "registered_source"), ("t\n1", "registered_source")]),
    ("d/.env", "A=1\nAPI_TOKEN=2", "secretfile", "dotenv_keys", ["API_TOKEN"], [("2", "selected_security_field")]),
    (".env", "A=1", "secretfile", "dotenv_keys", ["A", "B"], "dotenv_missing"), (".env", "A=1\nwhat", "secretfile", "dotenv_keys", ["A"], "dotenv_text"), (".env", "A=1", "secretfile", "json_pointers", ["/A"], "dotenv_kind"),
    (".env", "A=1\nwhat\n\nB", "secretfile", None, None, [("A=1\nwhat", "registered_source"), ("B", "registered_source")]),
    ("x.json", DOC, "doc", None, None, [(DOC, "registered_source")]), ("x.md", "a", "doc", "json_pointers", ["/a"], "format"), ("e.md", "", "doc", None, None, []),
    ("m.py", "import os\n\ndef f():\n  pass\nclass C:\n  def g(self): pass\n", "code", None, None, [("import os", "registered_source"), ("def f():\n  pass", "registered_source"), ("class C:\n  def g(self): pass", "registered_source")]),
])
def test_sources_become_pieces(spark, path, text, kind, selector, values, want):
    row = chunks(spark, path, text, kind, selector, values)
    if isinstance(want, str):
        assert (row.problem, row.pieces) == (sources.PROBLEMS[want], None)
    else:
        assert row.problem is None and [tuple(p) for p in row.pieces] == want


def test_chunks_bind_to_what_holds_them(spark):
    given = spark.createDataFrame([("s", "w", "k.json", "secretfile", "json_pointers", ["/token"]), ("gone", "w", "none.md", "doc", None, None)], SOURCE)
    files = spark.createDataFrame([("w", "k.json", '{"token": "ZX81-4471-QPLM", "note": "harmless words"}'), ("v", "k.json", "{}")], "workspace_id string, path string, text string")
    found = sources.chunks_of(given, files)
    row = found.first()
    assert (row.chunk_id, row.ordinal, row.signal, found.count()) == ("s:0:" + hashlib.sha256(b"ZX81-4471-QPLM").hexdigest()[:16], 0, "selected_security_field", 1)
    log = [("stop", json.dumps({"session_id": "s", "last_assistant_message": "it is ZX81-4471-QPLM"}), 1, "w")]
    known = with_operations(fragments.contexts(fragments.normalized_events(spark.createDataFrame(log, "phase string, payload string, sequence_no long, workspace_id string"))))
    assert [r.method for r in flow.source_bindings(found, known).collect()] == ["substring"]
    with pytest.raises(Exception, match="missing pointer"):
        sources.chunks_of(given.filter("source_id = 's'").withColumn("selector_values", F.array(F.lit("/b"))), files).collect()


def test_structure_is_pointers_and_types(spark):
    texts = ['{"a": 1}', '{"a": "1"}', '{"a": {}}', '{"a": null}', '{"a": [true]}', '{"a": 2.5}', '{ "a" : 7 }', "{", '{"b": {"x/~": []}, "a": "é"}']
    out = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", workflow.structure_hash(F.col("t")).alias("h")).collect()}
    assert out["{"] is None and out['{"a": 1}'] == out['{"a": 2.5}'] == out['{ "a" : 7 }'] and len(set(out.values())) == 7
    entries = [["", "object"], ["/a", "string"], ["/b", "object"], ["/b/x~1~0", "array"]]
    assert out['{"b": {"x/~": []}, "a": "é"}'] == hashlib.sha256(json.dumps(entries, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
