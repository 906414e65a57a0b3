"""Events, what they carry, and the fragments of it that are compared.

An event is one JSON object. Its artifacts are the fields that its phase names; an artifact's fragments are the artifact as
a whole, each scalar in its JSON with a pointer, and for tool input each key. Contexts are fragments with all that their
event says.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.canonical import fold, folded
from sluice.functions.text import text_hash

LEAVES = "artifact_id string, json_pointer string, key string, text string, fragment_kind string"
PARTS = "artifact_role artifact_hash json_pointer key text fragment_kind normalized_text".split()
FRAGMENT = "fragment_id artifact_id json_pointer fragment_kind semantic_role text text_hash normalized_text token_count".split()
#: Which keys name which role. Others keep the role of their artifact.
ROLES = {
    "command": "command",
    "cmd": "command",
    "query": "query",
    "search_query": "search_query",
    "path": "path",
    "file_path": "path",
    "filepath": "path",
    "content": "content",
    "contents": "content",
    "data": "content",
    "text": "content",
    "message": "content",
    "body": "content",
    "description": "content",
    "comment": "content",
    "title": "content",
    "attachment_text": "content",
    "stdout": "stdout",
    "stderr": "stderr",
    "output": "tool_output",
    "response": "tool_output",
    "server": "server",
    "server_name": "server",
    "mcp_server": "server",
    "tool": "tool",
    "tool_name": "tool",
    "mcp_tool": "tool",
}
#: Roles whose text is compared, and fields of a payload by phase with the role of their artifact.
CONTENT_ROLES = "command query search_query content stdout stderr tool_output final_answer".split()
FIELDS = {
    "pre_tool_use": [("tool_input", "tool_input")],
    "post_tool_use": [("tool_input", "tool_input"), ("tool_output", "tool_response")],
    "stop": [("final_answer", f) for f in ("last_assistant_message", "final_answer", "response", "assistant_response", "message")],
}
SHELL_TOOLS = "bash shell exec exec_command command terminal run_command".split()
SEARCH_TOOLS = "search web_search websearch web_search_query browser_search internet_search".split()
MCP_TOOLS = "mcp mcp_call mcp_tool_call mcp_server_tool_call mcpserver_tool_call".split()
TEXT_FIELDS = "session_id turn_id tool_use_id tool_name cwd model permission_mode transcript_path".split()
MOST_PAYLOAD_BYTES, MOST_DEPTH, MOST_NUMBER_CHARS = 1024 * 1024, 64, 128


def _column(run, kind: str, *columns: Column) -> Column:
    return F.pandas_udf(run, kind)(*columns)


def stable_json(payload: Column) -> Column:
    """JSON text with sorted keys and no spaces; null for what is no JSON."""

    def one(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return _column(lambda x: x.map(one, na_action="ignore"), "string", payload)


def as_text(value) -> str | None:
    """A member of a JSON object as text: strings as they are, all else indented with sorted keys; None where missing."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2)


def stringified(payload: Column, field: Column) -> Column:
    """as_text() of a member of a JSON object; null where missing."""

    def one(x: str | None, name: str) -> str | None:
        return as_text(json.loads(x).get(name)) if x else None

    return _column(lambda x, names: pd.Series([one(a, b) for a, b in zip(x, names)], dtype=object), "string", payload, field)


def nesting(x: Column) -> Column:
    """Depth of containers of a JSON text, whatever stands in its strings."""
    bare = F.regexp_replace(F.regexp_replace(x, r'"(?:\\(?s:.)|[^"\\])*+"?', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most"))
    return F.aggregate(steps, start, step)["most"]


def longest_number(x: Column) -> Column:
    """Characters of the longest number outside strings of a JSON text."""
    bare = F.regexp_replace(x, r'"(?:\\(?s:.)|[^"\\])*+"?', "\"\"")
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(bare, F.lit(r"([-+.0-9eE]+)"), 1), lambda n: F.length(n))), F.lit(0))


def rejection(payload: Column) -> Column:
    """Why a payload is not read; null if it is: too long, a byte order mark, NUL, no JSON object, lone surrogates, not a
    number, numbers or nesting beyond the bounds."""
    bare = F.regexp_replace(payload, r'"(?:\\(?s:.)|[^"\\])*+"?', "\"\"")
    lone = r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}"
    return (
        F.when(payload.isNull(), "empty")
        .when(F.octet_length(payload) > MOST_PAYLOAD_BYTES, "too_long")
        .when(payload.startswith("\ufeff"), "byte_order_mark")
        .when(F.contains(payload, F.lit("\0")), "nul")
        .when(nesting(payload) > MOST_DEPTH, "too_deep")
        .when(longest_number(payload) > MOST_NUMBER_CHARS, "number_too_long")
        .when(bare.rlike(r"NaN|Infinity"), "not_finite")
        .when(payload.rlike(lone), "lone_surrogate")
        .when(~F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False)), "no_object")
    )


def top_level_strings(payload: Column, *names: str) -> list[Column]:
    """String members of the outermost object, also of a text that was cut off: the last of equal names counts, and what
    is nested does not."""
    string = r'"((?:\\(?s:.)|[^"\\])*+)"'

    def member(name: str) -> Column:
        pieces = F.regexp_extract_all(payload, F.lit(rf'({string}\s*:\s*{string}|{string}|[\[\]{{}}])'), 1)

        def step(s: Column, p: Column) -> Column:
            depth = s["depth"] + F.when(p.isin("[", "{"), 1).when(p.isin("]", "}"), -1).otherwise(0)
            hit = (s["depth"] == 1) & p.rlike(rf'^"{name}"\s*:')
            value = F.regexp_extract(p, rf'^"{name}"\s*:\s*{string}$', 1)
            return F.struct(depth.alias("depth"), F.when(hit, value).otherwise(s["value"]).alias("value"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("value"))
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), F.aggregate(pieces, start, step)["value"], F.lit('"'))), "$", "string").alias(name)

    return [member(n) for n in names]


def normalized_events(payloads: DataFrame) -> DataFrame:
    """payloads (phase, payload, sequence_no, workspace_id) as typed events. Missing members are null; a stop flag that is
    no boolean is null; payloads that rejection() refuses are left out."""
    v = F.try_parse_json("payload")

    def text(name: str) -> Column:
        value = F.try_variant_get(v, f"$.{name}", "string")
        boolean = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN"
        return F.when(boolean, F.initcap(value)).otherwise(value).alias(name)

    flag = F.try_variant_get(v, "$.stop_hook_active", "variant")
    stop = F.when(F.schema_of_variant(flag) == "BOOLEAN", F.try_variant_get(v, "$.stop_hook_active", "boolean")).alias("stop_hook_active")
    rows = payloads.filter(rejection(F.col("payload")).isNull()).withColumn("stable", stable_json(F.col("payload")))
    rows = rows.select("workspace_id", "sequence_no", "phase", *map(text, TEXT_FIELDS), stop, "payload", "stable")
    identity = F.when(F.col("workspace_id").isNull(), F.col("stable")).otherwise(
        F.concat(F.lit('{"payload":'), "stable", F.lit(',"workspace_namespace_id":'), F.concat(F.lit('"'), F.col("workspace_id"), F.lit('"')), F.lit("}"))
    )
    parts = [F.coalesce(c, F.lit("-")) for c in ("session_id", "turn_id", "tool_use_id", "tool_name")]
    return rows.withColumn("event_id", F.concat_ws(":", "phase", *parts, F.left(text_hash(identity), F.lit(16)))).drop("stable")


def artifacts(events: DataFrame) -> DataFrame:
    """(artifact_id, event_id, artifact_role, text): the members of the payload that the phase names, if not null."""
    fields = F.create_map(*(x for phase, pairs in FIELDS.items() for x in (F.lit(phase), F.array(*(F.struct(F.lit(r).alias("artifact_role"), F.lit(f).alias("field")) for r, f in pairs)))))
    named = events.select("event_id", "payload", F.inline(F.try_element_at(fields, "phase")))
    found = named.withColumn("text", stringified(F.col("payload"), F.col("field"))).filter("text is not null")
    artifact_id = F.concat_ws(":", "event_id", "artifact_role", F.left(text_hash(F.col("text")), F.lit(16)))
    return found.select(artifact_id.alias("artifact_id"), "event_id", "artifact_role", "text")


def semantic_role(key: Column, artifact_role: Column) -> Column:
    by_key = F.try_element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.lower(key))
    return F.when(artifact_role == "final_answer", artifact_role).otherwise(F.coalesce(by_key, artifact_role))


def leaves_of(role: str, text: str | None) -> Iterator[tuple[str, str, str | None, str]]:
    """(json_pointer, key, text, fragment_kind) of an artifact: the text as a whole (artifact_root, pointer /), each scalar
    of its JSON in order (payload), and for tool input each key of an object (json_key). Nulls are skipped; a text that is
    no JSON has its root only."""
    yield "/", "", text, "artifact_root"
    try:
        todo = [("", "", json.loads(text), None)]
    except (ValueError, TypeError, RecursionError):
        return
    while todo:
        pointer, key, value, kind = todo.pop()
        if kind == "json_key":
            yield pointer, key, key, kind
        elif isinstance(value, (dict, list)):
            children = value.items() if isinstance(value, dict) else enumerate(value)
            for k, child in reversed(list(children)):
                at = f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}"
                todo.append((at, str(k), child, None))
                if isinstance(value, dict) and role == "tool_input":
                    todo.append((at, str(k), None, "json_key"))
        elif value is not None and pointer:
            yield pointer, key, str(value), "payload"


def leaves(rows: DataFrame) -> DataFrame:
    """(LEAVES) of rows (artifact_id, artifact_role, text): leaves_of() each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*(c.to_pylist() for c in batch.columns))
            rows = [(artifact_id, *leaf) for artifact_id, role, text in found for leaf in leaves_of(role, text)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[x.split()[0] for x in LEAVES.split(", ")])

    return rows.select("artifact_id", "artifact_role", "text").mapInArrow(run, LEAVES)


def parts_of(payload: Column, phase: Column) -> Column:
    """array of PARTS: artifacts() of an event, each once, and leaves() of them with folded() text. All of it is one call,
    as every Python function in a stage has a process of its own in each task, which holds a batch of texts."""

    def of(payload: str | None, phase: str | None) -> Iterator[tuple]:
        value, seen = json.loads(payload) if payload else {}, set()
        for role, field in FIELDS.get(phase, ()):
            text = as_text(value.get(field))
            if text is not None and (role, text) not in seen:
                seen.add((role, text))
                artifact_hash = hashlib.sha256(text.encode()).hexdigest()[:16]
                for pointer, key, leaf, kind in leaves_of(role, text):
                    yield role, artifact_hash, pointer, key, leaf, kind, fold(leaf)

    def some(payloads: pa.Array, phases: pa.Array) -> pa.Array:
        found = [list(of(*x)) for x in zip(payloads.to_pylist(), phases.to_pylist())]
        columns = list(zip(*(row for rows in found for row in rows))) or [()] * len(PARTS)
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=PARTS))

    def run(payloads: pa.Array, phases: pa.Array) -> pa.Array:
        # Few at a time are Python objects.
        return pa.concat_arrays([some(payloads.slice(at, 500), phases.slice(at, 500)) for at in range(0, max(1, len(payloads)), 500)])

    kind = f"array<struct<{','.join(f'{name}:string' for name in PARTS)}>>"
    return F.arrow_udf(run, kind)(payload, phase)


def _described(rows: DataFrame) -> DataFrame:
    """Leaves (artifact_id, artifact_role, json_pointer, key, text, fragment_kind, normalized_text) with role, hash, id and
    number of tokens."""
    key = F.col("fragment_kind") == "json_key"
    role = F.when(key, "json_key").when(F.col("fragment_kind") == "artifact_root", F.col("artifact_role")).otherwise(semantic_role(F.col("key"), F.col("artifact_role")))
    rows = rows.withColumn("semantic_role", role).withColumn("text_hash", text_hash(F.col("text")))
    parts = [F.col("artifact_id"), F.when(key, "fragment:key").otherwise("fragment"), F.left(text_hash(F.col("json_pointer")), F.lit(10)), F.left("text_hash", F.lit(16))]
    count = F.when(F.col("normalized_text") == "", 0).otherwise(F.size(F.split("normalized_text", " ")))
    return rows.withColumns({"fragment_id": F.concat_ws(":", *parts), "token_count": count})


def fragments(found: DataFrame) -> DataFrame:
    """Fragments of artifacts, with role, normal form, hash and id."""
    rows = leaves(found).join(found.select("artifact_id", "artifact_role").distinct(), "artifact_id")
    return _described(rows.withColumn("normalized_text", folded(F.col("text")))).select(*FRAGMENT)


def contexts(events: DataFrame) -> DataFrame:
    """Fragments of events with what their event says of them. They are made of their event alone, so that nothing is
    shuffled; ids hold the event's, so that those of two events differ."""
    said = [c for c in events.columns if c not in ("event_id", "payload", "stop_hook_active")]
    rows = events.select("event_id", *said, F.inline(parts_of(F.col("payload"), F.col("phase"))))
    rows = _described(rows.withColumn("artifact_id", F.concat_ws(":", "event_id", "artifact_role", "artifact_hash")))
    return rows.select("event_id", "artifact_id", *(c for c in FRAGMENT if c != "artifact_id"), "artifact_role", *said)


def tool_kind(tool_name: Column) -> Column:
    """Lower-cased words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(tool_name, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def mcp_parts(tool_name: Column) -> Column:
    """struct(server, tool) of a name mcp__server__tool; null for any other."""
    shape = "^(?i:mcp)__(.+?)__(?s:(.+))$"
    return F.when(tool_name.rlike(shape), F.struct(F.regexp_extract(tool_name, shape, 1).alias("server"), F.regexp_extract(tool_name, shape, 2).alias("tool")))


def is_root() -> Column:
    """Roots, also those stored before kinds were."""
    legacy = (F.col("json_pointer") == "/") & (F.substring_index("artifact_id", ":", -1) == F.left("text_hash", F.lit(16)))
    return (F.col("fragment_kind") == "artifact_root") | legacy


def is_argument() -> Column:
    """Scalars of the arguments of an outbound call."""
    wrapped = tool_kind(F.col("tool_name")).isin(MCP_TOOLS) & F.col("json_pointer").rlike("^/(arguments|args|input)/")
    return F.coalesce((F.col("phase") == "pre_tool_use") & (F.col("artifact_role") == "tool_input") & ~is_root() & (mcp_parts(F.col("tool_name")).isNotNull() | wrapped), F.lit(False))


def is_content() -> Column:
    """Fragments that are compared: text of a role with content or an argument, not a second copy of tool input, not a
    container."""
    container = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return (
        ~F.col("fragment_kind").isin("operation_container", "operation_control", "operation_removed")
        & ~((F.col("phase") == "post_tool_use") & (F.col("artifact_role") == "tool_input"))
        & (F.col("normalized_text") != "")
        & (F.col("semantic_role").isin(CONTENT_ROLES) | is_argument())
        & ~(is_root() & container)
    )


def canonical(rows: DataFrame) -> DataFrame:
    """Content fragments, of those of an artifact with one role and normal form the first by pointer; arguments stay."""
    kept = rows.filter(is_content()).withColumn("whole", F.col("fragment_kind").isin("artifact_root", "payload") & ~is_argument())
    order = Window.partitionBy("artifact_id", "semantic_role", "normalized_text").orderBy(F.col("fragment_kind") != "artifact_root", "json_pointer", "fragment_id")
    first = kept.filter("whole").withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    return first.unionByName(kept.filter("not whole")).drop("whole")


def scope() -> Column:
    """What is compared with each other: a session, else a turn, of a workspace; null for neither."""
    workspace = F.coalesce("workspace_id", F.lit("legacy-unscoped"))
    session = F.struct(workspace.alias("workspace"), F.lit("session").alias("kind"), F.col("session_id").alias("id"))
    turn = F.struct(workspace.alias("workspace"), F.lit("turn").alias("kind"), F.col("turn_id").alias("id"))
    return F.when(F.col("session_id").isNotNull(), session).when(F.col("turn_id").isNotNull(), turn)


def with_legacy_workspace(sources: DataFrame, observed: DataFrame) -> DataFrame:
    """sources whose workspace is null take the one workspace that is observed; where there are several or none, they go."""
    only = observed.agg(F.count_distinct(F.coalesce("workspace_id", F.lit("\0"))).alias("n"), F.max("workspace_id").alias("only"))
    out = sources.join(F.broadcast(only), F.lit(True))
    return out.filter("workspace_id is not null or n = 1").withColumn("workspace_id", F.coalesce("workspace_id", "only")).drop("n", "only")


def outcomes(events: DataFrame) -> DataFrame:
    """(event_id, status, evidence) of tool calls by what their response says: exit codes before flags before markers of
    patches; what shell output says counts for nothing."""
    rows = events.select("event_id", "phase", "tool_name", stringified(F.col("payload"), F.lit("tool_response")).alias("text"))
    answers = rows.filter("text is not null").select(F.col("event_id").alias("artifact_id"), F.lit("tool_output").alias("artifact_role"), "text")
    found = members(answers)
    code, flag, unflag = F.col("key").isin("exit_code", "exitCode"), F.col("key").isin("success", "succeeded", "ok"), F.col("key").isin("failed", "failure")
    number = F.when(F.col("kind").isin("integer", "string") & F.col("text").rlike(r"^-?\d+$"), F.col("text").cast("decimal(38,0)"))
    said = F.when(F.col("kind") == "boolean", (F.col("text") == "true") == flag)
    by_event = found.groupBy(F.col("artifact_id").alias("event_id")).agg(
        F.min_by(number, F.when(code & (number != 0), F.col("at"))).alias("failed"),
        F.bool_or((flag | unflag) & (said == F.lit(False))).alias("refused"),
        F.bool_or((code & number.isNull()) | ((flag | unflag) & (F.col("kind") != "boolean"))).alias("odd"),
        F.bool_or(code & number.isNotNull()).alias("coded"),
        F.bool_or((flag | unflag) & said).alias("agreed"),
    )
    no = F.lit(False)
    failing = F.coalesce(F.col("failed").isNotNull() & (F.col("failed") != 0), no)
    patch, low = F.lower("tool_name") == "apply_patch", F.lower("text")
    pair = lambda status, evidence: F.struct(F.lit(status).alias("status"), (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence"))
    outcome = (
        F.when(F.col("phase") != "post_tool_use", pair("unknown", "not_post_tool_use"))
        .when(F.col("text").isNull(), pair("unknown", "missing_tool_response"))
        .when(failing, pair("failed", F.concat(F.lit("exit_code:"), F.col("failed").cast("string"))))
        .when(F.coalesce("refused", no), pair("failed", "explicit_failure_flag"))
        .when(F.coalesce("odd", no), pair("unknown", "invalid_structured_outcome"))
        .when(F.coalesce("coded", no), pair("succeeded", "exit_code:0"))
        .when(F.coalesce("agreed", no), pair("succeeded", "explicit_success_flag"))
        .when(patch & low.rlike("patch failed|apply_patch failed|error:"), pair("failed", "failure_marker"))
        .when(patch & low.rlike("done!|success"), pair("succeeded", "apply_patch_success_marker"))
        .when(patch, pair("unknown", "apply_patch_success_unconfirmed"))
        .otherwise(pair("unknown", "success_unconfirmed"))
    )
    return rows.join(by_event, "event_id", "left").select("event_id", outcome.alias("o")).select("event_id", "o.*")


def members(rows: DataFrame) -> DataFrame:
    """(artifact_id, at, key, text, kind): members of the objects of a JSON text that are no containers, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}
        for batch in batches:
            out: list[tuple] = []
            for artifact_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    todo, at = [("", json.loads(text))], 0
                except (ValueError, RecursionError):
                    continue
                while todo:
                    key, value = todo.pop()
                    if isinstance(value, (dict, list)):
                        children = value.items() if isinstance(value, dict) else (("", v) for v in value)
                        todo.extend(reversed(list(children)))
                        if key and isinstance(value, dict | list):
                            out.append((artifact_id, at, key, "", "container"))
                    elif key:
                        out.append((artifact_id, at, key, value if isinstance(value, str) else json.dumps(value), kinds[type(value)]))
                    at += 1
            columns = list(zip(*out)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["artifact_id", "at", "key", "text", "kind"])

    return rows.select("artifact_id", "text").mapInArrow(run, "artifact_id string, at long, key string, text string, kind string")
