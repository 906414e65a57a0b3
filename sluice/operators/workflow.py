"""Runs, settings, profiles of outbound tools, review of candidates, redaction and evidence of payloads."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.canonical import let, with_prepared
from sluice.functions.compare import compare_binding
from sluice.operators.fragments import nesting
from sluice.operators.lineage import identity
from sluice.operators.metrics import shadow_action
from sluice.operators.storage import stored

#: Fixed values.
MOST_BYTES, MOST_FIELDS, MOST_DEPTH = 32 * 1024, 32, 8
MOST_FINDINGS, MOST_TARGETS = 32, 16
#: Bytes of a block of values and of one of the texts that are searched in them, about.
VALUE_BLOCK, TEXT_BLOCK = 4_000_000, 2_000_000
REDACTION = ["derived-redact-decision:v1", "redaction-decision-derivation-v1"]
MOVES = {
    "proposed": ["approving", "rejected", "ignored", "stale"],
    "approving": ["approved", "proposed", "stale"],
    "rejected": ["proposed"],
    "ignored": ["proposed"],
    "stale": ["proposed"],
    "approved": ["stale"],
}


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, run_id: str, expected: str | None) -> None:
    """Write tables of a run below run_id=, then point the folder's current run at it, if that is still the expected one.

    The pointer is a file of its own per run and its predecessor; creating it fails where another run was faster, so of
    two runs with one predecessor one is published.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/run_id={run_id}/{name}")
    if current(spark, folder) != expected:
        raise ValueError("the published run has changed")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_runs/after-{expected or 'none'}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    stream.write(bytearray(run_id.encode()))
    stream.close()


def current(spark: SparkSession, folder: str) -> str | None:
    """The run that was published last: the one behind which none was."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_runs")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.text(f"{folder}/_runs", wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), "after-(.*)$", 1).alias("after"))
    last = rows.join(rows.select(F.col("after").alias("value")), "value", "left_anti").first()
    return last and last["value"]


def run_scope(runs: DataFrame, workspace: str, run_id: str | None = None) -> DataFrame:
    """The run of that id, or the workspace's latest; an error unless it is one, completed and the workspace's own."""
    own = runs.filter((F.col("workspace_id") == workspace) & (F.col("status") == "completed"))
    chosen = own.filter(F.col("run_id") == run_id) if run_id else own.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
    checked = F.when(F.count("*") == 1, F.first("run_id")).otherwise(F.raise_error(F.lit("no such run")))
    return chosen.agg(checked.alias("run_id"))


def matching_sources(lineage: DataFrame, chunks: DataFrame, wanted: str) -> DataFrame:
    """(source): sources of lineage (source_kind, source) that are named by id, kind:id, their source's id or its key."""
    named = lineage.select("source_kind", "source").distinct().join(chunks.select(F.col("chunk_id").alias("source"), "source_id", "source_key"), "source", "left")
    full = F.concat_ws(":", "source_kind", "source")
    return named.filter((F.col("source") == wanted) | (full == wanted) | (F.col("source_id") == wanted) | (F.col("source_key") == wanted)).select("source").distinct()


def effective_settings(settings: DataFrame, environment: DataFrame, requires: DataFrame) -> DataFrame:
    """(workspace_id, name, value, origin): what the environment says, else the workspace, else false; a setting that
    requires (name, needed) one that is off is off."""
    rows = settings.join(environment.select("name", F.col("value").alias("env")), "name", "left")
    value = F.coalesce("env", "value", F.lit(False))
    origin = F.when(F.col("env").isNotNull(), "environment").when(F.col("value").isNotNull(), "workspace").otherwise("default")
    rows = rows.select("workspace_id", "name", value.alias("value"), origin.alias("origin"))
    off = requires.join(rows.filter("not value").select("workspace_id", F.col("name").alias("needed")), "needed").select("workspace_id", "name", F.lit(True).alias("blocked")).distinct()
    rows = rows.join(off, ["workspace_id", "name"], "left")
    return rows.select("workspace_id", "name", (F.col("value") & F.col("blocked").isNull()).alias("value"), F.when(F.col("value") & F.col("blocked"), "dependency").otherwise(F.col("origin")).alias("origin"))


def input_rejection(arguments: Column) -> Column:
    """Why the arguments of an outbound call are not inspected; null if they are."""
    fields = F.size(F.json_object_keys(arguments))
    return (
        F.when(F.octet_length(arguments) > MOST_BYTES, "input_too_large")
        .when(F.coalesce(~F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(True)), "input_not_object")
        .when(fields > MOST_FIELDS, "too_many_fields")
        .when(nesting(arguments) > MOST_DEPTH, "input_too_deep")
    )


def registry_version(profiles: DataFrame) -> DataFrame:
    """(version): hash of the profiles' content, whatever their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(profiles.columns))).cast("binary"), 256)
    return profiles.agg(F.left(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "").cast("binary"), 256), F.lit(16)).alias("version"))


def validated(calls: DataFrame, profiles: DataFrame) -> DataFrame:
    """calls (call_id, server, tool, arguments) with profile_id and rejection: null where all members are fields of the
    profile (profile_id, server, tool, fields: array of struct(name, type, required)) of the right type, and none that is
    required is missing."""
    rows = calls.join(profiles, ["server", "tool"], "left")
    v = F.try_parse_json("arguments")
    keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    kinds = F.from_json("arguments", F.lit("map<string,string>"))
    types = F.transform_values(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, x: F.schema_of_variant(x))
    names = F.transform("fields", lambda f: f["name"])
    odd = F.size(F.array_except(keys, names)) > 0
    missing = F.exists("fields", lambda f: f["required"] & ~F.array_contains(keys, f["name"]))
    kind = F.exists("fields", lambda f: F.array_contains(keys, f["name"]) & (F.coalesce(F.try_element_at(types, f["name"]), F.lit("")) != f["type"]))
    rejection = (
        F.when(F.col("profile_id").isNull(), "unknown_profile").when(input_rejection(F.col("arguments")).isNotNull(), input_rejection(F.col("arguments")))
        .when(odd, "unknown_field").when(missing, "missing_field").when(F.coalesce(kind, F.lit(True)), "wrong_type")
    )
    return rows.select(*calls.columns, "profile_id", rejection.alias("rejection"))


def reviewed(reviews: DataFrame) -> DataFrame:
    """(candidate_id, status, revision, valid): the state of each candidate by its append-only log (candidate_id, revision,
    from_status, to_status): the last entry's, valid if each entry starts where the one before ended, by an allowed move."""
    w = Window.partitionBy("candidate_id").orderBy("revision")
    allowed = F.create_map(*(x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    first = F.lag("to_status").over(w).isNull()
    ok = F.when(first, F.col("from_status").isNull() & (F.col("to_status") == "proposed")).otherwise(
        (F.col("from_status") == F.lag("to_status").over(w)) & F.array_contains(F.try_element_at(allowed, "from_status"), F.col("to_status")) & (F.col("revision") == F.lag("revision").over(w) + 1)
    )
    rows = reviews.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return rows.groupBy("candidate_id").agg(F.max_by("to_status", "revision").alias("status"), F.max("revision").alias("revision"), F.bool_and("ok").alias("valid"))


def appended(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """log and the new rows; a new row that would change one that is there is an error."""
    met = log.select(*keys, F.struct(*log.columns).alias("a")).join(new.select(*keys, F.struct(*log.columns).alias("b")), keys)
    checked = new.join(met.filter("a <> b").select(*keys, F.lit(True).alias("_changes")), keys, "left")
    checked = checked.filter(F.when(F.col("_changes"), F.raise_error(F.lit("the log is append-only"))).otherwise(True).cast("boolean")).drop("_changes")
    return log.unionByName(checked.join(log, keys, "left_anti"))


def structure_hash(text: Column) -> Column:
    """Hash of the pointers and types of all values of a JSON text, containers and nulls among them, by sorted key; null for
    what is no JSON."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}

    def one(x: str) -> str | None:
        try:
            todo, entries = [("", json.loads(x))], []
        except (ValueError, RecursionError):
            return None
        while todo:
            pointer, value = todo.pop()
            entries.append((pointer, kinds[type(value)]))
            children = [(k.replace("~", "~0").replace("/", "~1"), value[k]) for k in sorted(value)] if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
            todo.extend((f"{pointer}/{k}", child) for k, child in reversed(children))
        return hashlib.sha256(json.dumps(entries, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    return F.pandas_udf(lambda x: x.map(one, na_action="ignore"), "string")(text)


def with_replaced(arguments: Column, pointers: Column, replacement: str) -> Column:
    """JSON objects with the members that top-level pointers name replaced."""

    def one(text: str, found) -> str | None:
        value = json.loads(text)
        names = [p[1:].replace("~1", "/").replace("~0", "~") for p in found]
        if any(p.count("/") != 1 for p in found) or not set(names) <= set(value):
            return None
        return json.dumps(value | dict.fromkeys(names, replacement), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return F.pandas_udf(lambda a, p: pd.Series([one(x, y) for x, y in zip(a, p)], dtype=object), "string")(arguments, pointers)


def redact_decision(finding_id: Column, block_decision_id: Column) -> Column:
    """Id of the decision to redact that a block decision gives; null if that is not the finding's."""
    block = F.sha2(F.concat_ws("\0", finding_id, F.lit("block"), F.lit("PreToolUse")).cast("binary"), 256)
    quoted = F.concat(F.lit('["' + '","'.join(REDACTION) + '","'), block_decision_id, F.lit('","redact","PreToolUse"]'))
    return F.when(finding_id.rlike("^[0-9a-f]{64}$") & (block == block_decision_id), F.sha2(quoted.cast("binary"), 256))


def redaction_plan(calls: DataFrame, findings: DataFrame, targets: DataFrame, replacement: str = "[REDACTED]") -> DataFrame:
    """(call_id, pointers, rewritten, rejection): all or nothing for each call (call_id, arguments, rejection).

    findings: call_id, sink_id, decision (block or other), pointer, redactable. A plan needs a validated call, as many
    findings and targets as the bounds allow, a block decision for each finding, a sink for each target (call_id, sink_id),
    and pointers that may be redacted.
    """
    found = findings.groupBy("call_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("decision") == "block").alias("blocks"), F.bool_and("redactable").alias("redactable"),
        F.sort_array(F.collect_set("pointer")).alias("pointers"), F.collect_set("sink_id").alias("found_sinks"),
    )
    asked = targets.groupBy("call_id").agg(F.collect_set("sink_id").alias("sinks"))
    rows = calls.join(found, "call_id", "left").join(asked, "call_id", "left")
    problem = (
        F.when(F.col("rejection").isNotNull(), F.col("rejection")).when(F.col("n").isNull(), "no_findings").when(F.col("n") > MOST_FINDINGS, "too_many_findings")
        .when(F.size("pointers") > MOST_TARGETS, "too_many_targets").when(~F.col("blocks"), "finding_not_blocked").when(~F.col("redactable"), "not_redactable")
        .when(F.size(F.array_except("found_sinks", F.coalesce("sinks", F.array().cast("array<string>")))) > 0, "sink_not_covered")
    )
    rows = rows.withColumn("rejection", problem)
    empty = F.array().cast("array<string>")
    rewritten = with_replaced(F.col("arguments"), F.coalesce(F.when(F.col("rejection").isNull(), F.col("pointers")), empty), replacement)
    rows = rows.withColumn("rewritten", F.when(F.col("rejection").isNull(), rewritten))
    return rows.select("call_id", F.when(F.col("rejection").isNull(), F.col("pointers")).alias("pointers"), "rewritten", F.when(F.col("rejection").isNull() & F.col("rewritten").isNull(), "unresolved_pointer").otherwise(F.col("rejection")).alias("rejection"))


def confirmations(plans: DataFrame, observed: DataFrame) -> DataFrame:
    """(plan_id, status) of plans (plan_id, workspace_id, session_id, tool_use_id, input_hash, structure) against what was
    observed after the call (same scope; input_hash, structure): confirmed, mismatch, or unobserved."""
    keys = ["workspace_id", "session_id", "tool_use_id"]
    seen = observed.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("input_hash").alias("o_hash"), F.col("structure").alias("o_structure"))
    on = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]
    rows = plans.join(seen, on, "left")
    same = (F.col("input_hash") == F.col("o_hash")) & (F.col("structure") == F.col("o_structure"))
    status = F.when(F.col("o_hash").isNull(), "unobserved").when(same, "confirmed").otherwise("mismatch")
    return rows.groupBy("plan_id").agg(F.max(status).alias("status"))


def cleanup(plans: DataFrame, links: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What retention leaves of plans and their links (both with plan_id), and how many rows go: reasons (plan_id, reason)
    of the plans that go."""
    gone = reasons.filter("reason is not null").select("plan_id").distinct()
    counts = reasons.agg(F.count_if(F.col("reason").isNotNull()).alias("plans"), F.coalesce(F.sum((F.col("reason") == "orphan").cast("long")), F.lit(0)).alias("orphans"))
    dropped = links.join(gone, "plan_id", "left_semi").agg(F.count("*").alias("links"))
    return plans.join(gone, "plan_id", "left_anti"), links.join(gone, "plan_id", "left_anti"), counts.join(dropped)


def held_texts(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(workspace_id, value_id, text_id): which of texts (workspace_id, text_id, text) stand in which of values
    (workspace_id, value_id, value) of their workspace; all are distinct, and an empty text stands in none.

    Values and texts of a workspace are dealt to blocks. Where two blocks meet, the texts are one automaton that reads each
    value once, so that a task takes no more than two blocks, however many texts a workspace has.
    """
    values, texts = values.filter("value is not null"), texts.filter("text <> ''")
    blocks = lambda rows, column, most, name: rows.groupBy("workspace_id").agg(F.ceil(F.sum(F.octet_length(column) + 1) / most).alias(name))
    load = blocks(values, "value", VALUE_BLOCK, "v_blocks").join(blocks(texts, "text", TEXT_BLOCK, "t_blocks"), "workspace_id")

    def dealt(rows: DataFrame, id: str, column: str, own: str, other: str) -> DataFrame:
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(other)
        block = F.pmod(F.xxhash64(id), F.col(f"{own}_blocks")).alias(own)
        return rows.join(load, "workspace_id").select("workspace_id", block, others, id, F.col(column).cast("binary").alias(column))

    def run(v: pa.Table, t: pa.Table) -> pa.Table:
        import ahocorasick

        # Bytes as characters: the automaton takes strings.
        read = lambda rows, id, column: zip(rows.column(id).to_pylist(), (x.decode("latin-1") for x in rows.column(column).to_pylist()))
        automaton, out = ahocorasick.Automaton(), []
        for id, text in read(t, "text_id", "text"):
            automaton.add_word(text, id)
        if len(automaton) and v.num_rows:
            automaton.make_automaton()
            out = [(value_id, text_id) for value_id, value in read(v, "value_id", "value") for text_id in dict.fromkeys(id for _, id in automaton.iter(value))]
            workspace = v.column("workspace_id")[0].as_py()
        named = {"workspace_id": [workspace] * len(out) if out else [], "value_id": [x[0] for x in out], "text_id": [x[1] for x in out]}
        return pa.table({k: pa.array(x, pa.string()) for k, x in named.items()})

    cell = ["workspace_id", "v", "t"]
    met = dealt(values, "value_id", "value", "v", "t").groupBy(*cell).cogroup(dealt(texts, "text_id", "text", "t", "v").groupBy(*cell))
    return met.applyInArrow(run, "workspace_id string, value_id string, text_id string")


def payload_evidence(submitted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per sink (workspace_id, sink_id, segment_index, extraction) of what was submitted (value; null for what could not be
    resolved): statuses, number of values and bytes, and the chunks (workspace_id, chunk_id, text, signal) that a value is
    or holds, of all chunks of its workspace.
    """
    keys = ["workspace_id", "sink_id", "segment_index", "extraction"]
    hashed = lambda column: F.sha2(F.col(column).cast("binary"), 256).alias(f"{column}_id")
    sent = submitted.filter("value is not null").select(*keys, hashed("value")).distinct()
    known = chunks.filter("text is not null").select("workspace_id", "chunk_id", hashed("text"), "signal").distinct()
    values = submitted.filter("workspace_id is not null and value is not null").select("workspace_id", hashed("value"), "value").distinct()
    texts = chunks.filter("workspace_id is not null and text is not null").select("workspace_id", hashed("text"), "text").distinct()
    held = stored(held_texts(values, texts).filter("value_id <> text_id"), "held")
    # A text and a value that holds it are compared once, however many sinks send the value; the comparison takes long, so
    # that pairs are dealt over all tasks however few bytes they are.
    pairs = held.join(known.select("workspace_id", "text_id", "signal").distinct(), ["workspace_id", "text_id"]).select("text_id", "value_id", "signal").distinct()
    pairs = pairs.join(texts.select("text_id", "text").distinct(), "text_id").join(values.select("value_id", "value").distinct(), "value_id")
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value_id", "text_id")
    prepared = with_prepared(with_prepared(pairs, "text", "left"), "value", "right")
    inside = let(compare_binding(F.col("signal"), F.col("left"), F.col("right"), 4), lambda d: d["matched"] & (d["method"] == "substring"))
    compared = stored(prepared.select("text_id", "value_id", "signal", inside.alias("inside")), "compared").filter("inside")
    within = held.join(known, ["workspace_id", "text_id"]).alias("h")
    by_text = [F.col(f"h.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("text_id", "value_id", "signal")]
    within = within.join(compared.alias("i"), by_text, "left_semi").select("workspace_id", "value_id", "chunk_id", F.lit("resolved_payload_exact_substring").alias("method"))
    exact = known.select("workspace_id", F.col("text_id").alias("value_id"), "chunk_id", F.lit("resolved_payload_exact").alias("method"))
    matched = sent.join(exact.unionByName(within), ["workspace_id", "value_id"]).groupBy(*keys, "chunk_id").agg(F.min("method").alias("method"))
    matched = matched.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("chunk_id", "method"))).alias("matches"))
    counts = submitted.groupBy(*keys).agg(F.count("value").alias("values"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
    rows = counts.join(matched, keys, "left")
    evaluated = F.col("values") > 0
    resolved, compared = F.when(evaluated, "evaluated").otherwise("unsupported"), F.when(evaluated, "evaluated").otherwise("not_run")
    snapshot = F.when(F.col("values") == 0, "unresolved").when(F.col("extraction") == "resolved_file", "pre_execution_file_snapshot").otherwise("tool_input_literal")
    none = F.array().cast("array<struct<chunk_id:string,method:string>>")
    out = rows.select(*keys, resolved.alias("resolution_status"), compared.alias("comparison_status"), snapshot.alias("snapshot"), "values", "bytes", F.coalesce("matches", none).alias("matches"))
    kind = F.array_min(F.transform("matches", lambda m: m["method"]))
    return out.withColumn("shadow_action", shadow_action(F.col("resolution_status"), F.col("comparison_status"), F.coalesce(kind, F.lit(""))))


def exact_file_decisions(evidence: DataFrame, sinks: DataFrame, run_id: str) -> DataFrame:
    """Block decisions of payload_evidence(): only where a file was resolved and compared before the call ran, for HTTP
    sinks (node_id, sink_type, workspace_id) of the same workspace."""
    sure = evidence.filter("resolution_status = 'evaluated' and comparison_status = 'evaluated' and extraction = 'resolved_file' and snapshot = 'pre_execution_file_snapshot'")
    known = sinks.filter("sink_type = 'external_http_request'").select(F.col("node_id").alias("sink_id"), "workspace_id", "sink_type")
    rows = sure.join(known, ["sink_id", "workspace_id"]).select("sink_id", "segment_index", "sink_type", F.inline("matches"))
    finding = identity(F.lit(run_id), F.col("chunk_id"), F.col("sink_id"), F.col("segment_index"), F.col("method"))
    rows = rows.withColumn("finding_id", finding).withColumn("decision_id", identity(F.col("finding_id"), F.lit("block"), F.lit("PreToolUse")))
    return rows.select("decision_id", "finding_id", F.lit("block").alias("action"), F.lit("critical").alias("severity"), "sink_type", F.col("chunk_id").alias("source"), F.col("sink_id").alias("node"), F.lit(1.0).alias("score"), F.lit("PreToolUse").alias("hook"), F.lit("resolved_file_exact").alias("evidence_kind"))
