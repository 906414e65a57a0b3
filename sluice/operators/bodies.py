"""What HTTP commands send: literal bodies, and the content of files as it was before the command ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import shell
from sluice.operators.files import CONTENT_ROLES, chain, steps
from sluice.operators.filesystem import normal_path
from sluice.operators.fragments import SHELL_TOOLS, tool_kind
from sluice.operators.operations import commands, call_key, segment_id
from sluice.operators.storage import stored

#: Fixed values.
MOST_REFERENCES, MOST_PATH_BYTES = 8, 4096


def version_texts(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(node_id, content) of versions (files.chain()) whose content one fragment shows: what a tool wrote or read."""
    told = rows.filter("makes and kind in ('tool_write', 'tool_read') and size(fragments) = 1")
    # Other texts are never a step's content (files.calls()), and not shuffled.
    shown = contexts.filter(F.col("semantic_role").isin(*CONTENT_ROLES)).select("fragment_id", F.col("text").alias("content"))
    return told.select(F.col("own_id").alias("node_id"), F.col("fragments")[0].alias("fragment_id")).join(shown, "fragment_id").select("node_id", "content")


def _looks(references: DataFrame, like: DataFrame) -> DataFrame:
    """references (call_key, workspace_id, session_id, at, path, link) as steps that look at a path before their call does
    anything."""
    given = {"effect": F.lit("P"), "kind": F.lit("body"), "step": F.lit(-1), "state": F.lit("present")}
    columns = [given.get(f.name, F.col(f.name) if f.name in references.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    return references.select(*columns)


def bodies(contexts: DataFrame, root: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """What the HTTP segments of shell commands send, a row for each body in order: workspace_id, session_id, sink_id (of
    flow.shell_sinks()), segment_index, extraction (static_values, resolved_file, coarse_fallback), value (null if it is
    not known), reason (why not).

    A segment whose bodies are not all literal is told if every one is literal or --data-binary @file, the file's path is
    relative and stays inside root, and its content is that of the version which held before the call: an as-of look at
    the chain of versions. All or nothing counts for a segment; a command's bodies share bounds on their number, bytes
    and files, used up in order.
    """
    rows = commands(contexts, call_key()).filter(tool_kind(F.col("tool_name")).isin(SHELL_TOOLS))
    rows = stored(rows.withColumn("plan", shell.plan(F.col("text"))).filter("plan is not null"), "plans")
    rows = stored(rows.select("*", shell.submissions(F.col("plan")).alias("static"), F.filter("plan", shell.sends_http).alias("segments")).drop("plan").filter("size(segments) > 0"), "sent")
    # The call's place among others is that of its first event.
    first = contexts.groupBy(call_key().alias("call_key")).agg(F.min("sequence_no").alias("at"))
    each = rows.join(first, "call_key").select(
        "call_key", "workspace_id", "session_id", "tool_use_id", "event_id", "cwd", "fragment_id", "at",
        F.explode(F.arrays_zip("static", shell.file_bodies(F.col("segments")).alias("file"), F.col("segments").alias("segment"))).alias("b"),
    )
    literal = F.col("b.static.extraction") == "static_values"
    parts = F.when(literal, F.transform("b.static.submitted", lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("path")))).otherwise(F.col("b.file.parts"))
    segment = F.col("b.segment")
    each = each.select(
        "call_key", "workspace_id", "session_id", "tool_use_id", "event_id", "cwd", "at", segment["index"].alias("segment_index"), literal.alias("literal"),
        segment_id(F.col("fragment_id"), segment["index"], segment["text"]).alias("segment_id"), F.when(~literal, F.col("b.file.reason")).alias("reason"), parts.alias("parts"),
    )
    each = stored(each, "submissions")
    at = each.select("*", F.posexplode_outer("parts").alias("k", "part"))
    path = F.col("part.path")
    refused = (
        F.when((path == "") | (F.octet_length(path) > MOST_PATH_BYTES) | F.contains(path, F.lit("\0")), "invalid_file_reference")
        .when(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), "file_reference_outside_workspace")
    )
    at = at.withColumn("refused", refused).withColumn("whole", F.when(path.isNotNull() & F.col("refused").isNull(), normal_path(path, F.col("cwd"), F.lit(root).cast("string"))))
    at = at.withColumn("refused", F.when(path.isNotNull() & F.col("refused").isNull() & F.col("whole").isNull(), "file_reference_outside_workspace").otherwise(F.col("refused")))
    at = stored(at.withColumn("link", F.concat_ws("\0", "call_key", F.col("segment_index").cast("string"), F.col("k").cast("string"))), "bodies")
    operations = steps(contexts, root)
    asked = at.filter("whole is not null").select("call_key", "workspace_id", "session_id", "tool_use_id", "at", F.col("whole").alias("path"), "link")
    followed = stored(chain(operations.unionByName(_looks(asked, operations)), known), "followed")
    held = followed.filter("kind = 'body' and before_id is not null").select("link", F.col("before_id").alias("node_id"))
    # Most versions are never sent, and their content is not looked up.
    asked_for = followed.join(held.select(F.col("node_id").alias("own_id")).distinct(), "own_id", "left_semi")
    held = held.join(version_texts(asked_for, contexts), "node_id")
    found = at.join(held.select("link", "content"), "link", "left")
    value = F.when(path.isNull(), F.col("part.value")).otherwise(F.col("content"))
    reason = F.when(path.isNotNull(), F.coalesce("refused", F.when(F.col("content").isNull(), "file_reference_unavailable"), F.when(F.contains("content", F.lit("\0")), "resolved_payload_not_text")))
    item = F.struct("segment_index", "k", value.alias("value"), path.isNotNull().alias("is_file"), reason.alias("reason"), F.col("reason").alias("why"), "literal", "segment_id")
    whole = found.groupBy("call_key", "workspace_id", "session_id", "tool_use_id", "event_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    whole = whole.withColumn("failed", _within_bounds(F.col("items")))
    out = whole.select("workspace_id", "session_id", "tool_use_id", "event_id", "failed", F.explode("items").alias("i"))
    why = F.try_element_at("failed", F.col("i.segment_index"))
    identity = F.concat_ws(
        "\0", F.lit("sink_candidate_v2"), F.coalesce("workspace_id", F.lit("legacy-unscoped")), F.lit("external_http_request"), F.coalesce("session_id", F.lit("-")),
        F.coalesce("tool_use_id", "event_id"), "i.segment_id",
    )
    told = why.isNull()
    kind = F.when(told & F.col("i.literal"), "static_values").when(told, "resolved_file").otherwise("coarse_fallback")
    out = out.select(
        "workspace_id", "session_id", F.sha2(identity.cast("binary"), 256).alias("sink_id"), F.col("i.segment_index").alias("segment_index"), F.col("i.k").alias("k"), kind.alias("extraction"),
        F.when(told, F.col("i.value")).alias("value"), why.alias("reason"),
    )
    # A segment that can't be told is one row.
    return out.filter("reason is null or coalesce(k, 0) = 0").drop("k")


def _within_bounds(items: Column) -> Column:
    """map(segment_index, reason) of the segments that can't be told: by themselves, or as the bounds are used up."""
    start = F.struct(F.lit(shell.MOST_VALUES).alias("values"), F.lit(shell.MOST_BYTES).alias("bytes"), F.lit(MOST_REFERENCES).alias("files"), F.create_map().cast("map<int,string>").alias("failed"))

    def step(s: Column, i: Column) -> Column:
        size = F.octet_length(F.coalesce(i["value"], F.lit("")))
        out_of_files = i["is_file"] & (s["files"] <= 0)
        limit = (
            F.when(i["value"].isNull() & i["is_file"].eqNullSafe(F.lit(False)), i["why"])
            .when(out_of_files, "file_reference_limit_exceeded").when(i["reason"].isNotNull(), i["reason"])
            .when((size > shell.MOST_VALUE_BYTES) | (size > s["bytes"]) | (s["values"] <= 0), "resolved_payload_limit_exceeded").otherwise(i["why"])
        )
        gone = F.map_contains_key(s["failed"], i["segment_index"])
        uses = ~gone & (limit.isNull() | limit.eqNullSafe(i["why"])) & i["value"].isNotNull()
        failed = F.when(~gone & limit.isNotNull(), F.map_concat(s["failed"], F.create_map(i["segment_index"], limit))).otherwise(s["failed"])
        return F.struct(
            (s["values"] - F.when(uses, 1).otherwise(0)).alias("values"), (s["bytes"] - F.when(uses, size).otherwise(0)).alias("bytes"),
            (s["files"] - F.when(i["is_file"] & ~gone & ~out_of_files, 1).otherwise(0)).alias("files"), failed.alias("failed"),
        )

    return F.aggregate(items, start, step)["failed"]
