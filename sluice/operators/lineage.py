"""Best-path lineage from sources through weighted edges: propagation, paths, trees, findings at sinks, and policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.storage import discard, stored

#: Frontiers that are kept apart before they are merged into one table.
MERGE_EVERY = 6
#: Nodes that edges lead to which every executor gets.
MOST_ENDS = 1_000_000
#: Sink types that a critical finding blocks, order of actions, and what is said to a user.
BLOCKED = (
    "external_http_request external_message external_git_publish external_package_publish external_deploy external_search"
    " external_api_call external_file_transfer"
).split()
ACTIONS = ["block", "continue_review", "redact", "warn", "allow"]
SEVERITIES = ["critical", "high", "medium", "low"]
SAID = {
    "answer": "Protected source content appears in the final answer. Revise the final answer to remove protected details, then continue.",
    "external": "Protected source content would be sent to an external sink. Remove protected details from the tool input before retrying.",
    "file": "Protected source content was found in a file-backed external payload. Remove protected content from the referenced file or choose a public payload before retrying.",
    "other": "Protected source content reached a policy-controlled sink. Review and remove protected details before continuing.",
}
ASSIGNED = ["source", "node", "score", "hops", "edge_id"]


def _best(rows: DataFrame) -> DataFrame:
    """Of a source's paths to a node the best: the highest score, then the fewest hops, then the smallest last edge."""
    chosen = F.min(F.struct((-F.col("score")).alias("s"), "hops", "edge_id")).alias("b")
    return rows.groupBy("source", "node").agg(chosen).select("source", "node", (-F.col("b.s")).alias("score"), "b.hops", "b.edge_id")


def _extended(known: DataFrame, start: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """Follow edges from the rows of start until nothing improves: (known with all that was found, what was written).

    Each hop writes its frontier only; what is known is the best of all frontiers, merged into one table now and then. A hop
    ends at nodes that edges lead to. Where these are few enough for every executor, known rows of other nodes are never
    looked up, and of the edges only those that start at them are read from the second hop on.
    """
    mine = not hasattr(edges, "stored_at")
    edges = edges.select(F.col("src").alias("node"), "dst", F.col("score").alias("w"), F.col("edge_id").alias("e"))
    edges = stored(edges, "edges") if mine else edges
    ends = stored(edges.select(F.col("dst").alias("node")).distinct(), "ends")
    few = ends.count() <= MOST_ENDS
    at_ends = lambda rows: rows.join(F.broadcast(ends), "node", "left_semi") if few else rows
    parts, frontier, used, better = [known], start, [edges], False
    while not frontier.isEmpty():
        if few and len(used) == 1 and frontier is not start:
            used.append(stored(at_ends(edges), "edges"))
        step = frontier.join(used[-1], "node")
        step = step.select("source", F.col("dst").alias("node"), (F.col("score") * F.col("w")).alias("score"), (F.col("hops") + 1).alias("hops"), F.col("e").alias("edge_id"))
        old = at_ends(parts[0]).select("source", "node", "score")
        for part in parts[1:]:
            old = old.unionByName(part.select("source", "node", "score"))
        old = old.groupBy("source", "node").agg(F.max("score").alias("old"), F.lit(True).alias("seen"))
        step = _best(step.filter(F.col("score") >= least)).join(old, ["source", "node"], "left")
        found = stored(step.filter("old is null or score > old").drop("old"), "frontier")
        better = better or not found.filter("seen").isEmpty()
        frontier = found.drop("seen")
        frontier.stored_at = found.stored_at
        parts.append(frontier)
        if len(parts) > MERGE_EVERY:
            merged = stored(_latest(parts, better), "known")
            discard(*parts[1:-1])
            parts, better = [merged], False
    discard(*(used if mine else used[1:]), ends)
    return _latest(parts, better), parts


def _latest(parts: list[DataFrame], better: bool) -> DataFrame:
    """The best row of each source and node: a later frontier holds only better ones. better: whether any frontier holds a
    row of what was known before it; if none does, all rows stay."""
    rows = parts[0].select(*ASSIGNED)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*ASSIGNED))
    return _best(rows) if better else rows


def propagate(seeds: DataFrame, edges: DataFrame, least: float = 0.15) -> DataFrame:
    """Best product of scores from each source to each node it reaches with at least `least`.

    seeds: source, node, score, edge_id, taken whatever their score; edges: src, dst, score, edge_id. Only improved nodes
    go on, until nothing improves; scores are at most 1, so that it ends on cycles. Returns source, node, score, hops,
    edge_id (the last edge).
    """
    start = stored(_best(seeds.select("source", "node", "score", F.lit(1).alias("hops"), "edge_id")), "seeds")
    return _extended(start, start, edges, least)[0]


def propagate_new(known: DataFrame, seeds: DataFrame, edges: DataFrame, least: float = 0.15) -> DataFrame:
    """The rows of lineage that new seeds and new edges change, given what is known (as propagate() returns it): better
    seeds, and nodes known already at which a new edge starts, are where the search goes on."""
    known = stored(known.select(*ASSIGNED), "known")
    old = known.select("source", "node", F.col("score").alias("old"))
    fresh = _best(seeds.select("source", "node", "score", F.lit(1).alias("hops"), "edge_id")).join(old, ["source", "node"], "left")
    better = stored(fresh.filter("old is null or score > old").drop("old"), "better")
    reached = known.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(*ASSIGNED)
    start = stored(_best(better.unionByName(reached)), "start")
    found = _extended(_best(known.unionByName(better.select(*ASSIGNED))), start, edges, least)[0]
    return found.join(old, ["source", "node"], "left").filter("old is null or score > old").drop("old")


def paths(lineage: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, step, node, edge_id): the nodes from source (step 0) to each target (source, node), walked back by
    last edges. A path whose edge is not there starts at the node that was reached last."""
    came = lineage.join(edges.select("edge_id", F.col("src").alias("previous")), "edge_id", "left").select("source", "node", "hops", "edge_id", "previous")
    came = stored(came, "came")
    rows = stored(targets.select("source", F.col("node").alias("target")).join(came.withColumnRenamed("node", "target"), ["source", "target"]).withColumn("node", F.col("target")), "walk")
    parts = [rows]
    # hops falls with each step back, so that this ends whatever the edges are.
    while not rows.isEmpty():
        back = rows.filter("previous <> source").select("source", "target", F.col("previous").alias("node"), F.col("hops").alias("bound"))
        if back.isEmpty():
            break
        rows = stored(back.join(came, ["source", "node"]).filter("hops < bound").select("source", "target", "hops", "edge_id", "previous", "node"), "walk")
        parts.append(rows)
    found = parts[0].select("source", "target", F.col("hops").alias("step"), "node", "edge_id")
    for part in parts[1:]:
        found = found.union(part.select("source", "target", "hops", "node", "edge_id"))
    roots = targets.select("source", F.col("node").alias("target"), F.lit(0).alias("step"), F.col("source").alias("node"), F.lit(None).cast(found.schema["edge_id"].dataType).alias("edge_id"))
    return found.union(roots)


def tree(lineage: DataFrame, edges: DataFrame, least: float = 0.0, most_depth: int | None = None) -> DataFrame:
    """(source, parent, node, depth, sibling, score, edge_id): for each node of a source's tree the node that its last edge
    comes from, its depth, and its place among siblings by depth and id."""
    rows = lineage.filter(F.col("score") >= least).join(edges.select("edge_id", F.col("src").alias("parent")), "edge_id")
    order = Window.partitionBy("source", "parent").orderBy("hops", "node")
    rows = rows.withColumn("sibling", F.row_number().over(order))
    if most_depth is not None:
        rows = rows.filter(F.col("hops") <= most_depth)
    return rows.select("source", "parent", "node", F.col("hops").alias("depth"), "sibling", "score", "edge_id")


def summary(lineage: DataFrame) -> DataFrame:
    """Per source: nodes reached, the longest path, the best and the least score."""
    return lineage.groupBy("source").agg(F.count("*").alias("nodes"), F.max("hops").alias("longest"), F.max("score").alias("best"), F.min("score").alias("least"))


def subgraph(lineage: DataFrame, edges: DataFrame, all_edges: bool = False) -> DataFrame:
    """Edges that lineage took last; with all_edges, every edge at a node of lineage."""
    if not all_edges:
        return edges.join(lineage.select("edge_id").distinct(), "edge_id", "left_semi")
    nodes = lineage.select(F.explode(F.array(F.col("source").cast("string"), F.col("node").cast("string"))).alias("n")).distinct()
    out = edges.join(nodes, edges["src"].cast("string") == nodes["n"], "left_semi")
    return out.unionByName(edges.join(nodes, edges["dst"].cast("string") == nodes["n"], "left_semi")).distinct()


def mermaid(edges: DataFrame) -> DataFrame:
    """(line_no, line) of a flow chart: nodes, then edges, each in order."""
    return _lines(edges, "flowchart TD", '  %s["%s"]', "  %s -->|%s %.3f| %s", None)


def dot(edges: DataFrame) -> DataFrame:
    """(line_no, line) of a directed graph in the DOT language."""
    return _lines(edges, "digraph information_flow {", '  %s [label="%s"];', '  %s -> %4$s [label="%2$s %3$.3f"];', "}")


def _lines(edges: DataFrame, first: str, node: str, edge: str, last: str | None) -> DataFrame:
    name = lambda c: F.concat(F.lit("n_"), F.left(F.sha2(c.cast("string").cast("binary"), 256), F.lit(12)))
    label = F.replace(F.col("n").cast("string"), F.lit('"'), F.lit("'"))
    nodes = edges.select(F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("n")).distinct()
    rows = nodes.select(F.lit(1).alias("part"), F.col("n").alias("k"), F.format_string(node, name(F.col("n")), label).alias("line"))
    drawn = F.format_string(edge, name(F.col("src")), F.replace(F.col("relation"), F.lit("|"), F.lit("/")), F.col("score").cast("double"), name(F.col("dst")))
    rows = rows.union(edges.select(F.lit(2), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), "relation", "edge_id"), drawn))
    spark = edges.sparkSession
    ends = [(0, "", first)] + ([(3, "", last)] if last else [])
    return rows.union(spark.createDataFrame(ends, "part int, k string, line string")).orderBy("part", "k")


def severity(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def findings(lineage: DataFrame, sinks: DataFrame, least: float = 0.3, included: tuple[str, ...] = (), only: tuple[str, ...] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Lineage that reaches a sink (node, sink_type) with at least `least`, with severity: external sinks, those of a type
    in included, of these the ones in only. sources (source): those whose findings are wanted."""
    kind = F.col("sink_type")
    wanted = kind.startswith("external_") | kind.isin(*included) if included else kind.startswith("external_")
    wanted = wanted & kind.isin(*only) if only is not None else wanted
    rows = lineage.filter(F.col("score") >= least)
    if sources is not None:
        rows = rows.join(sources.select("source").distinct(), "source", "left_semi")
    return rows.join(sinks.filter(wanted), "node").withColumn("severity", severity(F.col("score")))


def identity(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(p.cast("string") for p in parts)).cast("binary"), 256)


def decide(found: DataFrame, blocked: list[str] = BLOCKED) -> DataFrame:
    """Action, hook and reason of each finding."""
    kind, grade = F.col("sink_type"), F.col("severity")
    action = (
        F.when(~grade.isin("critical", "high"), "allow")
        .when((grade == "critical") & (kind == "final_answer"), "continue_review")
        .when((grade == "critical") & kind.isin(*blocked), "block")
        .otherwise("warn")
    )
    hook = F.when(kind == "final_answer", "Stop").when(kind.startswith("external_"), "PreToolUse")
    reason = F.concat(F.col("action"), F.lit(" because "), grade, F.lit(" source lineage reached "), kind, F.lit(" sink candidate"))
    return found.withColumn("action", action).withColumn("hook", hook).withColumn("reason", reason)


def decision_ids(decisions: DataFrame, run: Column) -> DataFrame:
    """finding_id and decision_id of decisions with source_kind."""
    rows = decisions.withColumn("finding_id", identity(run, F.col("source_kind"), F.col("source"), F.col("node")))
    return rows.withColumn("decision_id", identity(F.col("finding_id"), F.col("action"), F.coalesce("hook", F.lit("-"))))


def action_rank(action: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ACTIONS)), action), F.lit(0)) - 1, F.lit(9))


def strongest(decisions: DataFrame, by: list[str], hook: str | None = None) -> DataFrame:
    """The first decision of each group by action, score, source and sink; with hook, of those that it can show: findings
    of external sinks show at PreToolUse, PermissionRequest and PostToolUse, those of answers at Stop."""
    if hook is not None:
        shown = F.col("sink_type").startswith("external_") & F.lit(hook in ("PreToolUse", "PermissionRequest", "PostToolUse"))
        decisions = decisions.filter((F.col("hook") == hook) | shown | ((F.col("sink_type") == "final_answer") & F.lit(hook == "Stop")))
    order = F.struct(action_rank(F.col("action")).alias("r"), (-F.col("score")).alias("s"), "source", "node")
    rest = [c for c in decisions.columns if c not in by]
    return decisions.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("d")).select(*by, "d.*")


def ordered(decisions: DataFrame) -> DataFrame:
    return decisions.orderBy(action_rank(F.col("action")), F.desc("score"), "source", "node")


def ordered_findings(found: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return found.orderBy(rank, F.desc("score"), "source", "node")


def explained(decisions: DataFrame, command: str = "sluice trace") -> DataFrame:
    """decisions (source_kind, ...) with what a user, and an engineer, is told."""
    kind = F.col("sink_type")
    told = F.when(kind == "final_answer", SAID["answer"]).when(kind.startswith("external_"), SAID["external"]).otherwise(SAID["other"])
    if "evidence_kind" in decisions.columns:
        told = F.when(F.col("evidence_kind") == "resolved_file_exact", SAID["file"]).otherwise(told)
    source = F.concat_ws(":", "source_kind", F.col("source").cast("string"))
    facts = F.format_string("source=%s sink=%s score=%.2f severity=%s", source, kind, F.col("score").cast("double"), F.col("severity"))
    trace = F.concat(F.lit(f"{command} --node sink_candidate:"), F.col("node").cast("string"))
    shown = F.format_string("Source: %s; Sink: %s; Score: %.2f; Severity: %s", source, kind, F.col("score").cast("double"), F.col("severity"))
    rows = decisions.withColumn("user_message", told).withColumn("technical_summary", facts).withColumn("trace_command", trace)
    return rows.withColumn("message", F.concat_ws("\n", "user_message", shown, F.concat(F.lit("Trace: "), "trace_command")))


def hook_output(hook: Column, action: Column, message: Column) -> Column:
    """JSON that a hook answers with; {} where it has nothing to say."""
    specific = lambda *parts: F.to_json(F.struct(F.struct(*parts).alias("hookSpecificOutput")))
    name = hook.alias("hookEventName")
    context = specific(name, message.alias("additionalContext"))
    denied = specific(name, F.lit("deny").alias("permissionDecision"), message.alias("permissionDecisionReason"))
    refused = specific(name, F.struct(F.lit("deny").alias("behavior"), message.alias("message")).alias("decision"))
    stopped = F.to_json(F.struct(F.lit("block").alias("decision"), message.alias("reason"), F.struct(name, message.alias("additionalContext")).alias("hookSpecificOutput")))
    review = F.to_json(F.struct(F.lit("block").alias("decision"), message.alias("reason")))
    pre, ask, post, stop = (hook == x for x in ("PreToolUse", "PermissionRequest", "PostToolUse", "Stop"))
    return (
        F.when(pre & (action == "block"), denied)
        .when((pre | post) & (action == "warn"), context)
        .when(ask & (action == "block"), refused)
        .when(post & (action == "block"), stopped)
        .when(stop & (action == "continue_review"), review)
        .when(stop & (action == "warn"), F.to_json(F.struct(message.alias("systemMessage"))))
        .otherwise("{}")
    )
