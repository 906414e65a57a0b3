"""Queries over lineage, decisions, evaluations, settings and reviews; customers, orders and suppliers make the graph, labels
and documents the cases, events the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import count_bucket
from sluice.operators import lineage, metrics, workflow
from sluice.operators.storage import stored
from sluice.plans.catalog import FINDINGS_SQL, GRAPH_SQL, decided, order_edges
from sluice.plans.registry import query, read


def with_lineage(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lineage, and all edges with those that bind sources. The edges are a table, as both read them."""
    seeds, edges = order_edges(spark, sf_dir)
    edges = stored(edges, "edges")
    bindings = seeds.select(F.col("source").alias("src"), F.col("node").alias("dst"), "score", "edge_id")
    return lineage.propagate(seeds, edges), bindings.unionByName(edges).withColumn("relation", F.lit("flows"))


@query(GRAPH_SQL + """, t AS (SELECT * FROM b WHERE node LIKE 's%' AND score >= 0.7)
SELECT source, node AS target, unnest([0, 1, 2]) AS step, unnest([source, split_part(edge_id, '-', 1), node]) AS node FROM t""")
def lineage_paths(spark, sf_dir):
    known, edges = with_lineage(spark, sf_dir)
    return lineage.paths(known, edges, known.filter("node like 's%' and score >= 0.7")).select("source", "target", "step", "node")


@query(GRAPH_SQL + """SELECT source, CASE hops WHEN 1 THEN source ELSE split_part(edge_id, '-', 1) END AS parent, node, hops AS depth,
  CAST(row_number() OVER (PARTITION BY source, CASE hops WHEN 1 THEN source ELSE split_part(edge_id, '-', 1) END ORDER BY hops, node) AS INTEGER) AS sibling FROM b WHERE score >= 0.5""")
def lineage_tree(spark, sf_dir):
    return lineage.tree(*with_lineage(spark, sf_dir), least=0.5).select("source", "parent", "node", "depth", "sibling")


@query(GRAPH_SQL + "SELECT source, count(*) AS nodes, max(hops) AS longest, round(max(score), 9) AS best, round(min(score), 9) AS least FROM b GROUP BY source")
def lineage_summary(spark, sf_dir):
    found = lineage.summary(with_lineage(spark, sf_dir)[0])
    return found.select("source", "nodes", "longest", F.round("best", 9).alias("best"), F.round("least", 9).alias("least"))


@query(GRAPH_SQL + """, e AS (SELECT edge_id, score FROM p WHERE hops = 1 UNION SELECT src || '-' || dst, score FROM f)
SELECT edge_id, round(score, 9) AS score FROM e WHERE edge_id IN (SELECT edge_id FROM b)""")
def lineage_subgraph(spark, sf_dir):
    return lineage.subgraph(*with_lineage(spark, sf_dir)).select("edge_id", F.round("score", 9).alias("score"))


@query(GRAPH_SQL + """, e AS (SELECT source AS src, node AS dst, score, edge_id FROM p WHERE hops = 1 UNION SELECT src, dst, score, src || '-' || dst FROM f),
u AS (SELECT * FROM e WHERE edge_id IN (SELECT edge_id FROM b)), n AS (SELECT src AS n FROM u UNION SELECT dst FROM u)
SELECT 'flowchart TD' AS line UNION ALL SELECT '  n_' || left(sha256(n), 12) || '["' || n || '"]' FROM n
UNION ALL SELECT '  n_' || left(sha256(src), 12) || ' -->|flows ' || printf('%.3f', score) || '| n_' || left(sha256(dst), 12) FROM u""")
def graph_chart(spark, sf_dir):
    known, edges = with_lineage(spark, sf_dir)
    return lineage.mermaid(stored(lineage.subgraph(known, edges), "drawn")).select("line")


@query(FINDINGS_SQL + """SELECT source, node, 'source=customer:' || source || ' sink=' || sink_type || ' score=' || round(CAST(score AS DECIMAL(18, 9)), 2) || ' severity=' || severity AS technical_summary,
  CASE WHEN action = 'block' AND hook = 'PreToolUse' THEN 'deny' WHEN action = 'continue_review' THEN 'block' WHEN action = 'warn' AND hook = 'PreToolUse' THEN 'context' WHEN action = 'warn' THEN 'system' ELSE '{}' END AS answer FROM d""")
def decision_reports(spark, sf_dir):
    told = lineage.explained(decided(spark, sf_dir).withColumn("source_kind", F.lit("customer")).withColumn("score", F.round("score", 9)))
    out = told.withColumn("json", lineage.hook_output(F.col("hook"), F.col("action"), F.col("message")))
    answer = F.coalesce(
        F.get_json_object("json", "$.hookSpecificOutput.permissionDecision"), F.get_json_object("json", "$.decision"),
        F.when(F.get_json_object("json", "$.hookSpecificOutput.additionalContext") == F.col("message"), "context"),
        F.when(F.get_json_object("json", "$.systemMessage") == F.col("message"), "system"), F.col("json"),
    )
    return out.select("source", "node", "technical_summary", answer.alias("answer"))


@query("SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 16 THEN '5-16' ELSE '17+' END AS bucket, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def line_count_buckets(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("orders"))


CASES_SQL = """WITH c AS (SELECT doc_id AS id, lang AS family, source, l.quality = 0 AS expected, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) > 0.03 * length(d.text) AS actual,
  [lang, source] AS tags, CASE WHEN l.toxic = 1 THEN 'block' WHEN l.quality = 0 THEN 'warn' ELSE 'allow' END AS expected_action, CASE WHEN doc_id % 7 = 0 THEN 'block' WHEN doc_id % 5 = 0 THEN 'warn' ELSE 'allow' END AS actual_action,
  'g' || doc_id // 4 AS counterfactual_group, n_chars FROM labels l JOIN documents d USING (doc_id))
"""


def cases(spark, sf_dir) -> DataFrame:
    t = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    wanted = F.when(F.col("toxic") == 1, "block").when(F.col("quality") == 0, "warn").otherwise("allow")
    taken = F.when(F.col("doc_id") % 7 == 0, "block").when(F.col("doc_id") % 5 == 0, "warn").otherwise("allow")
    return t.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("family"), "source", (F.col("quality") == 0).alias("expected"), (symbols > 0.03 * F.length("text")).alias("actual"),
        F.array("lang", "source").alias("tags"), wanted.alias("expected_action"), taken.alias("actual_action"),
        F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4).cast("string")).alias("counterfactual_group"), "n_chars",
    )


def acted(spark, sf_dir) -> DataFrame:
    return cases(spark, sf_dir).select("id", F.col("expected_action").alias("expected"), F.col("actual_action").alias("actual"))


@query(CASES_SQL + """, t AS (SELECT DISTINCT id, expected, actual, unnest(tags) AS tag FROM c),
m AS (SELECT tag, count(*) FILTER (expected AND actual) AS tp, count(*) FILTER (NOT expected AND actual) AS fp, count(*) FILTER (expected AND NOT actual) AS fn, count(*) FILTER (NOT expected AND NOT actual) AS tn FROM t GROUP BY tag)
SELECT tag, tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM m""")
def metrics_by_tag(spark, sf_dir):
    return metrics.by_tag(cases(spark, sf_dir)).select("tag", "tp", "fp", "fn", "tn", "precision", "recall")


@query(CASES_SQL + "SELECT id, CASE WHEN actual THEN 'false_positive' ELSE 'false_negative' END AS kind FROM c WHERE expected <> actual")
def wrong_cases(spark, sf_dir):
    return metrics.wrong(cases(spark, sf_dir))


@query(CASES_SQL + """, n AS (SELECT expected_action AS expected, actual_action AS actual, count(*) AS n FROM c GROUP BY ALL)
SELECT *, sum(CASE WHEN expected = actual THEN n ELSE 0 END) OVER (PARTITION BY expected) / sum(n) OVER (PARTITION BY expected) AS accuracy FROM n""")
def action_confusion(spark, sf_dir):
    return metrics.actions(acted(spark, sf_dir))


@query(CASES_SQL + """SELECT id, CASE WHEN expected_action = 'allow' AND actual_action = 'block' THEN 'false_block' WHEN expected_action = 'allow' THEN 'unexpected_warning' ELSE 'missed_block' END AS kind FROM c
  WHERE expected_action = 'allow' AND actual_action <> 'allow' OR expected_action = 'block' AND actual_action <> 'block'""")
def action_errors(spark, sf_dir):
    return metrics.action_errors(acted(spark, sf_dir))


@query(CASES_SQL + """, g AS (SELECT counterfactual_group, count(*) = 2 AND bool_and(expected = actual) AS ok FROM c GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (ok) AS passed, count(*) FILTER (ok) / count(*) AS accuracy FROM g""")
def counterfactual_groups(spark, sf_dir):
    return metrics.counterfactuals(cases(spark, sf_dir).withColumn("correct", F.col("expected") == F.col("actual")))


@query(CASES_SQL + """SELECT family AS method, count(*) AS n, min(n_chars) AS least, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most FROM c GROUP BY 1""")
def score_stats(spark, sf_dir):
    return metrics.score_stats(cases(spark, sf_dir).select(F.col("family").alias("method"), F.col("n_chars").alias("score")))


@query(CASES_SQL + """SELECT family, count(*) AS n, count(*) FILTER (expected) AS positives, count(*) FILTER (expected AND actual) AS retrieved, count(*) FILTER (expected AND actual) / nullif(count(*) FILTER (expected), 0) AS recall,
  quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, count(*) FILTER (n_chars >= 1000) / count(*) AS saturation FROM c GROUP BY 1""")
def retrieval_metrics(spark, sf_dir):
    rows = cases(spark, sf_dir).select("family", F.col("expected").alias("relevant"), F.col("actual").alias("found"), F.col("n_chars").alias("n_candidates"))
    return metrics.retrieval(rows, 1000, "family")


@query("""WITH e AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1), a AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id % 9 = 0),
m AS (SELECT count(*) FILTER (e.id IS NOT NULL AND a.id IS NOT NULL) AS tp, count(*) FILTER (e.id IS NULL) AS fp, count(*) FILTER (a.id IS NULL) AS fn FROM e FULL JOIN a ON e.id = a.id)
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM m""")
def selector_sets(spark, sf_dir):
    expected = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return metrics.sets(expected, read(spark, sf_dir, "documents").filter("doc_id % 9 = 0").select(F.col("doc_id").alias("id"))).drop("f1")


@query(CASES_SQL + """, f AS (SELECT family, count(*) FILTER (NOT actual) / count(*) AS s FROM c WHERE NOT expected GROUP BY 1) SELECT count(*) AS families, min(s) AS least FROM f""")
def negative_family_specificity(spark, sf_dir):
    return metrics.least_specificity(cases(spark, sf_dir))


@query(CASES_SQL + """, p AS (SELECT *, CASE id % 3 WHEN 0 THEN 'evaluated' WHEN 1 THEN 'unsupported' ELSE 'unavailable' END AS status FROM c),
q AS (SELECT *, CASE WHEN status = 'evaluated' THEN actual END AS detected, CASE WHEN status = 'evaluated' THEN actual_action END AS act FROM p)
SELECT source, count(*) AS n, count(*) FILTER (status = 'evaluated') AS evaluated, count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'unavailable') AS unavailable,
  count(*) FILTER (expected AND coalesce(detected, false)) AS tp, count(*) FILTER (NOT expected AND coalesce(detected, false)) AS fp, count(*) FILTER (expected AND NOT coalesce(detected, false)) AS fn,
  count(*) FILTER (coalesce(act, 'allow') = expected_action) / count(*) AS action_accuracy FROM q GROUP BY source""")
def sink_profiles(spark, sf_dir):
    status = F.when(F.col("id") % 3 == 0, "evaluated").when(F.col("id") % 3 == 1, "unsupported").otherwise("unavailable")
    rows = cases(spark, sf_dir).withColumn("status", status)
    seen = F.col("status") == "evaluated"
    rows = rows.withColumn("detected", F.when(seen, F.col("actual"))).withColumn("action", F.when(seen, F.col("actual_action"))).withColumnRenamed("expected_action", "recommended_action")
    return metrics.profile(rows, "source").select("source", "n", "evaluated", "unsupported", "unavailable", "tp", "fp", "fn", "action_accuracy")


@query("""SELECT CASE event_id % 2 WHEN 0 THEN 'allow' ELSE 'block' END || '->' || CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'purchase' THEN 'would_block' ELSE 'would_allow' END AS change,
  count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY 1""")
def shadow_report(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    seen = F.when(F.col("event_type") == "error", "unsupported").otherwise("evaluated")
    found = F.when(F.col("event_type") == "purchase", "resolved_payload_exact").otherwise("")
    rows = e.select(F.when(F.col("event_id") % 2 == 0, "allow").otherwise("block").alias("base_action"), metrics.shadow_action(seen, F.lit("evaluated"), found).alias("shadow_action"), F.col("value").alias("duration_ms"))
    return metrics.shadow_report(rows)


@query("SELECT count(*) AS keys, median(n) AS median FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def median_candidates(spark, sf_dir):
    return metrics.median_per(read(spark, sf_dir, "orders"), "o_custkey")


@query(CASES_SQL + """, o AS (SELECT count(*) FILTER (expected AND actual) / count(*) FILTER (actual) AS precision, count(*) FILTER (expected_action = 'allow' AND actual_action = 'block') AS blocks FROM c)
SELECT 'minimum_precision' AS name, precision AS observed, CAST(0.9 AS DOUBLE) AS threshold, precision >= 0.9 AS passed FROM o UNION ALL SELECT 'maximum_false_blocks', blocks, CAST(0 AS DOUBLE), blocks <= 0 FROM o UNION ALL SELECT 'minimum_unseen', CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE), false""")
def release_gate(spark, sf_dir):
    c = cases(spark, sf_dir)
    seen = c.agg(metrics.ratio(F.count_if(F.col("expected") & F.col("actual")), F.count_if("actual")).alias("p"), F.count_if(F.expr("expected_action = 'allow' and actual_action = 'block'")).cast("double").alias("b"))
    observed = seen.select(F.inline(F.array(F.struct(F.lit("minimum_precision").alias("name"), F.col("p").alias("value")), F.struct(F.lit("maximum_false_blocks").alias("name"), F.col("b").alias("value")))))
    limits = spark.createDataFrame([("minimum_precision", 0.9), ("maximum_false_blocks", 0.0), ("minimum_unseen", 0.5)], "name string, value double")
    return metrics.gate(observed, limits)


@query("""WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 1 AND p_size < 10)
SELECT count(*) FILTER (a.p_name IS NOT NULL AND b.p_name IS NOT NULL) AS shared, count(*) AS either, count(*) FILTER (a.p_name IS NOT NULL AND b.p_name IS NOT NULL) / count(*) AS score FROM a FULL JOIN b USING (p_name)""")
def vocabulary_overlap(spark, sf_dir):
    t = read(spark, sf_dir, "part")
    return metrics.set_jaccard(t.filter("p_partkey % 2 = 0").select("p_name"), t.filter("p_partkey % 2 = 1 and p_size < 10").select("p_name"))


@query("""WITH v AS (SELECT DISTINCT CASE item_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS kind, text AS value FROM benchmark)
SELECT kind, count(*) AS n FROM (SELECT DISTINCT kind, value FROM v JOIN documents d ON contains(d.text, value)) GROUP BY kind""")
def privacy_exposures(spark, sf_dir):
    values = read(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"), F.col("text").alias("value"))
    return metrics.exposures(values, read(spark, sf_dir, "documents"))


@query("""WITH r AS (SELECT user_id, event_id, lag(event_type) OVER w AS before, event_type, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id AS candidate_id, k AS revision, CASE WHEN k = 1 THEN NULL WHEN before IN ('click', 'signup') THEN 'rejected' ELSE 'proposed' END AS from_status,
  CASE WHEN k = 1 THEN 'proposed' WHEN event_type IN ('click', 'signup') THEN 'rejected' ELSE 'proposed' END AS to_status FROM r)
SELECT candidate_id, arg_max(to_status, revision) AS status, max(revision) AS revision,
  bool_and(CASE WHEN revision = 1 THEN to_status = 'proposed' ELSE from_status = p AND (from_status, to_status) IN (('proposed', 'rejected'), ('rejected', 'proposed')) END) AS valid
FROM (SELECT *, lag(to_status) OVER (PARTITION BY candidate_id ORDER BY revision) AS p FROM s) GROUP BY 1""")
def candidate_states(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    status = lambda c: F.when(c.isin("click", "signup"), "rejected").otherwise("proposed")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("candidate_id"), F.row_number().over(w).alias("revision"), F.lag("event_type").over(w).alias("before"), "event_type")
    first = F.col("revision") == 1
    return workflow.reviewed(rows.select("candidate_id", "revision", F.when(~first, status(F.col("before"))).alias("from_status"), F.when(first, "proposed").otherwise(status(F.col("event_type"))).alias("to_status")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS workspace_id, 'policy' AS name, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE false END AS value, CASE s_suppkey % 3 WHEN 2 THEN 'default' ELSE 'workspace' END AS origin FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'shadow', s_suppkey % 3 = 0, CASE s_suppkey % 3 WHEN 0 THEN 'environment' ELSE 'dependency' END FROM supplier""")
def effective_settings(spark, sf_dir):
    t = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("workspace_id"), F.col("s_suppkey").alias("k"))
    policy = F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 3 == 1, False)
    rows = t.select("workspace_id", F.lit("policy").alias("name"), policy.alias("value")).union(t.select("workspace_id", F.lit("shadow"), F.lit(None).cast("boolean")))
    environment = spark.createDataFrame([("shadow", True)], "name string, value boolean")
    return workflow.effective_settings(rows, environment, spark.createDataFrame([("shadow", "policy")], "name string, needed string"))


@query("""SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 4 = 3 THEN 'unobserved' WHEN o_orderkey % 4 = 2 THEN 'mismatch' ELSE 'confirmed' END AS status FROM orders""")
def redaction_confirmations(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    scope = [F.lit("w").alias("workspace_id"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").cast("string").alias("tool_use_id")]
    plans = o.select(F.col("o_orderkey").alias("plan_id"), *scope, F.col("o_orderpriority").alias("input_hash"), F.lit("s").alias("structure"))
    seen = o.filter("o_orderkey % 4 <> 3").select(*scope, F.when(F.col("o_orderkey") % 4 == 2, "x").otherwise(F.col("o_orderpriority")).alias("input_hash"), F.lit("s").alias("structure"))
    return workflow.confirmations(plans, seen)


@query("""SELECT 's' || p_partkey AS sink_id, CASE WHEN p_partkey % 5 = 4 THEN 'unsupported' ELSE 'evaluated' END AS resolution_status,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 0 THEN 'resolved_payload_exact' WHEN p_partkey % 5 = 1 THEN 'resolved_payload_exact_substring' END AS method,
  CASE WHEN p_partkey % 5 = 4 THEN 'unknown' WHEN p_partkey % 5 <= 1 THEN 'would_block' ELSE 'would_allow' END AS shadow_action FROM part""")
def payload_evidence(spark, sf_dir):
    """Parts send an identifier that is protected, or holds one that is, or none."""
    t = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    value = F.when(k == 0, "key-4711-ab12cd").when(k == 1, F.concat(F.lit("note key-4711-ab12cd for "), "p_name")).when(k < 4, F.col("p_name"))
    rows = t.select(F.lit("w").alias("workspace_id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("sink_id"), F.lit(0).alias("segment_index"), F.lit("static_values").alias("extraction"), value.alias("value"))
    protected = spark.createDataFrame([("w", "c1", "key-4711-ab12cd", "selected_security_field"), ("other", "c2", "red bolt", "registered_source")], "workspace_id string, chunk_id string, text string, signal string")
    found = workflow.payload_evidence(rows, protected)
    return found.select("sink_id", "resolution_status", F.get("matches", F.lit(0))["method"].alias("method"), "shadow_action")


@query("SELECT count(*) AS plans_left, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01') AS links_left FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def retention_cleanup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), "o_orderdate")
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), "l_linenumber").join(o.select("plan_id"), "plan_id", "left_semi")
    reasons = o.select("plan_id", F.when(F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01'"), "expired").alias("reason"))
    plans, kept, _ = workflow.cleanup(o, links, reasons)
    return plans.agg(F.count("*").alias("plans_left")).join(kept.agg(F.count("*").alias("links_left")))


@query("SELECT user_id, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_events(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("user_id", "event_id")


@query("""SELECT 'c' || o_custkey AS n FROM orders UNION SELECT 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey FROM supplier""")
def node_union(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("n"))
    b = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("n"))
    return a.union(b).union(read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("n"))).distinct()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def orphan_nodes(spark, sf_dir):
    closed = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(closed, "c_custkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def owned_edges(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")
