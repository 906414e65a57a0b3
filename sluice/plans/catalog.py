"""Queries over the given tables, each with its SQL.

conversations stand for tool calls (a conversation is a session, a turn an event), events.props for JSON payloads,
documents for protected sources, labels for expected decisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.functions.documents import paragraphs
from sluice.operators import fragments, lineage, metrics, retrieval, secrets, tables
from sluice.plans.registry import QUERIES, SQL, query, read

NORMAL = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"""SELECT conv_id, turn, role, {NORMAL} AS normalized, sha256({NORMAL}) AS text_hash,
  CASE WHEN {NORMAL} = '' THEN 0 ELSE len(string_split({NORMAL}, ' ')) END AS n_tokens FROM conversations""")
def normalize_turns(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    n = T.normalize_text(F.col("text"))
    return t.select("conv_id", "turn", "role", n.alias("normalized"), T.text_hash(n).alias("text_hash"), T.token_count(F.col("text")).alias("n_tokens"))


@query("""SELECT event_id, '/' || key AS pointer, key, value, 'tool_input' AS role
  FROM (SELECT event_id, unnest(json_keys(props)) AS key, unnest(map_values(CAST(CAST(props AS JSON) AS MAP(VARCHAR, VARCHAR)))) AS value FROM events)""")
def fragment_leaves(spark, sf_dir):
    payloads = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("artifact_id"), F.lit("tool_input").alias("artifact_role"), F.col("props").alias("text"))
    leaves = fragments.leaves(payloads).filter("fragment_kind = 'payload'")
    role = fragments.semantic_role(F.col("key"), F.lit("tool_input")).alias("role")
    return leaves.select(F.col("artifact_id").cast("long").alias("event_id"), F.col("json_pointer").alias("pointer"), "key", F.col("text").alias("value"), role)


@query("""SELECT role, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest,
  quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.95) AS p95 FROM conversations GROUP BY role""")
def length_percentiles(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").withColumn("n_chars", F.length("text"))
    return t.groupBy("role").agg(
        F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), *metrics.nearest_rank("n_chars", 0.5, 0.95)
    )


@query("""SELECT event_id, ts, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_event_per_user(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return tables.latest(e, ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def least_sequence(spark, sf_dir):
    return tables.least_wins(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("""SELECT a.event_id, b.event_id AS outcome_id FROM events a ASOF JOIN events b
  ON a.user_id = b.user_id AND a.event_id > b.event_id""")
def previous_event(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("event_id", F.lag("event_id").over(w).alias("outcome_id")).filter("outcome_id is not null")


@query("""SELECT l.toxic, d.lang, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY GROUPING SETS ((l.toxic, d.lang), (l.toxic), ())""")
def grouped_metrics(spark, sf_dir):
    t = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return t.groupingSets([["toxic", "lang"], ["toxic"], []], "toxic", "lang").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l.quality = 0 AS expected, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) > 0.03 * length(d.text) AS actual
    FROM labels l JOIN documents d USING (doc_id)),
  c AS (SELECT count(*) FILTER (expected AND actual) AS tp, count(*) FILTER (NOT expected AND actual) AS fp,
    count(*) FILTER (expected AND NOT actual) AS fn, count(*) FILTER (NOT expected AND NOT actual) AS tn FROM t)
  SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity,
    (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM c""")
def confusion_matrix(spark, sf_dir):
    t = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    return t.agg(*metrics.confusion(F.col("quality") == 0, symbols > 0.03 * F.length("text")))


@query("""SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 1024 THEN '1-1024' WHEN n <= 4096 THEN '1025-4096' WHEN n <= 32768 THEN '4097-32768' ELSE '32769+' END AS bucket, count(*) AS documents
  FROM (SELECT strlen(text) AS n FROM documents) GROUP BY 1""")
def byte_buckets(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select(T.byte_bucket(F.octet_length("text")).alias("bucket"))
    return t.groupBy("bucket").agg(F.count("*").alias("documents"))


INDEX_SQL = r"""
WITH f AS (SELECT conv_id AS scope, turn AS sequence_no, conv_id * 10000 + turn AS id, text FROM conversations),
s AS (SELECT id, scope, sequence_no, length(text) AS n_chars, CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 5 THEN [text]
  ELSE list_distinct(list_transform(range(1, length(text) - 3), lambda i: substring(text, CAST(i AS BIGINT), 5))) END AS s FROM f),
x AS (SELECT id, scope, sequence_no, n_chars, len(s) AS n_features, unnest(s) AS g FROM s),
m AS (SELECT q.id AS query_id, c.id AS candidate_id, q.n_features AS q_features, c.n_features AS c_features, c.n_chars, count(*) AS overlap
  FROM x q JOIN x c ON q.scope = c.scope AND q.g = c.g AND c.sequence_no < q.sequence_no GROUP BY ALL)
"""


def turns(spark, sf_dir) -> DataFrame:
    t = read(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.col("conv_id").alias("scope"), F.col("turn").alias("sequence_no"), "text")


def met_turns(spark, sf_dir) -> DataFrame:
    x = retrieval.index(turns(spark, sf_dir))
    return retrieval.overlaps(x, x)


@query(INDEX_SQL + "SELECT query_id, candidate_id, overlap FROM m")
def overlap_join(spark, sf_dir):
    return met_turns(spark, sf_dir).select("query_id", "candidate_id", "overlap")


@query(INDEX_SQL + """, e AS (SELECT *, overlap / least(q_features, c_features) AS coverage FROM m WHERE n_chars >= 8),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, overlap DESC, candidate_id) <= 2 AS f FROM e),
b AS (SELECT *, NOT f AND row_number() OVER (PARTITION BY query_id, f ORDER BY overlap DESC, coverage DESC, candidate_id) <= 1 AS g FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, g DESC, coverage DESC, overlap DESC, candidate_id) AS rank FROM b)
SELECT query_id, candidate_id, overlap, coverage, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def dual_top_k(spark, sf_dir):
    return retrieval.top_candidates(met_turns(spark, sf_dir), 3).select("query_id", "candidate_id", "overlap", "coverage", "rank")


@query("""WITH n AS (SELECT DISTINCT p_type, p_name FROM part),
s AS (SELECT *, list_distinct(list_transform(range(1, length(p_name) - 3), lambda i: substring(p_name, CAST(i AS BIGINT), 5))) AS g FROM n WHERE length(p_name) > 5)
SELECT a.p_type, a.p_name AS query_id, b.p_name AS candidate_id, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS score
FROM s a JOIN s b ON a.p_type = b.p_type AND a.p_name <> b.p_name WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.3""")
def jaccard_edges(spark, sf_dir):
    names = read(spark, sf_dir, "part").select("p_type", "p_name").distinct().filter(F.length("p_name") > 5)
    x = retrieval.index(names.select(F.struct("p_type", "p_name").alias("id"), F.col("p_type").alias("scope"), F.lit(0).alias("sequence_no"), F.col("p_name").alias("text")))
    met = retrieval.overlaps(x, x, forward=False)
    score = F.col("overlap") / (F.col("q_features") + F.col("c_features") - F.col("overlap"))
    return met.select("query_id.p_type", F.col("query_id.p_name").alias("query_id"), F.col("candidate_id.p_name").alias("candidate_id"), score.alias("score")).filter("score >= 0.3")


GRAPH_SQL = """
WITH RECURSIVE f AS MATERIALIZED (SELECT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst, max(0.4 + l_linenumber / 20.0) AS score FROM lineitem GROUP BY ALL),
p AS (SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS node, CAST(0.5 + (o_orderkey % 50) / 100.0 AS DOUBLE) AS score, 1 AS hops, 'o' || o_orderkey AS edge_id FROM orders
  UNION SELECT p.source, f.dst, p.score * f.score, p.hops + 1, f.src || '-' || f.dst FROM p JOIN f ON f.src = p.node WHERE p.score * f.score >= 0.15),
b AS (SELECT source, node, score, hops, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY score DESC, hops, edge_id) AS k FROM p) WHERE k = 1)
"""


def order_edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers stand for sources, orders for their bindings, line items for edges to sinks (suppliers)."""
    seeds = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("node"),
        (0.5 + (F.col("o_orderkey") % 50) / 100).alias("score"), F.concat(F.lit("o"), "o_orderkey").alias("edge_id"),
    )
    edges = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    edges = edges.agg(F.max(0.4 + F.col("l_linenumber") / 20).alias("score")).withColumn("edge_id", F.concat("src", F.lit("-"), "dst"))
    return seeds, edges


def order_lineage(spark, sf_dir) -> DataFrame:
    return lineage.propagate(*order_edges(spark, sf_dir))


@query(GRAPH_SQL + "SELECT source, node, round(score, 9) AS score, hops, edge_id FROM b")
def best_path_lineage(spark, sf_dir):
    return order_lineage(spark, sf_dir).select("source", "node", F.round("score", 9).alias("score"), "hops", "edge_id")


FINDINGS_SQL = GRAPH_SQL + """, s AS (SELECT 's' || s_suppkey AS node, CASE s_suppkey % 4 WHEN 0 THEN 'final_answer' WHEN 1 THEN 'external_message'
    WHEN 2 THEN 'external_http_request' ELSE 'external_deploy' END AS sink_type FROM supplier),
z AS (SELECT b.source, b.node, sink_type, b.score, CASE WHEN b.score >= 0.9 THEN 'critical' WHEN b.score >= 0.6 THEN 'high' ELSE 'medium' END AS severity
  FROM b JOIN s USING (node) WHERE b.score >= 0.3),
d AS (SELECT *, CASE WHEN severity NOT IN ('critical', 'high') THEN 'allow' WHEN severity = 'critical' AND sink_type = 'final_answer' THEN 'continue_review'
    WHEN severity = 'critical' AND sink_type LIKE 'external_%' THEN 'block' ELSE 'warn' END AS action,
  CASE WHEN sink_type = 'final_answer' THEN 'Stop' ELSE 'PreToolUse' END AS hook FROM z)
"""


def decided(spark, sf_dir) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("final_answer", "external_message", "external_http_request", "external_deploy"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    sinks = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), kinds.alias("sink_type"))
    return lineage.decide(lineage.findings(order_lineage(spark, sf_dir), sinks, included=("final_answer",)))


@query(FINDINGS_SQL + "SELECT source, node, sink_type, severity, action, hook, round(score, 9) AS score FROM d")
def policy_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("source", "node", "sink_type", "severity", "action", "hook", F.round("score", 9).alias("score"))


@query(FINDINGS_SQL + """SELECT source, sink_type, severity, action FROM (SELECT *, row_number() OVER (PARTITION BY source
  ORDER BY CASE action WHEN 'block' THEN 0 WHEN 'continue_review' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, round(score, 9) DESC, node) AS k FROM d) WHERE k = 1""")
def strongest_decision(spark, sf_dir):
    return lineage.strongest(decided(spark, sf_dir).withColumn("score", F.round("score", 9)), ["source"]).select("source", "sink_type", "severity", "action")


@query("""SELECT event_id, recorded_at, CASE WHEN n IS NULL THEN 'orphan' WHEN recorded_at < TIMESTAMP '1996-01-01' THEN 'expired' END AS reason
  FROM (SELECT o_orderkey AS event_id, o_orderdate AS recorded_at FROM orders) LEFT JOIN (SELECT DISTINCT event_id AS e, 1 AS n FROM events) ON e = event_id""")
def retention_plan(spark, sf_dir):
    plans = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("recorded_at"))
    return tables.retained(plans, read(spark, sf_dir, "events"), F.expr("timestamp_ntz'1996-01-01'"))


@query("SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in secrets.CREDENTIALS.values()) + " AS credentials FROM documents")
def credential_scan(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", secrets.credential_count(F.col("text")).alias("credentials"))


@query(r"""SELECT doc_id, CAST(ordinal - 1 AS INTEGER) AS ordinal, sha256(chunk) AS chunk_hash FROM (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '')) AS chunk,
    generate_subscripts(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> ''), 1) AS ordinal FROM documents)""")
def paragraph_chunks(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("ordinal", "chunk"))
    return t.select("doc_id", "ordinal", T.text_hash(F.col("chunk")).alias("chunk_hash"))


@query("""SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) /
  (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark, sf_dir):
    a = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_decisions(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sluice.plans import flows, reports  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
