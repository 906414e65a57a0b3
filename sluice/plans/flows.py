"""Queries over a log of tool calls, made of the conversations: a question is a search, an answer ends a turn, a system
message is what a tool returned; first turns are protected chunks. Parts and customers make commands and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import canonical, documents, shell
from sluice.functions.compare import compare
from sluice.operators import bodies, files, filesystem, flow, fragments, lineage, operations, secrets, sources
from sluice.operators.metrics import parity
from sluice.operators.storage import beside, discard, stored
from sluice.plans.registry import query, read, spread
from sluice.streaming import incremental


def payloads(spark, sf_dir) -> DataFrame:
    t = spread(read(spark, sf_dir, "conversations"))
    own = [F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("turn_id"), F.concat_ws("-", "conv_id", "turn").alias("tool_use_id")]
    asked = F.to_json(F.struct(*own, F.lit("web_search").alias("tool_name"), F.struct(F.col("text").alias("query")).alias("tool_input")))
    told = F.to_json(F.struct(*own, F.lit("read").alias("tool_name"), F.struct(F.col("text").alias("content")).alias("tool_response")))
    said = F.to_json(F.struct(*own[:2], F.col("text").alias("last_assistant_message")))
    phase = F.when(F.col("role") == "user", "pre_tool_use").when(F.col("role") == "system", "post_tool_use").otherwise("stop")
    payload = F.when(F.col("role") == "user", asked).when(F.col("role") == "system", told).otherwise(said)
    return t.select(phase.alias("phase"), payload.alias("payload"), (F.col("turn") + 1).alias("sequence_no"), F.lit("w").alias("workspace_id"))


def events(spark, sf_dir) -> DataFrame:
    return fragments.normalized_events(payloads(spark, sf_dir))


def all_contexts(spark, sf_dir) -> DataFrame:
    """A table, as contexts are read by every adapter and comparison."""
    return stored(fragments.contexts(events(spark, sf_dir)), "contexts")


def chunks(spark, sf_dir) -> DataFrame:
    """First turns of conversations as protected chunks."""
    t = read(spark, sf_dir, "conversations").filter("turn = 0").select("text").distinct()
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return t.select(F.concat(F.lit("c"), F.left(digest, F.lit(16))).alias("chunk_id"), F.lit("w").alias("workspace_id"), "text", digest.alias("text_hash"), F.lit("registered_source").alias("signal"))


LOG_SQL = """WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS sequence_no, text,
  CASE role WHEN 'user' THEN 'tool_input' WHEN 'system' THEN 'tool_output' ELSE 'final_answer' END AS artifact_role,
  CASE role WHEN 'user' THEN 'query' WHEN 'system' THEN 'content' END AS key FROM conversations),
r AS (SELECT *, CASE WHEN key IS NULL THEN text ELSE '{' || chr(10) || '  "' || key || '": ' || CAST(to_json(text) AS VARCHAR) || chr(10) || '}' END AS root FROM l)
"""


@query(LOG_SQL + "SELECT session_id, sequence_no, artifact_role, sha256(root) AS text_hash FROM r")
def event_artifacts(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = fragments.artifacts(e).join(e.select("event_id", "session_id", "sequence_no"), "event_id")
    return rows.select("session_id", "sequence_no", "artifact_role", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query(LOG_SQL + """SELECT session_id, sequence_no, '/' AS json_pointer, 'artifact_root' AS fragment_kind, artifact_role AS semantic_role, sha256(root) AS text_hash FROM r
UNION ALL SELECT session_id, sequence_no, '/' || key, 'payload', key, sha256(text) FROM r WHERE key IS NOT NULL
UNION ALL SELECT session_id, sequence_no, '/' || key, 'json_key', 'json_key', sha256(key) FROM r WHERE artifact_role = 'tool_input'""")
def context_fragments(spark, sf_dir):
    return all_contexts(spark, sf_dir).select("session_id", "sequence_no", "json_pointer", "fragment_kind", "semantic_role", "text_hash")


@query(LOG_SQL + "SELECT session_id, sequence_no, sha256(text) AS text_hash FROM l WHERE trim(text) <> ''")
def canonical_contexts(spark, sf_dir):
    return fragments.canonical(all_contexts(spark, sf_dir)).select("session_id", "sequence_no", "text_hash")


@query("""SELECT a.p_partkey AS id, max(b.p_partkey) AS candidate FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND b.p_partkey < a.p_partkey GROUP BY 1""")
def exact_repeats(spark, sf_dir):
    """The newest earlier fragment of the scope with the same canonical form; parts of a brand stand for a session's."""
    t = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("fragment_id"), F.col("p_partkey").alias("sequence_no"), F.col("p_brand").alias("scope"), F.col("p_name").alias("text"))
    rows = stored(canonical.with_prepared(t, "text").select("fragment_id", "sequence_no", "scope", F.col("prepared.exact_key").alias("exact_key")), "prepared")
    return flow.exact_candidates(rows).select(F.col("fragment_id").alias("id"), F.col("candidate_id").alias("candidate"))


@query()
def artifact_flow_edges(spark, sf_dir):
    return flow.artifact_edges(all_contexts(spark, sf_dir))


@query()
def source_binding_edges(spark, sf_dir):
    table = flow.comparable(all_contexts(spark, sf_dir))
    out = flow.source_bindings(chunks(spark, sf_dir), None, flow.artifact_edges(None, table=table), table=table)
    discard(table)
    return out


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS sequence_no, CASE role WHEN 'user' THEN 'external_search' ELSE 'final_answer' END AS sink_type FROM conversations
  WHERE role = 'user' OR role = 'assistant'""")
def sink_candidates(spark, sf_dir):
    return flow.all_sinks(all_contexts(spark, sf_dir))[0].select("session_id", "sequence_no", "sink_type")


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(conv_id AS VARCHAR) || '-' || turn AS call_id, turn + 1 AS first_sequence_no,
  CASE role WHEN 'user' THEN 3 ELSE 2 END AS fragments FROM conversations WHERE role IN ('user', 'system')""")
def tool_calls(spark, sf_dir):
    called = flow.tool_calls(all_contexts(spark, sf_dir).filter("tool_use_id is not null"))
    return called.select("session_id", "call_id", "first_sequence_no", F.size("fragments").alias("fragments"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS sequence_no, 'unknown' AS status, CASE role WHEN 'system' THEN 'success_unconfirmed' ELSE 'not_post_tool_use' END AS evidence FROM conversations")
def tool_outcomes(spark, sf_dir):
    e = events(spark, sf_dir)
    return fragments.outcomes(e).join(e.select("event_id", "session_id", "sequence_no"), "event_id").select("session_id", "sequence_no", "status", "evidence")


#: Each part is a command; what a shell would do with its name stays literal, as it stands in single quotes.
COMMANDS = {
    0: "curl -s -X POST -d '{}' https://x.example/p && git push origin main",
    1: "cat 'in/{}.txt' | grep ring > out.txt; scp out.txt host:",
    2: "echo '{}' >> log.txt",
    3: "cd /tmp; curl -d '{}' u",
}


def commands(spark, sf_dir) -> DataFrame:
    command = F.lit(None).cast("string")
    for k, pattern in COMMANDS.items():
        before, after = pattern.split("{}")
        command = F.when(F.col("p_partkey") % 4 == k, F.concat(F.lit(before), "p_name", F.lit(after))).otherwise(command)
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", "p_name", command.alias("command"))


@query("""SELECT p_partkey, s.* FROM (SELECT p_partkey, unnest(CASE p_partkey % 4
  WHEN 0 THEN [{'segment_index': 0, 'connector': NULL, 'program': 'curl', 'sink_type': 'external_http_request', 'operations': 0}, {'segment_index': 1, 'connector': 'and_then', 'program': 'git', 'sink_type': 'external_git_publish', 'operations': 0}]
  WHEN 1 THEN [{'segment_index': 0, 'connector': NULL, 'program': 'cat', 'sink_type': NULL, 'operations': 1}, {'segment_index': 1, 'connector': 'pipe', 'program': 'grep', 'sink_type': NULL, 'operations': 1},
    {'segment_index': 2, 'connector': 'sequence', 'program': 'scp', 'sink_type': 'external_file_transfer', 'operations': 0}]
  WHEN 2 THEN [{'segment_index': 0, 'connector': NULL, 'program': 'echo', 'sink_type': NULL, 'operations': 1}] ELSE [] END) AS s FROM part)""")
def shell_segments(spark, sf_dir):
    rows = commands(spark, sf_dir).select("p_partkey", F.explode(shell.plan(F.col("command"))).alias("s"))
    words = F.transform("s.words", lambda w: w["value"])
    return rows.select(
        "p_partkey", F.col("s.index").alias("segment_index"), "s.connector", F.get(words, F.lit(0)).alias("program"),
        shell.sink_type(words).alias("sink_type"), F.size("s.operations").alias("operations"),
    )


@query("SELECT p_partkey, 0 AS segment_index, 'static_values' AS extraction, p_name AS submitted FROM part WHERE p_partkey % 4 = 0")
def http_submissions(spark, sf_dir):
    rows = commands(spark, sf_dir).select("p_partkey", F.explode(shell.submissions(shell.plan(F.col("command")))).alias("s"))
    return rows.select("p_partkey", F.col("s.index").alias("segment_index"), "s.extraction", F.array_join("s.submitted", "|").alias("submitted"))


@query("""SELECT p_partkey, unnest(['add', 'update', 'delete']) AS operation, unnest([p_name || '.py', 'b', 'c']) AS path, unnest([NULL, p_brand, NULL]) AS move_to,
  unnest([sha256(p_name), sha256('new'), sha256('')]) AS added_hash FROM part""")
def patch_files(spark, sf_dir):
    t = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))
    patch = F.concat_ws("\n", F.lit("*** Begin Patch"), F.concat(F.lit("*** Add File: "), "p_name", F.lit(".py")), F.concat(F.lit("+"), "p_name"), F.lit("*** Update File: b"), F.concat(F.lit("*** Move to: "), "p_brand"), F.lit("@@\n-old\n+new"), F.lit("*** Delete File: c"), F.lit("*** End Patch"))
    rows = t.select("p_partkey", F.explode(documents.patch_operations(patch)).alias("o"))
    return rows.select("p_partkey", "o.operation", "o.path", "o.move_to", F.sha2(F.col("o.added").cast("binary"), 256).alias("added_hash"))


@query("""SELECT c_custkey, unnest(['NAME', 'API_KEY', 'SEGMENT']) AS key, unnest([c_name, 'k' || c_custkey || chr(10) || 'x', c_mktsegment]) AS value FROM customer""")
def dotenv_values(spark, sf_dir):
    t = read(spark, sf_dir, "customer")
    text = F.concat(F.lit("# settings\nexport NAME='"), "c_name", F.lit('\' # who\nAPI_KEY="k'), F.col("c_custkey").cast("string"), F.lit('\\nx"\nEMPTY=\nSEGMENT = '), "c_mktsegment", F.lit(" # part\n"))
    return t.select("c_custkey", F.inline(documents.dotenv(text)))


@query("""SELECT 's/' || c_custkey || '/' || CASE c_custkey % 2 WHEN 0 THEN '.env' ELSE 'a.json' END AS path, CASE c_custkey % 2 WHEN 0 THEN 'dotenv_keys' ELSE 'json_pointers' END AS kind,
  CASE c_custkey % 2 WHEN 0 THEN 'API_KEY' ELSE '/db/dbPassword' END AS selectors, CAST(NULL AS VARCHAR) AS problem FROM customer""")
def secret_selectors(spark, sf_dir):
    t = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    env = F.concat(F.lit("NAME="), "c_mktsegment", F.lit("\nAPI_KEY=z9"), F.col("c_custkey").cast("string"), F.lit("q\nAUTH_TOKEN=${TOKEN}\nPASSWORD=changeme\nTOKEN_TYPE=Bearer\n"))
    doc = F.concat(F.lit('{"db": {"dbPassword": "p9'), F.col("c_custkey").cast("string"), F.lit('", "secret_ref": "vault://x", "token_url": "https://x/y"}, "keys": ["a"]}'))
    even = F.col("c_custkey") % 2 == 0
    path = F.concat(F.lit("s/"), F.col("c_custkey").cast("string"), F.when(even, "/.env").otherwise("/a.json"))
    found = secrets.discover(t.select(path.alias("path"), F.when(even, env).otherwise(doc).alias("text")))
    return found.select("path", "kind", F.array_join("selectors", ",").alias("selectors"), "problem")


FILES_SQL = """WITH o AS (SELECT user_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS path,
  CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'click' THEN 'write' WHEN 'signup' THEN 'write' ELSE 'read' END AS operation, event_type FROM events)
"""


def file_operations(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type").isin("click", "signup"), "write").otherwise("read")
    path = F.concat(F.lit("/f/"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))
    return read(spark, sf_dir, "events").select(
        F.lit("w").alias("workspace_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("sequence_no"), F.lit(0).alias("operation_index"),
        F.lit(None).cast("string").alias("tool_use_id"), kind.alias("operation"), path.alias("path"),
        F.when(kind == "write", F.sha2(F.col("event_id").cast("string").cast("binary"), 256)).alias("content_hash"),
    )


@query(FILES_SQL + """, m AS (SELECT *, lag(operation IN ('write', 'read')) OVER w AS live FROM o WINDOW w AS (PARTITION BY user_id, path ORDER BY seq)),
v AS (SELECT *, operation = 'write' OR (operation = 'read' AND NOT coalesce(live, false)) AS makes FROM m),
n AS (SELECT *, max(CASE WHEN makes THEN seq WHEN operation = 'delete' THEN -seq END) OVER () AS x,
  last_value(CASE WHEN makes THEN seq WHEN operation = 'delete' THEN -1 END IGNORE NULLS) OVER (PARTITION BY user_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS made FROM v)
SELECT seq AS sequence_no, operation, makes, CASE WHEN made >= 0 AND operation <> 'delete' THEN made END AS version_of FROM n""")
def file_versions(spark, sf_dir):
    rows = filesystem.versions(file_operations(spark, sf_dir))
    made = rows.filter("makes").select("node_id", F.col("sequence_no").alias("version_of"))
    return rows.join(made, "node_id", "left").select("sequence_no", "operation", "makes", "version_of")


@query(FILES_SQL + """, m AS (SELECT *, lag(operation) OVER (PARTITION BY user_id, path ORDER BY seq) AS before FROM o)
SELECT 'written_to' AS relation, count(*) AS n FROM m WHERE operation = 'write' UNION ALL SELECT 'read_from', count(*) FROM m WHERE operation = 'read'
UNION ALL SELECT 'updated_from', count(*) FROM m WHERE operation = 'write' AND before IN ('write', 'read') UNION ALL SELECT 'deleted_by', count(*) FROM m WHERE operation = 'delete' AND before IN ('write', 'read')""")
def file_flow(spark, sf_dir):
    rows = filesystem.versions(file_operations(spark, sf_dir)).withColumn("fragment_id", F.concat(F.lit("f"), F.col("sequence_no").cast("string")))
    return filesystem.file_edges(rows).groupBy("relation").agg(F.count("*").alias("n"))


FLOW_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id AS seq, event_type, '/f/' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS path, 'v' || json_extract_string(props, '$.k') AS h,
  CASE WHEN event_type IN ('click', 'signup') THEN 'W' WHEN event_type = 'purchase' THEN 'B' ELSE 'R' END AS op FROM events),
s AS (SELECT *, count(*) FILTER (op = 'W') OVER (PARTITION BY user_id, path ORDER BY seq) AS seg FROM o),
p AS (SELECT *, first_value(op) OVER w AS first, row_number() OVER w AS k,
  last_value(CASE WHEN op <> 'B' THEN h END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM s WINDOW w AS (PARTITION BY user_id, path, seg ORDER BY seq)),
m AS (SELECT *, op = 'W' OR (op = 'R' AND NOT (seg = 0 AND first = 'B') AND held IS DISTINCT FROM h) OR (op = 'B' AND seg = 0 AND k = 1) AS makes FROM p),
v AS MATERIALIZED (SELECT *, max(CASE WHEN makes THEN seq END) OVER (PARTITION BY user_id, path ORDER BY seq) AS version FROM m),
e AS MATERIALIZED (SELECT 'content' AS src_kind, seq AS src, 'version' AS dst_kind, version AS dst FROM v WHERE op = 'W' UNION ALL SELECT 'version', version, CASE op WHEN 'R' THEN 'content' ELSE 'command' END, seq FROM v WHERE op <> 'W'),
"""


def file_log(spark, sf_dir, command: str = "cat /") -> DataFrame:
    """Events as tool calls on five files: some write, some read with a tool, some run a shell command on a file."""
    k = F.get_json_object("props", "$.k")
    path, content = F.concat(F.lit("/f/"), (k.cast("long") % 5).cast("string")), F.concat(F.lit("v"), k)
    own = [F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("tool_use_id")]
    wrote = F.to_json(F.struct(*own, F.lit("Write").alias("tool_name"), F.struct(path.alias("path"), content.alias("content")).alias("tool_input")))
    shown = F.to_json(F.struct(*own, F.lit("Read").alias("tool_name"), F.struct(path.alias("path")).alias("tool_input"), F.struct(content.alias("content")).alias("tool_response")))
    ran = F.to_json(F.struct(*own, F.lit("Bash").alias("tool_name"), F.lit("/").alias("cwd"), F.struct(F.concat(F.lit(command), F.substring(path, 2, 99)).alias("command")).alias("tool_input")))
    kind = F.col("event_type")
    phase = F.when(kind.isin("click", "signup", "purchase"), "pre_tool_use").otherwise("post_tool_use")
    payload = F.when(kind.isin("click", "signup"), wrote).when(kind == "purchase", ran).otherwise(shown)
    return spread(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")).select(phase.alias("phase"), payload.alias("payload"), F.col("event_id").alias("sequence_no"), F.lit("w").alias("workspace_id"))


def file_contexts(log) -> DataFrame:
    """Contexts of file_log() as a table, without the forms that only comparisons read."""
    known = operations.with_operations(fragments.contexts(fragments.normalized_events(log)))
    return stored(known.drop("text_hash", "normalized_text", "token_count"), "contexts")


@query(FLOW_SQL + """r AS (SELECT 'signup' AS source, 'content' AS kind, seq, 1 AS hops FROM v WHERE event_type = 'signup'
  UNION ALL SELECT 'path ' || path, 'version', seq, 1 FROM v WHERE makes AND path IN ('/f/0', '/f/3')
  UNION ALL SELECT r.source, e.dst_kind, e.dst, r.hops + 1 FROM r JOIN e ON e.src_kind = r.kind AND e.src = r.seq)
SELECT source, kind, seq AS sequence_no, min(hops) AS hops FROM r GROUP BY ALL""")
def file_lineage(spark, sf_dir):
    """Where what signups write, and what two protected paths hold, goes through files: nodes by the event that made them."""
    known = file_contexts(file_log(spark, sf_dir))
    made, edges = files.file_flow(known)
    made = stored(made.select("node_id", "workspace_id", "path", "sequence_no", "state"), "resources")
    edges = stored(edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "score", "edge_id"), "edges")
    protected = spark.createDataFrame([(f"path {p}", "w", p) for p in ("/f/0", "/f/3")], "source_id string, workspace_id string, path string")
    bound = flow.path_bindings(protected, made)
    written = read(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("sequence_no"))
    starts = known.filter("phase = 'pre_tool_use' and semantic_role = 'content' and json_pointer <> '/'").join(written, "sequence_no").select(F.lit("signup").alias("source"), F.col("fragment_id").alias("node"))
    seeds = starts.select("source", "node", F.lit(1.0).alias("score"), F.lit("").alias("edge_id")).union(bound.select("src_id", "dst_id", "score", "edge_id"))
    reached = lineage.propagate(seeds, edges)
    kind = F.when(F.col("fragment_kind") == "bash_segment", "command").otherwise("content")
    # Paths, keys and, where they have leaves, whole texts are no ends of edges.
    held = known.filter("json_pointer <> '/' and (fragment_kind = 'bash_segment' or semantic_role = 'content')")
    nodes = held.select(F.col("fragment_id").alias("node"), kind.alias("kind"), "sequence_no").union(made.select("node_id", F.lit("version"), "sequence_no"))
    return reached.join(nodes, "node").select("source", "kind", "sequence_no", "hops")


@query("""WITH o AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS path, 'v' || json_extract_string(props, '$.k') AS h FROM events),
p AS (SELECT *, last_value(CASE WHEN event_type <> 'purchase' THEN h END IGNORE NULLS) OVER (PARTITION BY user_id, path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM o)
SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN held IS NULL THEN 'coarse_fallback' ELSE 'resolved_file' END AS extraction, held AS value,
  CASE WHEN held IS NULL THEN 'file_reference_unavailable' END AS reason, count(*) AS n FROM p WHERE event_type = 'purchase' GROUP BY ALL""")
def file_bodies(spark, sf_dir):
    """What commands send that post a file: its content as the version that held before them has it."""
    log = file_log(spark, sf_dir, "curl -s --data-binary @")
    known = file_contexts(log)
    return bodies.bodies(known).groupBy("session_id", "extraction", "value", "reason").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'a.json' WHEN 'signup' THEN 'b.json' WHEN 'view' THEN '.env' WHEN 'purchase' THEN 'n.md' ELSE 'c.py' END AS name,
  CASE event_type WHEN 'click' THEN ['x' || event_id, 't ' || props, 'last'] WHEN 'signup' THEN ['t ' || props] WHEN 'view' THEN ['key' || event_id] WHEN 'purchase' THEN ['first ' || event_id, 'second' || chr(10) || 'line']
    ELSE ['import x', 'def f():' || chr(10) || '    return ' || event_id, 'class A:' || chr(10) || '    pass'] END AS parts FROM events),
c AS (SELECT 's' || event_id AS source_id, event_type, unnest(parts) AS text, unnest(range(len(parts))) AS ordinal FROM f)
SELECT source_id || ':' || ordinal || ':' || left(sha256(text), 16) AS chunk_id, CAST(ordinal AS INTEGER) AS ordinal, text,
  CASE WHEN event_type IN ('signup', 'view') THEN 'selected_security_field' ELSE 'registered_source' END AS signal FROM c""")
def source_chunks(spark, sf_dir):
    """Chunks of files that events make: JSON with and without selected pointers, dotenv, paragraphs and definitions."""
    t, n, kind = read(spark, sf_dir, "events"), F.col("event_id").cast("string"), F.col("event_type")
    secret = F.concat(F.lit("t "), "props")
    doc = F.to_json(F.struct(F.concat(F.lit("x"), n).alias("first"), F.lit(1).alias("n"), F.struct(secret.alias("api~key/token")).alias("deep"), F.array(F.lit(" "), F.lit("last")).alias("list")))
    env = F.concat(F.lit("# settings\nNAME=x\nexport API_KEY='key"), n, F.lit("' # mine\nEMPTY=\n"))
    note, code = F.concat(F.lit("first "), n, F.lit("\n\n \n\nsecond\nline\n")), F.concat(F.lit("import x\n\ndef f():\n    return "), n, F.lit("\n\nclass A:\n    pass\n"))
    name = F.when(kind == "click", "a.json").when(kind == "signup", "b.json").when(kind == "view", ".env").when(kind == "purchase", "n.md").otherwise("c.py")
    text = F.when(kind.isin("click", "signup"), doc).when(kind == "view", env).when(kind == "purchase", note).otherwise(code)
    rows = t.select(F.concat(F.lit("s"), n).alias("source_id"), F.lit("w").alias("workspace_id"), F.concat(n, F.lit("/"), name).alias("path"), F.when(kind.isin("click", "signup", "view"), "secretfile").otherwise("doc").alias("type"), text.alias("text"),
                    F.when(kind == "signup", "json_pointers").when(kind == "view", "dotenv_keys").alias("selector_kind"), F.when(kind == "signup", F.array(F.lit("/deep/api~0key~1token"))).when(kind == "view", F.array(F.lit("API_KEY"))).alias("selector_values"))
    return sources.chunks_of(rows.drop("text"), rows.select("workspace_id", "path", "text")).select("chunk_id", "ordinal", "text", "signal")


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(x, '^[a-z0-9._/ -]+$') THEN array_to_string(regexp_extract_all(x, '[a-z0-9]+'), '/') ELSE x END AS identifier
  FROM (SELECT p_partkey, lower(p_brand || '-' || p_partkey || '.' || (10000 + p_partkey)) AS x FROM part WHERE NOT contains(p_brand, '#')
  UNION ALL SELECT p_partkey, lower(replace(p_brand, '#', '_') || '-' || p_partkey || '.' || (10000 + p_partkey)) FROM part)""")
def identifier_keys(spark, sf_dir):
    brand = F.regexp_replace("p_brand", "#", "_")
    x = F.lower(F.concat(brand, F.lit("-"), F.col("p_partkey").cast("string"), F.lit("."), (10000 + F.col("p_partkey")).cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", canonical.identifier_key(x).alias("identifier"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS l, b.p_name AS r, CASE WHEN a.p_name = b.p_name AND length(a.p_name) >= 8 THEN 'exact' ELSE 'none' END AS method FROM n a, n b""")
def compared_names(spark, sf_dir):
    """Part names of two words: equal ones, and others, which all conflict as they have two words each."""
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    x = canonical.with_prepared(names, "p_name")
    pairs = x.select(F.col("p_name").alias("l"), F.col("prepared").alias("a"), F.lit(1).alias("k")).join(x.select(F.col("p_name").alias("r"), F.col("prepared").alias("b"), F.lit(1).alias("k")), "k")
    return pairs.select("l", "r", compare(F.col("a"), F.col("b"))["method"].alias("method"))


@query()
def compared_turns(spark, sf_dir):
    """Neighbouring turns of a conversation, decided by the whole cascade."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    x = canonical.with_prepared(t, "text").drop("text")
    after = x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("prepared").alias("next"))
    return x.join(after, ["conv_id", "turn"]).select("conv_id", "turn", compare(F.col("prepared"), F.col("next")).alias("d")).select("conv_id", "turn", "d.*")


@query("SELECT unnest(['edges', 'lineage', 'findings', 'decisions']) AS part, true AS found, 0 AS differing")
def full_incremental_parity(spark, sf_dir):
    """Whether a run over all events finds anything, and how many rows it has that a run in two steps, the second of which
    brings late turns, does not have, or the other way round."""
    log = payloads(spark, sf_dir)
    protected = stored(canonical.with_prepared(chunks(spark, sf_dir), "text"), "chunks")
    start, late = incremental.empty_state(spark, log), F.col("sequence_no") % 3 == 2
    step = lambda state, rows: incremental.advance(state, rows, protected, "d")
    # Both runs are many small jobs, so that planning takes most of the time: neither waits for the other.
    whole, steps = beside(spark, lambda: step(start, log), lambda: step(step(start, log.filter(~late)), log.filter(late)))
    discard(protected)
    layers = [x | told(x) for x in (whole, steps)]
    keys = {"edges": ["edge_id", "score"], "lineage": ["source", "node", "score"], "findings": ["source", "node", "severity"], "decisions": ["source", "node", "action"]}
    out = []
    for part, columns in keys.items():
        rows = [x[part].select(*(F.round(c, 9).alias(c) if c == "score" else c for c in columns)) for x in layers]
        found = rows[0].agg((F.count("*") > 0).alias("found"))
        out.append(parity(*rows).agg(F.count("*").alias("differing")).join(found).select(F.lit(part).alias("part"), "found", "differing"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def told(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Findings and decisions of a state."""
    found = lineage.findings(state["lineage"], state["sinks"].select(F.col("node_id").alias("node"), "sink_type"), included=("final_answer",))
    return {"findings": found, "decisions": lineage.decide(found)}


@query("""SELECT user_id, event_id, max(CASE WHEN event_type IN ('error', 'purchase') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS outcome_id FROM events""")
def latest_outcome(spark, sf_dir):
    """The last outcome (an error or a purchase) of a session up to each event."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    done = F.when(F.col("event_type").isin("error", "purchase"), F.col("event_id"))
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.last(done, ignorenulls=True).over(w).alias("outcome_id"))


@query("""WITH o AS (SELECT event_id, event_type, user_id AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS u FROM events),
b AS (SELECT 'all' AS answers, max(event_id) AS most FROM events UNION ALL SELECT 'half', max(event_id) // 2 FROM events),
c AS (SELECT answers, s, u, min(event_id) AS sequence_no FROM o, b WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
p AS (SELECT answers, s, u, arg_max(event_type, event_id) AS last, max(event_id) AS answer_no FROM o, b WHERE event_type NOT IN ('click', 'purchase') AND event_id <= most GROUP BY ALL)
SELECT c.answers, sequence_no, CASE last WHEN 'view' THEN 'succeeded' WHEN 'signup' THEN 'failed' ELSE 'unknown' END AS outcome,
  CASE WHEN last = 'view' THEN 'exit_code:0' WHEN last = 'signup' THEN 'exit_code:2' WHEN last IS NOT NULL THEN 'success_unconfirmed' END AS evidence, answer_no
FROM c LEFT JOIN p ON c.answers = p.answers AND c.s IS NOT DISTINCT FROM p.s AND c.u IS NOT DISTINCT FROM p.u""")
def operation_outcomes(spark, sf_dir):
    """What the last answer says about each operation of a command, by all answers and by those of the first half."""
    own = [F.col("user_id").cast("string").alias("session_id"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string").alias("tool_use_id"), F.lit("Bash").alias("tool_name"), F.col("event_id").cast("string").alias("turn_id")]
    ran = F.to_json(F.struct(*own, F.struct(F.concat(F.lit("cat /f/"), own[1]).alias("command")).alias("tool_input")))
    code = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "signup", 2)
    answer = F.to_json(F.struct(*own, F.struct(code.alias("exit_code"), F.lit("read").alias("stdout")).alias("tool_response")))
    asks = F.col("event_type").isin("click", "purchase")
    t = read(spark, sf_dir, "events")
    log = t.select(F.when(asks, "pre_tool_use").otherwise("post_tool_use").alias("phase"), F.when(asks, ran).otherwise(answer).alias("payload"), F.col("event_id").alias("sequence_no"), F.lit("w").alias("workspace_id"))
    known = stored(fragments.normalized_events(log), "events")
    found, said = stored(operations.operations(fragments.contexts(known)), "operations"), stored(fragments.outcomes(known), "outcomes")
    most = t.agg(F.max("event_id")).first()[0] or 0
    answer_no = known.select(F.col("event_id").alias("outcome_event_id"), F.col("sequence_no").alias("answer_no"))
    by = lambda name, through: operations.with_outcomes(found, known, said, through).join(answer_no, "outcome_event_id", "left").select(F.lit(name).alias("answers"), "sequence_no", "outcome", F.col("outcome_evidence").alias("evidence"), "answer_no")
    return by("all", None).union(by("half", most // 2))
