"""Readers and writers of event logs, manifests of protected sources, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.fragments import rejection

MANIFEST = "schema_version int, sources array<struct<id:string,path:string,type:string,sensitivity:string,policy_tags:array<string>,selector:struct<dotenv_keys:array<string>,json_pointers:array<string>>>>"


def read_json_events(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON objects as (events, quarantine): what rejection() refuses goes to the second, with the reason."""
    lines = (spark.readStream if streaming else spark.read).text(path).withColumn("reason", rejection(F.col("value")))
    return lines.filter("reason is null").select(F.col("value").alias("payload")), lines.filter("reason is not null").select("value", "reason")


def read_manifest(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """Protected sources of a manifest (schema 1 or 2): source_id, path, type, sensitivity, policy_tags, selector_kind,
    selector_values. Ids must be unique, paths relative and inside the workspace; a selector has one kind and values."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select("schema_version", F.inline("sources"))
    keys, pointers = F.coalesce(F.size("selector.dotenv_keys"), F.lit(0)), F.coalesce(F.size("selector.json_pointers"), F.lit(0))
    keys, pointers = F.greatest(keys, F.lit(0)), F.greatest(pointers, F.lit(0))
    problem = (
        F.when(~F.col("schema_version").isin(1, 2), "schema version is not supported")
        .when(F.col("id").isNull() | F.col("path").isNull(), "id or path is missing")
        .when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), "path leaves the workspace")
        .when(F.col("selector").isNotNull() & ((F.col("schema_version") == 1) | ((keys > 0) == (pointers > 0))), "selector is not valid")
    )
    rows = rows.withColumn("problem", problem).withColumn("path", F.when(F.col("problem").isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("manifest: "), "problem"))))
    one = rows.groupBy("id").agg(F.count("*").alias("n"), F.first(F.struct("path", "type", "sensitivity", "policy_tags", "selector")).alias("s"))
    source_id = F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("manifest: two sources are named "), "id")))
    kind = F.when(F.size("s.selector.dotenv_keys") > 0, "dotenv_keys").when(F.size("s.selector.json_pointers") > 0, "json_pointers")
    values = F.when(F.size("s.selector.dotenv_keys") > 0, F.col("s.selector.dotenv_keys")).otherwise(F.col("s.selector.json_pointers"))
    return one.select(source_id.alias("source_id"), F.lit(workspace).alias("workspace_id"), "s.path", "s.type", "s.sensitivity", "s.policy_tags", kind.alias("selector_kind"), values.alias("selector_values"))


def of_scope(rows: DataFrame, workspace: str, session: str | None = None, after: int | None = None, through: int | None = None, tool_uses: list[str] | None = None) -> DataFrame:
    """Rows of a workspace, in order: of a session, behind and up to a sequence number, of some tool uses. All of it is
    pushed down to the scan."""
    found: Column = F.col("workspace_id") == workspace
    for condition, given in ((F.col("session_id") == session, session), (F.col("sequence_no") > after, after), (F.col("sequence_no") <= through, through)):
        found = found & condition if given is not None else found
    if tool_uses is not None:
        found = found & F.col("tool_use_id").isin(tool_uses)
    return rows.filter(found).orderBy("sequence_no", *(c for c in ("event_id", "fragment_id", "edge_id") if c in rows.columns))


def of_run(spark: SparkSession, folder: str, run_id: str, table: str, kind: str | None = None) -> DataFrame:
    """A table of a published run; of node snapshots, those of a kind."""
    rows = spark.read.parquet(f"{folder}/run_id={run_id}/{table}")
    return rows if kind is None else rows.filter(F.col("node_kind") == kind)


def write_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that rows has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_report(report: DataFrame, folder: str) -> int:
    """A report (few rows) as one JSON file, the next number in folder: written beside its place, then renamed to a name
    that nobody has, so that readers see the old one or the new one whenever it breaks off. The one before it stays."""
    spark = report.sparkSession
    beside = f"{folder}/_{uuid.uuid4().hex}"
    report.coalesce(1).write.json(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(beside)) if f.getPath().getName().startswith("part-"))
    number = max(_reports(spark, folder), default=0) + 1
    if not fs.rename(part, path(f"{folder}/report-{number}.json")):
        raise ValueError("another report was faster")
    fs.delete(path(beside), True)
    for old in _reports(spark, folder):
        if old < number - 1:
            fs.delete(path(f"{folder}/report-{old}.json"), False)
    return number


def _reports(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return [int(n[7:-5]) for n in names if n.startswith("report-") and n.endswith(".json")]


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """The last report of a folder."""
    return spark.read.json(f"{folder}/report-{max(_reports(spark, folder))}.json")
