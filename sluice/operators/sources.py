"""Protected sources as chunks: the values of a secret file, else the definitions or paragraphs of a text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.canonical import folded
from sluice.functions.documents import definitions, dotenv, field_signal, paragraphs, stripped
from sluice.functions.text import text_hash, token_count

REGISTERED = "registered_source"
#: What is said of selectors that don't fit their file.
PROBLEMS = {
    "dotenv_kind": "dotenv source requires selector.dotenv_keys",
    "dotenv_text": "selected dotenv source is not statically parseable",
    "dotenv_missing": "selector.dotenv_keys contains a missing or empty key",
    "json_kind": "JSON source requires selector.json_pointers",
    "json_text": "selected JSON source is not valid JSON",
    "json_value": "selector.json_pointers must resolve to non-empty string values",
    "json_missing": "selector.json_pointers contains a missing pointer",
    "format": "source selector does not match a supported secretfile format",
}


def json_strings(text: Column, pointers: Column) -> Column:
    """array of struct(pointer, value) of the strings of a JSON text in order; with pointers, of what these name, whose
    value is null if it is no string. Null for what is no JSON."""

    def walk(text: str | None, wanted) -> list[dict] | None:
        try:
            todo = [("", json.loads(text))]
        except (TypeError, ValueError, RecursionError):
            return None
        wanted = None if wanted is None else set(wanted)
        out = []
        while todo:
            pointer, value = todo.pop()
            if (isinstance(value, str) if wanted is None else pointer in wanted):
                out.append({"pointer": pointer, "value": value if isinstance(value, str) else None})
            children = list(value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ())
            todo.extend((f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", child) for k, child in reversed(children))
        return out

    def run(text: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([walk(t, w) for t, w in zip(text, wanted)], dtype=object)

    return F.pandas_udf(run, "array<struct<pointer:string,value:string>>")(text, pointers)


def split_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources (source_id, workspace_id, path, type, selector_kind, selector_values) with the text of their file (files:
    workspace_id, path, text): pieces (array of struct(text, signal), in order) and problem, why there are none. Sources
    without a file stay out."""
    have = files.select(F.col("workspace_id").alias("w"), F.col("path").alias("p"), "text")
    rows = sources.join(have, F.col("path").eqNullSafe(F.col("p")) & F.col("workspace_id").eqNullSafe(F.col("w"))).drop("w", "p")
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    secret = F.col("type") == "secretfile"
    is_env = secret & ((name == ".env") | name.startswith(".env."))
    is_json = secret & name.rlike(r"^.+\.json$")
    asked, kind = F.col("selector_kind").isNotNull(), F.col("selector_kind")
    text, wanted = F.col("text"), F.col("selector_values")
    piece = lambda value, signal: F.struct(value.alias("text"), signal.alias("signal"))
    plain = lambda values: F.transform(values, lambda v: piece(v, F.lit(REGISTERED)))
    rows = rows.withColumn("format", F.when(is_env, "dotenv").when(is_json, "json").when(name.endswith(".py"), "python").otherwise("text"))
    rows = rows.withColumn("strings", json_strings(F.when(F.col("format") == "json", text), F.when(asked, wanted)))
    rows = rows.withColumn("pairs", F.when(F.col("format") == "dotenv", dotenv(text)))
    terminal = lambda p: F.replace(F.replace(F.regexp_extract(p, "[^/]*$", 0), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    assigned = F.when(asked, F.transform(F.filter("pairs", lambda a: F.array_contains(wanted, a["key"])), lambda a: piece(a["value"], field_signal(a["key"])))).otherwise(plain(F.col("pairs.value")))
    full = F.filter("strings", lambda s: stripped(s["value"]) != "")
    members = F.when(asked, F.transform("strings", lambda s: piece(s["value"], field_signal(terminal(s["pointer"]))))).otherwise(plain(F.transform(full, lambda s: s["value"])))
    whole = plain(F.when(F.col("format") == "python", definitions(text)).otherwise(paragraphs(text)))
    lacks = lambda found: F.size(F.array_except(wanted, found)) > 0
    why = lambda key: F.lit(PROBLEMS[key])
    in_env, in_json = F.col("format") == "dotenv", F.col("format") == "json"
    problem = F.when(
        asked,
        F.when(in_env & (kind != "dotenv_keys"), why("dotenv_kind")).when(in_json & (kind != "json_pointers"), why("json_kind")).when(~in_env & ~in_json, why("format"))
        .when(in_env & F.col("pairs").isNull(), why("dotenv_text")).when(in_json & F.col("strings").isNull(), why("json_text"))
        .when(in_env & lacks(F.col("pairs.key")), why("dotenv_missing"))
        .when(in_json & F.exists("strings", lambda s: F.coalesce(stripped(s["value"]) == "", F.lit(True))), why("json_value")).when(in_json & lacks(F.col("strings.pointer")), why("json_missing")),
    )
    # What can't be read falls back to paragraphs, so that a parser's limits never unprotect a text.
    pieces = F.coalesce(F.when(in_env, assigned).when(in_json, members), whole)
    return rows.select(*sources.columns, F.when(problem.isNull(), pieces).alias("pieces"), problem.alias("problem"))


def chunks_of(sources: DataFrame, files: DataFrame) -> DataFrame:
    """The chunks of sources, as flow.source_bindings() takes them: chunk_id, source_id, workspace_id, ordinal, text,
    normalized_text, text_hash, token_count, signal. A selector that doesn't fit its file is an error."""
    rows = split_sources(sources, files)
    said = F.raise_error(F.concat(F.lit("source "), "source_id", F.lit(": "), "problem"))
    each = rows.select("source_id", "workspace_id", F.posexplode(F.when(F.col("problem").isNull(), F.col("pieces")).otherwise(said)).alias("ordinal", "c"))
    rows = each.select("source_id", "workspace_id", "ordinal", "c.text", text_hash(F.col("c.text")).alias("text_hash"), "c.signal").withColumn("normalized_text", folded(F.col("text")))
    chunk_id = F.concat_ws(":", "source_id", F.col("ordinal").cast("string"), F.left("text_hash", F.lit(16)))
    return rows.select(chunk_id.alias("chunk_id"), "source_id", "workspace_id", "ordinal", "text", "normalized_text", "text_hash", token_count(F.col("normalized_text")).alias("token_count"), "signal")
