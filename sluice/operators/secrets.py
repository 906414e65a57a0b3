"""Which keys of dotenv and JSON files hold secrets, and known formats of credentials."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import documents
from sluice.functions.canonical import let, words
from sluice.operators.fragments import leaves, nesting

#: Fixed values.
MARKERS = "access_key api_key auth authentication authorization bearer credential passwd password private_key secret token".split()
PLACEHOLDERS = "change_me changeme configure_later example_only illustrative_only not_set redacted replace_me replace_this set_me unset withheld".split()
WEAK = "demo dummy example fake fixture illustrative mock sample test".split()
WEAK_NAMES = WEAK + "blueprint cookbook default defaults dist placeholder reference skeleton template".split()
PROTOCOLS = (
    "access api_key authorization_code basic bearer client_secret_basic client_secret_jwt client_secret_post digest dpop"
    " id_token jwt mac none ntlm oauth oauth2 oidc openid password private_key_jwt refresh refresh_token saml"
).split()
ALGORITHMS = "aes ed25519 es256 es384 es512 hs256 hs384 hs512 none ps256 ps384 ps512 rs256 rs384 rs512 rsa".split()
POLICIES = "default disabled enforced optional required strict".split()
KINDS = "method mode scheme type".split()
REFERENCES = "endpoint file header id identifier name path prefix ref reference scope scopes uri url version".split()
PLACES = "endpoint file path ref reference uri url".split()
QUALIFIERS = KINDS + REFERENCES + ["algorithm", "format", "policy"]
MANAGERS = (
    "arn:aws:secretsmanager: arn:aws:ssm: aws-secretsmanager:// azure-keyvault:// doppler:// gcp-secret-manager:// op://"
    " secret-manager:// secret:// sm:// ssm:// vault://"
).split()
LABELS = {"d_po_p": "dpop", "o_auth": "oauth", "o_auth2": "oauth2", "open_id": "openid"}
MOST_CLASSIFIED, MOST_SELECTORS, MOST_SELECTOR_BYTES, MOST_ITEMS, MOST_DEPTH, CONFIDENCE = 8192, 256, 4096, 4096, 32, 0.95
CREDENTIALS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "github_token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})",
    "openai_key": r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}",
    "aws_access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "stripe_live_key": r"sk_live_[A-Za-z0-9]{16,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "credential_url": r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s/:@]+:[^\s/@]+@",
}
USER_PATHS = {"posix_user_path": r"/(?:Users|home)/[A-Za-z0-9._-]+/", "windows_user_path": r"(?i)[A-Z]:\\Users\\[A-Za-z0-9._-]+\\"}


def credential_counts(x: Column, allowed: list[str] | None = None) -> Column:
    """struct of how often each format occurs, without matches that hold an allowed text (known synthetic ones)."""

    def count(pattern: str) -> Column:
        if not allowed:
            return F.regexp_count(x, F.lit(pattern))
        found = F.regexp_extract_all(x, F.lit(pattern if pattern.startswith("(?i)") else f"(?:{pattern})"), 0)
        return F.size(F.filter(found, lambda m: ~F.exists(words(allowed), lambda a: F.contains(m, a))))

    return F.struct(*(count(p).cast("long").alias(n) for n, p in (CREDENTIALS | USER_PATHS).items()))


def credential_count(x: Column) -> Column:
    total = F.lit(0)
    for pattern in CREDENTIALS.values():
        total = total + F.regexp_count(x, F.lit(pattern))
    return total.cast("long")


def compatible(x: Column) -> Column:
    """Compatibility form of a string column."""
    return F.pandas_udf(lambda x: x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore"), "string")(x)


def segments(x: Column) -> Column:
    """Lower-cased words of an identifier, parted at marks, humps and acronyms. x: in compatibility form."""
    humps = F.regexp_replace(F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(F.regexp_replace(humps, "[^A-Za-z0-9]+", "_")), "_"), lambda s: s != "")


def secret_key(key: Column) -> Column:
    """Whether an identifier's words, or two that follow each other, say that it holds a secret."""

    def of(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.concat_ws("_", a, b))
        return F.arrays_overlap(s, words(MARKERS)) | F.arrays_overlap(pairs, words(MARKERS))

    return F.coalesce(let(segments(key), of), F.lit(False))


def label(x: Column) -> Column:
    joined = F.array_join(segments(x), "_")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in LABELS.items() for v in pair)), joined), joined)


def placeholder(x: Column) -> Column:
    """References to variables, brackets, rows of marks, and words that stand for a value to come."""
    shape = x.rlike(r"^\$[A-Za-z_][A-Za-z0-9_]*$|^\$\{[A-Za-z_][A-Za-z0-9_]*(?::[-+?=][^{}]*)?\}$|^\{\{[^{}]+\}\}$|^<[^<>]+>$|^[*xX_-]{4,}$")
    s = segments(x)
    later = (F.size(s) >= 2) & F.get(s, F.lit(0)).isin("change", "configure", "replace", "set") & F.element_at(F.concat(F.array(F.lit("")), s), -1).isin("later", "me", "placeholder", "this")
    return shape | label(x).isin(PLACEHOLDERS) | F.coalesce(later, F.lit(False))


def managed(x: Column) -> Column:
    """References to a manager of secrets."""
    low = F.lower(x)
    return low.rlike("^(" + "|".join(MANAGERS).replace(".", r"\.") + ")") | low.rlike("^/*projects/+[^/]+/+secrets/+[^/]+/+versions/+[^/]+")


def metadata(key: Column, x: Column) -> Column:
    """Values that name a protocol, an algorithm, a policy or a place, under keys that ask for one."""

    def of(s: Column) -> Column:
        has = lambda names: F.arrays_overlap(s, words(names))
        key_id = F.contains(F.concat(F.lit("_"), F.array_join(s, "_"), F.lit("_")), F.lit("_access_key_id_"))
        said = label(x)
        protocol = (has("auth authentication authorization bearer token".split()) | has(KINDS)) & said.isin(PROTOCOLS)
        place = has(PLACES) & (x.rlike(r"^(/|\./|\.\./|~/)") | x.rlike(r"[/\\]"))
        name = x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,255}$") | (has(["scope", "scopes"]) & x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/ -]{0,255}$"))
        found = (
            F.when((F.size(s) == 0) | key_id, False)
            .when(protocol, True)
            .when(~has(QUALIFIERS), False)
            .when(has(["algorithm", "format"]), said.isin(ALGORITHMS + PROTOCOLS))
            .when(has(KINDS), said.isin(PROTOCOLS))
            .when(has(["policy"]), said.isin(POLICIES))
            .otherwise(has(REFERENCES) & (x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$") | place | name))
        )
        return F.coalesce(found, F.lit(False))

    return let(segments(key), of)


def secret_value(key: Column, x: Column, path: Column) -> Column:
    """Whether a value can be a secret: no reference, no placeholder, nothing that only describes one. Values over the
    bound are taken as they are. key and x: in compatibility form."""
    x = documents.stripped(x)
    weak = F.arrays_overlap(segments(x), words(WEAK)) & F.arrays_overlap(segments(F.regexp_extract(path, "[^/]*$", 0)), words(WEAK_NAMES))
    told = (F.length(x) <= MOST_CLASSIFIED) & (placeholder(x) | weak | metadata(key, x))
    return (x != "") & ~managed(x) & ~told


def json_problem(x: Column) -> Column:
    """Why a text is refused as JSON: an object has a key twice, or it can't be read."""

    def unique(pairs: list[tuple]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise KeyError
        return found

    def one(text: str) -> str:
        try:
            json.loads(text, object_pairs_hook=unique)
        except KeyError:
            return "json_duplicate_key"
        except (ValueError, RecursionError):
            pass
        return "source_not_parseable"

    return F.pandas_udf(lambda x: x.map(one, na_action="ignore"), "string")(x)


def _fields(files: DataFrame) -> DataFrame:
    """(path, kind, selector, key, value, problem) of files (path, text): assignments of .env files, string members of
    .json files."""
    base = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    env = files.filter((base == ".env") | base.startswith(".env."))
    lines = F.filter(F.transform(documents.lines(F.col("text")), documents.stripped), lambda s: ~s.rlike("^(#.*)?$"))
    shape = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)\s*=(.*)$"
    keys = F.transform(lines, lambda s: F.regexp_extract(s, shape, 1))
    problem = F.when(documents.dotenv(F.col("text")).isNull(), "source_not_parseable").when(F.size(F.array_distinct(keys)) < F.size(keys), "dotenv_duplicate_key")
    assigned = env.select("path", F.lit("dotenv_keys").alias("kind"), problem.alias("problem"), F.explode_outer(documents.dotenv(F.col("text"))).alias("p"))
    assigned = assigned.select("path", "kind", F.col("p.key").alias("selector"), "p.key", "p.value", "problem")
    docs = files.filter(F.lower("path").endswith(".json"))
    variant = F.try_parse_json("text")
    # Spark's parser refuses an object that has a key twice, too.
    bad = F.when(variant.isNull(), json_problem(F.col("text"))).when(nesting(F.col("text")) > MOST_DEPTH, "json_too_deep")
    roots = docs.select("path", "text", bad.alias("problem"))
    found = leaves(roots.filter("problem is null").select(F.col("path").alias("artifact_id"), F.lit("tool_input").alias("artifact_role"), "text"))
    items = found.filter("fragment_kind = 'json_key' or json_pointer rlike '/[0-9]+$'").groupBy("artifact_id").agg(F.count_distinct("json_pointer").alias("items"))
    members = found.filter("fragment_kind = 'payload'").join(items, "artifact_id", "left")
    many = F.when(F.col("items") > MOST_ITEMS, "json_too_many_items")
    named = members.select(F.col("artifact_id").alias("path"), F.lit("json_pointers").alias("kind"), F.col("json_pointer").alias("selector"), "key", F.col("text").alias("value"), many.alias("problem"))
    none = F.lit(None).cast("string")
    failed = roots.filter("problem is not null").select("path", F.lit("json_pointers").alias("kind"), none.alias("selector"), none.alias("key"), none.alias("value"), "problem")
    return assigned.unionByName(named).unionByName(failed)


def discover(files: DataFrame) -> DataFrame:
    """(path, kind, selectors, confidence, problem) of files (path, text): the sorted keys, or pointers, whose values are
    secrets, or why there are none."""
    rows = _fields(files).withColumn("key_form", compatible(F.col("key"))).withColumn("value_form", compatible(F.col("value")))
    hit = secret_key(F.col("key_form")) & secret_value(F.col("key_form"), F.col("value_form"), F.col("path"))
    found = rows.groupBy("path", "kind").agg(F.max("problem").alias("problem"), F.sort_array(F.collect_set(F.when(F.coalesce(hit, F.lit(False)), F.col("selector")))).alias("selectors"))
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.size("selectors") == 0, "no_secret_selector")
        .when(F.size("selectors") > MOST_SELECTORS, "too_many_selectors")
        .when(F.exists("selectors", lambda s: F.octet_length(s) > MOST_SELECTOR_BYTES), "selector_too_long")
    )
    found = found.withColumn("problem", problem)
    chosen = F.when(F.col("problem").isNull(), F.col("selectors")).otherwise(F.array().cast("array<string>"))
    return found.select("path", "kind", chosen.alias("selectors"), F.when(F.col("problem").isNull(), CONFIDENCE).alias("confidence"), "problem")
