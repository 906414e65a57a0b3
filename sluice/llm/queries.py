"""The queries opN_<name>: each applies an operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import (
    decontaminate,
    html_text,
    licenses,
    merkle,
    mixing,
    near_dedup,
    packing,
    periodic,
    quality,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
)

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "found.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max("found.score"), F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0)).alias("score"),
        F.col("found").alias("detections"),
    )


def op3_quality_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged.select(*names)


def op4_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op5_near_dedup_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_decontaminate_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_url_filter_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def _flat_length(spans: str) -> F.col:
    """Length of all spans of a flat array start, end, start, ..."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b)


def op8_substring_dedup_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", _flat_length("removed").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = (F.size("removed") / 2).cast("long").alias("n_spans")
    return out.select("doc_id", "n_bytes", _flat_length("removed").alias("n_removed"), n_spans, F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op10_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def repeating_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the contract of op11 looks at: in some documents all words from one on repeat with a period."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), repeating_tail)
    # Lengths over periods are compared as doubles: below 2 ** 26 words two different ones are told apart.
    ranked = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256)
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(ranked).alias("b"), digest.alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("1000 * b.length div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_merkle_multiproof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.verified(docs, F.when(chosen, lowered)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_mix_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity_nnpu, op2_license_scan, op3_quality_weak_supervision, op4_pack_best_fit, op5_near_dedup_chosen_path,
        op6_decontaminate_wu_manber, op7_url_filter_trie, op8_substring_dedup_lsm, op9_suffix_array_dedup, op10_extract_html,
        op11_periodic_runs_grammar, op12_merkle_multiproof, op13_mix_pareto,
    ]
    return {f.__name__: f for f in found}
