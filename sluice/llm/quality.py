"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes for (1) or against (-1) a document or abstains (0). Documents are counted by their votes - at most
3 ** rules patterns, however many documents - and expectation-maximisation over these counts estimates the share of
good documents and how often each rule is right on good and on bad ones. A document stays if the posterior probability that it is good is high enough.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import stored

ROUNDS = 25
#: name: (condition for, condition against); otherwise the rule abstains.
RULES = {
    "long_enough": ("n_words >= 40", "n_words < 15"),
    "word_length": ("word_chars between 2.5 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 11 * n_words"),
    "few_symbols": ("n_symbols <= 0.05 * n_words", "n_symbols > 0.3 * n_words"),
    "few_symbol_characters": ("n_symbols <= 0.01 * word_chars", "n_symbols > 0.05 * word_chars"),
    "few_symbol_runs": ("n_runs <= 0.01 * n_words", "n_runs > 0.1 * n_words"),
    "few_repeated_lines": ("n_dup_lines = 0", "n_dup_lines > 0.25 * n_lines"),
    "few_repeats": ("n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    "few_capitals": ("n_capitals <= 0.15 * word_chars", "n_capitals > 0.4 * word_chars"),
    "few_shouts": ("n_shouts <= 0.05 * n_words", "n_shouts > 0.3 * n_words"),
    "sentences": ("n_stops >= 0.02 * n_words", "n_stops = 0 and n_words >= 60"),
}
SPACE = " \t\n\x0b\f\r"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, size: int = 5) -> Column:
    """How many words stand in windows of `size` words that the array holds twice or more."""
    n = F.size(words)
    grams = F.slice(F.arrays_zip(*(F.slice(words, F.lit(1 + i), F.greatest(n, F.lit(1))) for i in range(size))), 1, F.greatest(n - (size - 1), F.lit(0)))
    hashes = F.transform(grams, lambda g: F.xxhash64(g))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _let(ranked, lambda s: F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        reach = _let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _measured(text: Column) -> Column:
    """A struct of what the rules look at, with words and lines split once."""
    bare = F.translate(text, SPACE, "")
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike("\\A[ \\t-\\r]*\\z"))
    lines = F.when(F.length(bare) > 0, lines).otherwise(F.array().cast("array<string>"))

    def all_of(w: Column, x: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(bare),
            "n_symbols": _count(text, "#*$%&|<>"),
            "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_repeat_words": repeated_words(w),
            "n_lines": F.size(x),
            "n_runs": F.regexp_count(text, F.lit(r"([#*$%&|<>])\1")),
            "n_capitals": _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_shouts": _count(text, "!"),
            "n_stops": _count(text, ".?"),
        }
        return F.struct(*(value.cast("long").alias(name) for name, value in found.items()))

    return _let(words, lambda w: _let(lines, lambda x: all_of(w, x)))


def measures(documents: DataFrame) -> DataFrame:
    """doc_id and what the rules look at, over whole texts. A null text has no words, lines or characters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _measured(text).alias("m")).select("doc_id", "m.*")


def votes(rules: dict[str, tuple[str, str]] = RULES) -> str:
    return f"array({', '.join(f'case when {good} then 1 when {bad} then -1 else 0 end' for good, bad in rules.values())})"


def estimate(measured: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> tuple[float, list[float], list[float]]:
    """Share of good documents, and how often each rule that votes is right on good and on bad ones, by
    expectation-maximisation over counts of vote patterns.

    Everything happens in one expression over one row of at most 3 ** rules patterns. Bounds keep rules from turning
    round or ruling alone; 20 imagined votes steady them; without documents the first guesses return.
    """
    patterns = measured.select(F.expr(votes(rules)).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n"))
    all_patterns = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("t"))
    # The arrays of logarithms: what a vote for, and a vote against, say for good.
    expect = """transform(t, x -> named_struct('v', x.v, 'n', x.n, 'q', 1D / (1D + exp(-(ln(p.prior / (1D - p.prior)) +
        aggregate(zip_with(x.v, p.rule, (v, a) -> case v when 1 then ln(a.good / (1D - a.bad))
            when -1 then ln((1D - a.good) / a.bad) else 0D end), 0D, (s, y) -> s + y))))))"""
    maximise = """named_struct('prior', (1D + aggregate(e, 0D, (s, x) -> s + x.n * x.q)) / (2D + aggregate(e, 0D, (s, x) -> s + x.n)),
        'rule', transform(p.rule, (a, j) -> named_struct(
            'good', least(0.995D, greatest(0.7D, aggregate(e, 19D, (s, x) -> s + case when x.v[j] = 1 then x.n * x.q else 0D end)
                / aggregate(e, 20D, (s, x) -> s + case when x.v[j] <> 0 then x.n * x.q else 0D end))),
            'bad', least(0.98D, greatest(0.1D, aggregate(e, 8D, (s, x) -> s + case when x.v[j] = -1 then x.n * (1D - x.q) else 0D end)
                / aggregate(e, 20D, (s, x) -> s + case when x.v[j] <> 0 then x.n * (1D - x.q) else 0D end))))))"""
    start = f"named_struct('prior', 0.8D, 'rule', array_repeat(named_struct('good', 0.95D, 'bad', 0.4D), {len(rules)}))"
    fitted = f"aggregate(sequence(1, {ROUNDS}), {start}, (p, r) -> transform(array({expect}), e -> {maximise})[0])"
    model = all_patterns.select(F.expr(fitted).alias("m")).first()["m"]
    return model["prior"], [r["good"] for r in model["rule"]], [r["bad"] for r in model["rule"]]


def posterior(votes: str, prior: float, good: list[float], bad: list[float]) -> str:
    """Probability that a document is good, given its votes."""
    says = [f"struct({math.log(g / (1 - b))}D as yes, {math.log((1 - g) / b)}D as no)" for g, b in zip(good, bad)]
    each = f"zip_with({votes}, array({', '.join(says)}), (v, s) -> case v when 1 then s.yes when -1 then s.no else 0D end)"
    return f"1D / (1D + exp(-({math.log(prior / (1 - prior))}D + aggregate({each}, 0D, (a, b) -> a + b))))"


#: Too short or too repetitive: rejected whatever the rules say.
BASE_FAILED = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"


def judge(documents: DataFrame, least: float = 0.5, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed (too short, or too repetitive: rejected at once), quality (posterior
    probability) and kept. Null and repeated ids stay as they are; no documents give no rows."""
    measured = stored(measures(documents), "measures")
    judged = measured.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", F.expr(posterior(votes(rules), *estimate(measured, rules))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def keep(documents: DataFrame, least: float = 0.5, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """The documents that judge() keeps, with all their columns. Measures twice rather than move or copy texts: once to
    fit the model, once in the filter, whose condition holds all measures in one struct so that they are taken once."""
    model = estimate(measures(documents), rules)
    holds = f"not {BASE_FAILED} and {posterior(votes(rules), *model)} >= {least}D"
    within = re.sub(r"\b(n_[a-z_]+|word_chars)\b", r"m.\1", holds)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.struct("*").alias("carried"), F.array(_measured(text)).alias("measured"))
    return rows.filter(f"transform(measured, m -> {within})[0]").select("carried.*")
