"""Evaluation: confusion matrices, ratios, percentiles, groups, gates, parity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that are searched for at once, at most.
MOST_VALUES = 100_000


def ratio(a: Column, b: Column) -> Column:
    """a / b; null without cases."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(expected: Column, actual: Column) -> list[Column]:
    """Counts and ratios as aggregates; a ratio without cases is null."""
    tp, fp = F.count_if(expected & actual), F.count_if(~expected & actual)
    fn, tn = F.count_if(expected & ~actual), F.count_if(~expected & ~actual)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    ]


def f1() -> Column:
    """Of the columns precision and recall: null if one is, 0 if both are 0."""
    return F.when((F.col("precision") + F.col("recall")) == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("f1")


def wrong(cases: DataFrame) -> DataFrame:
    """(id, kind): false positives and negatives of cases (id, expected, actual)."""
    kind = F.when(~F.col("expected") & F.col("actual"), "false_positive").when(F.col("expected") & ~F.col("actual"), "false_negative")
    return cases.select("id", kind.alias("kind")).filter("kind is not null")


def by_tag(cases: DataFrame) -> DataFrame:
    """Confusion of cases (expected, actual, tags) for each of their tags."""
    rows = cases.select("expected", "actual", F.explode(F.array_distinct("tags")).alias("tag"))
    return rows.groupBy("tag").agg(*confusion(F.col("expected"), F.col("actual"))).withColumn("f1", f1())


def actions(cases: DataFrame) -> DataFrame:
    """(expected, actual, n, accuracy): how often each action was taken where another was expected, and the share of right
    ones per expected action."""
    counts = cases.groupBy("expected", "actual").agg(F.count("*").alias("n"))
    totals = counts.groupBy("expected").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("expected") == F.col("actual"), F.col("n")).otherwise(0)).alias("right"))
    return counts.join(totals, "expected").select("expected", "actual", "n", ratio(F.col("right"), F.col("total")).alias("accuracy"))


def action_errors(cases: DataFrame) -> DataFrame:
    """(id, kind) of cases (id, expected, actual): actions that should not, or should, have been taken."""
    allowed, e, a = F.col("expected") == "allow", F.col("expected"), F.col("actual")
    kind = (
        F.when(allowed & (a == "block"), "false_block").when(allowed & (a == "warn"), "unexpected_warning").when(allowed & (a == "continue_review"), "unexpected_review")
        .when((e == "block") & (a != "block"), "missed_block").when((e == "continue_review") & (a != "continue_review"), "missed_review")
    )
    return cases.select("id", kind.alias("kind")).filter("kind is not null")


def counterfactuals(cases: DataFrame) -> DataFrame:
    """(groups, passed, accuracy): groups of exactly two cases (counterfactual_group, correct) that are both right."""
    groups = cases.filter("counterfactual_group is not null").groupBy("counterfactual_group").agg((F.count("*") == 2).alias("two"), F.bool_and("correct").alias("right"))
    n, passed = F.count("*"), F.count_if(F.col("two") & F.col("right"))
    return groups.agg(n.alias("groups"), passed.alias("passed"), ratio(passed, n).alias("accuracy"))


def nearest_rank(column: str, *shares: float) -> list[Column]:
    """Nearest-rank percentiles: the smallest value with at least this share at or below it."""
    return [F.expr(f"percentile_disc({p}) within group (order by {column})").alias(f"p{round(100 * p)}") for p in shares]


def score_stats(cases: DataFrame) -> DataFrame:
    """Per method: number of scores, the least, nearest-rank percentiles, the largest."""
    return cases.groupBy("method").agg(F.count("*").alias("n"), F.min("score").alias("least"), *nearest_rank("score", 0.5, 0.95), F.max("score").alias("most"))


def retrieval(cases: DataFrame, limit: int, *by: str) -> DataFrame:
    """Of queries (relevant: should be found, found, n_candidates): positives, those found, recall, how many candidates
    there were, and the share of queries that filled the limit."""
    positives, found = F.count_if("relevant"), F.count_if(F.col("relevant") & F.col("found"))
    full = F.count_if(F.col("n_candidates") >= limit)
    return cases.groupBy(*by).agg(
        F.count("*").alias("n"), positives.alias("positives"), found.alias("retrieved"), ratio(found, positives).alias("recall"),
        *nearest_rank("n_candidates", 0.5, 0.95), ratio(full, F.count("*")).alias("saturation"),
    )


def sets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Confusion of two sets of rows: tp, fp, fn, precision, recall and f1."""
    keys = expected.columns
    e, a = (x.select(*keys).distinct().withColumn(n, F.lit(1)) for x, n in ((expected, "e"), (actual, "a")))
    both = e.join(a, keys, "full")
    tp, fp, fn = F.count_if(F.expr("e = 1 and a = 1")), F.count_if(F.expr("e is null")), F.count_if(F.expr("a is null"))
    return both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall")).withColumn("f1", f1())


def exact_sets(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(files, exact, rate): keys of expected whose set of values is found exactly."""
    gathered = lambda rows, name: rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))
    both = gathered(expected, "e").join(gathered(actual, "a"), key, "left")
    n, same = F.count("*"), F.count_if(F.col("e").eqNullSafe(F.col("a")))
    return both.agg(n.alias("files"), same.alias("exact"), ratio(same, n).alias("rate"))


def least_specificity(cases: DataFrame) -> DataFrame:
    """(families, least): the smallest specificity of the families of negatives (family, expected, actual)."""
    by_family = cases.filter(~F.col("expected")).groupBy("family").agg(ratio(F.count_if(~F.col("actual")), F.count("*")).alias("specificity"))
    return by_family.agg(F.count("*").alias("families"), F.coalesce(F.min("specificity"), F.lit(0.0)).alias("least"))


def extraction(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Of segments (case_id, index, extraction, submitted): how many are found, how many with the right kind, how many with
    the right values, and how many fall back."""
    keys = ["case_id", "index"]
    both = expected.join(actual.select(*keys, F.col("extraction").alias("kind"), F.col("submitted").alias("values")), keys, "left")
    n, found = F.count("*"), F.count_if(F.col("kind").isNotNull())
    kinds, values = F.count_if(F.col("kind") == F.col("extraction")), F.count_if(F.col("values") == F.col("submitted"))
    return both.agg(n.alias("segments"), found.alias("found"), ratio(kinds, n).alias("kind_accuracy"), ratio(values, n).alias("value_accuracy"), F.count_if(F.col("kind") == "coarse_fallback").alias("fallbacks"))


def chunk_recall(values: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of protected values (source_id, value): the share that is a chunk of its source, and that some chunk contains."""
    met = values.join(chunks.select("source_id", F.col("text").alias("chunk")), "source_id", "left").groupBy("source_id", "value")
    met = met.agg(F.coalesce(F.bool_or(F.col("chunk") == F.col("value")), F.lit(False)).alias("exact"), F.coalesce(F.bool_or(F.contains("chunk", "value")), F.lit(False)).alias("held"))
    return met.agg(F.count("*").alias("n"), ratio(F.count_if("exact"), F.count("*")).alias("exact_recall"), ratio(F.count_if("held"), F.count("*")).alias("containing_recall"))


def profile(cases: DataFrame, *by: str) -> DataFrame:
    """Of cases (status, expected, detected, action, recommended_action): how many are evaluated, unsupported, unavailable;
    detection among the evaluated, and end to end, where what is not evaluated counts as allowed."""
    seen = F.col("status") == "evaluated"
    hit = F.coalesce("detected", F.lit(False))
    tp, fp, fn = F.count_if(F.col("expected") & hit), F.count_if(~F.col("expected") & hit), F.count_if(F.col("expected") & ~hit)
    missed = F.count_if(seen & F.col("expected") & ~hit)
    taken = F.coalesce("action", F.lit("allow")) == F.col("recommended_action")
    return cases.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(seen).alias("evaluated"), F.count_if(F.col("status") == "unsupported").alias("unsupported"), F.count_if(F.col("status") == "unavailable").alias("unavailable"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + missed).alias("evaluated_recall"), ratio(F.count_if(taken), F.count("*")).alias("action_accuracy"),
    )


def profile_delta(cases: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(id, kind): cases (id, profile, status, expected, detected) that both profiles evaluate and only the candidate
    detects: recovered positives and introduced false positives."""
    seen = lambda name: cases.filter((F.col("profile") == name) & (F.col("status") == "evaluated"))
    both = seen(baseline).select("id", F.col("detected").alias("before")).join(seen(candidate).select("id", "expected", "detected"), "id")
    kind = F.when(F.col("expected"), "recovered_positive").otherwise("introduced_false_positive")
    return both.filter("not before and detected").select("id", kind.alias("kind"))


def shadow_action(resolution: Column, comparison: Column, match: Column) -> Column:
    exact = match.isin("resolved_payload_exact", "resolved_payload_exact_substring")
    return F.when((resolution != "evaluated") | (comparison != "evaluated"), "unknown").when(exact, "would_block").otherwise("would_allow")


def shadow_report(observations: DataFrame) -> DataFrame:
    """Per change from the base action to the shadow's: how often, and how long it took (duration_ms)."""
    change = F.concat_ws("->", "base_action", "shadow_action").alias("change")
    return observations.groupBy(change).agg(F.count("*").alias("n"), *nearest_rank("duration_ms", 0.5, 0.95, 0.99), F.max("duration_ms").alias("most"))


def median_per(rows: DataFrame, key: str) -> DataFrame:
    """(keys, median): the median number of rows per key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.median("n").alias("median"))


def gate(observed: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, observed, threshold, passed) of observed (name, value) against thresholds (name, value): those named maximum_*
    from above, all others from below; what was not observed counts as 0."""
    rows = thresholds.select("name", F.col("value").alias("threshold")).join(observed.select("name", F.col("value").alias("observed")), "name", "left")
    rows = rows.withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return rows.withColumn("passed", F.when(F.col("name").startswith("maximum_"), F.col("observed") <= F.col("threshold")).otherwise(F.col("observed") >= F.col("threshold")))


def passed(checks: DataFrame) -> DataFrame:
    """One row: whether there are checks and all of them hold."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results holds, with the side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def set_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shared, either, score) of the distinct rows of two tables; 0 if both are empty."""
    x, y = a.distinct().withColumn("_a", F.lit(1)), b.select(*a.columns).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, a.columns, "full")
    shared, either = F.count_if(F.expr("_a = 1 and _b = 1")), F.count("*")
    return both.agg(shared.alias("shared"), either.alias("either"), F.coalesce(ratio(shared, either), F.lit(0.0)).alias("score"))


def exposures(values: DataFrame, reports: DataFrame) -> DataFrame:
    """(kind, n): how many values (kind, value), raw or as hash, stand in the text of a report.

    The values are a bounded list of a test corpus: up to MOST_VALUES are one automaton, that reads each text once whatever
    their number; of a longer list each value is searched by itself."""
    both = values.select("kind", "value").union(values.select(F.concat("kind", F.lit("_hash")), F.sha2(F.col("value").cast("binary"), 256))).distinct()
    known = both.filter("value <> ''").limit(MOST_VALUES + 1).collect()
    if len(known) > MOST_VALUES:
        met = reports.select("text").join(F.broadcast(both), F.contains("text", "value")).select("kind", "value")
    else:
        empty = both.filter("value = ''").join(reports.filter("text is not null").select(F.lit(True)).limit(1)).select("kind", "value")
        met = reports.select("text").mapInArrow(_standing([(r.kind, r.value) for r in known]), "kind string, value string").union(empty)
    return met.distinct().groupBy("kind").agg(F.count("*").alias("n"))


def _standing(known: list[tuple[str | None, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (kind, value) those that stand in a text, each once a task."""
    kinds: dict[str, list[str | None]] = {}
    for kind, value in known:
        kinds.setdefault(value, []).append(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, seen = ahocorasick.Automaton(), set()
        for value in kinds:
            automaton.add_word(value, value)
        automaton.make_automaton()
        for batch in batches:
            for text in batch.column(0):
                if kinds and text.is_valid:
                    seen.update(value for _, value in automaton.iter(text.as_py()))
        rows = [(kind, value) for value in sorted(seen) for kind in kinds[value]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["kind", "value"])

    return run


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """A digest of all rows whatever their order: SHA-256 of each row's SHA-256, summed by 32-bit words, so that nothing is
    gathered in one place, and equal tables of whatever partitioning agree."""
    row = F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)
    words = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *words).cast("binary"), 256).alias("digest"))
