"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share by weight of all words, at most MOST times its words; what is above goes to the others by
weight. Within a source the expected copies of a document rise with its length class (the bits of its size), so that
inclusion is unequal: the whole part of them is certain, the fraction p is sampled. Documents are ranked by random odds
u / (1 - u) divided by inclusion odds p / (1 - p); the sample, whose size is fixed in words, is the beginning of that order
that fits into what the certain copies leave. One document, the one whose size comes nearest to the words that are still
missing, completes a source.

Nothing is gathered by source: the end of the beginning is found by sums over 4096 slots of the rank, then over 4096 slots
of the slot it falls into, and so on, and rows that are equal in everything are one row with a count.

Defined results: a null text has no words; a document without words is taken 0 times; a null source is a source, the last
one; of rows that repeat a doc_id, source and text each is taken on its own; null ids stay; an empty table gives an empty
result; other columns, whatever their names, are not looked at. The random number comes from doc_id and text alone, so that
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SLOTS, DEPTH = 4096, 3
BITS = 52


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on doc_id and text alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"))
    return (F.conv(F.left(digest, F.lit(BITS // 4)), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << BITS))


def counted(documents: DataFrame) -> DataFrame:
    """source, doc_id, size and random number u, with how many rows have them (n)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), words_of(text).alias("size"), uniform(F.col("doc_id"), text).alias("u"))
    return rows.groupBy("source", "doc_id", "size", "u").agg(F.count("*").alias("n"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with place (from 0) by code point, null last; ranges are numbered on their own, then shifted."""
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    dealt = stored(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources")
    within = dealt.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return within.join(shift, "part").withColumn("place", F.col("before") + F.col("k") - 1).drop("part", "k", "before")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with target: shares by weight of all words, none above most times the source's words,
    the excess reshared by weight until none is above. Each round sums over the table and brings back two numbers."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(numbered(sources).withColumn("weight", weight), "weighted")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, -1
    while True:
        above = F.lit(share) * F.col("weight") > most * F.col("source_size")
        capped, taken, rest = rows.agg(F.count_if(above), F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not rest or (capped == before):
            break
        before, share = capped, (total - (taken or 0)) / rest
    target = F.least(F.lit(share) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return rows.withColumn("target", target)


def copies(rows: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, bits, expected) of the length classes of each source: expected copies are in proportion to the bits of the
    size, at most `most`, and their words add up to the target. There are 64 classes at most."""
    classes = rows.filter("size > 0").groupBy("source", F.length(F.bin("size")).alias("bits")).agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    longer = Window.partitionBy("source").orderBy(F.desc("bits"))
    above = F.coalesce(F.sum("words").over(longer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("bits")).over(longer.rowsBetween(0, Window.unboundedFollowing))
    same = F.col("source").eqNullSafe(F.col("s"))
    known = targets.select(F.col("source").alias("s"), "target")
    held = classes.withColumn("above", above).withColumn("below", below).join(known, same).drop("s")
    # If the classes above have `most` copies, those from here on have rate * bits; the first class that this leaves below `most` says the rate.
    held = held.withColumn("rate", (F.col("target") - most * F.col("above")) / F.col("below"))
    fits = F.col("rate") * F.col("bits") <= most
    rate = F.coalesce(F.max_by(F.when(fits, F.col("rate")), F.when(fits, F.col("bits"))).over(Window.partitionBy("source")), F.lit(float(most)))
    return held.select("source", "bits", F.least(F.lit(float(most)), rate * F.col("bits")).alias("expected"))


def _slot(depth: int) -> Column:
    """The slot of the rank x at a depth, from 0; x in (0, 1)."""
    at = F.col("x") * F.lit(float(SLOTS))
    for _ in range(depth):
        at = (at - F.floor(at)) * F.lit(float(SLOTS))
    return F.floor(at).cast("int")


def sampled(rows: DataFrame) -> DataFrame:
    """rows (source, x, size, n, room) with `extra`: how many of the n equal rows are in the sample. Per source, in the order
    of x, rows are taken as long as their words fit into room; then the one that completes it best.

    The slot where the words no longer fit is found from coarse to fine; beside a window over the slots of one slot, only
    the rows of the finest slot (of a billionth of a source) are ever looked at one by one.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    ended = None  # per source: slots down to here (path) and the words before them
    inside = rows
    for depth in range(DEPTH):
        if ended is not None:
            path = ended.select(F.col("source").alias("s"), "slot", "before")
            inside = inside.join(path, same & (_slot(depth - 1) == F.col("slot"))).drop("s", "slot")
            inside = inside.withColumn("room", F.col("room") - F.col("before")).drop("before")
        sums = inside.groupBy("source", _slot(depth).alias("slot")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("room").alias("room"))
        order = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        through = sums.withColumn("through", F.sum("words").over(order)).filter("through > room")
        fresh = through.groupBy("source").agg(F.min_by(F.struct("slot", (F.col("through") - F.col("words")).alias("before")), "slot").alias("e")).select("source", "e.*")
        ended = stored(fresh, "slots")
    # The last slot's rows one by one, and the first of them that does not fit as a whole.
    path = ended.select(F.col("source").alias("s"), "slot", "before")
    fine = inside.join(path, same & (_slot(DEPTH - 1) == F.col("slot"))).drop("s", "slot")
    order = Window.partitionBy("source").orderBy("x", "u", "doc_id", "size")
    fine = fine.withColumn("through", F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
    first = F.struct("x", "u", "doc_id", "size", F.floor((F.col("room") - F.col("through") + F.col("size") * F.col("n")) / F.col("size")).alias("fit"))
    edges = stored(fine.filter("through > room").groupBy("source").agg(F.min(first).alias("edge")).select(F.col("source").alias("s"), "edge"), "edges")
    placed = rows.join(edges, same, "left").drop("s")
    here, edge = F.struct("x", "u", "doc_id", "size"), F.struct("edge.x", "edge.u", "edge.doc_id", "edge.size")
    extra = F.when(F.col("edge").isNull() | (here < edge), F.col("n")).when(here == edge, F.col("edge.fit")).otherwise(F.lit(0))
    return placed.withColumn("extra", extra.cast("long")).drop("edge")


def completed(placed: DataFrame) -> DataFrame:
    """placed with one more row of each source in the sample, if that brings its words nearer to its room."""
    same = F.col("source").eqNullSafe(F.col("s"))
    gaps = placed.groupBy("source").agg((F.first("room") - F.sum(F.col("extra") * F.col("size"))).alias("gap")).select(F.col("source").alias("s"), "gap")
    left = placed.filter("extra < n and p > 0").join(gaps, same).drop("s")
    miss = F.abs(F.col("gap") - F.col("size"))
    best = left.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "x", "u", "doc_id", "size", "gap")).alias("b"))
    best = best.filter("b.miss < b.gap").select(F.col("source").alias("s"), F.struct("b.x", "b.u", "b.doc_id", "b.size").alias("one"))
    out = placed.join(best, same, "left").drop("s")
    return out.withColumn("extra", F.col("extra") + F.coalesce((F.struct("x", "u", "doc_id", "size") == F.col("one")).cast("long"), F.lit(0))).drop("one")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of documents: source, doc_id, size, source_size, target (the source's), expected (copies),
    copies and taken (copies * size)."""
    rows = stored(counted(documents), "counted")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(with_targets(sources, weights, most), "targets")
    classes = stored(copies(rows, targets, most), "classes")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    c = classes.select(F.col("source").alias("s"), F.col("bits").alias("b"), "expected")
    same = F.col("source").eqNullSafe(F.col("s"))
    known = rows.join(c, same & (F.length(F.bin("size")) == F.col("b")), "left").drop("s", "b")
    known = known.withColumn("expected", F.when(F.col("size") > 0, F.col("expected")).otherwise(F.lit(0.0)))
    known = known.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.floor("expected"))
    certain = known.groupBy("source").agg(F.sum(F.col("whole") * F.col("size") * F.col("n")).alias("certain")).select(F.col("source").alias("s"), "certain")
    u, p = F.col("u"), F.col("p")
    odds = u * (1 - p) / (u * (1 - p) + (1 - u) * p)  # u's odds over p's, as a number in (0, 1): the same order
    drawn = known.filter("p > 0").withColumn("x", odds).join(certain, same).drop("s").join(t, same).drop("s")
    drawn = stored(drawn.withColumn("room", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0))).drop("certain"), "drawn")
    sample = completed(stored(sampled(drawn), "sample"))
    rest = known.filter("p = 0").join(t, same).drop("s").withColumn("extra", F.lit(0).cast("long"))
    names = ["source", "doc_id", "size", "source_size", "target", "expected", "whole", "extra", "n"]
    both = sample.select(*names).unionByName(rest.select(*names))
    each = both.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    number = F.col("whole") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0)
    return each.select("source", "doc_id", "size", "source_size", "target", "expected", number.cast("long").alias("copies"), (number * F.col("size")).cast("long").alias("taken"))


def mixture(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each document of mix() as often as it is taken, with all its columns. Documents are told by source and
    doc_id; of several with the same, each gets an equal share of their copies, the first rows one more."""
    keys = ["source", "doc_id"]
    totals = mixed.groupBy(*(F.col(k).alias(f"m_{k}") for k in keys)).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    met = (F.col("source").cast("string").eqNullSafe(F.col("m_source"))) & F.col("doc_id").cast("long").eqNullSafe(F.col("m_doc_id"))
    rows = documents.join(totals, met).drop("m_source", "m_doc_id").filter("_copies > 0")
    one = rows.filter("_rows = 1").withColumn("_n", F.col("_copies"))
    several = rows.filter("_rows > 1").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"))))
    several = several.withColumn("_n", F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_k") <= F.col("_copies") % F.col("_rows")).cast("long")).drop("_k")
    both = one.unionByName(several).filter("_n > 0")
    return both.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_k", "_n", "_copies", "_rows")
