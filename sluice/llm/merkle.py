"""A Merkle manifest of a dataset, and proofs of many of its rows at once (Octopus multiproof).

Every row is a leaf of the tree of its language; FAN consecutive nodes of a level become their hash until one is left, the
subroot; the subroots are the leaves of a tree of the same kind, whose root stands for the dataset.

manifest() deals leaves into ranges of bounded size, number them, and lets each range hash whatever lies in it as a whole;
nodes over the borders of ranges are hashed level by level from what is left. prove() takes any leaves: each range finds the
smallest set of nodes that its leaves miss on their way up, all ranges fetch theirs with one join, and a range derives the
nodes that its leaves share once and expands the proof of each leaf from them. What a task holds is bounded by the size of
ranges, of which one language may have many.

Defined results: null fields are hashed as "-"; a null text stays null when it is tampered with; rows of a language with the
same doc_id (or none, which stand first) are ordered by their hash; an empty table gives empty results; further columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import stored

FAN = 8
#: Leaves that a task holds at once, about.
LEAVES_AT_ONCE = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "part int, tree string, leaves long, level int, place long, digest string, loose boolean, known int, doc_id long, candidate string"
PROOFS = "tree string, place long, known int, doc_id long, digest string, root string, proof_sha256 string, folded string, before array<string>, after array<string>"


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_of(values: dict[str, Column]) -> Column:
    """The hash of a row: its fields as byte count, colon and value, or - for null."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(field(values[name]) for name in FIELDS)).cast("binary"), 256)


def tree_of(lang: Column) -> Column:
    """The name of a tree, which is never null and sorts as the language does, null first."""
    return F.coalesce(F.concat(F.lit("+"), lang.cast("string")), F.lit(""))


def widths(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def within(digests: list[str], first: int, leaves: int) -> list[tuple[int, int, str, bool]]:
    """(level, place, digest, loose) of the nodes all of whose leaves lie in digests, the leaves from place first on of a
    tree; loose ones have a parent of which that isn't so."""
    out, low = [], first
    for level, width in enumerate(widths(leaves)):
        high = low + len(digests)
        if width == 1:
            out += [(level, 0, d, False) for d in digests]
            break
        a, b = -(-low // FAN), (high // FAN if high < width else -(-width // FAN))
        out += [(level, low + k, d, not a <= (low + k) // FAN < b) for k, d in enumerate(digests)]
        digests = [joined(digests[FAN * j - low : FAN * (j + 1) - low]) for j in range(a, b)]
        low = a
    return out


def missing(places: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes from which, and the leaves at places, the root follows."""
    out, own = [], np.unique(places)
    for level, width in enumerate(widths(leaves)[:-1]):
        parents = np.unique(own // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        out += [(level, p) for p in np.setdiff1d(children[children < width], own, assume_unique=True).tolist()]
        own = parents
    return out


class Derived:
    """All nodes above some leaves of a tree, from these and the missing ones."""

    def __init__(self, leaves: int, own: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.widths = widths(leaves)
        self.levels = [dict(own)] + [{} for _ in self.widths[1:]]
        for (level, place), digest in fetched.items():
            self.levels[level].setdefault(place, digest)
        at = set(own)
        for level, width in enumerate(self.widths[:-1]):
            at = {p // FAN for p in at}
            here = self.levels[level]
            for p in at:
                self.levels[level + 1][p] = joined([here[c] for c in range(FAN * p, min(FAN * (p + 1), width))])
        self.around = lru_cache(4096)(self._around)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def _around(self, level: int, place: int) -> tuple[str, str]:
        """The siblings before and after a node, joined."""
        start = place // FAN * FAN
        own = [self.levels[level][c] for c in range(start, min(start + FAN, self.widths[level]))]
        return "".join(own[: place - start]), "".join(own[place - start + 1 :])

    def path(self, place: int) -> list[tuple[str, str]]:
        out = []
        for level in range(len(self.widths) - 1):
            out.append(self.around(level, place))
            place //= FAN
        return out


def dealt(leaves: DataFrame) -> DataFrame:
    """leaves (tree, doc_id, digest, candidate) by ranges of tree, doc_id and digest: the column part. Equal rows are dealt
    by where they are read, so that no range is much larger than others. known is 0 where there is no doc_id, else 1."""
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // LEAVES_AT_ONCE))
    rows = leaves.withColumn("known", F.col("doc_id").isNotNull().cast("int")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "tree", "known", "doc_id", "digest", "tie")
    return stored(rows.drop("tie").withColumn("part", F.spark_partition_id()), "dealt")


def manifest(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees of leaves (tree, doc_id, digest, candidate): part, tree, leaves, level, place, digest, and at
    level 0 doc_id and candidate."""
    rows = dealt(leaves)
    counts = rows.groupBy("part", "tree").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tree").orderBy("part")
    first = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("part", "tree", first.alias("first"), F.sum("n").over(Window.partitionBy("tree")).alias("leaves"))

    def climb(key: tuple, own: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        known = {r.tree: (int(r.first), int(r.leaves)) for r in spans.itertuples(index=False)}
        out = []
        own = own.sort_values(["tree", "known", "doc_id", "digest"], kind="stable")
        for tree, group in own.groupby("tree", sort=False):
            start, total = known[tree]
            for (level, place, digest, loose), row in _beside(within(group["digest"].tolist(), start, total), group):
                out.append((key[0], tree, total, level, place, digest, loose, *row))
        return _frame(out, NODES)

    lower = rows.groupBy("part").cogroup(spans.groupBy("part")).applyInPandas(climb, NODES)
    nodes = [stored(lower, "nodes")]
    most = nodes[0].agg(F.max("leaves")).first()[0] or 1
    loose = nodes[0].filter("loose")
    for level in range(len(widths(most)) - 1):
        # What two ranges have of a run of FAN nodes meets here, and what became of the level below.
        runs = loose.filter(F.col("level") == level).groupBy("tree", "leaves", F.floor(F.col("place") / FAN).alias("place"))
        digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("place").alias("p"), "digest"))), lambda n: n["digest"]), "").cast("binary"), 256)
        width = F.ceil(F.col("leaves") / F.lit(FAN ** (level + 1)))
        made = runs.agg(digest.alias("digest")).select(
            F.lit(None).cast("int").alias("part"), "tree", "leaves", F.lit(level + 1).alias("level"), "place", "digest", (width > 1).alias("loose"),
            F.lit(None).cast("int").alias("known"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("candidate"),
        )
        nodes.append(stored(made, "nodes"))
        loose = loose.unionByName(nodes[-1].filter("loose"))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def _beside(nodes: list[tuple], group: pd.DataFrame):
    """Each node with (known, doc_id, candidate), which leaves have."""
    own = zip(group["known"].tolist(), group["doc_id"].tolist(), group["candidate"].tolist())
    for node in nodes:
        yield node, (next(own) if node[0] == 0 else (None, None, None))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.where(out.notna(), None)


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, digest) of the top of each tree."""
    width = F.when(F.col("level") > 0, F.ceil(F.col("leaves") / F.pow(F.lit(float(FAN)), F.col("level")))).otherwise(F.col("leaves"))
    return nodes.filter(width == 1).select("tree", "digest")


def prove(nodes: DataFrame, wanted: DataFrame, above: DataFrame | None = None, full: bool = False) -> DataFrame:
    """Proofs of wanted, rows of level 0 of a manifest: tree, place, doc_id, digest, root (of the tree, as derived),
    proof_sha256 (the hash of all siblings, from the leaf up, left to right), folded (the root that follows from candidate
    and the siblings); full: the siblings before and after the path, level by level.

    above (tree, before, after), if given, are paths that go on from the roots of trees.
    """
    wanted = wanted.select("part", "tree", "leaves", "place", "digest", "known", "doc_id", "candidate")

    def needs(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, leaves), group in own.groupby(["tree", "leaves"], sort=False):
            out += [(key[0], tree, level, place) for level, place in missing(group["place"].to_numpy(dtype=np.int64), int(leaves))]
        return _frame(out, "part int, tree string, level int, place long")

    needed = wanted.select("part", "tree", "leaves", "place").groupBy("part").applyInPandas(needs, "part int, tree string, level int, place long")
    fetched = needed.join(nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"])
    none = F.array().cast("array<string>")
    sent = fetched.select("part", "tree", "level", "place", "digest", none.alias("before"), none.alias("after"))
    if above is not None:
        trees = wanted.select("part", "tree").distinct().join(above, "tree")
        sent = sent.unionByName(trees.select("part", "tree", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"), F.lit("").alias("digest"), "before", "after"))

    def expand(key: tuple, own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        nodes_of: dict[str, dict[tuple[int, int], str]] = {}
        going_on: dict[str, list[tuple[str, str]]] = {}
        for r in sent.itertuples(index=False):
            if r.level < 0:
                going_on[r.tree] = list(zip(r.before, r.after))
            else:
                nodes_of.setdefault(r.tree, {})[r.level, r.place] = r.digest
        out = []
        for (tree, leaves), group in own.groupby(["tree", "leaves"], sort=False):
            group = group.sort_values("place")
            derived = Derived(int(leaves), dict(zip(group["place"].tolist(), group["digest"].tolist())), nodes_of.get(tree, {}))
            more = going_on.get(tree, [])
            for r in group.itertuples(index=False):
                path = derived.path(int(r.place)) + more
                h = r.candidate
                for before, after in path:
                    h = joined([before, h, after])
                proof = joined([x for pair in path for x in pair])
                sides = ([b for b, _ in path], [a for _, a in path]) if full else (None, None)
                out.append((tree, r.place, r.known, r.doc_id, r.digest, derived.root, proof, h, *sides))
        return _frame(out, PROOFS)

    return wanted.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(expand, PROOFS)


def verified(documents: DataFrame, tampered: Column) -> DataFrame:
    """Each row of documents with its leaf, subroot, root, proof_sha256, folded_root and verified. tampered: a change to text
    for rows that someone tampered with (null for others); their roots are folded from the changed leaf."""
    values = {name: F.col(name) for name in FIELDS} | {"n_chars": F.col("n_chars").cast("long"), "doc_id": F.col("doc_id").cast("long")}
    leaf = leaf_of(values)
    candidate = F.when(tampered.isNotNull(), leaf_of(values | {"text": tampered})).otherwise(leaf)
    leaves = stored(documents.select(tree_of(F.col("lang")).alias("tree"), values["doc_id"].alias("doc_id"), leaf.alias("digest"), candidate.alias("candidate")), "leaves")
    nodes = manifest(leaves)
    # The subroots, in the order of their languages, are the leaves of one more tree.
    ranks = stored(ranked(roots(nodes)), "subroots")
    tops = manifest(ranks.select(F.lit("").alias("tree"), "doc_id", "digest", F.col("digest").alias("candidate")))
    shown = prove(tops, tops.filter("level = 0"), full=True).select("doc_id", F.col("root").alias("top"), "before", "after")
    known = stored(ranks.select("tree", "doc_id").join(shown, "doc_id").drop("doc_id"), "tops")
    proofs = prove(nodes, nodes.filter("level = 0"), known)
    out = proofs.join(known.select("tree", "top"), "tree")
    return out.select(
        F.when(F.col("known") == 1, F.col("doc_id")).alias("doc_id"), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), "proof_sha256",
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("top")).alias("verified"), "tree", "place",
    )


def ranked(subroots: DataFrame) -> DataFrame:
    """Subroots (tree, digest) with the rank of their language as doc_id: ranges are numbered, then shifted."""
    parts = int(subroots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(subroots.repartitionByRange(parts, "tree").withColumn("part", F.spark_partition_id()), "trees")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("tree")) + F.col("before")
    return rows.join(shift, "part").select("tree", number.cast("long").alias("doc_id"), "digest")
