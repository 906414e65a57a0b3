"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of hashes of its word shingles, sketched by minwise tokens: BRANCHING whole ones to branch by, and
one byte of each of COMPARED ones to compare by, which leaves little doubt. Each of TREES independent
trees branches the documents: a node chooses a few sketch positions, a document goes to the child that its token at a
chosen position names, so that similar documents meet again and again. Nodes of few documents are compared
exhaustively, on sketches first; so are nodes that stay large, after the last level or as further choices do not part
them: in cells, each a block of the node against itself or another one, so that all pairs of the node are compared. A
cell does not emit all its pairs: in a first pass it emits a spanning forest of its similar pairs, which is confirmed on
the full sets and closed to components; in a second pass the documents that are similar to one of another component
bring their full sets to the cell, which compares every two of them that no link joins yet. So a pair is left out only
where confirmed links join its ends already. Documents of equal sets are one document from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import LOWER, Rolling, WordHashes, byte_rows, discard, mix, stored, texts
from sluice.llm.substring_dedup import arrays, key_bits, with_meets

#: Minwise tokens that a node can choose among.
BRANCHING = 64
#: Minwise tokens of which a byte is compared: similarity s shows as s + (1 - s) / 256, with a deviation of 0.019 at 0.75.
COMPARED = 512
TREES = 12
#: Levels by pairs: each adds two choices.
ROUNDS = 4
#: A node of at most so many documents is not branched further.
SMALL = 128
#: Documents of a block (about; hashing deals them).
BLOCK = 1024
#: A node that keeps so much of its parent is not branched further. This and ROUNDS weigh rows of branches against
#: compared sketches: no pair is lost by stopping early.
STAYS = 0.75**2
#: Sketch similarity below the threshold at which a pair is still confirmed on full sets (over four deviations).
SLACK = 0.0875
SKETCHES = "doc_id long, th long, n_shingles long, f1 long, f2 long, sketch binary, prints binary"


def shingles(text: bytes, size: int, hashes: WordHashes, rolling: Rolling) -> np.ndarray:
    """Sorted distinct hashes of all shingles; a text of fewer words has one, a text without words none."""
    words = text.translate(LOWER).split()
    h = hashes.of(words)
    return np.unique(rolling.load(h).windows(min(size, len(words)))) if words else h


def sketch(s: np.ndarray) -> tuple[bytes, bytes]:
    """Minima of the set under COMPARED hash functions: the first BRANCHING whole, and a byte of each."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    seeds = (mix(np.arange(1, COMPARED + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None]
    lowest = np.full(COMPARED, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        y = x[None, at : at + 512] ^ seeds
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0xC2B2AE35)
        np.minimum(lowest, y.min(axis=1), out=lowest)
    # A minimum's high bits are mostly 0: the byte is one of a scrambled value.
    byte = (mix(lowest.astype(np.uint64)) >> np.uint64(32)).astype(np.uint8)
    return lowest[:BRANCHING].tobytes(), byte.tobytes()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, rolling = WordHashes(), Rolling()
        for batch in batches:
            n, f, out, compared = [], [], [], []
            for text in byte_rows(batch.column(2)):
                s = shingles(text, size, hashes, rolling)
                n.append(len(s))
                f.append(xxhash.xxh3_128_digest(s.tobytes()))
                whole, byte = sketch(s)
                out.append(whole)
                compared.append(byte)
            halves = np.frombuffer(b"".join(f), dtype=np.int64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64())]
            columns += [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(out, pa.binary()), pa.array(compared, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCHES.split(", ")])

    return docs.mapInArrow(run, SKETCHES)


def branch(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each row's node: (row, child). A node goes by one chosen position, every third node by two."""
    rows = np.arange(len(node))
    first = mix(node + np.uint64(11))
    second = mix(node + np.uint64(12))
    two = np.flatnonzero(second % np.uint64(3) == 0)
    row = np.concatenate((rows, two))
    chosen = np.concatenate((first, mix(second[two]))) % np.uint64(BRANCHING)
    child = mix(node[row] ^ mix((chosen << np.uint64(32)) + tokens[row, chosen.astype(np.int64)].astype(np.uint64)))
    return row, child


def descend(rows: DataFrame, trees: int = 0) -> DataFrame:
    """(node, rep, parent) two levels further down, parent being the size n of the node above; with trees, from the
    roots of so many trees."""
    schema = "node long, rep long, parent long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, BRANCHING)
            out = []
            for tree in range(trees or 1):
                node = np.full(len(rep), tree + 1, dtype=np.uint64) if trees else batch.column("node").to_numpy().view(np.uint64)
                at, node = branch(mix(node), tokens)
                again, node = branch(node, tokens[at])
                out.append((node, rep[at[again]], n[at[again]]))
            yield arrays(out, schema)

    return rows.mapInArrow(run, schema)


def spanning(same: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of the maximum spanning forest of a symmetric matrix, of those that are at least so large."""
    seen, best, via = np.zeros(len(same), dtype=bool), np.zeros(len(same), dtype=same.dtype), np.zeros(len(same), dtype=int)
    now, edges = 0, []
    for _ in range(len(same) - 1):
        seen[now] = True
        better = same[now] > best
        best[better], via[better] = same[now][better], now
        best[seen] = -1
        now = int(best.argmax())
        if best[now] >= least:
            edges.append((int(via[now]), now))
    return edges


def alike(tokens: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Equal tokens of every two rows; 0 for a row with itself and rows of one block (side, -1 for none), which meet in
    another cell."""
    n = len(tokens)
    same = np.zeros((n, n), dtype=np.int16)
    for i in range(n - 1):
        same[i, i + 1 :] = np.count_nonzero(tokens[i + 1 :] == tokens[i], axis=1)
    same = np.maximum(same, same.T)
    same[(side[:, None] == side) & (side >= 0)] = 0
    return same


def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by node, in batches that part no node."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        node = batch.column("node").to_numpy()
        last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held


def cells(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each node."""
    node = batch.column("node").to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
    return zip(edges[:-1].tolist(), np.diff(edges).tolist())


def prints_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("prints").to_pylist()), dtype=np.uint8).reshape(-1, COMPARED)


def by_node(nodes: DataFrame) -> DataFrame:
    shards = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(shards, "node").sortWithinPartitions("node")


def compare(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) to confirm first, a spanning forest of each cell. nodes: node, side, rep, prints."""
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_nodes(batches):
            tokens, found = prints_of(batch), []
            rep, side = batch.column("rep").to_numpy(), batch.column("side").to_numpy()
            for s, n in cells(batch):
                if n == 2:
                    if np.count_nonzero(tokens[s] == tokens[s + 1]) >= least * COMPARED and (side[s] != side[s + 1] or side[s] < 0):
                        found.append((s, s + 1))
                elif n > 2:
                    edges = spanning(alike(tokens[s : s + n], side[s : s + n]), max(1, least * COMPARED))
                    found.extend((s + x, s + y) for x, y in edges)
            x = rep[np.array(found, dtype=np.int64).reshape(-1, 2)]
            x = np.unique(np.sort(x, axis=1), axis=0)
            yield arrays([(x[:, 0], x[:, 1])], schema)

    return by_node(nodes).mapInArrow(run, schema).distinct()


def undecided(nodes: DataFrame, least: float) -> DataFrame:
    """(node, side, rep, label): the rows of each cell that are similar to one of another label there. nodes: those
    columns and prints."""
    names = ["node", "side", "rep", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_nodes(batches):
            label, side, hit = batch.column("label").to_numpy(), batch.column("side").to_numpy(), np.zeros(batch.num_rows, dtype=bool)
            tokens = prints_of(batch)
            for s, n in cells(batch):
                order = s + np.argsort(label[s : s + n], kind="stable")
                to = np.searchsorted(label[order], label[order], side="right")
                for i in range(int(np.searchsorted(label[order], label[order[-1]]))):
                    others = order[to[i] :]  # all rows of larger labels
                    near = np.count_nonzero(tokens[others] == tokens[order[i]], axis=1) >= least * COMPARED
                    near &= (side[others] != side[order[i]]) | (side[others] < 0)
                    hit[others[near]] = True
                    hit[order[i]] |= near.any()
            yield batch.select(names).filter(pa.array(hit))

    return by_node(nodes).mapInArrow(run, "node long, side int, rep long, label long")


def united(nodes: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that join all rows of a cell with 100 * intersection >= threshold * union on full sets and different
    labels. nodes: node, side, rep, label, s."""
    schema = "a long, b long"

    def join(label: np.ndarray, side: np.ndarray, sets: list[bytes]) -> Iterator[tuple[int, int]]:
        size = np.array([len(x) // 8 for x in sets])
        flat = np.unique(np.frombuffer(b"".join(sets), dtype=np.uint64), return_inverse=True)[1]
        part = np.split(flat, np.cumsum(size)[:-1])
        mark, top = np.zeros(int(flat.max()) + 1, dtype=np.int64), label.copy()
        for i in range(len(sets) - 1):
            js = i + 1 + np.flatnonzero((top[i + 1 :] != top[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0)))
            mark[part[i]] = 1
            for js in np.split(js, range(256, len(js), 256)):
                if len(js):
                    both = np.add.reduceat(mark[np.concatenate([part[j] for j in js])], np.cumsum(size[js]) - size[js])
                    for j in js[100 * both >= threshold * (size[i] + size[js] - both)].tolist():
                        if top[j] != top[i]:
                            top[top == top[j]] = top[i]
                            yield i, j
            mark[part[i]] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_nodes(batches):
            rep, label, side = (batch.column(x).to_numpy() for x in ("rep", "label", "side"))
            found = []
            for s, n in cells(batch):
                sets = batch.column("s").slice(s, n).to_pylist()
                found.extend((s + i, s + j) for i, j in join(label[s : s + n], side[s : s + n], sets))
            x = rep[np.array(found, dtype=np.int64).reshape(-1, 2)]
            yield arrays([(x[:, 0], x[:, 1])], schema)

    return by_node(nodes).mapInArrow(run, schema)


def meetings(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """(node, side, rep) for every small node, or cell of a large one, where some tree brings documents together: every
    two documents of a node share one cell in which their sides differ or are -1. reps: rep, sketch."""
    rows, found, tables = descend(reps.withColumn("n", F.lit(2**62)), trees), [], []
    for level in range(ROUNDS):
        rows = stored(rows, "nodes")
        tables.append(rows)
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("n"), F.max("parent").alias("m")).filter("n > 1"), "sizes")
        tables.append(sizes)
        large = F.col("n") > SMALL
        ends = F.lit(level == ROUNDS - 1) | (F.col("n") >= STAYS * F.col("m"))
        rows = rows.drop("parent")
        found.append(rows.join(sizes.filter(~large).select("node"), "node").select("node", F.lit(-1).alias("side"), "rep"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = rows.join(sizes.filter(large & ends), "node").withColumn("block", F.pmod(F.xxhash64("node", "rep"), blocks).cast("int"))
        dealt = dealt.select("node", "rep", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        cell = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
        side = F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block"))
        found.append(dealt.select(cell.alias("node"), side.alias("side"), "rep"))
        if sizes.filter(large & ~ends).isEmpty():
            break
        rows = rows.join(sizes.filter(large & ~ends), "node").select("node", "rep", "n").distinct()
        rows = descend(rows.join(reps, "rep").select("node", "rep", "n", "sketch"))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.union(more)
    nodes = stored(nodes.distinct(), "cells")
    discard(*tables)
    return nodes


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, s): the full sets as sorted hashes. docs: rep, text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling()
        for batch in batches:
            s = [shingles(text, size, hashes, rolling).tobytes() for text in byte_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], names=["rep", "s"])

    return docs.select("rep", "text").mapInArrow(sets, "rep long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs with 100 * intersection >= threshold * union on full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def links(reps: DataFrame, docs: DataFrame, size: int, threshold: int, *wide: DataFrame) -> DataFrame:
    """Confirmed links whose components are those of all links. reps: rep, th, sketch, prints; docs: doc_id, th, text; wide:
    tables behind reps, which go as soon as their sketches and prints are read."""
    hashes = stored(reps.select("rep", "th"), "hashes")
    least = threshold / 100 - SLACK
    cells = meetings(reps.select("rep", "sketch"))
    nodes = stored(cells.join(reps, "rep").select("node", "side", "rep", "prints"), "meetings")
    discard(cells, *wide)
    first = stored(compare(nodes, least), "pairs")
    # Who meets nobody so similar in the first pass does not in the second.
    named = hashes.join(first.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep").select("rep", "th")
    named = stored(named, "named")
    # Few texts are named: the others are not shuffled.
    bits = key_bits(named.select(F.col("rep").alias("doc_id"), "th"))
    wanted = with_meets(docs, bits).filter("meets").select(F.col("doc_id").alias("rep"), "th", "text")
    wanted = wanted.join(named, ["rep", "th"]).dropDuplicates(["rep", "th"])
    sets = stored(shingle_sets(wanted, size), "sets")
    discard(bits)
    met = stored(confirmed(first, sets, threshold), "met")
    closed = components(met)
    label = named.select("rep").distinct().join(closed.withColumnRenamed("node", "rep"), "rep", "left")
    label = stored(label.select("rep", F.coalesce("label", "rep").alias("label")), "label")
    again = nodes.join(label, "rep").select("node", "side", "rep", "label", "prints")
    open_rows = stored(undecided(again, least), "undecided")
    discard(nodes, hashes, first, named, closed, label)
    found = stored(met.union(united(open_rows.join(sets, "rep").select("node", "side", "rep", "label", "s"), threshold)), "found")
    discard(met, sets, open_rows)
    return found


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node with a link. Each round, nodes move to their smallest
    neighbour's smallest neighbour, and links shrink to those between the nodes that are left; the smallest node of a
    component never moves."""
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(edges.filter("a <> b").distinct(), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(labels.withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        up = stored(edges.groupBy("b").agg(F.min("a").alias("a")), "up")
        above = up.select(F.col("b").alias("a"), F.col("a").alias("top"))
        moves = stored(up.join(above, "a", "left").select(F.col("b").alias("label"), F.coalesce("top", "a").alias("to")), "moves")
        old, labels = labels, stored(labels.join(moves, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        x = moves.select(F.col("label").alias("a"), F.col("to").alias("x"))
        y = moves.select(F.col("label").alias("b"), F.col("to").alias("y"))
        left = edges.join(x, "a", "left").join(y, "b").select(F.coalesce("x", "a").alias("x"), "y").filter("x <> y")
        done, edges = edges, stored(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(up, moves, old, done)
    discard(edges)
    return labels


def near_duplicates(documents: DataFrame, size: int = 5, threshold: int = 75) -> DataFrame:
    """Per row of documents: doc_id, th, n_shingles, component_id (smallest doc_id reachable by links, its own
    included), kept (doc_id = component_id).

    A null or wordless text has no shingles and is linked with nothing. Rows without doc_id take no part: component_id
    is null and kept true. Rows that repeat a doc_id all stay, with one component.
    """
    docs = texts(documents)
    sketched = stored(sketches(docs, size), "sketches")
    classes = sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2")
    classes = stored(classes.agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("sketch").alias("sketch"), F.first("prints").alias("prints")), "classes")
    # What the end needs is narrow: sketches and prints don't stay until then.
    ids = stored(sketched.select("doc_id", "th", "n_shingles", "f1", "f2"), "ids")
    named = stored(classes.select("f1", "f2", F.col("r.doc_id").alias("rep")), "named")
    discard(sketched)
    reps = classes.select(F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th"), "sketch", "prints")
    joined = links(reps, docs, size, threshold, classes)
    labels = components(joined)
    rep = named.select("f1", "f2", F.col("rep").alias("node")).join(labels, "node", "left")
    rep = rep.select("f1", "f2", F.coalesce("label", "node").alias("component"))
    # A doc_id's rows of several texts belong together: their classes share the id.
    out = ids.filter("n_shingles > 0 and doc_id is not null").join(rep, ["f1", "f2"])
    out = out.select("doc_id", "th", "n_shingles", F.least("component", "doc_id").alias("component_id"))
    rest = ids.filter("n_shingles = 0 or doc_id is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stored(out.union(rest), "duplicates")
    discard(ids, named, joined, labels)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, size: int = 5, threshold: int = 75) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the one with the smallest doc_id. Of
    repeated rows one stays, too; rows without doc_id all stay."""
    kept = near_duplicates(documents, size, threshold).filter("kept and doc_id is not null").select("doc_id", "th").distinct()
    rows = texts(documents, F.struct("*").alias("carried")).select("doc_id", "th", "carried")
    named = rows.join(kept, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    return named.union(rows.filter("doc_id is null")).select("carried.*")
