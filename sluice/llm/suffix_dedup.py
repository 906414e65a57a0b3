"""Removal of repeated byte strings by suffix sorting.

Only suffixes that can matter are sorted. A string of `width` bytes holds a gram of GRAM bytes whose hash is smallest
among its width - GRAM + 1 grams; equal strings hold the same ones, so the places of grams found more than once are
dealt by gram into buckets, which is the first pass of a bucket sort. Places with the same context (all that strings
around the gram can hold) are one place with a count. In each bucket the suffixes that start behind the gram, and the
reversed ones before it, are put in order by deep-shallow sorting: multikey quicksort down to SHALLOW bytes, then a
blind trie for each group that is still equal. Common prefixes of neighbours then tell which strings meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Rolling, byte_rows, local_minima, merged, mix, stored, texts
from sluice.llm.substring_dedup import PRINTS, arrays, contexts

GRAM = 32
#: Depth of the multikey quicksort.
SHALLOW = 8
#: Distinct contexts of one gram that are sorted together. Grams with more are a few very common passages with many
#: different surroundings; their strings are dealt out one by one.
BUCKET = 65_536
#: Cells (distance, context) that are handled together.
CELLS = 1 << 20
SPANS = "doc_id long, th long, s int, e int"
SHOWN = "w long, v long, doc_id long, th long, pos int"
KEPT = "doc_id long, n_bytes long, removed array<long>, kept_bytes binary"


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a and b agree on low bytes and differ within n
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


class BlindTrie:
    """Patricia trie that stores branching depths and bytes only; a string is placed by one descent to some leaf, one
    comparison there, and a second descent to the depth where it differs."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list | int = first  # a node is [depth, {byte: child}], a leaf a string's number; -1: end of string

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, number: int) -> None:
        s, node = self.strings[number], self.root
        while not isinstance(node, int):
            children = node[1]
            node = children.get(self._byte(s, node[0]))
            if node is None:
                node = next(iter(children.values()))
        other = self.strings[node]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            depth += 1  # equal strings part behind their end, in order of arrival
        parent, key, node = None, None, self.root
        while not isinstance(node, int) and node[0] < depth:
            parent, key = node, self._byte(s, node[0])
            node = node[1].get(key)
            if node is None:
                parent[1][key] = number
                return
        if not isinstance(node, int) and node[0] == depth:
            node[1][self._byte(s, depth) if depth <= len(s) else -1 - len(node[1])] = number
            return
        at = self._byte(other, depth) if depth <= len(other) else -1
        new = [depth, {at: node, (self._byte(s, depth) if depth <= len(s) else -2): number}]
        if parent is None:
            self.root = new
        else:
            parent[1][key] = new

    def in_order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        return out


def deep_shallow(strings: list[bytes], depth: int = 0) -> list[int]:
    """The strings' numbers in sorted order."""

    def quick(group: list[int], at: int) -> list[int]:
        if len(group) < 2:
            return group
        if at >= SHALLOW:
            trie = BlindTrie(strings, group[0])
            for number in group[1:]:
                trie.insert(number)
            return trie.in_order()
        key = BlindTrie._byte
        pivot = sorted(key(strings[group[i]], at) for i in (0, len(group) // 2, -1))[1]
        less, same, more = [], [], []
        for g in group:
            k = key(strings[g], at)
            (less if k < pivot else more if k > pivot else same).append(g)
        return quick(less, at) + (same if pivot < 0 else quick(same, at + 1)) + quick(more, at)

    return quick(list(range(len(strings))), depth)


def depths(strings: list[bytes], most: int) -> np.ndarray:
    """[d, i]: the group of string i among strings that agree on their first d bytes, for d = 0..most; below 0 if the
    string is shorter than d."""
    order = deep_shallow(strings)
    near = np.array([0] + [common_prefix(strings[i], strings[j]) for i, j in zip(order, order[1:])], dtype=np.int32)
    out = np.empty((most + 1, len(strings)), dtype=np.int32)
    lengths = np.array([len(s) for s in strings], dtype=np.int32)
    step = max(1, CELLS // len(strings))
    for low in range(0, most + 1, step):  # some distances at a time, so that memory stays small
        d = np.arange(low, min(low + step, most + 1), dtype=np.int32)[:, None]
        out[d, order] = np.cumsum(near < d, axis=1, dtype=np.int32)
        out[low : low + len(d)][lengths < d] = -1
    return out


def repeated_reach(left: list[bytes], right: list[bytes], most: int) -> list[tuple[int, int] | None]:
    """For each context (reversed bytes before its gram, bytes behind it): the fewest and the most bytes before the gram
    at which a string starts that another context holds too; None if there is none. A string has l bytes before the
    gram and most - l behind it, so all strings of a context overlap at the gram and cover one span."""
    n = len(left)
    if n == 2:
        a, b = common_prefix(left[0], left[1]), common_prefix(right[0], right[1])
        return [(max(0, most - b), a) if a + b >= most else None] * 2
    l, r = depths(left, most), depths(right, most)[::-1]
    found = np.zeros((most + 1, n), dtype=bool)
    alone = -1 - np.arange(n, dtype=np.int64)  # ids of places where a string ends too early
    step = max(1, CELLS // n)
    for low in range(0, most + 1, step):
        x, y = l[low : low + step], r[low : low + step]
        ids = np.where((x >= 0) & (y >= 0), x.astype(np.int64) * n + y, alone)
        order = np.argsort(ids, axis=1)
        ids = np.take_along_axis(ids, order, axis=1)
        same = ids[:, 1:] == ids[:, :-1]
        twice = np.zeros(ids.shape, dtype=bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        np.put_along_axis(found[low : low + step], order, twice, axis=1)
    fewest, longest = found.argmax(axis=0).tolist(), (most - found[::-1].argmax(axis=0)).tolist()
    return [span if some else None for some, *span in zip(found.any(axis=0).tolist(), fewest, longest)]


def hashes(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, dtype=np.uint8)]


BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def grams(docs: DataFrame, width: int) -> DataFrame:
    """The smallest grams h of all texts of at least `width` bytes, with the hash c of their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            out, held, doc_ids, ths = [], 0, batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(byte_rows(batch.column(2))):
                if len(text) < width:
                    continue
                b = hashes(text)
                g = rolling.load(b).windows(GRAM)
                at = local_minima(g, width - GRAM + 1)
                n = len(at)
                out.append((g[at], contexts(rolling, b, at, width - GRAM, GRAM), np.full(n, doc_ids[i]), np.full(n, ths[i]), at))
                held += n
                if held > 500_000:
                    yield arrays(out, PRINTS)
                    out, held = [], 0
            yield arrays(out, PRINTS)

    return docs.mapInArrow(run, PRINTS)


def remove_repeated_bytes(documents: DataFrame, width: int = 200) -> DataFrame:
    """Remove every byte covered by a string of `width` bytes that also starts anywhere else, in its own text or another.

    Returns doc_id, n_bytes, removed (spans of bytes, flat: start, end, start, ...) and kept_bytes. A null text is
    empty; a repeated row is a second text; rows without doc_id count as texts like any other.
    """
    none = F.lit(-(2**63) + 1)
    docs = texts(documents).withColumn("doc_id", F.coalesce("doc_id", none))
    twice = grams(docs, width).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    places = stored(grams(docs, width).join(stored(twice, "twice"), "h", "left_semi"), "places")
    alike = places.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
    alike = stored(alike.select("h", "c", "n", "first.*"), "alike")
    whole = places.join(alike.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    several = stored(alike.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    check = alike.join(several, "h").select("doc_id", "th", "h", "n", "m", "pos")
    reach = width - GRAM
    todo = stored(
        whole.select("doc_id", "th", "pos", F.lit(None).cast("struct<h:long,n:long,m:long,pos:int>").alias("place"))
        .union(check.select("doc_id", "th", F.lit(None).cast("int"), F.struct("h", "n", "m", "pos")))
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("whole"), F.collect_list("place").alias("check")),
        "todo",
    )

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, ths, checks = (batch.column(i).to_pylist() for i in (0, 1, 3))
            rows: list[tuple] = []
            for i, text in enumerate(byte_rows(batch.column(2))):
                for p in checks[i]:
                    at = p["pos"]
                    before, after = text[max(0, at - reach) : at][::-1], text[at + GRAM : at + GRAM + reach]
                    rows.append((p["h"], p["m"], p["n"], doc_ids[i], ths[i], at, before, after))
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * 2
            columns = list(zip(*rows)) or [()] * 8
            names = ["h", "m", "n", "doc_id", "th", "pos", "before", "after"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "h long, m long, n long, doc_id long, th long, pos int, before binary, after binary"
    marked = docs.join(todo, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "check")
    shown = stored(marked.filter("size(check) > 0").mapInArrow(show, schema), "shown")

    def bucket(rows: list[tuple]) -> Iterator[tuple]:
        spans = repeated_reach([r[5] for r in rows], [r[6] for r in rows], reach)
        for (_, n, doc_id, th, pos, _, _), span in zip(rows, spans):
            if n == 1 and span:
                yield doc_id, th, pos - span[1], pos - span[0] + width

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            names = ["doc_id", "th", "s", "e"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        held: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(x).to_pylist() for x in ("h", "n", "doc_id", "th", "pos", "before", "after")]
            for row in zip(*columns):
                if held and held[0][0] != row[0]:
                    found.extend(bucket(held))
                    held = []
                held.append(row)
            yield out(found)
        if held:
            yield out(list(bucket(held)))

    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shown.filter(F.col("m") <= BUCKET).repartition(shards, "h").sortWithinPartitions("h")
    spans = dealt.mapInArrow(order, SPANS)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(5), Rolling(6)
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("doc_id", "th", "pos", "before", "after", "h")]
            for at in range(0, batch.num_rows, 2000):
                out = []
                for doc_id, th, pos, before, after, h in zip(*(c[at : at + 2000] for c in columns)):
                    s = before[::-1] + bytes(GRAM) + after  # the gram is the same for all of h
                    if len(s) >= width:
                        b = hashes(s)
                        w, v = one.load(b).windows(width), two.load(b).windows(width)
                        n = len(w)
                        offset = np.arange(n)
                        w = mix(w ^ np.uint64(h & 0xFFFFFFFFFFFFFFFF) ^ (np.uint64(len(before)) - offset.astype(np.uint64)))
                        out.append((w, v, np.full(n, doc_id), np.full(n, th), pos - len(before) + offset))
                yield arrays(out, SHOWN)

    single = stored(shown.filter(F.col("m") > BUCKET).mapInArrow(one_by_one, SHOWN), "single")
    met = single.groupBy("w", "v").agg(F.count("*").alias("k")).filter("k > 1").select("w", "v")
    found = single.join(met, ["w", "v"], "left_semi").select("doc_id", "th", F.col("pos").alias("s"), (F.col("pos") + width).alias("e"))
    spans = spans.union(found).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = stored(todo.select("doc_id", "th", "whole").join(spans, ["doc_id", "th"], "left"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, kept = [], [], []
            whole, more = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, text in enumerate(byte_rows(batch.column(1))):
                n, at = len(text), np.asarray(whole[i] or [], dtype=np.int64)
                s, e = np.maximum(at - reach, 0), np.minimum(at + width, n)
                if more[i]:
                    s = np.concatenate((s, [x["s"] for x in more[i]]))
                    e = np.concatenate((e, [x["e"] for x in more[i]]))
                s, e = merged(s.astype(np.int64), e.astype(np.int64))
                n_bytes.append(n)
                removed.append(np.stack((s, e), axis=1).reshape(-1))
                edges = [0, *removed[-1].tolist(), n]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "removed", "kept_bytes"])

    out = docs.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "whole", "spans").mapInArrow(cut, KEPT)
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {-(2**63) + 1})"))
