"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in every document.

Windows are byte strings of words joined by single spaces. A table of block shifts skips positions where no window can
end, buckets by the last block select the windows to test, and direct comparison confirms. Windows are searched in
classes of like length, so that a short one doesn't shorten the shifts of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import PLAIN, byte_rows, carried, discard, merged, stored, texts, with_carried

#: Windows, each with one item, in one search (about; hashing deals them): bounds what the driver reads and sends at
#: once. Further windows are searched by further passes.
WINDOWS_AT_ONCE = 20_000
HITS = "doc_id long, th long, starts array<long>, ends array<long>, items array<long>"
FOUND = "doc_id long, text string, n_words long, starts array<long>, ends array<long>, items array<long>"


class WuManber:
    """Search for many byte strings at once; all must be at least two bytes long."""

    def __init__(self, strings: list[bytes]):
        self.m = m = min(map(len, strings))
        self.block = block = max(2, min(12, m // 3))
        self.default = m - block + 1
        self.shifts: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = {}
        for s in strings:
            for end in range(block, m + 1):
                part = s[end - block : end]
                if self.shifts.get(part, self.default) > m - end:
                    self.shifts[part] = m - end
            self.buckets.setdefault(s[m - block : m], []).append(s)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """All occurrences: (offset, string)."""
        at, n, block, m, default, shift = self.m, len(text), self.block, self.m, self.default, self.shifts.get
        while at <= n:
            step = shift(text[at - block : at], default)
            if step:
                at += step
                continue
            for s in self.buckets[text[at - block : at]]:
                if text.startswith(s, at - m):
                    yield at - m, s
            at += 1


def searches(strings: list[bytes]) -> list[WuManber]:
    classes: dict[int, list[bytes]] = {}
    for s in strings:
        classes.setdefault(min(len(s).bit_length(), 6), []).append(s)
    return [WuManber(c) for c in classes.values()]


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, n, item): the distinct windows of every item, as bytes, with their number of words. Rows without an id or
    without a word are no items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for item, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
                words = text.translate(PLAIN).split()
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[at : at + width]
                    rows.add((b" " + b" ".join(part) + b" ", len(part), item))
            columns = zip(zip(*rows) if rows else [()] * 3, (pa.binary(), pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["window", "n", "item"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("item_id is not null and text is not null")
    return rows.mapInArrow(cut, "window binary, n long, item long").distinct()


def search(windows: dict[bytes, tuple[list[int], int]]):
    """A function from a text to its number of words, and spans and items of the windows that occur."""
    finders = searches(list(windows)) if windows else []

    def find(text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        words = text.translate(PLAIN).split()
        line = b" " + b" ".join(words) + b" "
        spans, items, last, word = [], set(), 0, 0
        for at, s in sorted((x for f in finders for x in f.find(line)), key=lambda x: x[0]):
            word += line.count(b" ", last, at)
            last = at
            of, n = windows[s]
            spans.append((word, word + n))
            items.update(of)
        return len(words), spans, items

    return find


def block_of(rows: DataFrame) -> dict[bytes, tuple[list[int], int]]:
    """window -> (its items, its words), on the driver."""
    block: dict[bytes, tuple[list[int], int]] = {}
    for window, n, item in rows.collect():
        block.setdefault(bytes(window), ([], n))[0].append(item)
    return block


def find_windows(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Each document with its number of words, spans of words inside occurring windows, and the items they belong to.

    Null texts have no words; null ids and repeated rows stay as they are; an empty benchmark finds nothing. Other
    columns of documents come in the struct column carried.
    """
    windows = stored(item_windows(benchmark, width), "windows")
    blocks = max(1, -(-windows.count() // WINDOWS_AT_ONCE))
    many = pa.list_(pa.int64())

    def lists(found: list[tuple[np.ndarray, np.ndarray, list[int]]]) -> list[pa.Array]:
        return [pa.array(list(x), many) for x in (zip(*found) if found else [()] * 3)]

    def as_lists(spans, items) -> tuple[np.ndarray, np.ndarray, list[int]]:
        at = np.array(spans, dtype=np.int64).reshape(-1, 2)
        return *merged(at[:, 0], at[:, 1]), sorted(items)

    docs = texts(documents, *carried(documents))
    if blocks == 1:
        block = block_of(windows)
        discard(windows)

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = search(block)
            for batch in batches:
                n_words, found = [], []
                for text in byte_rows(batch.column(1)):
                    n, spans, items = find(text)
                    n_words.append(n)
                    found.append(as_lists(spans, items))
                columns = [*batch.columns[:2], pa.array(n_words, pa.int64()), *lists(found), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=[*FOUND_NAMES, *batch.schema.names[2:]])

        docs = docs.drop("th")
        return docs.mapInArrow(once, with_carried(FOUND, docs))

    none = F.lit(-(2**63) + 1)
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", none))
    hits = []
    for number in range(blocks):
        block = block_of(windows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == number))

        def one_of_many(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            find = search(block)
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(byte_rows(batch.column(2))):
                    _, spans, items = find(text)
                    if spans:
                        rows.append(i)
                        found.append(as_lists(spans, items))
                ids = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*ids, *lists(found)], names=[x.split()[0] for x in HITS.split(", ")])

        hits.append(stored(docs.select("doc_id", "th", "text").mapInArrow(one_of_many, HITS), "hits"))
    discard(windows)
    all_hits = hits[0]
    for more in hits[1:]:
        all_hits = all_hits.union(more)
    parts = [F.flatten(F.collect_set(x)).alias(x) for x in ("items",)]
    spans = F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("spans")
    all_hits = stored(all_hits.groupBy("doc_id", "th").agg(spans, *parts), "all_hits")
    discard(*hits)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [len(text.translate(PLAIN).split()) for text in byte_rows(batch.column(1))]
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            found = [as_lists([(x["starts"], x["ends"]) for x in spans or []], set(items or [])) for spans, items in rows]
            columns = [*batch.columns[:2], pa.array(n_words, pa.int64()), *lists(found), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, names=[*FOUND_NAMES, *batch.schema.names[4:]])

    out = docs.join(all_hits, ["doc_id", "th"], "left").withColumn("doc_id", F.nullif("doc_id", none))
    out = out.select("doc_id", "text", "spans", "items", *(x for x in docs.columns if x == "carried"))
    return out.mapInArrow(together, with_carried(FOUND, docs))


FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
