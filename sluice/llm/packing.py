"""Packing of documents into sequences of fixed length: best-fit decreasing over a segment tree.

The tree's leaves are the remaining capacities 1..length; each inner node counts the open windows below it. The
tightest window that takes a piece is the first non-empty leaf at or right of the piece's length: O(log length).
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import LOWER, byte_rows, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Pieces that are packed together: bounds a task's memory; each block leaves a few windows open at most.
BLOCK = 25_000
#: ASCII marks but the apostrophe, and words of letters (a-z, and those of U+00C0 to U+00FF).
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Words that are looked up together.
GROUP = 600_000


class OpenWindows:
    """Segment tree over remaining capacities, with a stack of window ids at each leaf."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the open window with the least room >= need."""
        count, at = self.count, need + self.leaves
        while not count[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece (given in decreasing length), and the number of windows."""
    tree, windows, offsets, made = OpenWindows(capacity), [], [], 0
    for n in lengths:
        found = tree.take_tightest(n)
        if found is None:
            room, window = capacity, made
            made += 1
        else:
            room, window = found
        windows.append(window)
        offsets.append(capacity - room)
        if room > n:
            tree.add(room - n, window)
    return windows, offsets, made


def splits_words(config: dict) -> bool:
    """Whether a tokenizer, by its file, is one whose ids WordIds can put together from words: it lower-cases after
    nothing but NFC and white space, and its split keeps letters and marks apart and drops white space."""
    parts = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    steps = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers") or []]
    pattern = (parts[0].get("pattern") or {}).get("Regex", "")
    drops = parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    whole = [x.get("type") for x in parts[1:]] == ["ByteLevel"] and parts[1].get("use_regex") is False and parts[1].get("add_prefix_space") is False
    kept_apart = r"[\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern
    return steps == ["NFC", "Replace", "Lowercase"] and drops and whole and kept_apart and not config.get("post_processor")


class WordIds(dict):
    """word -> its token ids as little-endian bytes; words are what lies between ASCII white space.

    The tokenizer's own split never crosses white space, so a text's ids are its words' ids one after another; for a
    tokenizer that may split otherwise (see splits_words) whole texts are encoded instead. Words are kept in two
    generations of `remembered` each at most: when the young one is full it becomes the old one, and the words met
    again move back to the young one, so that rare words go and frequent ones stay.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.remembered, self.old = Tokenizer.from_file(path), remembered, {}
        with open(path, encoding="utf-8") as file:
            self.by_word = splits_words(json.load(file))

    def learn(self, words: set[bytes]) -> None:
        """Make sure that all these words are known."""
        new = words.difference(self)
        if len(self) + len(new) > self.remembered:
            self.old = dict(self)
            self.clear()
            new = words
        new = self._moved(new)
        # A word of letters with marks after it is split there by the tokenizer too.
        split = {w: n for w in new if 0 < (n := len(w.rstrip(MARKS))) < len(w) and LETTERS.fullmatch(w, 0, n)}
        parts = {w[:n] for w, n in split.items()} | {w[n:] for w, n in split.items()}
        whole = list(self._moved(new.difference(split).union(parts).difference(self)))
        coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in whole], add_special_tokens=False)
        for word, e in zip(whole, coded):
            ids = e.ids
            self[word] = struct.pack(f"<{len(ids)}I", *ids)
        for word, n in split.items():
            self[word] = self[word[:n]] + self[word[n:]]

    def _moved(self, words: set[bytes]) -> set[bytes]:
        """Take words of the old generation over; those that are left are in neither."""
        if not self.old:
            return words
        found = [w for w in words if w in self.old]
        self.update((w, self.old[w]) for w in found)
        return words.difference(found)

    def words(self, text: bytes) -> list[bytes]:
        """The tokenizer lower-cases; doing so for A-Z first leaves fewer words. Its special tokens keep their case."""
        if not self.by_word:
            return [text]
        return (text if b"<|" in text else text.translate(LOWER)).split()

    def ids(self, words: list[bytes]) -> bytes:
        if self.by_word:
            return b"".join(map(self.__getitem__, words))
        ids = self.tokenizer.encode(words[0].decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks that a worker process runs."""
    return WordIds(path)


def pieces(documents: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Every document's ids, an end id after them, cut into full windows and a rest: one row per piece.

    A null text counts as empty and gives one piece with the end id alone; a null doc_id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = word_ids(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            doc_ids, at = batch.column(0).to_pylist(), 0
            group: list[list[bytes]] = []

            def flush() -> None:
                nonlocal at, group
                if known.by_word:
                    known.learn({w for words in group for w in words})
                for words in group:
                    ids = known.ids(words) + last
                    n = len(ids) // 4
                    for s in range(0, n, length):
                        part = ids[4 * s : 4 * (s + length)]
                        rows.append((doc_ids[at], s, len(part) // 4, zlib.crc32(part), n))
                    at += 1
                group = []

            held = 0
            for text in byte_rows(batch.column(1)):
                group.append(known.words(text or b""))
                held += len(group[-1]) if known.by_word else GROUP
                if held >= GROUP:
                    flush()
                    held = 0
            flush()
            columns = list(zip(*rows)) or [()] * 5
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, PIECES)


def pack(cut: DataFrame, length: int = 4096, block: int = BLOCK) -> DataFrame:
    """Give each piece its sequence and offset. Pieces are dealt at random into shards of about `block` pieces, each
    shard is packed best-fit decreasing; sequence ids are the shard's number and a count, so they are the same each run.
    """
    shards = max(1, -(-cut.count() // block))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        base = TaskContext.get().partitionId() << 36
        windows, offsets, _ = best_fit_decreasing(table.column("length").to_pylist(), length)
        table = table.append_column("sequence_id", pa.array(np.array(windows, dtype=np.int64) + base))
        table = table.append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    dealt = cut.repartition(shards, F.xxhash64("doc_id", "start", "ids_crc32"))
    return dealt.mapInArrow(packed, PACKED)


def pack_documents(documents: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Tokenize, cut and pack all documents; an empty table gives no rows."""
    return pack(stored(pieces(documents, tokenizer_path, length, end_id), "pieces"), length)
