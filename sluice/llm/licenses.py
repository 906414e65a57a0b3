"""Licence detection: ordered signature rules behind a keyword prefilter.

One automaton over all keywords decides which rules are tried on a text. Where detections overlap, an interval that
lies within a kept one of higher priority is suppressed; so is a later one of the same interval.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import PLAIN, byte_rows
from sluice.llm.license_rules import BASE, rules

DETECTED = "doc_id long, n_words long, base array<struct<label:string,word:long>>, found array<struct<label:string,score:double,first_word:long,n_words:long>>"


class Scanner:
    """All rules, compiled, with the automaton of their keywords."""

    def __init__(self, base: dict[str, str], ordered: list[tuple[str, float, str, str]]):
        import ahocorasick

        self.base = [(f" {phrase} ", label) for phrase, label in base.items()]
        self.rules = [(label, score, re.compile(f"(?<= ){pattern}(?= )")) for label, score, _, pattern in ordered]
        gates: dict[str, list[int]] = {}
        for i, (_, _, keyword, _) in enumerate(ordered):
            gates.setdefault(keyword, []).append(i)
        for phrase, _ in self.base:
            gates.setdefault(phrase.strip(), [])
        self.automaton = ahocorasick.Automaton()
        for keyword, of in gates.items():
            self.automaton.add_word(keyword, (keyword, of))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words; base places (label, word); kept detections (label, score, first word, words)."""
        words = text.translate(PLAIN).split()
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogateescape")
        met = dict(value for _, value in self.automaton.iter(line))
        if not met:
            return len(words), [], []
        places = []
        for phrase, label in self.base:
            places.extend((label, word) for _, word in _words_before(line, _all(line, phrase)))
        kept: list[tuple[int, int, str, float]] = []
        for rule in sorted({r for of in met.values() for r in of}):
            label, score, pattern = self.rules[rule]
            new = [m.span() for m in pattern.finditer(line)]
            if new and kept:
                kept.sort()
                starts, ends = [k[0] for k in kept], list(accumulate((k[1] for k in kept), max))
                new = [(s, e) for s, e in new if not (at := bisect_right(starts, s)) or ends[at - 1] < e]
            kept.extend((s, e, label, score) for s, e in new)
        kept.sort()
        words_before = _words_before(line, [k[0] for k in kept])
        found = [(label, score, n - 1, line.count(" ", s, e) + 1) for (s, e, label, score), (_, n) in zip(kept, words_before)]
        return len(words), places, found


def _all(line: str, phrase: str) -> Iterator[int]:
    at = line.find(phrase)
    while at >= 0:
        yield at
        at = line.find(phrase, at + 1)


def _words_before(line: str, places) -> Iterator[tuple[int, int]]:
    """(place, spaces before it) for rising places."""
    last = n = 0
    for at in places:
        n += line.count(" ", last, at)
        last = at
        yield at, n


def detect(documents: DataFrame, base: dict[str, str] | None = None, ordered: list[tuple[str, float, str, str]] | None = None) -> DataFrame:
    """Every document with its number of words, the places of base phrases, and the detections that were kept.

    A null text is empty and has none; null and repeated ids stay as they are.
    """
    base, ordered = BASE if base is None else base, rules() if ordered is None else ordered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, ordered)
        one = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        many = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        for batch in batches:
            rows = [scanner.scan(text or b"") for text in byte_rows(batch.column(1))]
            n = pa.array([r[0] for r in rows], pa.int64())
            places = pa.array([[dict(zip(("label", "word"), p)) for p in r[1]] for r in rows], one)
            found = pa.array([[dict(zip(("label", "score", "first_word", "n_words"), p)) for p in r[2]] for r in rows], many)
            yield pa.RecordBatch.from_arrays([batch.column(0), n, places, found], names=["doc_id", "n_words", "base", "found"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, DETECTED)
