"""Runs of periodic words, by a grammar of the words.

A run is a longest stretch of words with smallest period q (words q apart are equal) of at least LEAST and TIMES * q words.
Re-Pair turns the words into rules of two symbols; the runs over the middle of a rule are computed once, on the rule's
first expansion, and count at every place where the rule is derived. The smallest node of the derivation that holds a run
has it over its middle, so that every run is found whole; pieces that other nodes show of it are merged into it.

Every document is a task of its own, in Arrow batches: nothing is shuffled, a few texts are in memory at once. Time is in
proportion to the words of a text (times a logarithm), whatever repeats in it.

Defined results: a null or empty text has no words and no runs; repeated rows and null ids are treated as any row; an empty
table gives an empty result; other columns, whatever their names, come back in `carried`.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import byte_rows, carried, merged, with_carried

LEAST, TIMES = 24, 3
#: In a run every window of this many words occurs again one period away, since LEAST >= 2 * q + GRAM up to q = GRAM and
#: TIMES * q >= 2 * q + GRAM from there on.
GRAM = LEAST // TIMES
ROWS_AT_ONCE = 256
Run = tuple[int, int, int]  # start, end, period


def gram_names(ids: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Numbers of the windows of `width` (a power of two) elements: equal windows have equal numbers, by doubling."""
    names, w = ids.astype(np.int64), 1
    while w < width:
        if len(names) <= w:
            return np.empty(0, dtype=np.int64)
        names = np.unique(names[:-w] * (names.max() + 1) + names[w:], return_inverse=True)[1].astype(np.int64)
        w *= 2
    return names


def repair(ids: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Re-Pair: the most frequent pair of neighbours becomes a new symbol until no pair occurs twice. Returns the pair of
    each new symbol (numbered on from the largest id), and the symbols that are left.

    Places of a pair are listed when the pair comes up and looked at again when it is replaced: those that are gone by then,
    or overlap the one before, don't count.
    """
    n, base = len(ids), max(ids, default=-1) + 1
    sym, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        places.setdefault((sym[i], sym[i + 1]), []).append(i)
    queue = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapify(queue)
    rules: list[tuple[int, int]] = []
    while queue:
        claimed, pair = heappop(queue)
        there = [i for i in places.pop(pair, ()) if sym[i] == pair[0] and right[i] < n and sym[right[i]] == pair[1]]
        live, used = [], -1
        for i in there:
            if i != used:
                live.append(i)
                used = right[i]
        if len(live) < 2:
            continue
        if len(live) < -claimed:
            places[pair] = there
            heappush(queue, (-len(live), pair))
            continue
        x = base + len(rules)
        rules.append(pair)
        new: dict[tuple[int, int], list[int]] = {}
        for i in live:
            j = right[i]
            sym[i], sym[j], right[i] = x, -1, right[j]
            if (k := right[i]) < n:
                left[k] = i
                new.setdefault((x, sym[k]), []).append(i)
            if (h := left[i]) >= 0:
                new.setdefault((sym[h], x), []).append(h)
        for touched, at in new.items():
            if len(at) > 1:
                places[touched] = at
                heappush(queue, (-len(at), touched))
    rest, i = [], 0
    while i < n:
        rest.append(sym[i])
        i = right[i]
    return rules, rest


def folded(rules: list[tuple[int, int]], rest: list[int], base: int) -> list[tuple[int, int]]:
    """The rules with further ones that pair up what is left, so that the last rule derives everything."""
    rules = list(rules)
    while len(rest) > 1:
        odd = rest[len(rest) & ~1 :]
        start = base + len(rules)
        rules += zip(rest[::2], rest[1::2])
        rest = [*range(start, base + len(rules)), *odd]
    return rules


def stretch(t: np.ndarray, at: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest span in [low, high) of t around GRAM words at `at`, equal to those q further, that keeps period q."""
    e, step = at + GRAM, 32
    while (stop := min(e + step, high - q)) > e:
        same = t[e:stop] == t[e + q : stop + q]
        k = int(same.argmin())
        if not same[k]:
            e += k
            break
        e, step = stop, step * 8
    s, step = at, 32
    while (start := max(s - step, low)) < s:
        same = (t[start:s] == t[start + q : s + q])[::-1]
        k = int(same.argmin())
        if not same[k]:
            s -= k
            break
        s, step = start, step * 8
    return s, e + q


def crossing(t: np.ndarray, names: np.ndarray, where: np.ndarray, first: np.ndarray, low: int, middle: int, high: int) -> set[Run]:
    """The runs of t[low:high] that hold the words at middle - 1 and middle. where, first: places of each window name.

    The window before the middle or the one behind it lies in the run, and so does an equal one a period away.
    """
    found: set[Run] = set()
    for g in (middle - GRAM, middle):
        if g < low or g + GRAM > high:
            continue
        own = where[first[names[g]] : first[names[g] + 1]]
        most = (high - low) // TIMES
        own = own[np.searchsorted(own, max(low, g - most)) : np.searchsorted(own, min(high - GRAM, g + most), "right")]
        apart = np.abs(own - g)
        order = np.argsort(apart, kind="stable")
        for c, q in zip(own[order].tolist(), apart[order].tolist()):
            a = min(c, g)
            # A multiple of a period that goes on for as long shows the same run again.
            if not q or any(q % p == 0 and q <= e - s - p and s <= a and a + q + GRAM <= e for s, e, p in found):
                continue
            s, e = stretch(t, a, q, low, high)
            if e - s >= max(LEAST, TIMES * q) and s < middle < e:
                found.add((s, e, q))
    return {(s, e, q) for s, e, q in found if not any(p < q and q % p == 0 and a <= s and e <= b for a, b, p in found)}


def merged_runs(runs: list[Run]) -> list[Run]:
    """Pieces with one period that share a period's length or more are one run; by start, then period."""
    out: list[list[int]] = []
    for q, s, e in sorted((q, s, e) for s, e, q in runs):
        if out and out[-1][2] == q and s + q <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, q])
    return sorted(((s, e, q) for s, e, q in out), key=lambda r: (r[0], r[2]))


def runs_of(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers. A run lies within a stretch of windows that occur more than once, so the
    grammar is made of each such stretch."""
    names = gram_names(ids)
    if not len(names):
        return []
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    found: list[Run] = []
    starts, ends = merged(again, again + GRAM)
    keep = ends - starts >= LEAST
    if not keep.any():
        return []
    where = np.argsort(names, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(names))))
    for low, high in zip(starts[keep].tolist(), ends[keep].tolist()):
        symbols = np.unique(ids[low:high], return_inverse=True)[1].tolist()
        base = max(symbols) + 1
        rules = folded(*repair(symbols), base)
        length = [1] * base
        for a, b in rules:
            length.append(length[a] + length[b])
        derived: list[list[int]] = [[] for _ in length]
        derived[-1].append(low)
        for x in range(len(length) - 1, base - 1, -1):  # a rule stands behind those of its parts
            if length[x] < LEAST or not derived[x]:
                continue
            a, b = rules[x - base]
            derived[a] += derived[x]
            derived[b] += [p + length[a] for p in derived[x]]
            p = derived[x][0]
            for s, e, q in crossing(ids, names, where, first, p, p + length[a], p + length[x]):
                found += [(o + s - p, o + e - p, q) for o in derived[x]]
    return merged_runs(found)


def collapse_runs(documents: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), kept_text (words joined by one space,
    each run reduced to its first period) and the other columns in `carried`. Words are what white space of ASCII divides.
    change(doc_id, words), if given, makes the words that are looked at."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried(documents))
    schema = with_carried("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text binary", rows)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def look(doc_id: int | None, text: bytes) -> tuple[int, list[dict], bytes]:
        words = text.split()
        if change is not None:
            words = change(doc_id, words)
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        runs = runs_of(ids)
        if runs:
            gone = np.zeros(len(words), dtype=bool)
            for s, e, q in runs:
                gone[s + q : e] = True
            kept = b" ".join(words[i] for i in np.flatnonzero(~gone).tolist())
        else:
            kept = b" ".join(words)
        return len(words), [{"start": s, "length": e - s, "period": q} for s, e, q in runs], kept

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = part.column("doc_id")
                seen = [look(i, t) for i, t in zip(ids.to_pylist(), byte_rows(part.column("text")))]
                columns = [ids, pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1] for x in seen], pa.list_(run_type)), pa.array([x[2] for x in seen], pa.binary())]
                names = ["doc_id", "n_words", "runs", "kept_text"]
                if "carried" in part.schema.names:
                    columns.append(part.column("carried"))
                    names.append("carried")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
