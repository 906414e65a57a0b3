"""Substring deduplication over a log-structured index of fingerprints.

A window is `width` consecutive words. Its fingerprints are the hashes of its k-word grams that are smallest among any
width - k + 1 in a row: every window holds one, and equal windows hold the same ones. RepeatIndex keeps those of all
batches so far as sorted, immutable runs. A new batch becomes a run, which is merge-joined with the older ones; runs
are compacted when there are too many. Fingerprints met twice lead to the places to look at: there, first whole contexts
(all windows around a fingerprint) are compared by hash, then single windows. What is found is a pair of spans, one in
the new batch and one in an earlier document; a span goes only if its words equal those of the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import (
    Rolling,
    WordHashes,
    byte_rows,
    carried,
    discard,
    local_minima,
    merged,
    shared_folder,
    stored,
    texts,
    with_carried,
)

#: Words in a fingerprinted gram.
GRAM = 8
PRINTS = "h long, c long, doc_id long, th long, pos int"
WINDOWS = "w long, v int, doc_id long, th long, pos int, new int"
#: Bits that say which documents a table speaks of: 8 MB, whatever the number of documents, in blocks of 4 KB.
BITS, BLOCK = 1 << 26, 1 << 15
#: Spans that one row takes at most.
TOGETHER = 256
SPAN = [("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("least_s", pa.int32())]
SPANS = "least_doc long, least_th long, spans array<struct<doc_id:long,th:long,s:int,e:int,least_s:int>>"
SAID = "doc_id long, th long, s int, e int, words binary"
KEPT = "doc_id long, text string, n_words long, removed array<long>, kept_text binary"


def contexts(rolling: Rolling, h: np.ndarray, at: np.ndarray, reach: int, length: int) -> np.ndarray:
    """Hash of all that windows around each gram at `at` can hold: reach elements before and after it; what lies
    beyond the text's ends counts as an element of its own."""
    edge = np.zeros(reach, dtype=np.uint64)
    return rolling.load(np.concatenate((edge, h, edge))).windows(2 * reach + length, at)


def _bit(docs: DataFrame) -> tuple[Column, Column]:
    """The block, and the place in it, of a row's (doc_id, th)."""
    at = F.pmod(F.xxhash64(docs["doc_id"], docs["th"]), F.lit(BITS))
    return F.floor(at / BLOCK).cast("int"), (at % BLOCK).cast("int")


def key_bits(keys: DataFrame) -> DataFrame:
    """(block, bits): a bit for each (doc_id, th) of keys, combined before the shuffle; at most BITS of them."""
    block, at = _bit(keys)
    rows = keys.select(block.alias("block"), at.alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    return stored(rows, "bits")


def with_meets(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """docs (doc_id, th, ...) with meets: false only where no key has the row's bit, so that its text needn't be shuffled.
    Bits that many keys share make more rows meet, never fewer."""
    block, at = _bit(docs)
    met = docs.join(F.broadcast(bits), block == F.col("block"), "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.select(*docs.columns, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)).alias("meets"))


class RepeatIndex:
    """What earlier batches hold, as runs, and the repeats of a new one in it.

    A run of fingerprints has (h, n): how many places of its batches hold fingerprint h, bucketed and sorted by h, so
    that two runs are merge-joined without a shuffle. A run of places has (h, c, doc_id, th, pos), with the hash c of
    the place's context. Texts of earlier batches are looked up only where fingerprints meet.
    """

    def __init__(self, spark: SparkSession, width: int = 50, max_runs: int = 2):
        self.spark, self.width, self.max_runs = spark, width, max_runs
        self.runs: list[str] = []
        self.places: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, batch: DataFrame, copy: bool = True) -> DataFrame:
        """ingest() a batch and return its repeats()."""
        return self.repeats(self.ingest(batch, copy), len(self.places) - 1)

    def ingest(self, batch: DataFrame, copy: bool = True) -> DataFrame:
        """Add a batch. Returns (h): its fingerprints that occur twice in it, or in an earlier batch too.

        Rows without doc_id are not indexed. copy: keep the batch's texts as a table; without it, the batch must stay
        readable as long as the index is used.
        """
        docs = texts(batch).filter("doc_id is not null")
        if not docs.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
            docs = stored(docs.dropDuplicates(["doc_id", "th"]), "texts")  # repeated rows are one document
        elif copy:
            docs = stored(docs, "texts")
        places = stored(fingerprints(docs, self.width), "places")
        self.places.append(places)
        self.texts.append(docs)
        return self._met(places)

    def repeats(self, met: DataFrame, since: int, last: bool = False) -> DataFrame:
        """(doc_id, th, s, e, words) for the batches from number `since` on, given what ingest() returned for them: spans of
        words covered by windows that also start in a document with a smaller doc_id, of these batches or earlier ones,
        and the words found there. Documents of earlier batches are not changed any more, so bring batches in the order of
        doc_id. last: no batch comes any more, so that runs and places go as soon as they are read."""
        seen = self.places[0].withColumn("new", F.lit(int(since <= 0)))
        for i, old in enumerate(self.places[1:], 1):
            seen = seen.union(old.withColumn("new", F.lit(int(since <= i))))
        # Places whose fingerprint occurs twice; of earlier batches only for fingerprints of these.
        once = stored(met.distinct(), "hits")  # a table, so that Spark can split the join where many places share an h
        close = stored(seen.join(once, "h", "left_semi"), "met")
        discard(once)
        if last:
            self._forget()
        return self._said(self._spans(close))

    def close(self) -> None:
        """Delete the runs, places and texts."""
        self._forget()
        discard(*(t for t in self.texts if hasattr(t, "stored_at")))
        self.texts = []

    def _forget(self) -> None:
        for run in self.runs:
            self._drop(run)
        discard(*self.places)
        self.runs, self.places = [], []

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/{name}"
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        return name

    def _met(self, places: DataFrame) -> DataFrame:
        """Fingerprints h of a batch that occur twice in it, or once and in an earlier batch; the batch becomes a run."""
        if len(self.runs) >= self.max_runs:
            self._compact()
        new = self._write(places.groupBy("h").agg(F.count("*").alias("n")))
        met = self.spark.table(new).filter("n > 1").select("h")
        for run in self.runs:
            met = met.union(self.spark.table(new).select("h").join(self.spark.table(run).select("h"), "h"))
        met = stored(met, "hits")
        self.runs.append(new)
        return met

    def _compact(self) -> None:
        """Merge all runs into one."""
        rows = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            rows = rows.union(self.spark.table(run))
        old, self.runs = self.runs, [self._write(rows.groupBy("h").agg(F.sum("n").alias("n")))]
        for run in old:
            self._drop(run)

    def _drop(self, run: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark).rstrip('/')}/{run}")
        self.spark.sql(f"drop table {run}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _all_texts(self) -> DataFrame:
        docs = self.texts[0]
        for more in self.texts[1:]:
            docs = docs.union(more)
        return docs

    def _spans(self, close: DataFrame) -> DataFrame:
        """(SPANS) of the new batch, each with an equal one of a smaller document, by hashes; by that document. close is
        deleted. The same context in a smaller document: all its windows. Of contexts that share only the fingerprint, all places in the
        smallest document of each show their windows, one by one."""
        width, reach = self.width, self.width - GRAM
        least = [F.col(f"least.{x}").alias(f"least_{x}") for x in ("doc_id", "th", "pos")]
        first = stored(close.groupBy("h", "c").agg(F.min(F.struct("doc_id", "th", "pos")).alias("least")).select("h", "c", *least), "first")
        several = first.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.lit(True).alias("several"))
        several = stored(several, "several")
        named = stored(first.join(several, "h", "left"), "named")
        placed = stored(close.join(named, ["h", "c"]), "placed")
        discard(close, first, several, named)
        whole = placed.filter("new = 1 and least_doc_id < doc_id").select("doc_id", "th", "pos", "least_doc_id", "least_th", "least_pos")
        check = placed.filter("several and least_doc_id = doc_id").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("check"), F.max("new").alias("new"))

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, one, two = WordHashes(), Rolling(5), Rolling(6)
            for batch in batches:
                out, (doc_ids, ths, _, _, new), checks = [], (x.to_numpy(zero_copy_only=False) for x in batch.columns), batch.column(3)
                for i, text in enumerate(byte_rows(batch.column(2))):
                    words = text.split()
                    at = np.sort(checks[i].values.to_numpy().astype(np.int64))
                    spans = merged(np.maximum(at - reach, 0), np.minimum(at, len(words) - width) + 1)
                    at = np.concatenate([np.arange(s, e) for s, e in zip(*spans)])
                    h, n = hashes.of(words), len(at)
                    w, v = one.load(h).windows(width, at), two.load(h).windows(width, at)
                    out.append((w, (v >> np.uint64(33)).astype(np.int64), np.full(n, doc_ids[i]), np.full(n, ths[i]), at, np.full(n, new[i])))
                yield arrays(out, WINDOWS)

        bits = key_bits(placed.filter("several and least_doc_id = doc_id").select("doc_id", "th"))
        docs = with_meets(self._all_texts(), bits).filter("meets").drop("meets")
        shown = stored(docs.join(check, ["doc_id", "th"]).mapInArrow(windows, WINDOWS), "windows")
        equal = shown.groupBy("w", "v").agg(F.min(F.struct("doc_id", "th", "pos")).alias("least"), F.max("doc_id").alias("most"))
        equal = stored(equal.filter("least.doc_id < most").select("w", "v", *least), "equal")
        single = shown.filter("new = 1").join(equal, ["w", "v"]).filter("least_doc_id < doc_id").select(*whole.columns)
        rows = whole.withColumn("whole", F.lit(True)).union(single.withColumn("whole", F.lit(False)))
        pairs = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("least_doc_id", "least_th", "pos", "least_pos", "whole")).alias("pairs"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Neighbours that lie equally far apart in both documents become one span."""
            for batch in batches:
                by_least: dict[tuple[int, int], list[dict]] = {}
                for doc_id, th, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    other, other_th, pos, least_pos, whole = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
                    apart = least_pos.astype(np.int64) - pos
                    s = np.where(whole, pos - reach, pos).astype(np.int64)
                    order = np.lexsort((s, apart, other_th, other))
                    s, e, apart, other, other_th = s[order], pos[order].astype(np.int64) + width, apart[order], other[order], other_th[order]
                    parts = np.flatnonzero((other[1:] != other[:-1]) | (other_th[1:] != other_th[:-1]) | (apart[1:] != apart[:-1])) + 1
                    for at, to in zip([0, *parts.tolist()], [*parts.tolist(), len(s)]):
                        here = by_least.setdefault((int(other[at]), int(other_th[at])), [])
                        for x, y in zip(*merged(s[at:to], e[at:to])):
                            here.append({"doc_id": doc_id, "th": th, "s": int(x), "e": int(y), "least_s": int(x + apart[at])})
                out = [(*key, spans[i : i + TOGETHER]) for key, spans in by_least.items() for i in range(0, len(spans), TOGETHER)]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct(SPAN))]
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["least_doc", "least_th", "spans"])

        spans = stored(pairs.mapInArrow(join, SPANS), "spans")
        discard(placed, shown, equal, bits)
        return spans

    def _said(self, spans: DataFrame) -> DataFrame:
        """(SAID) the spans, cut to their texts' ends, with the words of the other document's span."""

        def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, found in zip(byte_rows(batch.column(1), 16), batch.column(0)):
                    rows, words = [], text.split()
                    for x in found.as_py():
                        # A context may reach over its text's start, and over its end.
                        cut = max(0, -x["s"], -x["least_s"])
                        part = words[x["least_s"] + cut : x["least_s"] + x["e"] - x["s"]]
                        rows.append((x["doc_id"], x["th"], x["s"] + cut, x["s"] + cut + len(part), b" ".join(part)))
                    kinds = [kind for _, kind in SPAN[:4]] + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "th", "s", "e", "words"])

        bits = key_bits(spans.select(F.col("least_doc").alias("doc_id"), F.col("least_th").alias("th")))
        docs = with_meets(self._all_texts(), bits).filter("meets")
        docs = docs.select(F.col("doc_id").alias("least_doc"), F.col("th").alias("least_th"), "text")
        out = stored(spans.join(docs, ["least_doc", "least_th"]).select("spans", "text").mapInArrow(say, SAID), "said")
        discard(spans, bits)
        return out


def fingerprints(docs: DataFrame, width: int, gram: int = GRAM) -> DataFrame:
    """Fingerprints h of all documents with an id and at least `width` words, with the hash c of their context."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling()
        for batch in batches:
            out, doc_ids, ths = [], batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(byte_rows(batch.column(2))):
                words = text.split()
                if len(words) < width:
                    continue
                w = hashes.of(words)
                g = rolling.load(w).windows(gram)
                at = local_minima(g, width - gram + 1)
                n = len(at)
                out.append((g[at], contexts(rolling, w, at, width - gram, gram), np.full(n, doc_ids[i]), np.full(n, ths[i]), at))
            yield arrays(out, PRINTS)

    return docs.filter("doc_id is not null").select("doc_id", "th", "text").mapInArrow(prints, PRINTS)


def arrays(rows: list[tuple[np.ndarray, ...]], schema: str) -> pa.RecordBatch:
    """A batch from tuples of numpy columns; unsigned integers become signed of the same bits."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": np.int64, "int": np.int32}
    columns = []
    for i, (_, kind) in enumerate(fields):
        x = np.concatenate([r[i] for r in rows]) if rows else np.empty(0, dtype=np.int64)
        x = x.view(np.int64) if x.dtype == np.uint64 else x
        columns.append(pa.array(x.astype(kinds[kind], copy=False)))
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def remove_repeats(documents: DataFrame, width: int = 50, batches: int = 3) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller doc_id.

    Documents come to the index in batches of rising doc_id. Returns doc_id, text, n_words, removed (spans of words,
    flat: start, end, start, ...) and kept_text (the other words joined by one space, as UTF-8). A null text has no
    words. Rows without doc_id have no place in the order: they are neither searched nor changed. A row that repeats
    another whole row is the same document. Should hashes of different words be equal, the words stay.
    """
    spark = documents.sparkSession
    low, high = texts(documents).agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [] if low is None else [low + (high - low) * i // batches for i in range(1, batches)]
    index, met = RepeatIndex(spark, width), []
    doc_id = F.col("doc_id").cast("long")
    for i in range(len(cuts) + 1):
        part = documents.filter(doc_id > cuts[i - 1]) if i else documents
        part = part.filter(doc_id <= cuts[i]) if i < len(cuts) else part
        met.append(index.ingest(part, copy=False))
    all_met = met[0]
    for more in met[1:]:
        all_met = all_met.union(more)
    spans = index.repeats(all_met, 0, last=True)
    index.close()
    discard(*met)
    bits = key_bits(spans.select("doc_id", "th"))
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e", "words")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, kept = [], [], []
            spans = batch.column(2)
            for i, text in enumerate(byte_rows(batch.column(1))):
                words = text.split()
                here = [(x["s"], x["e"]) for x in spans[i].as_py() or [] if b" ".join(words[x["s"] : x["e"]]) == x["words"]]
                at = np.array(here, dtype=np.int64).reshape(-1, 2)
                s, e = merged(at[:, 0], at[:, 1])
                n_words.append(len(words))
                removed.append(np.stack((s, e), axis=1).reshape(-1))
                if len(s):
                    edges = [0, *removed[-1].tolist(), len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                kept.append(b" ".join(words))
            columns = [pa.array(n_words, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            names = ["doc_id", "text", "n_words", "removed", "kept_text", *batch.schema.names[3:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, *batch.columns[3:]], names=names)

    more = carried(documents)
    docs = texts(documents, *more)
    # Only texts that may lose something are shuffled.
    columns = ["doc_id", "text", "spans", "carried"][: 3 + len(more)]
    marked = with_meets(docs, bits)
    all_docs = marked.filter("meets").join(spans, ["doc_id", "th"], "left").select(*columns)
    rest = marked.filter("not meets").withColumn("spans", F.lit(None).cast(all_docs.schema["spans"].dataType))
    all_docs = all_docs.union(rest.select(*columns))
    return all_docs.mapInArrow(cut, with_carried(KEPT, all_docs))
