"""What the operators share: words as bytes, window hashes, tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A-Z lower-cased, every other byte unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z lower-cased; ASCII that is neither letter nor digit becomes a space.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)
#: Words whose hashes a task remembers at most; then it forgets all and starts again.
REMEMBERED = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset in a local session (tests),
    one of our own; on a cluster no local folder would do, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. What df alone was
    made of is let go first, so that Spark deletes its shuffle files before the next step writes its own."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once all that reads them has been written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (null: empty), and th, a text hash that tells apart rows that repeat a doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def carried(df: DataFrame) -> list[Column]:
    """The columns besides doc_id and text as one struct column named carried, if there are any: they go through an
    operator untouched, whatever their names are."""
    others = [c for c in df.columns if c not in ("doc_id", "text")]
    return [F.struct(*(F.col(f"`{c}`") for c in others)).alias("carried")] if others else []


def with_carried(schema: str, df: DataFrame) -> StructType:
    """schema, and df's carried column if it has one."""
    out = StructType.fromDDL(schema)
    return out.add(df.schema["carried"]) if "carried" in df.columns else out


def byte_rows(column: pa.Array, step: int = 256):
    """The rows of a string column as bytes, a few at a time."""
    column = column.cast(pa.binary())
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (one to one)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hashes of windows of a sequence of 64-bit integers, of any width and anywhere, a few operations each: sums of
    elements times powers of an odd base, modulo 2 ** 64."""

    def __init__(self, seed: int = 0):
        self.base = int(mix(np.array([seed + 1], dtype=np.uint64))[0]) | 1
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def load(self, h: np.ndarray) -> Rolling:
        n = len(h)
        if n > len(self.up):
            size = 2 * n
            factors = np.ones((2, size), dtype=np.uint64)
            factors[:, 1:] = np.array([[self.base], [pow(self.base, -1, 1 << 64)]], dtype=np.uint64)
            self.up, self.down = np.cumprod(factors, axis=1)
        self.n, self.sums = n, np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * self.up[:n], out=self.sums[1:])
        return self

    def windows(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of k elements that start at each place of at (default: all)."""
        if at is None:
            n = max(0, self.n - k + 1)
            return mix((self.sums[k : k + n] - self.sums[:n]) * self.down[:n] + np.uint64(k))
        return mix((self.sums[at + k] - self.sums[at]) * self.down[at] + np.uint64(k))


def _sliding(h: np.ndarray, w: int, take) -> np.ndarray:
    """take (minimum or maximum) over each w consecutive elements, by doubling."""
    best, width = h, 1
    while width * 2 <= w:
        best = take(best[:-width], best[width:])
        width *= 2
    return take(best[: len(h) - w + 1], best[w - width : len(h) - width + 1]) if width < w else best


def local_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some w consecutive elements of h: any w in a row have one, and which
    they are depends on nothing else."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    lowest = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((edge, lowest, edge)), w, np.maximum) == h)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans: touching and overlapping ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))]
