"""Helpers that several corpus operators share.

Texts are handled in pieces of about ``CHUNK_BYTES`` inside a task, so that memory follows the chunk and not the
partition. A single longer text is always handled whole, with memory that follows its words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_CHECK = [_rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)]
_CHECK.append(_CHECK[0].copy())
_CHECK[1][65:91] = _CHECK[0][97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []
#: Bytes hashed at once; the tables of powers are kept up to this size.
BLOCK_BYTES = 1 << 19


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, n of each."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, BLOCK_BYTES + 1)
    tables = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, _P_INV)]
    if size == BLOCK_BYTES + 1:
        _powers[:] = tables
    return tables[0], tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, as 64-bit hashes, without a Python object per word.

    hashes: one uint64 a word; bounds: words of text i are ``bounds[i]:bounds[i + 1]``; starts, ends: byte places in
    the joined buffer. Two words share a hash with a chance of about 2**-56 a pair. Bytes are handled in blocks that
    end at a space, so beyond its own bytes and words a long text needs the memory of one block (a word of more than
    ``BLOCK_BYTES`` is a block of its own).
    """

    def __init__(self, texts: list[str | bytes | None], lower: bool = True):
        parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(parts) + b"\n"
        self.bytes = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths)])
        starts, ends, self._blocks, words = [], [], [], 0
        for a, b in self._cuts():
            space = _SPACE[self.bytes[a:b]]
            edge = np.flatnonzero(np.concatenate([[True], space[:-1]]) != space) + a  # a word starts, then ends, and so on
            starts.append(edge[0::2])
            ends.append(edge[1::2])
            self._blocks.append((a, b, words, words + len(edge) // 2))
            words += len(edge) // 2
        self.starts, self.ends = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends))
        self._table = _LOWER if lower else _BYTE
        self.hashes = self.hashed([None])[0]
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.bounds)

    def _cuts(self):
        """Blocks of the bytes, each up to and with a space; the last byte of all is one."""
        a, n = 0, len(self.bytes)
        while a < n:
            b, step = min(a + BLOCK_BYTES, n), 1 << 12
            while b < n and not _SPACE[self.bytes[b - 1]]:
                at = np.flatnonzero(_SPACE[self.bytes[b : b + step]])
                b, step = (b + int(at[0]) + 1 if len(at) else min(b + step, n)), 2 * step
            yield a, b
            a = b

    def hashed(self, widths: list[int | None], check: bool = False) -> list[np.ndarray]:
        """For each width, hashes of the words' first ``width`` bytes; of whole words for None. check: other, independent hashes."""
        out = [np.empty(len(self.starts), np.uint64) for _ in widths]
        table = _CHECK[self._table is _LOWER] if check else self._table
        for a, b, i, j in self._blocks:
            power, inverse = power_tables(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(table[self.bytes[a:b]] * power[: b - a], out=sums[1:])
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            before, back = sums[s], inverse[s]
            for k, width in enumerate(widths):
                end = e if width is None else np.minimum(s + width, e)
                out[k][i:j] = mix((sums[end] - before) * back + (end - s).astype(np.uint64))
        return out

    def is_space(self) -> np.ndarray:
        return _SPACE[self.bytes]

    def chars_before(self, places: np.ndarray) -> np.ndarray:
        """Code points before byte places of the joined buffer."""
        return places - np.searchsorted(np.flatnonzero((self.bytes & 0xC0) == 0x80), places)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def fold_hash(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for a sequence of word hashes, element by element."""
    h = np.full(parts[0].shape, 0x51ED270B, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + p)
    return h


def chunks(batches, columns: list[str], text: str = "text", size: int = CHUNK_BYTES):
    """Dicts of column lists, each with about ``size`` characters of text, from Arrow batches."""
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
        start = weight = 0
        for i, n in enumerate(lengths):
            weight += n + 32
            if weight >= size or i == batch.num_rows - 1:
                part = batch.slice(start, i + 1 - start)  # only this part becomes Python objects
                yield {c: part.column(c).to_pylist() for c in columns}
                start, weight = i + 1, 0


def per_group(df: DataFrame, by: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(key values, iterator of Arrow batches) -> batches, for each group; a group is streamed, not gathered."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(tuple(k.as_py() for k in key), batches)

    return df.groupBy(*by).applyInArrow(run, schema)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: Spark's bound of the bytes that go to a Python worker at once, what it is if nobody has set it, and what texts are sent with.
BATCH_SETTING, UNSET, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a few MB at a time, unless the session says otherwise: a task holds several copies of a batch."""
    if spark.conf.get(BATCH_SETTING, UNSET) == UNSET:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share. A local session that names none gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/redactory-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written once in the shared folder and read again, so that nothing upstream runs twice."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_volume(docs: DataFrame, text: str = "text") -> int:
    """Characters in all texts; what sizes blocks, filters and shards."""
    return int(docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0])


def held_out(doc_id, folds: int):
    """Whether crc32 of the id as text falls into fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for the ends of the undirected edges (a, b).

    Large-star and small-star rounds; each is two aggregations that combine before the shuffle and joins that
    adaptive execution can split, so a hub with a large part of the edges is no single task. Every round is written
    to the shared folder, and the one before it deleted.
    """
    spark, kind = edges.sparkSession, edges.schema["a"].dataType
    path = shared_dir(spark)
    edges = stored(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), path)
    if edges.isEmpty():
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # now every edge has a < b; the small star joins b's lesser neighbours to the least of them
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        last, path = path, shared_dir(spark)
        edges = stored(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), path)
        discard(spark, last)
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
