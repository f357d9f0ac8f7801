"""Line dedup with two Bloom filters: keys seen once, and keys seen again.

Each text's distinct line keys go to 64-bit hashes. Tasks fill a once and a twice filter for their own part; slices of
these filters meet in groups and are merged: a key is seen again if two parts have it, or one has it twice. Only keys
that the merged twice filter holds are suspects. Suspects alone shuffle, as 128-bit digests, for the exact count of
documents and the choice of the occurrence that stays. Line texts never move before the final join by document.

The twice filter is sent to the workers while it is at most ``limit_bytes``. Above that the filters stay cut into blocks
of ``BLOCK_KEYS`` keys: each task sends its distinct hashes to the blocks, a block fills its once and twice filters from
them, asks the latter about each and gives back the suspected hashes alone. Traffic is in proportion to the keys, a line
of a third of all documents is sent once a task, and the rows are the same.

Defined cases: null or empty texts are one empty line; a key that repeats inside one document counts once, and stays
or goes in all its lines; ties cannot occur, as the document is chosen by id; rows that repeat a doc_id count as one
document for the choice, and each is rewritten; a null doc_id is no document for the count and its
lines stay; an empty table gives no rows; other columns pass through, but for
those named n_lines, n_dropped, _drop or _id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactory.llm.common import batch_of, bound_batches, chunks, mix, per_group, read_table, stored

MIN_CHARS, MIN_DOCS = 40, 5
SLICE_BITS = 1 << 19
BITS_PER_KEY, PROBES = 12, 4
#: Keys of a block of the cut filters; rows of suspected hashes or repeated lines that are sent to the workers, as 8 or 24 bytes.
BLOCK_KEYS, ROWS_SENT, SALTS = 4_000_000, 1_000_000, 16
_SPACES = b" \t\n\r\x0b\x0c"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: spaces stripped, A-Z lowered."""
    return [x.strip(_SPACES).lower() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def digest(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _places(hashes: np.ndarray, n_slices: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slice of each hash, and its bits there."""
    a = mix(hashes)
    b = mix(a + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (hashes % np.uint64(n_slices)).astype(np.int64), [((a + np.uint64(i) * b) & np.uint64(SLICE_BITS - 1)).astype(np.int64) for i in range(PROBES)]


def _set(bits: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))


def _has(bits: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(places[0]), bool)
    for p in places:
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


_SLICE = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_SLICE_DDL = "slice int, once binary, twice binary"


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _merge(old: tuple[np.ndarray, np.ndarray] | None, once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (once, twice) if old is None else (old[0] | once, old[1] | twice | (old[0] & once))


def _slices(hashes: np.ndarray, n_slices: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slice, once bits, twice bits) of one part's keys; a key that comes again inside the part is in both."""
    keys, counts = np.unique(hashes, return_counts=True)
    at, places = _places(keys, n_slices)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(n_slices + 1))
    for s in range(n_slices):
        own = order[edges[s] : edges[s + 1]]
        if len(own):
            once, twice = np.zeros(SLICE_BITS // 8, np.uint8), np.zeros(SLICE_BITS // 8, np.uint8)
            _set(once, [p[own] for p in places])
            again = own[counts[own] > 1]
            _set(twice, [p[again] for p in places])
            yield s, once, twice


def key_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, keys): for each document the distinct long keys as packed 128-bit digests; documents without are left out."""

    def run(batches):
        for c in chunks(batches, ["doc_id", "text"]):
            ids, packed = [], []
            for i, t in zip(c["doc_id"], c["text"]):
                if i is not None and t is not None and len(t) >= min_chars:
                    own = {xxhash.xxh3_128_digest(k) for k in line_keys(t) if long_enough(k, min_chars)}
                    if own:
                        ids.append(i)
                        packed.append(b"".join(sorted(own)))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "keys": packed}, schema=pa.schema([("doc_id", pa.int64()), ("keys", pa.binary())]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys binary")


def _digests(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2)


def twice_filter(keys: DataFrame, n_slices: int) -> DataFrame:
    """(slice, bits): the merged twice filter."""

    def fill(batches):
        found = [_digests(b.column("keys").to_pylist())[:, 0].copy() for b in batches if b.num_rows]
        if found:
            for s, once, twice in _slices(np.concatenate(found).view(np.uint64), n_slices):
                yield batch_of(_SLICE, slice=[s], once=[_pack(once)], twice=[_pack(twice)])

    def merge(key, batches):
        seen = None
        for b in batches:
            for once, twice in zip(b.column("once").to_pylist(), b.column("twice").to_pylist()):
                seen = _merge(seen, _unpack(once), _unpack(twice))
        yield batch_of(_SLICE, slice=[key[0]], once=[_pack(seen[0])], twice=[_pack(seen[1])])

    # a slice has one row from each task; they meet in partial groups first
    parts = keys.mapInArrow(fill, _SLICE_DDL).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    partial = per_group(parts, ["slice", "part"], merge, _SLICE_DDL)
    return per_group(partial, ["slice"], merge, _SLICE_DDL).select("slice", "twice")


_ASKED = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("again", pa.binary())])


def suspected_hashes(keys: DataFrame, n_keys: int, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(hi): hashes that filters cut into blocks hold as seen again."""
    n_blocks = max(1, -(-n_keys // block_keys))
    bits = max(1 << 10, (block_keys * BITS_PER_KEY + 7) // 8 * 8)

    def asked(held: list[np.ndarray]):
        found, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        block = (found % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(n_blocks + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            yield batch_of(_ASKED, block=[b], hashes=[found[own].tobytes()], again=[np.packbits(counts[own] > 1).tobytes()])

    def ask(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(_digests(b.column("keys").to_pylist())[:, 0].copy())
                n += len(held[-1])
                if n > 1_000_000:
                    yield from asked(held)
                    held, n = [], 0
        if held:
            yield from asked(held)

    def places(hashes: np.ndarray) -> list[np.ndarray]:
        a = mix(hashes)
        step = mix(a + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return [((a + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]

    def decide(key, batches):
        once, twice, held = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), []
        for b in batches:
            for packed, flags in zip(b.column("hashes").to_pylist(), b.column("again").to_pylist()):
                hashes = np.frombuffer(packed, np.uint64)
                at = places(hashes)
                seen = _has(once, at) | np.unpackbits(np.frombuffer(flags, np.uint8), count=len(hashes)).astype(bool)
                _set(twice, [p[seen] for p in at])
                _set(once, at)
                held.append(hashes)
        hashes = np.unique(np.concatenate(held))
        found = hashes[_has(twice, places(hashes))].view(np.int64)
        for k in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_pydict({"hi": found[k : k + 100_000]}, schema=pa.schema([("hi", pa.int64())]))

    return per_group(keys.mapInArrow(ask, "block int, hashes binary, again binary"), ["block"], decide, "hi long")


def suspects(keys: DataFrame, n_keys: int, limit_bytes: int, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(hi, lo, doc_id) of keys that may be in several documents."""
    n_slices = max(1, -(-n_keys * BITS_PER_KEY // SLICE_BITS))
    if n_slices * (SLICE_BITS // 8) > limit_bytes:
        again = stored(suspected_hashes(keys, n_keys, block_keys))
        rows = keys.mapInArrow(_explode(None, 1), "hi long, lo long, doc_id long")
        return rows.join(F.broadcast(again) if again.count() <= ROWS_SENT else again, "hi", "left_semi")
    bits = np.zeros((n_slices, SLICE_BITS // 8), np.uint8)
    for row in twice_filter(keys, n_slices).toLocalIterator():
        bits[row["slice"]] = _unpack(bytes(row["twice"]))
    sent = keys.sparkSession.sparkContext.broadcast(bits)
    return keys.mapInArrow(_explode(sent, n_slices), "hi long, lo long, doc_id long")


def _explode(sent, n_slices: int):
    def run(batches):
        for b in batches:
            packed = b.column("keys").to_pylist()
            if not packed:
                continue
            d = _digests(packed)
            ids = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), [len(p) // 16 for p in packed])
            if sent is not None:
                at, places = _places(np.ascontiguousarray(d[:, 0]).view(np.uint64), n_slices)
                flat = sent.value.reshape(-1)
                hit = _has(flat, [at * SLICE_BITS + p for p in places])
                d, ids = d[hit], ids[hit]
            yield pa.RecordBatch.from_pydict({"hi": d[:, 0].copy(), "lo": d[:, 1].copy(), "doc_id": ids}, schema=pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64())]))

    return run


def _with_keeper(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """found with the keeper of its line: the lines are sent if few, else the join is salted, as one line may be in most documents."""
    if repeated.count() <= ROWS_SENT:
        return found.join(F.broadcast(repeated), ["hi", "lo"])
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["hi", "lo", "salt"]).drop("salt")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, limit_bytes: int = 64 << 20) -> DataFrame:
    """docs with repeated lines dropped: all columns, text rewritten, plus n_lines and n_dropped.

    A key of ``min_chars`` code points or more in ``min_docs`` documents or more stays in the largest doc_id only.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped", "_drop", "_id")])
    bound_batches(docs.sparkSession)
    keys = stored(key_table(docs, min_chars))
    n_keys = int(keys.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0]) // 16
    found = stored(suspects(keys, n_keys, limit_bytes).distinct())
    repeated = found.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("hi", "lo", "keeper")
    drops = _with_keeper(found, stored(repeated)).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("_drop"))
    joined = docs.join(drops.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_rewriter(docs.columns, min_chars), schema)


def _rewriter(columns: list[str], min_chars: int):
    def run(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, drop in zip(b.column("text").to_pylist(), b.column("_drop").to_pylist()):
                lines = (t or "").split("\n")
                n_lines.append(len(lines))
                if drop:
                    gone = {(x["hi"], x["lo"]) for x in drop}
                    kept = [line for line, k in zip(lines, line_keys(t)) if not (long_enough(k, min_chars) and digest(k) in gone)]
                    n_dropped.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    n_dropped.append(0)
                    texts.append(t)
            arrays = [pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return run


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.rid, l.i, l.line, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
