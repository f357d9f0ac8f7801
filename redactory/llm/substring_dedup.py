"""Substring dedup by line hashing: repeated passages lose all occurrences but the earliest ranked.

A text is cut into units: lines, and inside lines sentences; a sentence of under ``UNIT_WORDS`` words goes with those
after it in its line until they have as many, and such runs begin anew after each longer one. A unit is normalised (A-Z lowered, spaces united), hashed
to 128 bits, and digests are grouped over the whole corpus. The occurrence with the least (doc_id, place) stays. Other
occurrences go if, together with the repeated units next to them in the text, they make a passage of ``MIN_WORDS``
words or more, so that short stock lines stay. Offsets are those of the original text, in code points.

A passage may share its first and last sentence with other text, or have no end of a sentence at all. So windows of
``MIN_WORDS`` words are hashed too (128 bits), wherever they begin; of those that begin at neighbouring words the one
of least hash is taken (winnowing), so that two runs of ``RUN_WORDS`` equal words always have a window in common. Its
later copies go, with the repeated units that overlap or touch them; a window that overlaps its own first copy stays.
Of any ``RUN_WORDS`` words of a longer repeated run, ``MIN_WORDS`` or more go; up to 21 words at each end may stay.

Groups combine before the shuffle. The join back to the occurrences sends the ``HOT_KEYS`` most frequent digests at most
to the workers; of the others none has more than a ``HOT_KEYS``-th of all occurrences, so no task has a large group.

Defined cases: null and empty texts have no units; a very long text or line is cut whole; equal ranks cannot occur in
a table with distinct ids; rows that repeat a doc_id count as one document: what one row shares with another stays, and
what a row repeats itself goes; a null doc_id keeps its text; an empty table gives no rows; other columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactory.llm.common import Words, bound_batches, chunks, mix, power_tables, read_table, stored

#: Words of a passage that goes; words of an equal run that is found wherever it begins and ends.
MIN_WORDS, RUN_WORDS = 30, 51
UNIT_WORDS, HOT_KEYS = 4, 100_000
_UNIT = re.compile(r"[^\n]*?[.!?](?=[ \t\n\r\x0b\x0c]|$)|[^\n]+")
#: What str.split takes for a space and Words does not.
_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def units_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised) of each unit that has a word."""
    out, held, start, end = [], [], 0, 0
    for m in _UNIT.finditer(text):
        words = m.group().translate(_UPPER).split()
        if words:
            start, end = start if held else m.start(), m.end()
            held += words
        if held and (len(held) >= UNIT_WORDS or text[m.end() : m.end() + 1] in ("", "\n")):
            out.append((start, end, len(held), " ".join(held)))
            held = []
    return out


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """best of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[: len(values) - (width - size)], values[width - size :])


def sampled_windows(words: Words, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, another hash) of windows of ``size`` words; equal runs of ``run`` words in texts have one in common."""
    n, near = len(words.hashes), run - size + 1
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    power, inverse = power_tables(n + 1)

    def rolled(of_words: np.ndarray, at=slice(None)) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_words * power[:n])])
        return mix((sums[size:][at] - sums[:-size][at]) * inverse[: n - size + 1][at])

    hashes = rolled(words.hashes)
    least = _sliding(np.minimum, hashes, near)
    owner = words.text_of()
    least[owner[: n - run + 1] != owner[run - 1 :]] = 0
    edge = np.zeros(near - 1, np.uint64)
    at = np.flatnonzero((_sliding(np.maximum, np.concatenate([edge, least, edge]), near) == hashes) & (hashes > 0))
    return at, hashes[at], rolled(words.hashed([None], check=True)[0], at)


_INT = pa.int32()
_UNITS = pa.schema([("doc_id", pa.int64()), ("place", _INT), ("start", _INT), ("end", _INT), ("words", _INT), ("hi", pa.int64()), ("lo", pa.int64()), ("later", pa.bool_())])


def _later(row: np.ndarray, hi: np.ndarray, lo: np.ndarray, place: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which units come again in their own text, clear of their first occurrence there."""
    order = np.lexsort((place, lo, hi, row))
    r, h, k, p = row[order], hi[order], lo[order], place[order]
    new = np.concatenate([np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
    out = np.zeros(len(row), bool)
    out[order] = p >= p[np.flatnonzero(new)][np.cumsum(new) - 1] + words[order] if len(r) else False
    return out


def _unit_rows(ids: np.ndarray, row: np.ndarray, place, start, end, words, hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    place, start, end, words = (np.asarray(x, np.int32) for x in (place, start, end, words))
    columns = (ids[row], place, start, end, words, hi, lo, _later(row, hi, lo, place, words))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _UNITS)], schema=_UNITS)


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, place, start, end, words, hi, lo, later) of units and windows: place is the number of the first word in its text."""

    def run(batches):
        for c in chunks(batches, ["doc_id", "text"]):
            ids = np.array([i or 0 for i in c["doc_id"]], np.int64)
            texts = ["" if i is None else t or "" for i, t in zip(c["doc_id"], c["text"])]
            cols: list[list] = [[] for _ in range(5)]
            digests = []
            for row, t in enumerate(texts):
                k = 0
                for a, b, n, unit in units_of(t):
                    for col, v in zip(cols, (row, k, a, b, n)):
                        col.append(v)
                    digests.append(xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass")))
                    k += n
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield _unit_rows(ids, np.array(cols[0], np.int64), *cols[1:], d[:, 0].copy(), d[:, 1].copy())
            words = Words([_BLANK.sub(" ", t) for t in texts])
            at, hashes, others = sampled_windows(words, min_words, max(min_words, RUN_WORDS))
            own = words.text_of()[at]
            first, start, end = (words.chars_before(x) for x in (words.text_starts[own], words.starts[at], words.ends[at + min_words - 1]))
            yield _unit_rows(ids, own, at - words.bounds[own], start - first, end - first, np.full(len(at), min_words), hashes.view(np.int64), others.view(np.int64))

    ddl = "doc_id long, place int, start int, end int, words int, hi long, lo long, later boolean"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, words, first_docs) of each passage to remove; first_docs: documents that keep its units."""
    bound_batches(docs.sparkSession)
    units = stored(unit_table(docs, min_words))
    groups = stored(units.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1"))
    hot = F.col("n") > units.count() // HOT_KEYS
    common = units.join(F.broadcast(groups.where(hot).select("hi", "lo", "first_doc")), ["hi", "lo"], "left")
    gone = "(first_doc <> doc_id OR later)"
    columns = ["doc_id", "place", "start", "end", "words", "first_doc"]
    rare = common.where("first_doc IS NULL").drop("first_doc").join(groups.where(~hot).select("hi", "lo", "first_doc"), ["hi", "lo"])
    again = common.where(f"first_doc IS NOT NULL AND {gone}").select(*columns).unionByName(rare.where(gone).select(*columns))
    listed = again.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "words", "first_doc"))).alias("us"))

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("first_docs", pa.list_(pa.int64()))])

    def runs(batches):
        for b in batches:
            us = b.column("us")
            flat = us.flatten()
            place, start, end, n, source = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            if not len(place):
                continue
            row = np.repeat(np.arange(b.num_rows), us.value_lengths().to_numpy(zero_copy_only=False))
            # places of different texts are kept apart; a run ends where the next place lies beyond all ends before it
            low = place + (row << 40)
            high = np.maximum.accumulate(low + n)
            heads = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            tails = np.concatenate([heads[1:], [len(low)]])
            words = high[tails - 1] - low[heads]
            at = np.flatnonzero(words >= min_words)
            docs_of = b.column("doc_id").to_numpy(zero_copy_only=False)[row[heads[at]]]
            starts, ends = np.minimum.reduceat(start, heads)[at], np.maximum.reduceat(end, heads)[at]
            sources = [np.unique(source[heads[k] : tails[k]]).tolist() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs_of, starts, ends, words[at], sources), schema)], schema=schema)

    return listed.mapInArrow(runs, "doc_id long, start long, end long, words long, first_docs array<long>")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the repeated passages, and removed_spans: their original offsets."""
    spans = repeated_spans(docs, min_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed_spans"))
    kept = [c for c in docs.columns if c != "removed_spans"]
    joined = docs.select(*kept).join(spans.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    schema = joined.schema

    def run(batches):
        for b in batches:
            texts = []
            for t, cuts in zip(b.column("text").to_pylist(), b.column("removed_spans").to_pylist()):
                if cuts:
                    edges = [0, *(x for c in cuts for x in (c["start"], c["end"])), len(t)]
                    t = "".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in b.schema.names], names=b.schema.names)

    return joined.mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in schema]))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
