"""Vectors of a table against a query set, in cells of bounded size.

Rows are dealt into stripes and queries into blocks; a cell is one stripe with one block. Every stripe meets every block
once, each side is copied as often as the other has parts, and a cell fits in one task by the two sizes. No key is hot:
stripes and blocks come from row numbers or ranges of norms, never from values that many rows share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import per_group

STRIPE_ROWS, BLOCK_ROWS = 8192, 16384


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows as float64, whether a row is there and finite throughout). Shorter vectors are filled up with zeros."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(starts, lengths)] = values
    return out, pc.is_valid(column).to_numpy(zero_copy_only=False) & np.isfinite(out).all(axis=1)


def width_of(vectors: DataFrame, column: str = "embedding") -> int:
    """The longest vector's number of components."""
    return int(vectors.agg(F.greatest(F.coalesce(F.max(F.size(column)), F.lit(0)), F.lit(0))).first()[0])


def unpacked(column: pa.Array, width: int, kind) -> np.ndarray:
    """Vectors kept as bytes, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def packed(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def dealt(n_parts: int, key: str = "uid") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int")


def in_cells(rows: DataFrame, queries: DataFrame, n_stripes: int, n_blocks: int, fn: Callable, schema: str) -> DataFrame:
    """fn(queries of a block, rows of a stripe), both Arrow tables, for every cell; a cell without either is left out.

    rows have a column ``s`` (stripe), queries a column ``j`` (block); both have the same other columns.
    """
    names = [c for c in rows.columns if c != "s"]
    copies = rows.select(F.lit(True).alias("is_row"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("j"), "s", *names)
    asked = queries.select(F.lit(False).alias("is_row"), "j", F.explode(F.sequence(F.lit(0), F.lit(n_stripes - 1))).alias("s"), *names)

    def run(_, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        if cell.num_rows:
            is_row = cell.column("is_row")
            ask, held = cell.filter(pc.invert(is_row)).combine_chunks(), cell.filter(is_row).combine_chunks()
            if ask.num_rows and held.num_rows:
                yield from fn(ask, held)

    return per_group(copies.unionByName(asked), ["j", "s"], run, schema)


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's entries the k with the highest score, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (scores, ids, uids))
