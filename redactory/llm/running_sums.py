"""Running sums inside groups of any size, by ranges.

Rows are sorted by ranges of (group, order), and each range is summed by itself, as a stream of batches. Where a group goes
on from one range to the next, what it has come to so far is added afterwards: there is at most one such group a range,
so these carries are as few as the ranges. No group has to fit in a task, and none is a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from redactory.llm.common import stored


def running_sums(rows: DataFrame, by: str, order: list[Column], terms: list[str], ranged: list[Column] | None = None) -> DataFrame:
    """rows with ``<term>_sum`` for each of the long columns ``terms``: the sum over the group's rows up to this one.

    by is a long column without nulls. Rows that tie in ``ranged`` (``order``, if it is not given) stay in one range.
    The result is written.
    """
    schema = StructType([*rows.schema.fields, *(StructField(f"{t}_sum", LongType()) for t in terms), StructField("range_no", IntegerType()), StructField("is_end", BooleanType())])

    def run(batches):
        number, group, so_far, held = TaskContext.get().partitionId(), None, [0] * len(terms), None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(by).to_numpy()
            starts = np.flatnonzero(np.concatenate([[group is None or keys[0] != group], keys[1:] != keys[:-1]]))
            columns = []
            for i, t in enumerate(terms):
                x = b.column(t).to_numpy()
                total = np.concatenate([[0], np.cumsum(x)])
                before = np.full(len(x), -so_far[i], np.int64)  # what has to be taken off
                for_start = np.searchsorted(starts, np.arange(len(x)), side="right") - 1
                within = for_start >= 0
                before[within] = total[starts[for_start[within]]]
                columns.append(total[1:] - before)
                so_far[i] = int(columns[-1][-1])
            group = keys[-1]
            if held is not None:
                yield held
            n = b.num_rows
            held = pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(n, number, np.int32)), pa.array(np.zeros(n, bool))], names=schema.names)
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=schema.names)

    ranges = rows.repartitionByRange(F.col(by), *(ranged or order)).sortWithinPartitions(F.col(by), *order)
    summed = stored(ranges.mapInArrow(run, schema))
    ends = summed.where("is_end").select("range_no", by, *[f"{t}_sum" for t in terms]).orderBy("range_no").collect()  # one a range
    carries, carry = [], [0] * len(terms)
    for a, b in zip(ends, ends[1:]):
        same = carries and carries[-1][1] == a[1]
        carry = [x + (y if same else 0) for x, y in zip(a[2:], carry)]
        carries.append((b[0], a[1], *carry))
    names = [f"{t}_carry" for t in terms]
    sent = rows.sparkSession.createDataFrame(carries, ", ".join(["range_no int", f"`{by}` long", *(f"{n} long" for n in names)]))
    out = summed.join(F.broadcast(sent), ["range_no", by], "left")
    return out.select(*rows.columns, *[(F.col(f"{t}_sum") + F.coalesce(f"{t}_carry", F.lit(0))).alias(f"{t}_sum") for t in terms])
