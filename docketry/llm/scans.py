"""Running sums over sorted rows of any number, group by group, with no group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import stored

#: Rows of a range at most on average, and sums are taken modulo 2^62.
PART_ROWS, MASK = 1 << 20, (1 << 62) - 1


def ranges(df: DataFrame, n: int, part_rows: int = PART_ROWS) -> int:
    """Number of ranges for n rows: a few thousand rows each until all cores have one, and then `part_rows` each."""
    return max(1, -(-n // part_rows), min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // 2048)))


def running(rows: DataFrame, group: str, order: list[str], sums: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with each of `sums`, longs that aren't negative, as a running sum within its group, modulo 2^62.

    Rows are dealt out in ranges of group and order, so a large group lies in several; within a range the sums run as
    the rows stream by, and what the ranges before it hold of its first group is added afterwards. Only one row of
    each range reaches the driver. Groups mustn't be null; rows that tie in order stand in any order.
    """
    names = [f.name for f in rows.schema]
    at = [names.index(s) for s in sums]
    key = names.index(group)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        opening = last = carry = held = None

        def ended(batch: pa.RecordBatch, final: bool) -> pa.RecordBatch:
            edge = np.zeros(batch.num_rows, bool)
            edge[-1] = final
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge)], names=[*batch.schema.names, "_edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield ended(held, False)
            groups = batch.column(key).to_numpy()
            if opening is None:
                opening, last, carry = groups[0], groups[0], np.zeros(len(sums), np.uint64)
            starts = np.flatnonzero(np.append(groups[0] != last, groups[1:] != groups[:-1]))
            columns = list(batch.columns)
            for i, j in enumerate(at):
                total = np.cumsum(batch.column(j).to_numpy().astype(np.uint64)) + carry[i]
                before = np.append(carry[i], total[:-1]) if len(total) else total
                base = np.zeros(len(total), np.uint64)
                if len(starts):
                    own = before[starts] if starts[0] else np.append(carry[i], before[starts[1:]])
                    which = np.searchsorted(starts, np.arange(len(total)), "right") - 1
                    base = np.where(which >= 0, own[np.maximum(which, 0)], np.uint64(0))
                summed = (total - base) & np.uint64(MASK)
                carry[i] = summed[-1]
                columns[j] = pa.array(summed.astype(np.int64))
            last = groups[-1]
            held = pa.RecordBatch.from_arrays([*columns, pa.array(groups == opening), pa.array(np.full(len(groups), part, np.int32))], names=[*names, "_open", "_part"])
        if held is not None:
            yield ended(held, True)

    kinds = ", ".join(f"`{f.name}` {'bigint' if f.name in sums else f.dataType.simpleString()}" for f in rows.schema)
    parts = ranges(rows, rows.count(), part_rows)
    swept = stored(rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).mapInArrow(sweep, f"{kinds}, _open boolean, _part int, _edge boolean"))
    ends = {r["_part"]: r for r in swept.where("_edge").select("_part", "_open", group, *sums).collect()}
    firsts = {r["_part"]: r[group] for r in swept.where("_open").groupBy("_part").agg(F.first(group).alias(group)).collect()}
    carries, before, sofar = [], None, [0] * len(sums)
    for part in sorted(ends):
        end = ends[part]
        goes_on = before is not None and firsts[part] == before
        if goes_on:
            carries.append((part, *sofar))
        sofar = [(end[s] + (sofar[i] if goes_on and end["_open"] else 0)) & MASK for i, s in enumerate(sums)]
        before = end[group]
    schema = "_part int, " + ", ".join(f"_c{i} bigint" for i in range(len(sums)))
    small = F.broadcast(rows.sparkSession.createDataFrame(carries, schema))  # a row for each range at most
    add = {s: F.when(F.col("_open"), (F.col(s) + F.coalesce(f"_c{i}", F.lit(0))).bitwiseAND(F.lit(MASK))).otherwise(F.col(s)) for i, s in enumerate(sums)}
    return swept.join(small, "_part", "left").withColumns(add).select(*names)
