"""Ordered runs of rows handed to Python as they stream by, and scans over blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_groups(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[dict]], Iterator[tuple]], schema: str
) -> DataFrame:
    """Calls ``fn(key, rows)`` for each group of ``keys`` with its rows in ``order``.

    Rows are hash-partitioned by ``keys`` and sorted within each partition, then read through Arrow
    batch by batch: many small groups cost one Python call each and no group start-up. The caller
    makes groups bounded (see ``block`` columns of the operators that use this); only one group is
    held at a time. Nulls in keys form groups of their own. An empty table gives an empty result.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = target
        rows: list[dict] = []
        held: tuple | None = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
            out.clear()
            return made

        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != held:
                    if rows:
                        out.extend(fn(held, rows))
                    held, rows = key, []
                    if len(out) >= 8192:
                        yield batch()
                rows.append(row)
        if rows:
            out.extend(fn(held, rows))
        if out:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)
