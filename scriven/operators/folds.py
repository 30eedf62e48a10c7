"""Ordered folds: logic that depends on what was kept before, streamed per key in a set order."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a result batch.
BATCH = 10_000


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator], Iterable[tuple]], schema: str) -> DataFrame:
    """fold(key, rows) yields tuples of `schema` for each key's rows in order; nulls come first and are None, a null key is a key.

    One shuffle on the keys, sorted inside partitions; rows stream through Arrow batches, so a long group needs
    no more memory than the fold keeps. Small rows may mean much work: there are as many parts as a shuffle has, whatever their size.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)
    row = namedtuple("Row", df.columns, rename=True)._make
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        for key, group in groupby(rows, lambda r: tuple(r[i] for i in at)):
            for x in fold(key, group):
                out.append(x)
                if len(out) >= BATCH:
                    yield made()
        if out:
            yield made()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 1)
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
