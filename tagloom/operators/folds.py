"""Folds over the rows of a key in order, one row after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 4096  # rows of a batch that is given out


def fold_sorted(df: DataFrame, key: list[str], order: list[str], fold: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``fold(key, rows)`` gives for each key, where rows are the other columns of the
    key's rows, sorted by ``order``. Rows come from Spark's own sort, which spills, and pass
    one by one, so a key may have any number of rows; the fold keeps what it needs. Null is
    a key like any other."""
    rest = [c for c in df.columns if c not in key]
    out, n = to_arrow_schema(StructType.fromDDL(schema)), len(key)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        done: list[tuple] = []
        for k, group in groupby(rows, key=lambda r: r[:n]):
            for found in fold(k, (r[n:] for r in group)):
                done.append(found)
                if len(done) == ROWS:
                    yield batch(done)
                    done = []
        yield batch(done)

    ordered = df.repartition(*key).sortWithinPartitions(*key, *order)
    return ordered.select(*key, *rest).mapInArrow(run, schema)
