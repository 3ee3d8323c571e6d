"""Ordered folds over sorted partitions.

Rows are dealt by key and sorted once; each task walks its rows in one pass and
keeps the state of the current key only. So a key's history may be of any length,
and the time of a fold grows with its rows alone. Use this where a result depends
on the fold's own earlier output and no window can say it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fold_columns(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], added: str, start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """The rows with the columns `added` (a DDL string), computed key by key in the given order.

    `step(state, *inputs)` gets one row's input values and gives the next state and
    the values of the new columns; `start()` is the state before a key's first row.
    Rows with null keys are one key. Columns of the new names are replaced.
    """
    fresh = StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in fresh.names]
    schema = StructType([*(df.schema[c] for c in kept), *fresh.fields])
    # What the fold reads travels under names of its own, so that a replaced column can still be an input.
    named = {f"_k{i}": c for i, c in enumerate(keys)} | {f"_i{i}": c for i, c in enumerate(inputs)}
    rows = df.select(*kept, *[F.col(c).alias(n) for n, c in named.items()], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    lanes = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[f"_k{i}" for i in range(len(keys))])
    lanes = lanes.sortWithinPartitions(*[f"_k{i}" for i in range(len(keys))], *[f"_o{i}" for i in range(len(order))])
    lanes = lanes.drop(*[f"_o{i}" for i in range(len(order))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fresh.fields]
        current, state = None, None
        for batch in batches:
            own = list(zip(*(batch.column(f"_k{i}").to_pylist() for i in range(len(keys))), strict=True))
            given = zip(*(batch.column(f"_i{i}").to_pylist() for i in range(len(inputs))), strict=True)
            made = []
            for key, values in zip(own, given, strict=True):
                if key != current:
                    current, state = key, start()
                state, out = step(state, *values)
                made.append(out)
            columns = zip(*made, strict=True) if made else [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, *fresh.names])

    return lanes.mapInArrow(run, schema)
