"""Increasing maps of a score, pooled range by range.

Equal scores are added up first. Each task pools the adjacent violators of its own
range of scores; a pooled block is a first and last score, a sum and a count, and
blocks of neighbouring ranges pool in the same way. Ranges are joined only where
their border still falls, until none does, so a task holds the blocks of the
ranges that really have to meet. The driver sees one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import stage

BLOCKS = "part long, first double, last double, total double, n double"
_NAMES = ["part", "first", "last", "total", "n"]


Blocks = tuple[list, list, list, list]  # first and last score, total, count


def pooled(first: list, last: list, total: list, n: list, out: Blocks | None = None) -> Blocks:
    """Blocks in the order of their scores, pooled until their means rise; they may follow on others."""
    out = out or ([], [], [], [])
    for a, b, s, k in zip(first, last, total, n, strict=True):
        while out[0] and out[2][-1] * k > s * out[3][-1]:
            a, s, k = out[0].pop(), s + out[2].pop(), k + out[3].pop()
            out[1].pop()
        for column, value in zip(out, (a, b, s, k), strict=True):
            column.append(value)
    return out


def _pool_ranges(points: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Blocks = ([], [], [], [])
        for batch in batches:
            x, s, n = (batch.column(c).to_pylist() for c in ("x", "total", "n"))
            own = pooled(x, x, s, n, own)
        if own[0]:
            part = [TaskContext.get().partitionId()] * len(own[0])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(c, pa.float64()) for c in own)], _NAMES)

    return points.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(run, BLOCKS)


def _pool_group(table: pa.Table) -> pa.Table:
    table = table.sort_by("first")
    own = pooled(*(table.column(c).to_pylist() for c in _NAMES[1:]))
    return pa.table([pa.array([table.column("group")[0].as_py()] * len(own[0]), pa.int64()), *(pa.array(c, pa.float64()) for c in own)], names=_NAMES)


def fit_blocks(calibration: DataFrame, score: str, label: str, min_rows: int = 100, *, classes: bool = True) -> DataFrame:
    """Blocks (first, last, value, n) of the increasing map with the least squares; rows without score or label are left out.

    Too few rows, one score only, or (with `classes`) one label only are refused.
    """
    rows = calibration.select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y")).dropna()
    points = stage(rows.groupBy("x").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("n"), F.min("y").alias("least"), F.max("y").alias("most")), "iso-points")
    facts = points.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("least").alias("least"), F.max("most").alias("most")).first()
    if (facts["n"] or 0) < min_rows or facts["kinds"] < 2 or (classes and facts["least"] == facts["most"]):
        raise ValueError(f"calibration is insufficient: {int(facts['n'] or 0)} rows")
    blocks = stage(_pool_ranges(points.select("x", "total", "n")), "iso-blocks")
    while True:
        mean = F.col("total") / F.col("n")
        borders = blocks.groupBy("part").agg(F.min("first").alias("at"), F.min_by(mean, "first").alias("low"), F.max_by(mean, "first").alias("high")).orderBy("at").collect()
        group, parts, falls = 0, [], False
        for k, b in enumerate(borders):
            joined = k > 0 and borders[k - 1]["high"] > b["low"]
            falls, group = falls or joined, group + (k > 0 and not joined)
            parts.append((b["part"], group))
        if not falls:
            return blocks.select("first", "last", (F.col("total") / F.col("n")).alias("value"), "n")
        sizes = {g: sum(h == g for _, h in parts) for _, g in parts}
        spark = blocks.sparkSession
        table = F.broadcast(spark.createDataFrame([(p, g, sizes[g] > 1) for p, g in parts], "part long, group long, open boolean"))
        grouped = blocks.join(table, "part")
        done = grouped.where("not open").select(F.col("group").alias("part"), *_NAMES[1:])
        again = grouped.where("open").drop("part", "open").groupBy("group").applyInArrow(_pool_group, BLOCKS)
        blocks = stage(done.unionByName(again), "iso-blocks")


def apply_blocks(blocks: DataFrame, df: DataFrame, score: str, out: str, per_bucket: int = 100_000) -> DataFrame:
    """The map's value as `out`: constant inside a block, a straight line between two, the end values outside; null without a score.

    Blocks are cut into buckets of scores. Rows go to the bucket of their score,
    dealt over as many tasks as the session shuffles to, each with a copy of the
    bucket's blocks and of the next one on either side.
    """
    spark = df.sparkSession
    edges = stage(blocks, "iso-map")
    n = edges.count()
    cuts = edges.stat.approxQuantile("first", [k / (n // per_bucket + 1) for k in range(1, n // per_bucket + 1)], 0.0) if n > per_bucket else []
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucket(x):
        return F.size(F.filter(F.array(*[F.lit(c) for c in sorted({*cuts})]), lambda c: c <= x)) if cuts else F.lit(0)

    # Both sides need lanes of one type: equal numbers of two types hash apart.
    known = df.where(F.col(score).isNotNull()).withColumns({"_x": F.col(score).cast("double"), "_lane": F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int")})
    known = known.withColumn("_bucket", bucket(F.col("_x")))
    at = bucket(F.col("first"))
    copies = edges.withColumn("_bucket", F.explode(F.array_distinct(F.array(at - 1, at, at + 1, bucket(F.col("last"))))))
    copies = copies.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("first")
        first, last, value = (np.asarray(right.column(c)) for c in ("first", "last", "value"))
        ends, values = np.stack([first, last], 1).ravel(), np.repeat(value, 2)
        made = np.interp(np.asarray(left.column("_x")), ends, values) if left.num_rows else np.zeros(0)
        return left.select(names).append_column(out, pa.array(made, pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` double"
    mapped = known.groupBy("_bucket", "_lane").cogroup(copies.groupBy("_bucket", "_lane")).applyInArrow(run, schema)
    return mapped.unionByName(df.where(F.col(score).isNull()).select(*names, F.lit(None).cast("double").alias(out)))
