"""Versioned writes, upserts, calendar alignment and source materialisation."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.reconcile import align_source_scale, apply_scale, latest_per_key, merge_sources
from tapeloom.session import spread_by, stage
from tapeloom.sources import files


def write_versioned(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """Publish under a version name; an existing version is never overwritten."""
    path = f"{root.rstrip('/')}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_zip_csv(df: DataFrame, folder: str, member: str) -> int:
    """Text columns as ZIP files of CSV members, one ZIP per task, one member per value of a column.

    Rows are sorted by the member column inside each task and streamed, so a
    task holds one batch. Returns the number of files.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        path, now, handle, archive = f"{root}/{uuid.uuid4().hex}.zip", None, None, None
        with ExitStack() as open_files:
            for batch in batches:
                if batch.num_rows and archive is None:
                    stream = open_files.enter_context(system.open_output_stream(path, compression=None))
                    archive = open_files.enter_context(zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED))
                for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    key = row[names.index(member)]
                    if handle is None or key != now:
                        if handle is not None:
                            handle.close()
                        handle, now = io.TextIOWrapper(archive.open(f"{key}.csv", "w", force_zip64=True), "utf-8", newline=""), key
                        rows = csv.writer(handle)
                        rows.writerow(names)
                    rows.writerow(row)
            if handle is not None:
                handle.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([int(archive is not None)], pa.int64())})

    sorted_rows = df.repartition(member).sortWithinPartitions(member)
    return sorted_rows.mapInArrow(run, "files long").agg(F.sum("files")).first()[0]


def write_symbol_csv(df: DataFrame, folder: str, symbol: str) -> int:
    """One CSV file per symbol, `symbol=<value>.csv`, in one folder per task, without the symbol's column.

    Folders are as many as shuffle partitions, however many symbols there are, so
    that listing them stays short. Rows are sorted by symbol inside each task and
    streamed; a null symbol is written as `null`. Returns the number of files.
    """
    names = [c for c in df.columns if c != symbol]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files.located(f"{folder}/{TaskContext.get().partitionId():05d}")
        system.create_dir(root, recursive=True)
        now, done, writer = None, 0, None
        with ExitStack() as last:
            for batch in batches:
                rows, runs, first = batch.select(names), pc.run_end_encode(batch.column(symbol)), 0
                for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if writer is None or key != now:
                        last.close()
                        name = "null" if key is None else key
                        stream = last.enter_context(system.open_output_stream(f"{root}/{symbol}={name}.csv", compression=None))
                        writer, now, done = last.enter_context(arrow_csv.CSVWriter(stream, rows.schema)), key, done + 1
                    writer.write_batch(rows.slice(first, end - first))
                    first = end
        yield pa.RecordBatch.from_pydict({"files": pa.array([done], pa.int64())})

    return spread_by(df, symbol).sortWithinPartitions(symbol).mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def upsert_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing and incoming rows, the incoming one wins on an equal key."""
    both = existing.withColumn("batch_no", F.lit(0)).unionByName(incoming.withColumn("batch_no", F.lit(1)))
    return latest_per_key(both, keys, F.col("batch_no"))


def upsert_report(existing: DataFrame, incoming: DataFrame, merged: DataFrame) -> DataFrame:
    one = merged.agg(F.count(F.lit(1)).alias("after_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    return one.withColumn("before_rows", existing.agg(F.count(F.lit(1))).scalar()).withColumn(
        "incoming_rows", incoming.agg(F.count(F.lit(1))).scalar())


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str) -> None:
    """Merge into a parquet table, rewriting only the touched partitions.

    The touched partitions are read (pruned by their values), merged and written
    to a staged copy first, because a path cannot be overwritten while it is read.
    """
    touched = incoming.select(partition).distinct()
    old = spark.read.parquet(path).join(touched, partition, "left_semi")
    merged = stage(upsert_rows(old.select(*incoming.columns), incoming, keys).drop("batch_no"), "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def align_to_calendar(panel: DataFrame, cal: DataFrame, fields: list[str]) -> DataFrame:
    """Every session of each instrument between its first and last row."""
    no = F.broadcast(cal)
    numbered = panel.join(no, "dt")
    spans = numbered.groupBy("instrument").agg(F.min("session_no").alias("a"), F.max("session_no").alias("b"))
    grid = spans.select("instrument", F.col("a").alias("start_no"), F.explode(F.sequence("a", "b")).alias("session_no")).join(no, "session_no")
    return grid.join(panel.select("instrument", "dt", *fields), ["instrument", "dt"], "left")


def materialize_daily(primary: DataFrame, fallback: DataFrame, existing: DataFrame, start: str, end: str, max_error: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Restrict, rescale the fallback, merge, upsert; rows and one evidence row per instrument."""
    def clip(df: DataFrame) -> DataFrame:
        return df.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    # Both sources and the result are read several times below; each is built once.
    p, f = stage(clip(primary), "primary"), stage(clip(fallback), "fallback")
    # One small row per instrument, used for the rescaling and for the report.
    evidence = stage(align_source_scale(p, f, max_error=max_error), "evidence")
    merged = merge_sources(p, apply_scale(f, evidence), ["instrument", "dt"]).drop("source_no")
    rows = upsert_rows(existing, merged, ["instrument", "dt"]).drop("batch_no")
    touched = merged.select("instrument").distinct()
    rows = stage(rows.join(touched, "instrument", "left_semi"), "daily")
    return rows, materialize_evidence(rows, p, f).join(evidence, "instrument")


def materialize_minute(primary: DataFrame, fallback: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merge minute sources without rescaling; primary only when no fallback is given."""
    empty = primary.where(F.lit(False)) if fallback is None else fallback
    rows = merge_sources(primary, empty, keys).drop("source_no")
    return rows, materialize_evidence(rows, primary, empty)


def materialize_evidence(rows: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    p = primary.groupBy("instrument").agg(F.count(F.lit(1)).alias("primary_rows"))
    f = fallback.groupBy("instrument").agg(F.count(F.lit(1)).alias("fallback_rows"))
    out = rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    return out.join(p, "instrument", "left").join(f, "instrument", "left").fillna(0, ["primary_rows", "fallback_rows"])
