"""Bar, prediction and state readers over CSV, ZIP and parquet files."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.symbols import normalize_symbol
from tapeloom.operators.reconcile import latest_per_key
from tapeloom.session import spread_by, stage
from tapeloom.sources import files

# Accepted header spellings per canonical column, and the canonical columns themselves.
SYNONYMS = {
    "date": ["date", "datetime", "trade_date", "日期", "时间", "交易日期"],
    "instrument": ["instrument", "symbol", "代码", "股票代码"],
    "open": ["open", "开盘", "开盘价"],
    "high": ["high", "最高", "最高价"],
    "low": ["low", "最低", "最低价"],
    "close": ["close", "收盘", "收盘价"],
    "volume": ["volume", "vol", "成交量"],
    "amount": ["amount", "total_turnover", "成交额"],
    "limit_up": ["limit_up", "涨停价"],
    "limit_down": ["limit_down", "跌停价"],
    "prev_close": ["prev_close", "昨收", "前收盘"],
}
REQUIRED = ["date", "open", "high", "low", "close", "volume", "amount"]
OPTIONAL = ["limit_up", "limit_down", "prev_close"]
BAR_NUMBERS = REQUIRED[1:]


def canonical_columns(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rename by synonym and coerce numbers; unparsable numbers become null."""
    found = {}
    for name, words in SYNONYMS.items():
        hit = [c for c in df.columns if c.strip().lstrip("﻿") in words]
        if hit:
            found[name] = F.coalesce(*[F.col(f"`{c}`") for c in hit])
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"missing bar columns: {missing}")
    cols = [F.trim(found["date"]).alias("date")]
    if "instrument" in found:
        cols.append(found["instrument"].cast("string").alias("instrument"))
    cols += [found[c].try_cast("double").alias(c) for c in [*BAR_NUMBERS, *OPTIONAL] if c in found]
    return df.select(*cols, *(extra or []))


def _first_line(stream, step: int = 1 << 16) -> bytes | None:
    """The first line of an open file without its end, or None; reads no further than it must."""
    head = b""
    while b"\n" not in head and (piece := stream.read(step)):
        head += piece
    return head.split(b"\n", 1)[0].rstrip(b"\r") if head else None


def _decoded(head: bytes) -> tuple[str, str]:
    """A header and its charset: UTF-8 if it is valid, else GBK."""
    for charset in ("UTF-8", "GBK"):
        try:
            return head.decode(charset).lstrip("\ufeff"), charset
        except UnicodeDecodeError:
            continue
    raise ValueError(f"header is neither UTF-8 nor GBK: {head[:80]!r}")


def listed(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """`path` of every file under the paths, from their listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths).select("path")


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, head, charset) of every file that has a line; tasks read the first block of each file only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                with files.reader(path) as stream:
                    head = _first_line(stream)
                if head is not None:
                    found.append((path, *_decoded(head)))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in found], pa.string()) for k, c in enumerate(("path", "head", "charset"))})

    return listed(spark, paths).mapInArrow(run, "path string, head string, charset string")


def gbk_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files whose header is not valid UTF-8."""
    return [r["path"] for r in file_headers(spark, paths).where("charset = 'GBK'").orderBy("path").collect()]


def _load_order() -> Column:
    """Row order over files: path, block offset, position in the block."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark accepts only Unicode and Latin CSV charsets unless told otherwise."""
    if encoding.upper() not in ("UTF-8", "UTF-16", "ISO-8859-1", "US-ASCII"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def header_names(head: str) -> list[str]:
    """Column names of a header line; a repeated one gets its position."""
    names = next(csv.reader([head]), [])
    return [n if n not in names[:k] else f"{n}#{k}" for k, n in enumerate(names)]


def read_csv_text(spark: SparkSession, paths: list[str], encoding: str | None = None) -> list[DataFrame]:
    """The files as text columns, one frame per different header and charset.

    Each file is read under its own header, so files may order, name and omit
    columns differently. `encoding` overrides the charset found per file. Adds
    the load order `_o` and the path `_f`. The number of frames is that of the
    layouts in use; without files there are none. Only the layouts come to the
    driver, and file names where there are several.
    """
    heads = stage(file_headers(spark, paths), "heads")
    layouts = [(r["head"], r["charset"]) for r in heads.select("head", "charset").distinct().orderBy("head", "charset").collect()]
    frames = []
    for head, found in layouts:
        charset = encoding or found
        allow_charset(spark, charset)
        own = paths
        if len(layouts) > 1:
            own = [r["path"] for r in heads.where((F.col("head") == head) & (F.col("charset") == found)).orderBy("path").collect()]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header_names(head)])
        raw = spark.read.schema(schema).option("recursiveFileLookup", "true").option("header", "true").option("encoding", charset).csv(own)
        frames.append(raw.select("*", _load_order().alias("_o"), F.col("_metadata.file_path").alias("_f")))
    return frames


# Accepted spellings besides ISO dates; a stamp may carry a time of day.
STAMPS = ("yyyyMMdd", "yyyy/M/d", "yyyyMMddHHmmss", "yyyyMMdd HH:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d H:mm:ss")


def parse_stamp(text: Column) -> Column:
    """Timestamp from ISO or one of `STAMPS`, else null.

    Eight digits are a date: the ISO reading of such a string as a year is not
    asked for.
    """
    plain = F.trim(text)
    iso = F.when(~plain.rlike(r"^\d+$"), F.try_to_timestamp(plain))
    return F.coalesce(iso, *[F.try_to_timestamp(plain, F.lit(p)) for p in STAMPS])


def _bar_rows(texts: list[DataFrame], place: object, instrument_from_path: str | None, minute: bool) -> DataFrame:
    frames = [canonical_columns(f, ["_o", "_f"]) for f in texts]
    if not frames:
        raise ValueError(f"no file with a header under {place}")
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    if instrument_from_path:
        out = out.withColumn("instrument", F.regexp_extract("_f", instrument_from_path, 1))
    stamp = parse_stamp(F.col("date"))
    return out.withColumn("_text", F.col("date")).withColumn("date", stamp if minute else stamp.cast("date"))


def read_bars(spark: SparkSession, paths: list[str], *, encoding: str | None = None, instrument_from_path: str | None = None,
              minute: bool = False) -> DataFrame:
    """Bars from CSV: rename, coerce, drop bad dates, keep the last row per key.

    `instrument_from_path` is a pattern whose first group is the instrument, for
    layouts with one file per symbol. `dropped_rows` counts what bad dates cost.
    """
    out = _bar_rows(read_csv_text(spark, paths, encoding), paths, instrument_from_path, minute).where("date is not null").drop("_f", "_text")
    return latest_per_key(out, ["instrument", "date"], F.col("_o")).drop("_o")


def dropped_rows(spark: SparkSession, paths: list[str], *, encoding: str | None = None) -> DataFrame:
    """Per file its rows, those without a usable date, and one such text."""
    bad = F.col("date").isNull()
    return _bar_rows(read_csv_text(spark, paths, encoding), paths, None, True).groupBy(F.col("_f").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("dropped"), F.max(F.when(bad, F.col("_text"))).alias("example"))


def read_bar_panel(spark: SparkSession, paths: list[str], start: str, end: str, instrument_from_path: str) -> DataFrame:
    """One long panel of per-symbol files inside [start, end]."""
    bars = read_bars(spark, paths, instrument_from_path=instrument_from_path)
    return bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumnRenamed("date", "dt")


def read_minute_bars(spark: SparkSession, paths: list[str], encoding: str | None = None, instrument_from_path: str | None = None) -> DataFrame:
    """Minute bars with session date, minute of day and factor 1."""
    bars = read_bars(spark, paths, encoding=encoding, instrument_from_path=instrument_from_path, minute=True)
    return add_minute_columns(bars)


def add_minute_columns(bars: DataFrame) -> DataFrame:
    return bars.withColumnsRenamed({"date": "ts"}).withColumns({
        "dt": F.col("ts").cast("date"), "minute_of_day": F.hour("ts") * 60 + F.minute("ts"), "factor": F.lit(1.0)})


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, head, charset) of every member with a line of the ZIP files under a path.

    A task reads an archive's directory, at its end, and the first line of each
    member; nothing else of the archive is touched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column("path").to_pylist():
                found = []
                with files.reader(place) as stream, zipfile.ZipFile(stream) as archive:
                    for item in archive.infolist():
                        if item.is_dir():
                            continue
                        with archive.open(item) as handle:
                            head = _first_line(handle)
                        if head is not None:
                            found.append((place, item.filename, *_decoded(head)))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in found], pa.string()) for k, c in enumerate(("path", "member", "head", "charset"))})

    return listed(spark, [path], "*.zip").mapInArrow(run, "path string, member string, head string, charset string")


def _zip_lines(size: int):
    """Lines after the header of each member, decoded, in batches of about `size` characters."""

    def batch_of(name: str, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_pydict({"_f": pa.array([name] * n, pa.string()), "ordinal": pa.array(range(first, first + n), pa.int64()), "line": pa.array(lines, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (r["path"], r["member"]))
            for path, members in groupby(rows, key=lambda r: r["path"]):
                with files.reader(path) as stream, zipfile.ZipFile(stream) as archive:
                    for item in members:
                        name, lines, held, done = f"{path}!{item['member']}", [], 0, 0
                        with archive.open(item["member"]) as raw, io.TextIOWrapper(raw, item["charset"]) as text:
                            next(text)
                            for line in text:
                                lines.append(line.rstrip("\r\n"))
                                held += len(line)
                                if held >= size:
                                    yield batch_of(name, done, lines)
                                    lines, held, done = [], 0, done + len(lines)
                        if lines:
                            yield batch_of(name, done, lines)

    return run


def read_zip_text(spark: SparkSession, path: str, batch_chars: int = 4_000_000) -> list[DataFrame]:
    """CSV members of ZIP files as text columns, one frame per different header.

    Members, not archives, are dealt to tasks; a task seeks its members in the
    archive and streams their lines, which Spark parses. Adds `_o` and `_f`
    (archive!member) as `read_csv_text` does.
    """
    members = stage(zip_members(spark, path), "members")
    frames = []
    for row in members.select("head").distinct().orderBy("head").collect():
        own = spread_by(members.where(F.col("head") == row["head"]).select("path", "member", "charset"), "path", "member")
        fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in header_names(row["head"]))
        lines = own.mapInArrow(_zip_lines(batch_chars), "_f string, ordinal long, line string").where(F.trim("line") != "")
        frames.append(lines.select(F.from_csv("line", fields).alias("_c"), F.struct("_f", "ordinal").alias("_o"), "_f").select("_c.*", "_o", "_f"))
    return frames


def read_zip_minute_bars(spark: SparkSession, path: str, instrument_from_path: str | None = None) -> DataFrame:
    """Minute bars from CSV members of ZIP files; a member without a required column is refused.

    Members without an instrument column have none, unless `instrument_from_path`
    finds it in archive!member.
    """
    out = _bar_rows(read_zip_text(spark, path), path, instrument_from_path, True).where("date is not null").drop("_f", "_text")
    if "instrument" not in out.columns:
        out = out.withColumn("instrument", F.lit(None).cast("string"))
    return add_minute_columns(latest_per_key(out, ["instrument", "date"], F.col("_o")).drop("_o"))


def path_in_window(path: Column, start: str, end: str) -> Column:
    """False only for paths dated (20YYMMDD, else 20YY) outside the window."""
    days = F.regexp_extract_all(path, F.lit(r"(?<!\d)(20\d{6})(?!\d)"), F.lit(1))
    years = F.regexp_extract_all(path, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    lo, hi = start.replace("-", ""), end.replace("-", "")
    day_ok = F.exists(days, lambda d: d.between(lo, hi))
    year_ok = F.exists(years, lambda y: y.between(lo[:4], hi[:4]))
    return F.when(F.size(days) > 0, day_ok).when(F.size(years) > 0, year_ok).otherwise(F.lit(True))


def prune_sources(df: DataFrame, start: str, end: str) -> DataFrame:
    """Skip files dated outside the window (a filter on the file path alone, so
    it is applied while listing files)."""
    return df.where(path_in_window(F.col("_metadata.file_path"), start, end))


def read_fold_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Predictions of `fold_<n>` files with their fold; a repeated key raises."""
    raw = spark.read.option("header", "true").option("recursiveFileLookup", "true").schema("datetime string, instrument string, score string").csv(paths)
    fold = F.regexp_extract(F.col("_metadata.file_path"), r"fold_0*(\d+)", 1).cast("int")
    rows = raw.select(fold.alias("fold"), F.col("datetime").try_cast("date").alias("dt"), "instrument", F.col("score").try_cast("double").alias("score"))
    grouped = rows.groupBy("dt", "instrument").agg(F.count(F.lit(1)).alias("_n"), F.max("fold").alias("fold"), F.max("score").alias("score"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate prediction for "), "instrument")).cast("boolean")).otherwise(F.lit(True))
    return grouped.where(bad).drop("_n")


def normalize_provider_bars(df: DataFrame, frequency: str, source: str) -> DataFrame:
    """Vendor frame to the canonical schema; an empty input keeps it too.

    Missing numeric columns are null; the last load ordinal (`seq`) wins per
    (instrument, date).
    """
    if "order_book_id" not in df.columns:
        raise ValueError("provider frame lacks order_book_id")
    stamp = "datetime" if "datetime" in df.columns else "date"
    numbers = [*BAR_NUMBERS, *OPTIONAL]
    have = {("amount" if c == "total_turnover" else c): c for c in df.columns}
    cols = [F.col(have[c]).cast("string").try_cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in numbers]
    out = df.select(F.try_to_timestamp(F.col(stamp).cast("string")).alias("date"), normalize_symbol(F.col("order_book_id")).alias("instrument"), *cols, "seq")
    out = latest_per_key(out.where("date is not null"), ["instrument", "date"], F.col("seq")).drop("seq")
    return out.withColumns({"source": F.lit(source), "frequency": F.lit(frequency), "adjust_type": F.lit("pre")})


def unpivot_state_panel(wide: DataFrame, field: str) -> DataFrame:
    """Wide date x symbol flags to long rows, nulls kept."""
    symbols = [c for c in wide.columns if c != "dt"]
    return wide.unpivot(["dt"], symbols, "symbol", field)
