"""A: scans, sources and sinks.

File readers are checked on CSV files that Spark first writes from the tables
into the shared scratch folder.
"""

from pyspark.sql import functions as F

from tapeloom.catalog.base import BARS, FALLBACK, MINUTES, PRIMARY, SESS, query, with_
from tapeloom.catalog.joins import SCALE
from tapeloom.operators import sessions
from tapeloom.session import scratch_path, stage
from tapeloom.sources import readers, sinks

ZH = {"dt": "日期", "instrument": "代码", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘", "volume": "成交量", "amount": "成交额"}


def _csv(df, path, encoding="UTF-8"):
    readers.allow_charset(df.sparkSession, encoding)
    df.write.option("header", "true").option("encoding", encoding).csv(path)
    return path


@query("A1_read_bars", "instrument:s dt:d open:f close:f volume:f", with_(BARS) + """
SELECT CAST(instrument AS VARCHAR) AS instrument, dt, open, CASE WHEN month(dt) = 5 THEN close*2 WHEN day(dt) = 11 THEN NULL ELSE close END AS close, volume FROM bars WHERE day(dt) <> 13 OR month(dt) = 5""")
def _(t):
    root = scratch_path(t.spark, "bars-zh")
    b = stage(t.bars(), "bars")  # four files are written from it
    text = b.select(*[F.col(c).cast("string").alias(c) for c in ZH])
    dirty = text.withColumn("close", F.when(F.day(F.col("dt").cast("date")) == 11, "n/a").otherwise(F.col("close"))).withColumn(
        "dt", F.when(F.day(F.col("dt").cast("date")) == 13, "bad").otherwise(F.col("dt")))
    later = b.where(F.month("dt") == 5).withColumn("close", F.col("close") * 2).select(*[F.col(c).cast("string").alias(c) for c in ZH])
    # Three layouts: GBK words, the same in UTF-8 with other dates, and English names in another order.
    odd = F.col("instrument").cast("int") % 3
    _csv(dirty.where(odd == 0).withColumnsRenamed(ZH), f"{root}/b0", "GBK")
    slashed = dirty.withColumn("dt", F.coalesce(F.date_format(F.col("dt").try_cast("date"), "yyyy/M/d"), F.col("dt")))
    _csv(slashed.where(odd == 1).withColumnsRenamed(ZH), f"{root}/b1")
    digits = dirty.withColumn("dt", F.coalesce(F.date_format(F.col("dt").try_cast("date"), "yyyyMMdd"), F.col("dt")))
    _csv(digits.where(odd == 2).select("instrument", F.col("dt").alias("date"), "low", "high", "close", "open", "amount", F.col("volume").alias("vol")), f"{root}/b2")
    _csv(later.withColumnsRenamed(ZH), f"{root}/c", "GBK")
    return readers.read_bars(t.spark, [root]).withColumnRenamed("date", "dt")


@query("A2_read_bar_panel", "instrument:i dt:d close:f amount:f2", with_(BARS) + "SELECT instrument, dt, close, amount FROM bars WHERE dt BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")
def _(t):
    root = scratch_path(t.spark, "panel")
    sinks.write_symbol_csv(t.bars().withColumnRenamed("dt", "date"), root, "instrument")
    return readers.read_bar_panel(t.spark, [root], "1994-01-01", "1996-12-31", r"instrument=(\d+)")


@query("A3_read_minute_bars", "instrument:s dt:d minute_of_day:i close:f volume:f factor:f", with_(MINUTES) + "SELECT instrument, dt, minute_of_day, close, volume, 1.0 AS factor FROM minutes")
def _(t):
    root = scratch_path(t.spark, "minute")
    ts = F.col("dt").cast("timestamp") + F.make_dt_interval(mins=F.col("minute_of_day"))
    _csv(t.minutes().withColumn("时间", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).withColumnRenamed("instrument", "代码").drop("dt", "minute_of_day"), root)
    return readers.read_minute_bars(t.spark, [root])


@query("A3_zip_minute_bars", "instrument:s dt:d minute_of_day:i close:f volume:f factor:f", with_(MINUTES) + "SELECT instrument, dt, minute_of_day, close, volume, 1.0 AS factor FROM minutes")
def _(t):
    root = scratch_path(t.spark, "zips")
    ts = F.col("dt").cast("timestamp") + F.make_dt_interval(mins=F.col("minute_of_day"))
    fields = {"时间": F.date_format(ts, "yyyy/M/d H:mm:ss"), "代码": F.col("instrument"), **{ZH[c]: F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume", "amount")}}
    sinks.write_zip_csv(t.minutes().select(*[c.alias(n) for n, c in fields.items()]), root, "代码")
    return readers.read_zip_minute_bars(t.spark, root)


@query("A4_source_pruning", "year:i rows:i", with_(BARS) + "SELECT year(dt) AS year, count(*) AS rows FROM bars WHERE year(dt) BETWEEN 1995 AND 1996 GROUP BY 1")
def _(t):
    root = scratch_path(t.spark, "pruned")
    stamped = t.bars().withColumn("day", F.concat((F.year("dt") + 10).cast("string"), F.date_format("dt", "MM"), F.lit("15")))
    stamped.write.partitionBy("day").parquet(root)
    kept = readers.prune_sources(t.spark.read.parquet(root), "2005-01-01", "2006-12-31")
    return kept.groupBy(F.year("dt").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


@query("A5_normalize_provider_bars", "instrument:s dt:d close:f amount:f2 limit_up:f source:s frequency:s", with_(BARS) + """
SELECT 'sh' || lpad(CAST(instrument AS VARCHAR), 6, '0') AS instrument, dt, close+1 AS close, amount, NULL AS limit_up, 'vendor' AS source, '1d' AS frequency FROM bars""")
def _(t):
    raw = t.bars().select(F.concat(F.lpad(F.col("instrument").cast("string"), 6, "0"), F.lit(".XSHG")).alias("order_book_id"), F.col("dt").alias("date"), "open", "high", "low", "close", "volume",
                          F.col("amount").alias("total_turnover"), F.lit(1).alias("seq"))
    twice = raw.unionByName(raw.withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(2)))
    return readers.normalize_provider_bars(twice, "1d", "vendor").withColumnRenamed("date", "dt")


@query("A6_unpivot_state_panel", "dt:d symbol:s flag:b", with_(BARS) + """
SELECT dt, symbol, CASE symbol WHEN 's1' THEN bool_or(instrument = 1) WHEN 's2' THEN bool_or(instrument = 2) ELSE CASE WHEN day(dt) = 1 THEN NULL ELSE bool_or(instrument = 3) END END AS flag FROM bars, (VALUES ('s1'), ('s2'), ('s3')) s(symbol) GROUP BY dt, symbol""")
def _(t):
    wide = t.bars().groupBy("dt").agg(*[F.max(F.col("instrument") == k).alias(f"s{k}") for k in (1, 2, 3)])
    wide = wide.withColumn("s3", F.when(F.day("dt") != 1, F.col("s3")))
    return readers.unpivot_state_panel(wide, "flag")


@query("A7_read_fold_predictions", "fold:i dt:d instrument:s score:f", with_(BARS) + "SELECT year(dt)-1991 AS fold, dt, CAST(instrument AS VARCHAR) AS instrument, close/open AS score FROM bars")
def _(t):
    root = scratch_path(t.spark, "folds")
    rows = t.bars().select(F.col("dt").alias("datetime"), "instrument", (F.col("close") / F.col("open")).alias("score"), F.concat(F.lit("fold_"), F.lpad((F.year("dt") - 1991).cast("string"), 2, "0")).alias("part"))
    rows.write.option("header", "true").partitionBy("part").csv(root)
    return readers.read_fold_predictions(t.spark, [root])


@query("A9_upsert_bars", "instrument:i dt:d close:f batch_no:i", with_(PRIMARY, FALLBACK) + """
SELECT instrument, dt, coalesce(f.close, p.close) AS close, CAST(f.close IS NOT NULL AS INT) AS batch_no FROM prim p FULL JOIN fall f USING (instrument, dt)""")
def _(t):
    return sinks.upsert_rows(t.primary(), t.fallback(), ["instrument", "dt"])


@query("A9_upsert_table", "year:i rows:i close:f2", with_(PRIMARY, FALLBACK) + """
SELECT year(dt) AS year, count(*) AS rows, sum(close) AS close FROM (SELECT instrument, dt, coalesce(f.close, p.close) AS close FROM prim p FULL JOIN fall f USING (instrument, dt)) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "table")
    cols = ["instrument", "dt", "close", "year"]
    t.primary().withColumn("year", F.year("dt")).select(*cols).write.partitionBy("year").parquet(path)
    sinks.upsert_table(t.spark, path, t.fallback().withColumn("year", F.year("dt")).select(*cols), ["instrument", "dt"], "year")
    return t.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close"))


@query("A9_upsert_report", "before_rows:i incoming_rows:i after_rows:i first_dt:d last_dt:d", with_(PRIMARY, FALLBACK) + """
SELECT (SELECT count(*) FROM prim) AS before_rows, (SELECT count(*) FROM fall) AS incoming_rows, count(*) AS after_rows, min(dt) AS first_dt, max(dt) AS last_dt FROM (SELECT instrument, dt FROM prim UNION SELECT instrument, dt FROM fall)""")
def _(t):
    a, b = t.primary(), t.fallback()
    return sinks.upsert_report(a, b, sinks.upsert_rows(a, b, ["instrument", "dt"]))


@query("A10_write_versioned", "year:i rows:i", with_(BARS) + "SELECT year(dt) AS year, count(*) AS rows FROM bars GROUP BY 1")
def _(t):
    path = sinks.write_versioned(t.bars().withColumn("year", F.year("dt")), scratch_path(t.spark, "published"), "v1", ["year"])
    return t.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


@query("A11_align_to_calendar", "instrument:i dt:d start_no:i session_no:i close:f", with_(BARS, SESS, "sp AS (SELECT instrument, min(session_no) AS a, max(session_no) AS b FROM bars JOIN sess USING (dt) GROUP BY 1)") + """
SELECT sp.instrument, sess.dt, a AS start_no, session_no, close FROM sp JOIN sess ON session_no BETWEEN a AND b LEFT JOIN bars ON bars.instrument = sp.instrument AND bars.dt = sess.dt""")
def _(t):
    return sinks.align_to_calendar(t.bars(), sessions.calendar(t.dates()), ["close"])


MAT = SCALE.replace("sc AS (", "sc AS (") + """, m AS (SELECT instrument, dt, coalesce(p.close, f.close*CASE WHEN status = 'aligned' THEN scale ELSE 1 END) AS close FROM prim p FULL JOIN fall f USING (instrument, dt) JOIN sc USING (instrument)),
ex AS (SELECT instrument, dt, close FROM bars WHERE dt < DATE '1993-01-01'), r AS (SELECT instrument, dt, coalesce(m.close, ex.close) AS close FROM m FULL JOIN ex USING (instrument, dt))"""


@query("A12_materialize_daily", "instrument:i rows:i first_dt:d last_dt:d primary_rows:i fallback_rows:i status:s scale:f close_sum:f2", with_(BARS, MAT, """
a AS (SELECT instrument, count(*) AS rows, min(dt) AS first_dt, max(dt) AS last_dt, sum(close) AS close_sum FROM r GROUP BY 1), b AS (SELECT instrument, count(*) AS primary_rows FROM prim GROUP BY 1), c AS (SELECT instrument, count(*) AS fallback_rows FROM fall GROUP BY 1)""") + """
SELECT * FROM a JOIN sc USING (instrument) LEFT JOIN b USING (instrument) LEFT JOIN c USING (instrument)""")
def _(t):
    old = t.bars().where(F.col("dt") < F.lit("1993-01-01").cast("date"))
    rows, evidence = sinks.materialize_daily(t.primary(), t.fallback(), old, "1900-01-01", "2099-12-31", max_error=0.5)
    return evidence.join(rows.groupBy("instrument").agg(F.sum("close").alias("close_sum")), "instrument")


@query("A13_materialize_minute", "mode:s instrument:s rows:i primary_rows:i fallback_rows:i", with_(MINUTES) + """
SELECT 'both' AS mode, instrument, count(*) AS rows, count(*) FILTER (WHERE minute_of_day % 2 = 0) AS primary_rows, count(*) FILTER (WHERE minute_of_day % 2 = 1 OR minute_of_day % 3 = 0) AS fallback_rows FROM minutes GROUP BY 2
UNION ALL SELECT 'primary', instrument, count(*), count(*), 0 FROM minutes WHERE minute_of_day % 2 = 0 GROUP BY 2""")
def _(t):
    keys = ["instrument", "dt", "minute_of_day"]
    # Every minute comes from one source, every sixth from both.
    p, f = t.minutes().where("minute_of_day % 2 = 0"), t.minutes().where("minute_of_day % 2 = 1 or minute_of_day % 3 = 0")
    outs = [sinks.materialize_minute(p, x, keys)[1].withColumn("mode", F.lit(m)) for m, x in (("both", f), ("primary", None))]
    return outs[0].unionByName(outs[1])
