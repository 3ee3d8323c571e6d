"""H: streaming jobs, drained over the event table and checked by batch twins."""

from pyspark.sql import functions as F

from tapeloom.catalog.base import query, with_
from tapeloom.session import scratch_path
from tapeloom.streaming import jobs, positions

CLOSED = "w AS (SELECT max(ts) - INTERVAL 5 MINUTE AS wm FROM events)"


def ticks(t):
    e = jobs.read_events(t.spark, t.root)
    return e.select(F.col("event_type").alias("instrument"), "ts", F.col("value").alias("price"), F.col("user_id").cast("double").alias("qty"), F.col("event_id").alias("seq"))


@query("H1_stream_minute_bars", "instrument:s dt:d minute_of_day:i open:f high:f low:f close:f volume:f amount:f4", with_(CLOSED) + """
SELECT event_type AS instrument, CAST(m AS DATE) AS dt, extract(hour FROM m)*60 + extract(minute FROM m) AS minute_of_day, open, high, low, close, volume, amount FROM (
 SELECT event_type, date_trunc('minute', ts) AS m, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, sum(user_id) AS volume, sum(value*user_id) AS amount FROM events GROUP BY ALL), w WHERE m + INTERVAL 1 MINUTE <= wm""")
def _(t):
    bars = jobs.drain(jobs.minute_bars(ticks(t)), "minute-bars")
    return bars.withColumn("dt", F.col("ts").cast("date")).withColumn("minute_of_day", F.hour("ts") * 60 + F.minute("ts"))


CANDS = """c AS (SELECT * FROM (VALUES ('click', 'buy_first', 1.0, 100.0, 150.0), ('view', 'sell_first', 250.0, 100.0, 60000.0), ('purchase', 'buy_first', 0.5, 200.0, 120.0), ('error', 'sell_first', 300.0, 100.0, 1e9), ('signup', 'sell_first', 100.0, 100.0, 22000.0)) v(instrument, direction, entry_limit, volume, budget))"""


@query("H2_stream_trigger", "instrument:s direction:s dt:d second:i price:f touches:i", with_(CLOSED, CANDS, """
h AS (SELECT event_type AS instrument, direction, CAST(ts AS DATE) AS dt, ts, event_id, value FROM events JOIN c ON event_type = instrument, w WHERE CASE WHEN direction = 'buy_first' THEN value <= entry_limit ELSE value >= entry_limit END AND 2*volume*value <= budget AND CAST(ts AS DATE) + INTERVAL 1 DAY <= wm)""") + """
SELECT instrument, direction, dt, extract(hour FROM min(ts))*3600 + extract(minute FROM min(ts))*60 + floor(extract(second FROM min(ts))) AS second, min_by(value, event_id) AS price, count(*) AS touches FROM h GROUP BY instrument, direction, dt""")
def _(t):
    base = t.raw("events").select(F.col("event_type").alias("instrument")).distinct()
    pick = {"click": ("buy_first", 1.0, 100.0, 150.0), "view": ("sell_first", 250.0, 100.0, 60000.0), "purchase": ("buy_first", 0.5, 200.0, 120.0),
            "error": ("sell_first", 300.0, 100.0, 1e9), "signup": ("sell_first", 100.0, 100.0, 22000.0)}
    rows = None
    for name, vals in pick.items():
        item = F.struct(*[F.lit(v).alias(n) for v, n in zip(vals, ("direction", "entry_limit", "volume", "budget"))])
        rows = F.when(F.col("instrument") == name, item) if rows is None else rows.when(F.col("instrument") == name, item)
    cands = base.withColumn("c", rows).where("c is not null").select("instrument", "c.*")
    out = jobs.drain(jobs.first_triggers(ticks(t), cands), "triggers")
    return out.withColumn("second", F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))


@query("H3_stream_order_state", "order_key:i dt:d instrument:i side:s status:s callbacks:i", with_(CLOSED) + """
SELECT event_id // 6 AS order_key, CAST(ts AS DATE) AS dt, max_by(user_id, event_id) AS instrument, max_by(CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END, event_id) AS side, max_by(event_type, event_id) AS status, count(*) AS callbacks
FROM events, w WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= wm GROUP BY 1, 2""")
def _(t):
    e = jobs.read_events(t.spark, t.root)
    log = e.select(F.expr("event_id div 6").alias("order_key"), F.col("user_id").alias("instrument"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
                   F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    return jobs.drain(jobs.order_states(log), "orders")


FLOW = """fl AS (SELECT user_id AS account, CAST(ts AS DATE) AS dt, coalesce(sum(floor(value)) FILTER (WHERE event_type = 'purchase'), 0) AS bought, coalesce(sum(floor(value)) FILTER (WHERE event_type = 'click'), 0) AS offered
  FROM events, w WHERE event_type IN ('purchase', 'click') AND CAST(ts AS DATE) + INTERVAL 1 DAY <= wm2 GROUP BY ALL)"""
CLOSED2 = "w AS (SELECT max(ts) - INTERVAL 5 MINUTE AS wm2 FROM events WHERE event_type IN ('purchase', 'click'))"
LEDGER_SQL = "WITH RECURSIVE " + CLOSED2 + ", " + FLOW + """, o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY dt) AS k FROM fl),
g(account, dt, k, open_available, sold, refused, unsettled, total) AS (SELECT account, dt, k, 0.0::DOUBLE, 0.0::DOUBLE, offered, bought, bought FROM o WHERE k = 1
 UNION ALL SELECT o.account, o.dt, o.k, g.open_available-g.sold+g.unsettled, least(o.offered, g.open_available-g.sold+g.unsettled), o.offered-least(o.offered, g.open_available-g.sold+g.unsettled), o.bought, g.total-least(o.offered, g.open_available-g.sold+g.unsettled)+o.bought
 FROM o JOIN g ON o.account = g.account AND o.k = g.k+1) SELECT account, dt, open_available, sold, refused, unsettled, total FROM g"""


def flows(t):
    e = jobs.read_events(t.spark, t.root).where(F.col("event_type").isin("purchase", "click"))
    log = e.select(F.col("user_id").alias("account"), "ts", F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"), F.floor("value").cast("double").alias("shares"))
    return jobs.session_flows(log)


@query("H4_t1_position_ledger", "account:i dt:d open_available:f sold:f refused:f unsettled:f total:f", LEDGER_SQL)
def _(t):
    stream = flows(t)
    daily = jobs.follow(t.spark, jobs.drain_to_path(stream, "flows"), stream.schema)
    return jobs.drain(jobs.position_ledger(daily), "ledger")


@query("H4_ledger_batch", "account:i dt:d open_available:f sold:f refused:f unsettled:f total:f", LEDGER_SQL)
def _(t):
    return jobs.ledger_batch(jobs.drain(flows(t), "flows"))


POSITIONS_SQL = "WITH RECURSIVE " + CLOSED + """,
o AS (SELECT user_id AS account, event_id % 5 AS instrument, CAST(ts AS DATE) AS session, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'reserve' WHEN 'view' THEN 'fill' WHEN 'error' THEN 'release' ELSE 'buy' END AS kind, floor(value/10)::DOUBLE AS shares,
  row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS k FROM events, w WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= wm),
g(account, instrument, session, seq, kind, shares, k, done, total, available, frozen, unsettled) AS (
 SELECT DISTINCT account, instrument, CAST(NULL AS DATE), 0::BIGINT, '', 0.0::DOUBLE, 0::BIGINT, 0.0::DOUBLE, CASE WHEN account % 3 = 0 THEN 90.0 ELSE 0.0 END::DOUBLE, CASE WHEN account % 3 = 0 THEN 60.0 ELSE 0.0 END::DOUBLE, CASE WHEN account % 3 = 0 THEN 20.0 ELSE 0.0 END::DOUBLE, CASE WHEN account % 3 = 0 THEN 30.0 ELSE 0.0 END::DOUBLE FROM o
 UNION ALL SELECT account, instrument, session, seq, kind, shares, k, done,
  t + CASE kind WHEN 'buy' THEN done WHEN 'fill' THEN -done ELSE 0 END, a - CASE WHEN kind = 'fill' THEN done ELSE 0 END, f + CASE kind WHEN 'reserve' THEN done WHEN 'buy' THEN 0 ELSE -done END, u + CASE WHEN kind = 'buy' THEN done ELSE 0 END
 FROM (SELECT *, CASE kind WHEN 'buy' THEN shares WHEN 'reserve' THEN least(shares, greatest(a-f, 0)) WHEN 'release' THEN least(shares, f) ELSE CASE WHEN shares > f + 1e-9 THEN 0 ELSE shares END END AS done
  FROM (SELECT o.*, g.total AS t, g.frozen AS f, CASE WHEN o.session > g.session THEN least(g.total, g.available+g.unsettled) ELSE g.available END AS a, CASE WHEN o.session > g.session THEN 0 ELSE g.unsettled END AS u
   FROM o JOIN g ON o.account = g.account AND o.instrument = g.instrument AND o.k = g.k+1)))
SELECT account, instrument, session, seq, kind, shares, done, total, available, frozen, unsettled FROM g WHERE k > 0"""
POSITIONS = "account:i instrument:i session:d seq:i kind:s shares:f done:f total:f available:f frozen:f unsettled:f"


def order_events(t, stream=True):
    e = jobs.read_events(t.spark, t.root) if stream else t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "click", "reserve").when(F.col("event_type") == "view", "fill").when(F.col("event_type") == "error", "release").otherwise("buy")
    return e.select(F.col("user_id").alias("account"), (F.col("event_id") % 5).alias("instrument"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.floor(F.col("value") / 10).alias("shares"))


def opening(t):
    keys = t.raw("events").where("user_id % 3 = 0").select(F.col("user_id").alias("account"), (F.col("event_id") % 5).alias("instrument")).distinct()
    return keys.withColumns({"total": F.lit(90.0), "available": F.lit(60.0), "frozen": F.lit(20.0), "unsettled": F.lit(30.0)})


@query("H4_order_positions", POSITIONS, POSITIONS_SQL)
def _(t):
    return jobs.drain(positions.position_events(order_events(t), opening(t), overfill="refuse"), "positions")


@query("H4_order_positions_batch", POSITIONS, POSITIONS_SQL)
def _(t):
    events = order_events(t, stream=False)
    closed = events.agg((F.max("ts") - F.expr("INTERVAL 5 MINUTE")).alias("wm"))
    events = events.join(F.broadcast(closed), F.date_add(F.col("ts").cast("date"), 1).cast("timestamp") <= F.col("wm")).drop("wm")
    return positions.position_history(events, opening(t), overfill="refuse")


@query("H5_stream_throttle", "instrument:s dt:d second:i price:f forced:b", "WITH RECURSIVE " + CLOSED + """,
s AS (SELECT event_type AS instrument, CAST(m AS DATE) AS dt, extract(hour FROM m)*3600+extract(minute FROM m)*60+CAST(extract(second FROM m) AS BIGINT) AS sec, price FROM (SELECT event_type, date_trunc('second', ts) AS m, min_by(value, event_id) AS price FROM events GROUP BY ALL), w WHERE m + INTERVAL 1 SECOND <= wm),
z AS (SELECT * FROM s WHERE sec BETWEEN 21600 AND 72000),
g(instrument, dt, sec) AS (SELECT instrument, dt, min(sec) FROM z GROUP BY 1, 2 UNION ALL SELECT z.instrument, z.dt, min(z.sec) FROM g JOIN z ON z.instrument = g.instrument AND z.dt = g.dt AND z.sec >= g.sec+3600 GROUP BY 1, 2)
SELECT g.instrument, g.dt, g.sec AS second, price, g.sec >= 68400 AS forced FROM g JOIN z USING (instrument, dt, sec)
UNION ALL SELECT z.instrument, z.dt, 72000, max_by(price, z.sec), true FROM z WHERE z.dt + INTERVAL 72001 SECOND <= (SELECT max(dt + to_seconds(sec)) FROM s)
 AND NOT EXISTS (SELECT 1 FROM g WHERE g.instrument = z.instrument AND g.dt = z.dt AND g.sec >= 68400) GROUP BY 1, 2""")
def _(t):
    stream = jobs.second_ticks(ticks(t))
    seconds = jobs.follow(t.spark, jobs.drain_to_path(stream, "seconds"), stream.schema)
    out = jobs.drain(jobs.throttle(seconds, interval=3600, start=6 * 3600, end=20 * 3600, force_from=19 * 3600), "throttle")
    return out.withColumn("second", F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))


@query("H6_late_and_stale", "verdict:s n:i first_id:i", """
SELECT verdict, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, CASE WHEN a < 0 THEN 'future' WHEN a = 0 THEN 'same_day' WHEN a > 4 THEN 'stale' WHEN extract(hour FROM ts)*3600+extract(minute FROM ts)*60+floor(extract(second FROM ts)) > 54000 THEN 'late' ELSE 'fresh' END AS verdict
FROM (SELECT event_id, ts, user_id % 8 - 1 AS a FROM events)) GROUP BY 1""")
def _(t):
    e = jobs.read_events(t.spark, t.root).withColumn("signal_dt", F.date_sub(F.col("ts").cast("date"), (F.col("user_id") % 8 - 1).cast("int")))
    out = jobs.drain(jobs.flag_decisions(e, max_age=4, cutoff_second=54000).select("event_id", "verdict"), "verdicts")
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("H6_late_counts", "batch:i rows:i late:i latest:s", """
WITH a AS (SELECT event_id, ts, least(7, event_id * 8 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 10 = 3 THEN 2 ELSE 0 END) AS batch FROM events),
m AS (SELECT batch, max(ts) AS top FROM a GROUP BY 1), w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 MINUTE AS wm FROM m)
SELECT batch, count(*) AS rows, count(*) FILTER (WHERE ts < wm) AS late, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM a JOIN w USING (batch) GROUP BY 1""")
def _(t):
    # The event table comes in eight files; every tenth event arrives two files after its time.
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    top = e.agg((F.max("event_id") + 1).alias("n"))
    own = F.floor(F.col("event_id") * 8 / F.col("n")) + F.when(F.col("event_id") % 10 == 3, 2).otherwise(0)
    parts = e.join(F.broadcast(top), how="cross").withColumn("part", F.least(F.lit(7), own).cast("int")).select("event_id", "ts", "part")
    folder = scratch_path(t.spark, "arriving")
    parts.repartition(1).sortWithinPartitions("part").write.partitionBy("part").parquet(folder)
    stream = t.spark.readStream.schema("event_id bigint, ts timestamp, part int").option("maxFilesPerTrigger", 1).parquet(folder)
    got = jobs.arrivals(stream, "arrivals")
    return got.groupBy(F.col("part").alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("H1_closed_bars", "instrument:s dt:d minute_of_day:i open:f high:f low:f close:f volume:f amount:f4", """
SELECT event_type AS instrument, CAST(m AS DATE) AS dt, extract(hour FROM m)*60 + extract(minute FROM m) AS minute_of_day, open, high, low, close, volume, amount FROM (
 SELECT event_type, date_trunc('minute', ts) AS m, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, sum(user_id) AS volume, sum(value*user_id) AS amount FROM events GROUP BY ALL)""")
def _(t):
    end = t.raw("events").agg(F.date_add(F.max("ts").cast("date"), 2)).first()[0]
    bars = jobs.drain(jobs.minute_bars(jobs.with_close(ticks(t), str(end))), "closed-bars")
    return bars.withColumn("dt", F.col("ts").cast("date")).withColumn("minute_of_day", F.hour("ts") * 60 + F.minute("ts"))


@query("H7_session_summary", "dt:d events:i done:i missing:s blocked:i closed:b", with_(CLOSED, """
d AS (SELECT CAST(ts AS DATE) AS dt, count(*) AS events, count(*) FILTER (WHERE event_type = 'signup' AND user_id < 4) AS a, count(*) FILTER (WHERE event_type = 'purchase') AS b, count(*) FILTER (WHERE event_type = 'error' AND value > 200) AS c,
 count(*) FILTER (WHERE value > 300) AS blocked, count(*) FILTER (WHERE extract(hour FROM ts) = 23) AS cl FROM events, w WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= wm GROUP BY 1)""") + """
SELECT dt, events, CAST(a > 0 AS INT)+CAST(b > 0 AS INT)+CAST(c > 0 AS INT) AS done, concat_ws(',', CASE WHEN a = 0 THEN 'early' END, CASE WHEN b = 0 THEN 'trade' END, CASE WHEN c = 0 THEN 'alarm' END) AS missing, blocked, cl > 0 AS closed FROM d""")
def _(t):
    e = jobs.read_events(t.spark, t.root)
    kind = F.col("event_type")
    log = e.select("ts", F.when((kind == "signup") & (F.col("user_id") < 4), "early").when(kind == "purchase", "trade").when((kind == "error") & (F.col("value") > 200), "alarm").alias("decision"),
                   (F.col("value") > 300).alias("blocked"), (F.hour("ts") == 23).alias("is_close"))
    return jobs.drain(jobs.session_summary(log, ["early", "trade", "alarm"]), "sessions")
