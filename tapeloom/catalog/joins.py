"""C: joins."""

from pyspark.sql import functions as F

from tapeloom.catalog.base import BARS, BARS_W, FALLBACK, MINUTES, PRIMARY, SESS, query, with_
from tapeloom.catalog.windows import CUST_DAYS, ELIG, INTERVALS, W, _eligible, cust_days, scored_w
from tapeloom.functions.trading import BASE_COSTS, STRESS_COSTS
from tapeloom.operators import asof, evaluation, intraday, reconcile, rolling, sessions


def cal(t):
    return sessions.calendar(t.dates())


@query("A8_read_calendar", "dt:d session_no:i", with_(SESS) + "SELECT dt, row_number() OVER (ORDER BY dt) AS session_no FROM sess WHERE dt BETWEEN DATE '1994-01-01' AND DATE '1999-12-31'")
def _(t):
    return sessions.calendar(t.dates(), "1994-01-01", "1999-12-31")


@query("C1_next_session_map", "dt:d next_dt:d", with_(SESS) + "SELECT * FROM (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next_dt FROM sess) WHERE next_dt IS NOT NULL")
def _(t):
    return sessions.next_session_map(cal(t))


@query("C2_shift_sessions", "o_orderkey:i dt:d shifted:d kept:d", with_(SESS, """
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders), d AS (SELECT dt, (SELECT count(*) FROM sess s WHERE s.dt <= x.dt) + 3 AS k FROM (SELECT DISTINCT dt FROM o) x)""") + """
SELECT o_orderkey, o.dt, s.dt AS shifted, coalesce(s.dt, o.dt) AS kept FROM o JOIN d USING (dt) LEFT JOIN sess s ON session_no = k""")
def _(t):
    orders = t.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"))
    out = sessions.shift_sessions(orders, cal(t), 3)
    return sessions.shift_sessions(out, cal(t), 3, out="kept", past_end="keep")


@query("C3_signal_frame_join", "signal_dt:d trade_dt:d instrument:i score:f eligible:b trade_open:f trade_close:f", with_(BARS, ELIG, SESS, f"""
sg AS (SELECT instrument, dt, close/lag(close, 5) OVER ({W})-1 AS score FROM bars), nx AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS n FROM sess)""") + """
SELECT sg.dt AS signal_dt, n AS trade_dt, instrument, score, e.eligible, p.open AS trade_open, p.close AS trade_close
FROM sg JOIN nx USING (dt) LEFT JOIN elig e USING (dt, instrument) JOIN (SELECT instrument, dt AS n, open, close FROM bars) p USING (n, instrument) WHERE score IS NOT NULL""")
def _(t):
    signals = t.bars().withColumn("score", rolling.past_return(5)).where("score is not null").select("instrument", "dt", "score")
    return reconcile.signal_frame(signals, _eligible(t), t.bars(), sessions.next_session_map(cal(t)))


@query("C4_pit_group_join", "o_orderkey:i instrument:i dt:d grp:s", with_(INTERVALS, """
iv2 AS (SELECT instrument, prio AS g, start_dt, CASE WHEN instrument % 3 = 0 AND days = 1 THEN NULL WHEN instrument % 3 = 1 THEN end_dt + 200 ELSE end_dt END AS end_dt FROM ivf),
r AS (SELECT o_orderkey, o_custkey AS instrument, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) - 10 AS dt FROM orders),
m AS (SELECT r.o_orderkey, max_by(g, start_dt) AS g FROM r JOIN iv2 ON r.instrument = iv2.instrument AND dt BETWEEN start_dt AND coalesce(end_dt, DATE '2099-12-31') GROUP BY 1)""") + """
SELECT o_orderkey, instrument, dt, coalesce(g, '__UNKNOWN__') AS grp FROM r LEFT JOIN m USING (o_orderkey)""")
def _(t):
    iv = rolling.compress_intervals(cust_days(t), ["prio", "st"], "2002-12-31")
    m = F.col("instrument") % 3
    end = F.when((m == 0) & (F.col("days") == 1), F.lit(None)).when(m == 1, F.date_add("end_dt", 200)).otherwise(F.col("end_dt"))
    iv = iv.select("instrument", F.col("prio").alias("grp"), "start_dt", end.alias("end_dt"))
    rows = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("instrument"),
                                  F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40 - 10).cast("int")).alias("dt"))
    return asof.pit_group_join(rows, iv)


@query("C4_overlapping_intervals", "o_orderkey:i instrument:i dt:d grp:s", """WITH
iv AS (SELECT o_custkey AS instrument, 'g' || o_orderkey % 97 AS g, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7919 % 1500 AS INT) AS e FROM orders),
one AS (SELECT instrument, s, max(e) AS e, max_by(g, (e, g)) AS g FROM iv GROUP BY 1, 2),
r AS (SELECT o_orderkey, o_custkey AS instrument, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS dt FROM orders),
m AS (SELECT r.o_orderkey, max_by(g, s) AS g FROM r JOIN one ON r.instrument = one.instrument AND dt BETWEEN s AND e GROUP BY 1)
SELECT o_orderkey, instrument, dt, coalesce(g, '__UNKNOWN__') AS grp FROM r LEFT JOIN m USING (o_orderkey)""")
def _(t):
    # Every order opens an interval of up to four years, so that a customer's intervals overlap many times.
    o = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("instrument"), F.col("o_orderdate").cast("date").alias("day"))
    key = F.col("o_orderkey")
    iv = o.select("instrument", F.concat(F.lit("g"), key % 97).alias("grp"), F.col("day").alias("start_dt"), F.date_add("day", (key * 7919 % 1500).cast("int")).alias("end_dt"))
    rows = o.select("o_orderkey", "instrument", F.date_add("day", (key % 400).cast("int")).alias("dt"))
    return asof.pit_group_join(rows, iv)


SNAP = """snap AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS snap_dt, l_suppkey AS instrument, sum(l_quantity) AS shares FROM lineitem GROUP BY ALL)"""


def snapshots(t):
    return t.raw("lineitem").groupBy(F.date_trunc("quarter", "l_shipdate").cast("date").alias("snap_dt"), F.col("l_suppkey").alias("instrument")).agg(
        F.sum("l_quantity").alias("shares"))


@query("C5_snapshot_asof", "dt:d names:i shares:f", with_(SNAP, SESS, """
d AS (SELECT dt, (SELECT max(snap_dt) FROM snap WHERE snap_dt <= dt) AS snap_dt FROM sess)""") + """
SELECT dt, count(*) AS names, sum(shares) AS shares FROM d JOIN snap USING (snap_dt) GROUP BY dt""")
def _(t):
    rows = asof.snapshot_asof(snapshots(t), t.dates())
    return rows.groupBy("dt").agg(F.count(F.lit(1)).alias("names"), F.sum("shares").alias("shares"))


CTX = BARS_W + f""", ctx AS (SELECT h.dt, h.instrument, h.shares, h.mark_price, h.weight, t.trade_dt, t.open_exec, t.close_exec, coalesce(g.target_weight, 0) AS target_weight,
  coalesce(g.target_shares, 0) AS target_shares, CAST(g.dt IS NULL AS INT) AS target_missing FROM
  (SELECT dt, instrument, volume*10 AS shares, close AS mark_price, 0.01 AS weight FROM barsw WHERE volume > 30) h
  LEFT JOIN (SELECT dt, instrument, 0.02 AS target_weight, volume*12 AS target_shares FROM barsw WHERE volume < 90) g USING (dt, instrument)
  LEFT JOIN (SELECT n.dt, n.trade_dt, instrument, open AS open_exec, close AS close_exec FROM (SELECT dt, lead(dt) OVER (ORDER BY dt) AS trade_dt FROM (SELECT DISTINCT dt FROM barsw)) n
    JOIN barsw b ON b.dt = n.trade_dt) t USING (dt, instrument))"""


def context(t):
    b = t.bars_w()
    held = b.where("volume > 30").select("dt", "instrument", (F.col("volume") * 10).alias("shares"), F.col("close").alias("mark_price"), F.lit(0.01).alias("weight"))
    targets = b.where("volume < 90").select("dt", "instrument", F.lit(0.02).alias("target_weight"), (F.col("volume") * 12).alias("target_shares"), F.lit(1).alias("rank"))
    windows = b.select("dt", "instrument", F.col("open").alias("open_exec"), F.col("close").alias("close_exec"))
    nxt = sessions.next_session_map(sessions.calendar(b.select("dt")))
    return reconcile.position_context(held, targets, windows, nxt, BASE_COSTS)


@query("C6_position_context", "dt:d instrument:i trade_dt:d target_missing:i weight_gap:f share_ratio:f open_gap:f4 close_gap:f4 intraday_ret:f4 edge:f4 hit:f strong_hit:f", with_(CTX) + """
SELECT dt, instrument, trade_dt, target_missing, target_weight-weight AS weight_gap, target_shares/(shares+1e-12) AS share_ratio, open_exec/(mark_price+1e-12)-1 AS open_gap,
 close_exec/(mark_price+1e-12)-1 AS close_gap, close_exec/(open_exec+1e-12)-1 AS intraday_ret, e AS edge, CAST(coalesce(e > 0, false) AS INT) AS hit, CAST(coalesce(e > 0.002, false) AS INT) AS strong_hit
FROM (SELECT *, (open_exec*0.9998-close_exec*1.0002)/(mark_price+1e-12)-0.0015-0.0005 AS e FROM ctx)""")
def _(t):
    return context(t)


@query("C7_outer_merge_layers", "dt:d instrument:i a:f b:f c:f", with_(PRIMARY, FALLBACK, BARS_W) + """
SELECT dt, instrument, p.close AS a, f.close AS b, w.close AS c FROM prim p FULL JOIN fall f USING (dt, instrument)
 FULL JOIN barsw w USING (dt, instrument)""")
def _(t):
    tables = [t.primary(), t.fallback(), t.bars_w()]
    return reconcile.outer_merge([d.select("dt", "instrument", F.col("close").alias(n)) for d, n in zip(tables, "abc")], ["dt", "instrument"])


@query("C8_key_partition", "part:s n:i", with_(PRIMARY, FALLBACK) + """
SELECT 'shared' AS part, count(*) AS n FROM prim JOIN fall USING (instrument, dt) UNION ALL SELECT 'new_only', count(*) FROM prim ANTI JOIN fall USING (instrument, dt)
UNION ALL SELECT 'old_only', count(*) FROM fall ANTI JOIN prim USING (instrument, dt)""")
def _(t):
    parts = reconcile.key_partition(t.primary(), t.fallback(), ["instrument", "dt"])
    out = [d.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(n)) for n, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("C9_incremental_refresh", "instrument:i dt:d feature:f weight:f ratio:f reused:b", with_(PRIMARY, BARS) + """
SELECT b.instrument, b.dt, coalesce(p.close, b.close*2) AS feature, b.volume AS weight, coalesce(p.close, b.close*2)/b.volume AS ratio, p.close IS NOT NULL AS reused
FROM bars b LEFT JOIN prim p USING (instrument, dt)""")
def _(t):
    cached = t.primary().select("instrument", "dt", F.col("close").alias("feature"), F.lit(0.0).alias("weight"))
    context_rows = t.bars().select("instrument", "dt", F.col("volume").alias("weight"), "close")
    out = reconcile.incremental_refresh(
        cached, context_rows, ["instrument", "dt"], ["weight"],
        lambda new: new.select("instrument", "dt", (F.col("close") * 2).alias("feature"), "weight"))
    return out.withColumn("ratio", F.col("feature") / F.col("weight"))


@query("C10_blocklist_filter", "kept:i dropped:i kept_amount:f2", with_(BARS) + """
SELECT count(*) FILTER (WHERE s_acctbal >= 0) AS kept, count(*) FILTER (WHERE s_acctbal < 0) AS dropped, sum(amount) FILTER (WHERE s_acctbal >= 0) AS kept_amount
FROM bars JOIN supplier ON instrument = s_suppkey""")
def _(t):
    blocked = t.raw("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("instrument"))
    kept, dropped = reconcile.split_blocked(t.bars(), blocked)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("amount").alias("kept_amount")).withColumn("dropped", dropped.agg(F.count(F.lit(1))).scalar())


FILLS = """lf AS (SELECT CAST(o_orderdate AS DATE) AS dt, o_custkey AS instrument, o_orderpriority AS side, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS amount FROM orders GROUP BY ALL),
rf AS (SELECT CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 = 0 AS INT) AS dt, o_custkey AS instrument, o_orderpriority AS side, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS volume, sum(l_extendedprice) AS amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


@query("C11_reconcile_fills", "left_keys:i right_keys:i matched:i left_only:i right_only:i volume_mismatch:i volume_diff:f amount_diff:f2", with_(FILLS) + """
SELECT count(l.volume) AS left_keys, count(r.volume) AS right_keys, count(l.volume + r.volume) AS matched, count(*) FILTER (WHERE r.volume IS NULL) AS left_only, count(*) FILTER (WHERE l.volume IS NULL) AS right_only,
 count(*) FILTER (WHERE abs(coalesce(l.volume,0)-coalesce(r.volume,0)) > 1e-9) AS volume_mismatch, sum(coalesce(l.volume,0)-coalesce(r.volume,0)) AS volume_diff, sum(coalesce(l.amount,0)-coalesce(r.amount,0)) AS amount_diff
FROM lf l FULL JOIN rf r USING (dt, instrument, side)""")
def _(t):
    o = t.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"), F.col("o_custkey").alias("instrument"), F.col("o_orderpriority").alias("side"), "o_totalprice")
    lines = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("x"))
    keys = ["dt", "instrument", "side"]
    left = o.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("volume"), F.sum("o_totalprice").alias("amount"))
    # A seventh of the fills is booked a day later, so that keys differ between the sides.
    booked = o.join(lines, "o_orderkey").withColumn("dt", F.date_add("dt", (F.col("o_orderkey") % 7 == 0).cast("int")))
    right = booked.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("volume"), F.sum("x").alias("amount"))
    return reconcile.reconcile_summary(reconcile.reconcile(left, right, keys))


@query("C12_label_calendar", "signal_dt:d entry_dt:d available_dt:d", with_(SESS) + """
SELECT * FROM (SELECT dt AS signal_dt, lead(dt, 1) OVER (ORDER BY dt) AS entry_dt, lead(dt, 11) OVER (ORDER BY dt) AS available_dt FROM sess) WHERE available_dt IS NOT NULL""")
def _(t):
    return sessions.label_calendar(cal(t), 10)


SCALE = PRIMARY + ", " + FALLBACK + """, ov AS (SELECT instrument, dt, p.close/f.close AS ratio, row_number() OVER (PARTITION BY instrument ORDER BY dt) AS k FROM prim p JOIN fall f USING (instrument, dt) WHERE p.close > 0 AND f.close > 0),
h AS (SELECT instrument, quantile_cont(ratio, 0.5) AS scale FROM ov WHERE k <= 5 GROUP BY 1), e AS (SELECT instrument, quantile_cont(abs(ratio/scale-1), 0.95) AS error FROM ov JOIN h USING (instrument) WHERE k <= 5 GROUP BY 1),
n AS (SELECT instrument, count(*) AS overlap FROM ov GROUP BY 1), s AS (SELECT instrument, count(p) AS hp, count(f) AS hf FROM (SELECT DISTINCT instrument, 1 AS p FROM prim) FULL JOIN (SELECT DISTINCT instrument, 1 AS f FROM fall) USING (instrument) GROUP BY 1),
sc AS (SELECT instrument, CASE WHEN hp = 0 THEN 'fallback_only' WHEN hf = 0 THEN 'primary_only' WHEN coalesce(overlap, 0) < 5 THEN 'missing_overlap' WHEN error > 0.5 THEN 'unstable_overlap' ELSE 'aligned' END AS status,
  CASE WHEN overlap >= 5 THEN scale END AS scale, coalesce(overlap, 0) AS overlap, CASE WHEN overlap >= 5 THEN error END AS error FROM s LEFT JOIN n USING (instrument) LEFT JOIN h USING (instrument) LEFT JOIN e USING (instrument))"""


@query("C13_align_source_scale", "instrument:i status:s scale:f overlap:i error:f", with_(SCALE) + "SELECT * FROM sc")
def _(t):
    return reconcile.align_source_scale(t.primary(), t.fallback(), max_error=0.5)


@query("C14_asof_price", "instrument:s dt:d start_price:f end_price:f ret:f", with_(MINUTES) + """
SELECT instrument, dt, a AS start_price, b AS end_price, CASE WHEN a > 0 THEN b/a-1 END AS ret FROM (SELECT instrument, dt, max_by(close, minute_of_day) FILTER (WHERE minute_of_day <= 300) AS a,
 max_by(close, minute_of_day) FILTER (WHERE minute_of_day <= 900) AS b FROM minutes GROUP BY ALL)""")
def _(t):
    return intraday.minute_return(t.minutes(), 300, 900)


LIST = """ls AS (SELECT s_suppkey AS instrument, DATE '1992-01-01' + CAST(s_suppkey % 50 * 40 AS INT) AS listed_dt, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1997-01-01' + CAST(s_suppkey AS INT) END AS delisted_dt FROM supplier)"""


def listings(t):
    k = F.col("s_suppkey")
    return t.raw("supplier").select(
        k.alias("instrument"), F.date_add(F.lit("1992-01-01").cast("date"), (k % 50 * 40).cast("int")).alias("listed_dt"),
        F.when(k % 3 == 0, F.date_add(F.lit("1997-01-01").cast("date"), k.cast("int"))).alias("delisted_dt"))


@query("C15_pit_coverage", "dt:d expected:i observed:i unexpected:i missing:i bars_expected:i", with_(BARS_W, LIST, "d AS (SELECT DISTINCT dt FROM barsw)", """
x AS (SELECT d.dt, count(*) AS expected FROM d JOIN ls ON d.dt BETWEEN listed_dt AND coalesce(delisted_dt, DATE '2099-12-31') GROUP BY 1),
o AS (SELECT dt, count(*) FILTER (WHERE dt BETWEEN listed_dt AND coalesce(delisted_dt, DATE '2099-12-31')) AS observed, count(*) FILTER (WHERE dt NOT BETWEEN listed_dt AND coalesce(delisted_dt, DATE '2099-12-31')) AS unexpected FROM barsw JOIN ls USING (instrument) GROUP BY 1)""") + """
SELECT d.dt, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed, coalesce(unexpected, 0) AS unexpected, coalesce(expected, 0)-coalesce(observed, 0) AS missing, coalesce(expected, 0)*240 AS bars_expected
FROM d LEFT JOIN x USING (dt) LEFT JOIN o USING (dt)""")
def _(t):
    bars = t.bars_w()
    return reconcile.pit_coverage(listings(t), bars, sessions.calendar(bars.select("dt")), 240)


@query("C15_missing_symbol_dates", "instrument:i missing:i first_dt:d last_dt:d", with_(BARS_W, LIST, "d AS (SELECT DISTINCT dt FROM barsw)") + """
SELECT instrument, count(*) AS missing, min(dt) AS first_dt, max(dt) AS last_dt FROM (SELECT instrument, d.dt FROM ls JOIN d ON d.dt BETWEEN listed_dt AND coalesce(delisted_dt, DATE '2099-12-31')) ANTI JOIN barsw USING (instrument, dt) GROUP BY 1""")
def _(t):
    bars = t.bars_w()
    gaps = reconcile.missing_symbol_dates(listings(t), bars, sessions.calendar(bars.select("dt")))
    return gaps.groupBy("instrument").agg(F.count(F.lit(1)).alias("missing"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query("C16_label_overlap_compare", "instrument:i rows:i close_diff:f volume_diff:f exceeds:b", with_(PRIMARY, BARS) + """
SELECT instrument, count(*) AS rows, max(abs(p.close-b.close)) AS close_diff, max(abs(p.volume-b.volume)) AS volume_diff, greatest(max(abs(p.close-b.close)), max(abs(p.volume-b.volume))) > 1500 AS exceeds FROM prim p JOIN bars b USING (instrument, dt) GROUP BY 1""")
def _(t):
    return reconcile.overlap_compare(t.primary(), t.bars(), ["instrument", "dt"], ["close", "volume"], 1500.0)


@query("C17_parameter_grid", "gate:s cut:f rows:i coverage:f mean:f hit_ratio:f q10:f median:f q90:f", with_(BARS_W, f"""
s AS (SELECT score, label FROM (SELECT close/lag(close, 5) OVER ({W})-1 AS score, lead(close, 6) OVER ({W})/lead(close, 1) OVER ({W})-1 AS label FROM barsw) WHERE score IS NOT NULL AND label IS NOT NULL),
g(gate, cut) AS (SELECT 'fixed_0', 0.0::DOUBLE UNION ALL SELECT 'fixed_0.5', 0.5 UNION ALL SELECT 'quantile_0.5', quantile_cont(score, 0.5) FROM s UNION ALL SELECT 'quantile_0.9', quantile_cont(score, 0.9) FROM s)""") + """
SELECT gate, cut, count(*) AS rows, count(*)/(SELECT count(*) FROM s) AS coverage, avg(label) AS mean, avg(CAST(label > 0 AS INT)) AS hit_ratio, quantile_cont(label, 0.1) AS q10, quantile_cont(label, 0.5) AS median, quantile_cont(label, 0.9) AS q90
FROM s JOIN g ON score >= cut GROUP BY gate, cut""")
def _(t):
    return evaluation.threshold_grid(scored_w(t).dropna(subset=["score", "label"]), "score", "label", [0.0, 0.5], [0.5, 0.9])


@query("C18_key_contract_join", "matched:i left_only:i right_only:i close_unequal:i left_dup:i right_dup:i", with_(PRIMARY, BARS) + """
SELECT count(p.close + b.close) AS matched, count(*) FILTER (WHERE b.close IS NULL) AS left_only, count(*) FILTER (WHERE p.close IS NULL) AS right_only, count(*) FILTER (WHERE p.close <> b.close) AS close_unequal, 0 AS left_dup, 0 AS right_dup
FROM prim p FULL JOIN bars b USING (instrument, dt)""")
def _(t):
    return reconcile.contract_report(t.primary(), t.bars(), ["instrument", "dt"], ["close"])


@query("C19_conflict_keys", "mode:s side:s n:i", with_(PRIMARY, FALLBACK, "a AS (SELECT instrument, dt FROM prim)", "b AS (SELECT instrument, dt FROM fall)") + """
SELECT 'drop' AS mode, 'a' AS side, count(*) AS n FROM a ANTI JOIN b USING (instrument, dt) UNION ALL SELECT 'drop', 'b', count(*) FROM b ANTI JOIN a USING (instrument, dt)
UNION ALL SELECT 'wins', 'a', count(*) FROM a UNION ALL SELECT 'wins', 'b', count(*) FROM b ANTI JOIN a USING (instrument, dt)""")
def _(t):
    a, b = t.primary().select("instrument", "dt"), t.fallback().select("instrument", "dt")
    outs = [reconcile.drop_conflicts(a, b, ["instrument", "dt"], primary_wins=w).withColumn("mode", F.lit(m)) for w, m in ((False, "drop"), (True, "wins"))]
    return outs[0].unionByName(outs[1]).groupBy("mode", "side").agg(F.count(F.lit(1)).alias("n"))


@query("C20_market_state_blocks", "dt:d instrument:i sides:s reasons:s", with_(BARS_W, f"""
b AS (SELECT dt, instrument, CASE WHEN volume < 3 THEN 0 ELSE volume END AS volume, close/lag(close) OVER ({W})-1 AS pct FROM barsw),
wt AS (SELECT instrument, CAST(dt + INTERVAL 7 DAY AS DATE) AS dt FROM barsw),
dl AS (SELECT dt, instrument, CASE WHEN b.volume IS NULL THEN 'row_missing' WHEN volume <= 0 THEN 'volume_zero' WHEN abs(pct) >= 5 THEN 'limit_move' END AS reason FROM wt LEFT JOIN b USING (dt, instrument)),
rj AS (SELECT dt, instrument, CASE WHEN instrument % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN instrument % 5 = 0 THEN 'halted' ELSE 'no funds' END AS detail FROM barsw WHERE volume > 150),
u AS (SELECT dt, instrument, 'BUY' AS s, reason FROM dl WHERE reason IS NOT NULL UNION ALL SELECT dt, instrument, 'SELL', reason FROM dl WHERE reason IS NOT NULL UNION ALL SELECT dt, instrument, side, detail FROM rj
 UNION ALL SELECT dt, instrument, CASE WHEN side='BUY' THEN 'SELL' ELSE 'BUY' END, detail FROM rj WHERE detail = 'halted')""") + """
SELECT dt, instrument, string_agg(DISTINCT s, ',' ORDER BY s) AS sides, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons FROM u GROUP BY ALL""")
def _(t):
    b = t.bars_w().withColumn("pct", rolling.past_return(1)).withColumn("volume", F.when(F.col("volume") < 3, 0.0).otherwise(F.col("volume")))
    # Wanted: every name with a bar in the week before.
    wanted = t.bars_w().select(F.date_add("dt", 7).alias("dt"), "instrument")
    k = F.col("instrument")
    rejected = b.where(F.col("volume") > 150).select(
        "dt", "instrument", F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.when(k % 5 == 0, "halted").otherwise("no funds").alias("detail"))
    return reconcile.market_state_blocks(wanted, b, rejected, 5.0)


@query("C21_target_transition", "dt:d missing_prices:i sells:i buys:i sell_notional:f2 buy_notional:f2 cost:f2 turnover:f cash_before:f2 cash_final:f2 cash_min:f2 retained_changed:i", with_(SNAP, """
px AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS dt, l_suppkey AS instrument, avg(l_extendedprice/l_quantity) AS price FROM lineitem WHERE l_returnflag='N' GROUP BY ALL),
o AS (SELECT coalesce(a.dt, b.dt) AS dt, coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.shares, 0) AS bf, coalesce(b.shares, 0) AS af FROM
 (SELECT CAST(snap_dt + INTERVAL 3 MONTH AS DATE) AS dt, instrument, shares FROM snap) a FULL JOIN (SELECT snap_dt AS dt, instrument, shares FROM snap) b ON a.dt = b.dt AND a.instrument = b.instrument),
p AS (SELECT o.*, price, coalesce(price, 0) AS px, af-bf AS d FROM o LEFT JOIN px USING (dt, instrument)),
c AS (SELECT *, abs(d)*px AS ref, CASE WHEN d < 0 THEN -d*px*0.9995-greatest(-d*px*0.9995*0.0025, 5) WHEN d > 0 THEN -(d*px*1.0005+greatest(d*px*1.0005*0.001, 5)) ELSE 0 END AS cash FROM p)""") + """
SELECT dt, missing_prices, sells, buys, sell_notional, buy_notional, cost, (sell_notional+buy_notional)/1e8 AS turnover, cb AS cash_before, cb+sc+bc AS cash_final, least(cb, cb+sc, cb+sc+bc) AS cash_min, retained_changed FROM (
SELECT dt, count(*) FILTER (WHERE price IS NULL) AS missing_prices, count(*) FILTER (WHERE d < 0) AS sells, count(*) FILTER (WHERE d > 0) AS buys, coalesce(sum(ref) FILTER (WHERE d < 0), 0) AS sell_notional, coalesce(sum(ref) FILTER (WHERE d > 0), 0) AS buy_notional,
 sum(CASE WHEN d < 0 THEN ref-cash WHEN d > 0 THEN -cash-ref ELSE 0 END) AS cost, 1e8-sum(bf*px) AS cb, coalesce(sum(cash) FILTER (WHERE d < 0), 0) AS sc, coalesce(sum(cash) FILTER (WHERE d > 0), 0) AS bc,
 count(*) FILTER (WHERE bf > 0 AND af > 0 AND d <> 0) AS retained_changed FROM c GROUP BY dt)""")
def _(t):
    snap = snapshots(t)
    old = snap.select(F.add_months("snap_dt", 3).alias("dt"), "instrument", "shares")
    new = snap.select(F.col("snap_dt").alias("dt"), "instrument", "shares")
    prices = t.raw("lineitem").where("l_returnflag = 'N'").groupBy(F.date_trunc("quarter", "l_shipdate").cast("date").alias("dt"), F.col("l_suppkey").alias("instrument")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return reconcile.transition_summary(reconcile.target_orders(old, new, prices, ["dt"], STRESS_COSTS), ["dt"], 1e8)
