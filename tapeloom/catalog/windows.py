"""E: window functions over panels, and the daily-coefficient slice."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.catalog.base import BARS, BARS_W, SESS, query, with_
from tapeloom.functions import candles
from tapeloom.functions.guards import ratio
from tapeloom.operators import cross_section, evaluation, folds, ordered, rolling, sessions
from tapeloom.session import stage

W = "PARTITION BY instrument ORDER BY dt"
ELIG = f"""elig AS (SELECT *, coalesce(listing_days >= 30 AND avg_amount >= 10000 AND suspend_ratio <= 0.2 AND open > 0 AND close > 0, false) AS eligible FROM (
  SELECT *, row_number() OVER ({W}) AS listing_days,
   CASE WHEN count(amount) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN avg(amount) OVER ({W} ROWS 19 PRECEDING) END AS avg_amount,
   CASE WHEN count(*) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN avg(CAST(volume = 0 AS INT)) OVER ({W} ROWS 19 PRECEDING) END AS suspend_ratio FROM bars))"""


def _avg_rank(value: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1)/2.0)"


def _eligible(t):
    return rolling.pit_eligibility(t.bars(), min_days=30, min_amount=10_000)


@query("slice_daily_ic", "dt:d n:i ic:f available_dt:d", with_(BARS, ELIG, SESS, f"""
p AS (SELECT *, close/lag(close, 5) OVER ({W})-1 AS score, lead(close, 6) OVER ({W})/lead(close, 1) OVER ({W})-1 AS label FROM elig),
k AS (SELECT dt, score, label FROM p WHERE eligible AND score IS NOT NULL AND label IS NOT NULL),
r AS (SELECT dt, {_avg_rank('score', 'dt')} AS a, {_avg_rank('label', 'dt')} AS b FROM k),
i AS (SELECT dt, count(*) AS n, covar_pop(a, b)/nullif(stddev_pop(a)*stddev_pop(b), 0) AS ic FROM r GROUP BY dt HAVING count(*) >= 3),
av AS (SELECT dt, lead(dt, 6) OVER (ORDER BY dt) AS available_dt FROM sess)""") + """
SELECT dt, n, ic, available_dt FROM i LEFT JOIN av USING (dt) WHERE ic IS NOT NULL""")
def _(t):
    from tapeloom.plans import slices

    return slices.daily_ic_slice(t.bars(), t.dates(), horizon=5, min_names=3)


@query("E1_pit_eligibility", "instrument:i dt:d listing_days:i avg_amount:f2 suspend_ratio:f eligible:b",
       with_(BARS, ELIG) + "SELECT instrument, dt, listing_days, avg_amount, suspend_ratio, eligible FROM elig")
def _(t):
    return _eligible(t)


@query("E2_forward_returns", "instrument:i dt:d " + " ".join(f"cumret_{k}:f" for k in range(1, 6)), with_(BARS) + "SELECT instrument, dt, " + ", ".join(
    f"lead(close, {k + 1}) OVER ({W})/lead(close, 1) OVER ({W})-1 AS cumret_{k}" for k in range(1, 6)) + " FROM bars")
def _(t):
    return rolling.forward_paths(t.bars(), 5)


DAILY = f"""ret AS (SELECT *, close/lag(close) OVER ({W})-1 AS r FROM barsw),
daily AS (SELECT dt, count(*) AS n, avg(r) AS ret, avg(CAST(coalesce(r > 0, false) AS INT)) AS breadth, stddev_samp(r) AS dispersion, avg(amount) AS amount
  FROM ret GROUP BY dt)"""


def _daily(t):
    return evaluation.market_breadth(t.bars_w().withColumn("r", rolling.past_return(1)), "r")


def _rows(n):
    return f"OVER (ORDER BY dt ROWS {n - 1} PRECEDING)"


def _prod(n, m):
    return (f"CASE WHEN count(ret) {_rows(n)} >= {m} AND count(ret) {_rows(n)} = count(*) {_rows(n)} "
            f"THEN product(1+ret) {_rows(n)} - 1 END AS ret_{n}")


def _guard(fn, c, n, m):
    return f"CASE WHEN count({c}) {_rows(n)} >= {m} THEN {fn}({c}) {_rows(n)} END"


@query("E3_regime_features", "dt:d log_ret_5:f log_ret_10:f log_ret_20:f vol_5:f vol_20:f breadth_5:f dispersion_20:f amount_20:f2 amount_chg_20:f count_z60:f",
       with_(BARS_W, DAILY, f"""f AS (SELECT *, {_prod(5, 3)}, {_prod(10, 5)}, {_prod(20, 10)},
  {_guard('stddev_samp', 'ret', 5, 3)} AS vol_5, {_guard('stddev_samp', 'ret', 20, 10)} AS vol_20, {_guard('avg', 'breadth', 5, 3)} AS breadth_5,
  {_guard('avg', 'dispersion', 20, 10)} AS dispersion_20, {_guard('avg', 'amount', 20, 10)} AS amount_20,
  (n - {_guard('avg', 'n', 60, 20)})/nullif({_guard('stddev_samp', 'n', 60, 20)}, 0) AS count_z60 FROM daily)""") + """
SELECT *, ln(1+ret_5) AS log_ret_5, ln(1+ret_10) AS log_ret_10, ln(1+ret_20) AS log_ret_20, amount/lag(amount_20) OVER (ORDER BY dt) - 1 AS amount_chg_20 FROM f""")
def _(t):
    out = rolling.regime_features(_daily(t))
    return out.withColumns({f"log_ret_{n}": F.log1p(f"ret_{n}") for n in (5, 10, 20)})


@query("E4_rolling_drawdown", "dt:d mdd:f downside_vol:f", with_(BARS_W, DAILY, """
x AS (SELECT dt, ret, row_number() OVER (ORDER BY dt) AS k, sum(ln(1+coalesce(ret, 0))) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS lg FROM daily),
m AS (SELECT t.k, max(1-exp(j.lg-i.lg)) AS mdd FROM x t JOIN x i ON i.k BETWEEN t.k-19 AND t.k JOIN x j ON j.k BETWEEN i.k AND t.k GROUP BY t.k)""") + f"""
SELECT dt, CASE WHEN x.k >= 10 THEN mdd END AS mdd, CASE WHEN count(ret) {_rows(20)} >= 10 THEN CASE WHEN count(CASE WHEN ret < 0 THEN ret END) {_rows(20)} > 1
  THEN stddev_samp(CASE WHEN ret < 0 THEN ret END) {_rows(20)} ELSE 0 END END AS downside_vol FROM x JOIN m USING (k)""")
def _(t):
    return rolling.rolling_drawdown(_daily(t), "ret", 20, [])


@query("E5_rolling_z_gap_reset", "dt:d outer_median:f z:f risk_budget:f inner_low:f inner_high:f", with_(BARS_W, f"""
gapped AS (SELECT * REPLACE (dt + CAST(((year(dt)-1992)*2 + CAST(month(dt) >= 7 AS INT))*40 AS INT) AS dt) FROM barsw),
s AS (SELECT *, close/lag(close, 3) OVER ({W})-1 AS o, close/lag(close) OVER ({W})-1 AS i FROM gapped),
d AS (SELECT dt, quantile_cont(o, 0.5) FILTER (WHERE volume > 20) AS outer_median, quantile_cont(i, 0.2) AS inner_low, quantile_cont(i, 0.8) AS inner_high FROM s GROUP BY dt),
g AS (SELECT *, sum(CAST(coalesce(date_diff('day', lg, dt) > 20, false) AS INT)) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, lag(dt) OVER (ORDER BY dt) AS lg FROM d)),
z AS (SELECT *, CASE WHEN count(outer_median) OVER (PARTITION BY seg ORDER BY dt ROWS 19 PRECEDING) >= 10 THEN
  coalesce((outer_median - avg(outer_median) OVER (PARTITION BY seg ORDER BY dt ROWS 19 PRECEDING))/nullif(stddev_samp(outer_median) OVER (PARTITION BY seg ORDER BY dt ROWS 19 PRECEDING), 0), 0) ELSE 0 END AS z FROM g)""") + """
SELECT *, least(0.95, greatest(0.2, 0.6+0.1*z)) AS risk_budget FROM z""")
def _(t):
    # Every half-year is moved 40 days further, which leaves gaps without leaving out rows.
    half_years = (F.year("dt") - 1992) * 2 + (F.month("dt") >= 7).cast("int")
    bars = t.bars_w().withColumn("dt", F.date_add("dt", half_years * 40))
    scores = bars.withColumn("outer", rolling.past_return(3)).withColumn("inner", rolling.past_return(1)).withColumn("eligible", F.col("volume") > 20)
    return rolling.risk_thresholds(scores, window=20, gap_days=20, base=0.6, slope=0.1, low=0.2, high=0.95, q_low=0.2, q_high=0.8)


CUST_DAYS = """cd AS (SELECT o_custkey AS instrument, CAST(o_orderdate AS DATE) AS dt, max_by(o_orderpriority, o_orderkey) AS prio, max_by(o_orderstatus, o_orderkey) AS st
  FROM orders GROUP BY ALL)"""


def cust_days(t):
    return t.raw("orders").select(
        F.col("o_custkey").alias("instrument"), F.col("o_orderdate").cast("date").alias("dt"), "o_orderkey", "o_orderpriority", "o_orderstatus"
    ).groupBy("instrument", "dt").agg(F.max_by("o_orderpriority", "o_orderkey").alias("prio"), F.max_by("o_orderstatus", "o_orderkey").alias("st"))


INTERVALS = CUST_DAYS + f""", isl AS (SELECT *, sum(CAST(lp IS NULL OR lp <> prio OR ls <> st AS INT)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(prio) OVER ({W}) AS lp, lag(st) OVER ({W}) AS ls FROM cd)),
iv AS (SELECT instrument, prio, st, min(dt) AS start_dt, max(dt) AS e, count(*) AS days, g FROM isl GROUP BY instrument, prio, st, g),
ivf AS (SELECT instrument, prio, st, start_dt, CASE WHEN lead(g) OVER (PARTITION BY instrument ORDER BY g) IS NULL THEN greatest(e, DATE '2002-12-31') ELSE e END AS end_dt, days FROM iv)"""


@query("E6_compress_intervals", "instrument:i prio:s st:s start_dt:d end_dt:d days:i", with_(INTERVALS) + "SELECT * FROM ivf")
def _(t):
    return rolling.compress_intervals(cust_days(t), ["prio", "st"], "2002-12-31")


@query("E7_holding_streak", "instrument:i dt:d held_age:i entry_price:f unrealized_ret:f prev_day_ret:f", with_(BARS_W, f"""
h AS (SELECT instrument, dt, close AS mark_price, floor(volume/25) AS shares FROM barsw),
s AS (SELECT *, sum(CAST(coalesce(date_diff('day', ld, dt) > 10 OR ls <> shares, true) AS INT)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS streak
  FROM (SELECT *, lag(dt) OVER ({W}) AS ld, lag(shares) OVER ({W}) AS ls, lag(mark_price) OVER ({W}) AS pm FROM h))""") + """
SELECT instrument, dt, row_number() OVER (PARTITION BY instrument, streak ORDER BY dt) AS held_age,
 first_value(mark_price) OVER (PARTITION BY instrument, streak ORDER BY dt) AS entry_price,
 mark_price/(first_value(mark_price) OVER (PARTITION BY instrument, streak ORDER BY dt)+1e-12)-1 AS unrealized_ret, mark_price/(pm+1e-12)-1 AS prev_day_ret FROM s""")
def _(t):
    return rolling.holding_streaks(t.bars_w().select("instrument", "dt", F.col("close").alias("mark_price"), F.floor(F.col("volume") / 25).alias("shares")))


XS = f"xs AS (SELECT instrument, dt, close/open-1 AS a, high/low-1 AS b FROM barsw WHERE close/open IS NOT NULL)"


@query("E8_cross_sectional", "instrument:i dt:d universe:i a_rank:f b_rank:f a_rel:f b_rel:f a_mean:f a_median:f a_std:f positive_breadth:f", with_(BARS_W, XS) + f"""
SELECT instrument, dt, universe, {_avg_rank('a', 'dt')}/universe AS a_rank, {_avg_rank('b', 'dt')}/universe AS b_rank, a-am AS a_rel, b-bm AS b_rel, a_mean, am AS a_median, a_std, positive_breadth
FROM xs JOIN (SELECT dt, count(*) AS universe, quantile_cont(a, 0.5) AS am, quantile_cont(b, 0.5) AS bm, avg(a) AS a_mean, coalesce(stddev_samp(a), 0) AS a_std, avg(CAST(a > 0 AS INT)) AS positive_breadth
  FROM xs GROUP BY dt) USING (dt)""")
def _(t):
    xs = t.bars_w().select("instrument", "dt", (F.col("close") / F.col("open") - 1).alias("a"), (F.col("high") / F.col("low") - 1).alias("b"))
    return cross_section.cross_sectional(xs, ["dt"], ["a", "b"], ["a"], "a")


@query("E9_rank_pct", "doc_id:i lang:s rank_pct:f rank_min_desc:i rank_first:i", f"""
SELECT doc_id, lang, {_avg_rank('n', 'lang')}/count(*) OVER (PARTITION BY lang) AS rank_pct, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS rank_min_desc,
 row_number() OVER (PARTITION BY lang ORDER BY n, doc_id) AS rank_first FROM (SELECT doc_id, lang, n_chars // 50 AS n FROM documents)""")
def _(t):
    docs = t.raw("documents").select("doc_id", "lang", F.expr("n_chars div 50").alias("n"))
    return cross_section.rank_pct(docs, ["lang"], "n", "doc_id")


GRP = """grp AS (SELECT s_suppkey AS instrument, CASE WHEN s_suppkey % 9 = 0 THEN 'other' ELSE r_name END AS g FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def groups(t):
    name = F.when(F.col("s_suppkey") % 9 == 0, "other").otherwise(F.col("r_name"))
    return (t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("instrument"), name.alias("grp")))


@query("E10_group_snapshot", "instrument:i dt:d group_known:f group_count:i a_group_mean:f a_group_std:f a_group_rel:f group_breadth:f v_group_sum:f", with_(BARS_W, GRP, """
x AS (SELECT b.instrument, dt, close/open-1 AS a, volume AS v, CASE WHEN g = 'other' THEN 'U'||CAST(b.instrument AS VARCHAR) ELSE g END AS k, CAST(g <> 'other' AS INT) AS group_known
  FROM barsw b JOIN grp USING (instrument))""") + """
SELECT instrument, dt, group_known, group_count, m AS a_group_mean, s AS a_group_std, a-m AS a_group_rel, group_breadth, v_group_sum FROM x JOIN
 (SELECT dt, k, count(*) AS group_count, avg(a) AS m, coalesce(stddev_samp(a), 0) AS s, avg(CAST(a > 0 AS INT)) AS group_breadth, sum(v) AS v_group_sum FROM x GROUP BY dt, k) USING (dt, k)""")
def _(t):
    x = t.bars_w().select("instrument", "dt", (F.col("close") / F.col("open") - 1).alias("a"), F.col("volume").alias("v")).join(groups(t), "instrument")
    return cross_section.group_snapshot(x, ["dt"], ["a"], ["v"], "a")


@query("E11_neutralize", "instrument:i dt:d global_z:f group_z:f neutral_025:f neutral_050:f", with_(BARS_W, GRP, """
x AS (SELECT instrument, dt, g, close/open-1 AS a FROM barsw JOIN grp USING (instrument)),
z AS (SELECT instrument, dt, (a-avg(a) OVER d)/nullif(stddev_samp(a) OVER d, 0) AS gz, CASE WHEN count(a) OVER g >= 5 THEN (a-avg(a) OVER g)/nullif(stddev_samp(a) OVER g, 0) END AS iz
  FROM x WINDOW d AS (PARTITION BY dt), g AS (PARTITION BY dt, g))""") + """
SELECT instrument, dt, gz AS global_z, coalesce(iz, gz) AS group_z, 0.75*gz+0.25*coalesce(iz, gz) AS neutral_025, 0.5*gz+0.5*coalesce(iz, gz) AS neutral_050 FROM z""")
def _(t):
    x = t.bars_w().select("instrument", "dt", (F.col("close") / F.col("open") - 1).alias("a")).join(groups(t), "instrument")
    return cross_section.neutralize(x, "a", [0.25, 0.5])


ICW = f"""k AS (SELECT dt, score, label FROM (SELECT *, close/lag(close, 5) OVER ({W})-1 AS score, lead(close, 6) OVER ({W})/lead(close, 1) OVER ({W})-1 AS label FROM barsw)
  WHERE score IS NOT NULL AND label IS NOT NULL),
rk AS (SELECT dt, {_avg_rank('score', 'dt')} AS a, {_avg_rank('label', 'dt')} AS b FROM k),
ic AS (SELECT dt, count(*) AS n, covar_pop(a, b)/nullif(stddev_pop(a)*stddev_pop(b), 0) AS ic FROM rk GROUP BY dt HAVING count(*) >= 5),
calw AS (SELECT dt, lead(dt, 6) OVER (ORDER BY dt) AS available_dt FROM (SELECT DISTINCT dt FROM barsw)),
icm AS (SELECT dt AS signal_dt, available_dt, ic FROM ic JOIN calw USING (dt) WHERE available_dt IS NOT NULL AND ic IS NOT NULL)"""


def scored_w(t):
    return t.bars_w().withColumn("score", rolling.past_return(5)).withColumn("label", rolling.forward_return(5))


def matured_ic(t):
    bars = t.bars_w()
    cal = sessions.calendar(bars.select("dt"))
    ic = evaluation.daily_ic(scored_w(t), "score", "label", min_names=5)
    return evaluation.mature(ic, sessions.label_calendar(cal, 5))


@query("E12_causal_health", "dt:d health:f known:i trigger:b", with_(BARS_W, ICW, """
d AS (SELECT DISTINCT dt FROM barsw),
j AS (SELECT d.dt, ic, row_number() OVER (PARTITION BY d.dt ORDER BY signal_dt DESC) AS b FROM d JOIN icm ON available_dt <= d.dt),
h AS (SELECT dt, avg(ic) AS health, count(*) AS known FROM j WHERE b <= 20 GROUP BY dt)""") + """
SELECT d.dt, health, coalesce(known, 0) AS known, coalesce(known >= 10 AND health < 0, false) AS trigger FROM d LEFT JOIN h USING (dt)""")
def _(t):
    return folds.causal_health(matured_ic(t), t.bars_w().select("dt"), window=20, min_obs=10, below=0.0)


@query("E13_trailing_quantile_gate", "dt:d fold:i threshold:f margin:f enabled:b history:i", with_(BARS_W, f"""
s AS (SELECT dt, avg(a) AS m FROM (SELECT dt, close/open-1 AS a, row_number() OVER (PARTITION BY dt ORDER BY close/open-1 DESC, instrument) AS r FROM barsw) WHERE r <= 2 GROUP BY dt),
fl(fold, a, b) AS (VALUES (1, DATE '1998-01-01', DATE '1998-12-31'), (2, DATE '1999-01-01', DATE '1999-12-31'), (3, DATE '2000-01-01', DATE '2001-12-31')),
h AS (SELECT fold, m, row_number() OVER (PARTITION BY fold ORDER BY dt DESC) AS k FROM s JOIN fl ON dt < a),
q AS (SELECT fold, quantile_cont(m, 0.6) AS threshold, count(*) AS history FROM h WHERE k <= 60 GROUP BY fold)""") + """
SELECT dt, fold, threshold, m-threshold AS margin, m >= threshold AS enabled, history FROM s JOIN fl ON dt BETWEEN a AND b JOIN q USING (fold)""")
def _(t):
    from tapeloom.operators import selection

    x = t.bars_w().withColumn("a", F.col("close") / F.col("open") - 1)
    daily = selection.top_n(x, ["dt"], "a", "instrument", 2).groupBy("dt").agg(F.avg("a").alias("m"))
    starts = t.spark.createDataFrame([("1998-01-01",), ("1999-01-01",), ("2000-01-01",)], "start_dt string").select(F.col("start_dt").cast("date"))
    return folds.trailing_quantile_gate(daily, folds.fold_ranges(starts, "2001-12-31"), "m", lookback=60, quantile=0.6)


NAV = """nav AS (SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS dt, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
navs AS (SELECT series, dt, 1e6::DOUBLE + sum(CASE WHEN day(dt) % 3 = 0 THEN -v/20 ELSE v/20 END) OVER (PARTITION BY series ORDER BY dt ROWS UNBOUNDED PRECEDING) AS nav FROM nav)"""


def nav(t):
    daily = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("series"), F.col("o_orderdate").cast("date").alias("dt")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("series").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.day("dt") % 3 == 0, -F.col("v") / 20).otherwise(F.col("v") / 20)
    return daily.withColumn("nav", F.lit(1e6) + F.sum(step).over(w))


@query("E14_drawdown", "series:s dt:d nav:f2 drawdown:f", with_(NAV) + """
SELECT series, dt, nav, 1-nav/max(nav) OVER (PARTITION BY series ORDER BY dt ROWS UNBOUNDED PRECEDING) AS drawdown FROM navs""")
def _(t):
    return rolling.drawdown(nav(t), ["series"])


@query("E15_session_decay_weights", "instrument:i dt:d weight:f", with_(BARS, SESS) + """
SELECT instrument, dt, exp(-ln(2)*((SELECT max(session_no) FROM sess) - session_no)/500) AS weight FROM bars JOIN sess USING (dt)""")
def _(t):
    return rolling.session_decay_weights(t.bars(), sessions.calendar(t.dates()), 500)


@query("E16_kbar_price_features", "instrument:i dt:d " + " ".join(f"{n}:f4" for n in
       "kmid klen kmid2 kup kup2 klow klow2 ksft ksft2 open0 high0 low0 vwap0".split()), with_(BARS) + """
SELECT instrument, dt, (close-open)/open AS kmid, (high-low)/open AS klen, (close-open)/(high-low+1e-12) AS kmid2, (high-greatest(open,close))/open AS kup,
 (high-greatest(open,close))/(high-low+1e-12) AS kup2, (least(open,close)-low)/open AS klow, (least(open,close)-low)/(high-low+1e-12) AS klow2,
 (2*close-high-low)/open AS ksft, (2*close-high-low)/(high-low+1e-12) AS ksft2, open/close AS open0, high/close AS high0, low/close AS low0, amount/volume/close AS vwap0 FROM bars""")
def _(t):
    return t.bars().select("instrument", "dt", *[c.alias(n) for n, c in candles.candle_features().items()])


ROLL = "roc ma std beta rsqr rsv imxd corr cntd vma vstd wvma sumd qtlu qtld".split()


def _roll_sql(ns):
    cols = []
    for n in ns:
        f = f"OVER ({W} ROWS {n - 1} PRECEDING)"
        parts = {
            "roc": f"lag(close, {n}) OVER ({W})/close", "ma": f"avg(close) {f}/close", "std": f"stddev_samp(close) {f}/close",
            "beta": f"regr_slope(close, k) {f}/close", "rsqr": f"CASE WHEN stddev_pop(close) {f} > 1e-12 THEN regr_r2(close, k) {f} END",
            "rsv": f"(close-min(low) {f})/(max(high) {f}-min(low) {f}+1e-12)",
            "imxd": f"((max({{'h': high, 'n': -k}}) {f}).n*-1 - (max({{'h': -low, 'n': -k}}) {f}).n*-1)/{n}.0",
            "corr": f"CASE WHEN stddev_pop(close) {f} > 1e-12 AND stddev_pop(lv) {f} > 1e-12 THEN covar_pop(close, lv) {f}/(stddev_pop(close) {f}*stddev_pop(lv) {f}) END",
            "cntd": f"avg(CAST(d > 0 AS INT)-CAST(d < 0 AS INT)) {f}", "vma": f"avg(volume) {f}/volume", "vstd": f"stddev_samp(volume) {f}/volume",
            "wvma": f"stddev_samp(av) {f}/nullif(avg(av) {f}, 0)", "sumd": f"sum(d) {f}/nullif(sum(abs(d)) {f}, 0)",
            "qtlu": f"quantile_cont(close, 0.8) {f}/close", "qtld": f"quantile_cont(close, 0.2) {f}/close",
        }
        for name, sql in parts.items():
            need = ">" if name in ("roc", "cntd", "wvma", "sumd") else ">="
            cols.append(f"CASE WHEN k {need} {n} THEN {sql} END AS {name}{n}")
    return ", ".join(cols)


_BASE = f"""b AS (SELECT *, row_number() OVER ({W}) AS k, close-lag(close) OVER ({W}) AS d, ln(volume+1) AS lv, abs(close/lag(close) OVER ({W})-1)*volume AS av FROM bars)"""


@query("E17_rolling_alpha", "instrument:i dt:d " + " ".join(f"{r}{n}:f4" for n in (5, 10, 20) for r in ROLL),
       with_(BARS, _BASE) + f"SELECT instrument, dt, {_roll_sql((5, 10, 20))} FROM b")
def _(t):
    return candles.rolling_features(t.bars(), [5, 10, 20])


@query("E17_rolling_alpha_long", "instrument:i dt:d " + " ".join(f"{r}{n}:f4" for n in (30, 60, 120, 250) for r in ROLL),
       with_(BARS, _BASE) + f"SELECT instrument, dt, {_roll_sql((30, 60, 120, 250))} FROM b")
def _(t):
    return candles.rolling_features(t.bars(), [30, 60, 120, 250])


PROXY = "ovn_gap mom_tail5 rng_open intra_vol5 pv_div5 gap_mom3 tail_str5 intra_pos vol_ratio5 up_shadow body_ratio ret_skew20 amplitude_ma5 down_shadow".split()


def _m(x, n, fn="avg"):
    f = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {f} >= {n} THEN {fn}({x}) {f} END"


@query("E18_hf_and_inner_features", "instrument:i dt:d " + " ".join(f"{p}:f4" for p in PROXY), with_(BARS, f"""
b AS (SELECT *, close/lag(close) OVER ({W})-1 AS r, open/lag(close) OVER ({W})-1 AS gap, ln(volume/lag(volume) OVER ({W})+1e-12) AS lv, (close-open)/open AS oc, (high-low)/open AS ro,
  (close-open)/(high-low+1e-8) AS ts FROM bars)""") + f"""
SELECT instrument, dt, gap AS ovn_gap, {_m('oc', 5)} AS mom_tail5, ro AS rng_open, {_m('r', 5, 'stddev_samp')} AS intra_vol5,
 CASE WHEN count(lv) OVER ({W} ROWS 4 PRECEDING) >= 5 AND stddev_pop(r) OVER ({W} ROWS 4 PRECEDING) > 1e-12 AND stddev_pop(lv) OVER ({W} ROWS 4 PRECEDING) > 1e-12
  THEN covar_pop(r, lv) OVER ({W} ROWS 4 PRECEDING)/(stddev_pop(r) OVER ({W} ROWS 4 PRECEDING)*stddev_pop(lv) OVER ({W} ROWS 4 PRECEDING)) END AS pv_div5,
 {_m('gap', 3)} AS gap_mom3, {_m('ts', 5)} AS tail_str5, (close-low)/(high-low+1e-8) AS intra_pos, volume/({_m('volume', 5)}+1e-8) AS vol_ratio5,
 (high-close)/(high-low+1e-8) AS up_shadow, abs(close-open)/(high-low+1e-8) AS body_ratio, pow(r-({_m('r', 20)}), 3)/(({_m('r', 20, 'stddev_samp')})+1e-8) AS ret_skew20,
 {_m('ro', 5)} AS amplitude_ma5, (least(open,close)-low)/(high-low+1e-8) AS down_shadow FROM b""")
def _(t):
    return candles.daily_proxies(t.bars())


@query("E19_regime_feature_broadcast", "instrument:i dt:d ret_5:f breadth_5:f", with_(BARS_W, DAILY, f"""
f AS (SELECT dt, {_prod(5, 3)}, {_guard('avg', 'breadth', 5, 3)} AS breadth_5 FROM daily)""") + "SELECT instrument, dt, ret_5, breadth_5 FROM barsw LEFT JOIN f USING (dt)")
def _(t):
    feats = rolling.regime_features(_daily(t)).select("dt", "ret_5", "breadth_5")
    return cross_section.broadcast_date_fields(t.bars_w(), feats)


@query("E20_normalizers", "instrument:i dt:d close_z:f volume_z:f label_rank:f", with_(BARS, f"""
l AS (SELECT *, close/lag(close) OVER ({W})-1 AS label FROM bars),
m AS (SELECT quantile_cont(close, 0.5) AS mc, quantile_cont(volume, 0.5) AS mv FROM bars WHERE dt BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'),
a AS (SELECT any_value(mc) AS mc, any_value(mv) AS mv, quantile_cont(abs(close-mc), 0.5) AS dc, quantile_cont(abs(volume-mv), 0.5) AS dv FROM bars, m WHERE dt BETWEEN DATE '1993-01-01' AND DATE '1995-12-31')""") + f"""
SELECT instrument, dt, least(3, greatest(-3, (close-mc)/(1.4826*dc))) AS close_z, least(3, greatest(-3, (volume-mv)/(1.4826*dv))) AS volume_z,
 {_avg_rank('label', 'dt')}/count(*) OVER (PARTITION BY dt) AS label_rank FROM l, a WHERE label IS NOT NULL""")
def _(t):
    # The fit and the labels read the bars, the sizes of the dates and their ranks the labels.
    bars = stage(t.bars().select("instrument", "dt", "close", "volume"), "bars")
    fitted = cross_section.fit_robust_scale(bars, ["close", "volume"], "1993-01-01", "1995-12-31")
    labelled = stage(bars.withColumn("label", rolling.past_return(1)).where("label is not null"), "labelled")
    from tapeloom.skew import average_rank

    scaled = cross_section.apply_robust_scale(labelled, fitted, ["close", "volume"])
    return average_rank(scaled, ["dt"], "label", "label_rank", pct=True, staged=True)


@query("E21_schedule_flags", "dt:d session_no:i by_modulus:b due:b", with_(SESS, "ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders WHERE o_totalprice > 400000)") + """
SELECT dt, session_no, (session_no-1) % 5 = 0 AS by_modulus, l IS NULL OR session_no - l >= 5 AS due FROM (
 SELECT s.dt, session_no, max(CASE WHEN ev.dt IS NOT NULL THEN session_no END) OVER (ORDER BY s.dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM sess s LEFT JOIN ev ON s.dt = ev.dt)""")
def _(t):
    events = t.raw("orders").where("o_totalprice > 400000").select(F.col("o_orderdate").cast("date").alias("dt"))
    return sessions.schedule_flags(sessions.calendar(t.dates()), 5, events)


FOLDS = """fk AS (SELECT k, 500+21+k*200 AS vs FROM range(0, 200) r(k), (SELECT max(session_no) AS n FROM sess) WHERE 500+21+k*200+120+21+5+60-1 < n),
folds AS (SELECT k+1 AS fold, (SELECT dt FROM sess WHERE session_no = 1) AS train_start, a.dt AS train_end, b.dt AS valid_start, c.dt AS valid_end, d.dt AS test_start, e.dt AS test_end
 FROM fk JOIN sess a ON a.session_no = vs-21 JOIN sess b ON b.session_no = vs+1 JOIN sess c ON c.session_no = vs+120 JOIN sess d ON d.session_no = vs+120+21+5+1 JOIN sess e ON e.session_no = vs+120+21+5+60)"""


def fold_table(t):
    return folds.walk_forward_folds(sessions.calendar(t.dates()), train=500, valid=120, test=60, step=200, purge=21, embargo=5)


@query("E22_walk_forward_folds", "fold:i train_start:d train_end:d valid_start:d valid_end:d test_start:d test_end:d", with_(SESS, FOLDS) + "SELECT * FROM folds")
def _(t):
    return fold_table(t)


@query("E23_assign_folds", "instrument:i dt:d fold:i", with_(BARS, SESS, FOLDS) + """
SELECT instrument, dt, fold FROM bars JOIN folds ON dt BETWEEN test_start AND test_end""")
def _(t):
    ranges = fold_table(t).select("fold", F.col("test_start").alias("start_dt"), F.col("test_end").alias("end_dt"))
    return folds.assign_folds(t.bars(), ranges, sessions.calendar(t.dates()))


@query("E24_anchored_split", "dt:d role:s", with_(SESS, """
b AS (SELECT dt, row_number() OVER (ORDER BY dt DESC) - 5 AS p, count(*) OVER () - 5 AS n FROM sess WHERE dt < DATE '1999-01-01'),
c AS (SELECT *, greatest(20, ceil(n*0.1)) AS cal FROM b), v AS (SELECT *, greatest(20, ceil((n-cal)*0.15)) AS val FROM c)""") + """
SELECT dt, CASE WHEN p <= 0 THEN 'purged' WHEN p <= cal THEN 'calib' WHEN p <= cal+val THEN 'valid' ELSE 'fit' END AS role FROM v""")
def _(t):
    return folds.anchored_split(sessions.calendar(t.dates()), "1999-01-01", purge=5, valid_fraction=0.15, min_valid=20, calib_fraction=0.1, min_calib=20)


def quarter_targets(t):
    lines = t.raw("lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("dt")).agg(F.sum("l_quantity").alias("shares"))


TGT = """tgt AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS dt, sum(l_quantity) AS shares FROM lineitem GROUP BY ALL)"""


@query("E25_effective_targets", "symbol:i dt:d shares:f effective:f", "WITH RECURSIVE " + TGT + """,
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM tgt),
e(symbol, dt, shares, k, effective) AS (SELECT symbol, dt, shares, k, CASE WHEN shares > 0 AND shares < 100 THEN 0 ELSE shares END FROM o WHERE k = 1
 UNION ALL SELECT o.symbol, o.dt, o.shares, o.k, CASE WHEN o.shares > e.effective AND o.shares - e.effective < 100 THEN e.effective ELSE o.shares END FROM o JOIN e ON o.symbol = e.symbol AND o.k = e.k+1)
SELECT symbol, dt, shares, effective FROM e""")
def _(t):
    return ordered.effective_targets(quarter_targets(t), F.lit(100.0))


@query("E26_carry_blocked_targets", "symbol:i dt:d side:s current:f desired:f final:f reason:s", "WITH RECURSIVE " + TGT + """,
keep AS (SELECT symbol, CASE WHEN (symbol + month(dt)) % 4 = 0 THEN CAST(dt + INTERVAL 3 MONTH AS DATE) ELSE dt END AS dt, sum(shares) AS shares FROM tgt GROUP BY ALL),
fr AS (SELECT symbol, min(dt) AS f FROM keep GROUP BY 1), g AS (SELECT fr.symbol, d.dt FROM fr, (SELECT DISTINCT dt FROM keep) d WHERE d.dt >= f),
o AS (SELECT g.symbol, g.dt, coalesce(shares, 0) AS want, row_number() OVER (PARTITION BY g.symbol ORDER BY g.dt) AS k,
  CASE (g.symbol + year(g.dt)) % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE '-' END AS blk FROM g LEFT JOIN keep USING (symbol, dt)),
e AS (SELECT symbol, dt, k, 0.0::DOUBLE AS cur, want, CASE WHEN blk='BUY' AND want > 0 THEN 0.0::DOUBLE ELSE want END AS fin, CASE WHEN want > 0 THEN 'BUY' WHEN want < 0 THEN 'SELL' ELSE 'HOLD' END AS side, blk FROM o WHERE k = 1
 UNION ALL SELECT o.symbol, o.dt, o.k, e.fin, o.want, CASE WHEN (o.blk='BUY' AND o.want > e.fin) OR (o.blk='SELL' AND o.want < e.fin) THEN e.fin ELSE o.want END,
  CASE WHEN o.want > e.fin THEN 'BUY' WHEN o.want < e.fin THEN 'SELL' ELSE 'HOLD' END, o.blk FROM o JOIN e ON o.symbol = e.symbol AND o.k = e.k+1)
SELECT symbol, dt, side, cur AS current, want AS desired, fin AS final, CASE WHEN side = blk THEN 'blocked_' || lower(side) ELSE 'target' END AS reason FROM e WHERE fin > 0 OR cur > 0""")
def _(t):
    # A quarter of the targets comes one quarter late, so that symbols are absent on some dates.
    late = F.when((F.col("symbol") + F.month("dt")) % 4 == 0, F.add_months("dt", 3)).otherwise(F.col("dt"))
    targets = quarter_targets(t).withColumn("dt", late).groupBy("symbol", "dt").agg(F.sum("shares").alias("shares"))
    m = (F.col("symbol") + F.year("dt")) % 5
    dates = targets.agg(F.collect_set("dt")).scalar()
    grid = targets.select("symbol").distinct().withColumn("dt", F.explode(dates))
    blocks = grid.select("symbol", "dt", F.when(m == 0, "BUY").when(m == 1, "SELL").alias("side")).where("side is not null")
    return ordered.carry_blocked_targets(targets, blocks)
