"""F: sort, limit, top-k and allocation; G: set operations."""

from pyspark.sql import functions as F

from tapeloom.catalog.aggregates import TR, trades
from tapeloom.catalog.base import BARS, BARS_W, FALLBACK, HELD, PRIMARY, SESS, query, with_
from tapeloom.catalog.windows import GRP, W, _avg_rank, groups
from tapeloom.operators import blending, ordered, reconcile, selection, sessions
from tapeloom.skew import row_position

X = "x AS (SELECT *, close/open-1 AS a FROM barsw)"


def xw(t):
    return t.bars_w().withColumn("a", F.col("close") / F.col("open") - 1)


@query("F1_daily_top_n", "dt:d instrument:i rank:i a:f", with_(BARS_W, X) + "SELECT dt, instrument, rank, a FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY a DESC, instrument) AS rank FROM x) WHERE rank <= 10")
def _(t):
    return selection.top_n(xw(t), ["dt"], "a", "instrument", 10)


CAP = GRP + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY close DESC, instrument) AS rank FROM barsw), pv AS (SELECT n AS dt, instrument FROM rk JOIN (SELECT dt, lead(dt) OVER (ORDER BY dt) AS n FROM (SELECT DISTINCT dt FROM barsw)) USING (dt) WHERE rank <= 10),
mk AS (SELECT rk.dt, rk.instrument, rank, g, CAST(pv.instrument IS NOT NULL AND rank <= 20 AS INT) AS k FROM rk JOIN grp USING (instrument) LEFT JOIN pv ON pv.dt = rk.dt AND pv.instrument = rk.instrument),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt, g ORDER BY k DESC, rank) AS gi FROM mk) WHERE gi <= 4)"""


def ranked_w(t):
    return row_position(t.bars_w(), ["dt"], "close", "instrument", "rank", descending=True)


@query("F2_group_capped_top_k", "dt:d instrument:i rank:i pick:i retained:i grp:s", with_(BARS_W, CAP) + """
SELECT dt, instrument, rank, pick, k AS retained, g AS grp FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY k DESC, rank) AS pick FROM cp) WHERE pick <= 10""")
def _(t):
    ranked = ranked_w(t).join(groups(t), "instrument")
    nxt = F.broadcast(sessions.next_session_map(sessions.calendar(t.bars_w().select("dt"))))
    prev = ranked.where("rank <= 10").select("dt", "instrument").join(nxt, "dt").select(F.col("next_dt").alias("dt"), "instrument")
    return selection.group_capped_top_k(ranked, prev, ["dt"], top_k=10, buffer_k=20, fraction=0.4)


@query("F3_rank_hysteresis", "dt:d instrument:i rank:i member:b", with_(BARS_W, "rk AS (SELECT dt, instrument, row_number() OVER (PARTITION BY dt ORDER BY close DESC, instrument) AS rank FROM barsw)") + f"""
SELECT *, coalesce(last_value(CASE WHEN rank <= 10 THEN 1 WHEN rank > 20 THEN 0 END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS member FROM rk""")
def _(t):
    return selection.rank_hysteresis(ranked_w(t), enter=10, leave=20)


@query("F3_buffered_membership", "profile:s dt:d pos:i instrument:i", "WITH RECURSIVE " + BARS_W + """,
pools AS (SELECT 'p' || instrument % 4 AS profile, * FROM barsw),
rk AS (SELECT profile, dt, instrument, row_number() OVER (PARTITION BY profile, dt ORDER BY close DESC, instrument) AS rank FROM pools),
n AS (SELECT profile, dt, row_number() OVER (PARTITION BY profile ORDER BY dt) AS d, list(instrument ORDER BY rank) AS all_names, coalesce(list(instrument ORDER BY rank) FILTER (WHERE rank <= 20), []) AS near FROM rk WHERE rank <= 30 GROUP BY profile, dt),
g(profile, d, dt, picked) AS (SELECT profile, d, dt, all_names[1:10] FROM n WHERE d = 1
 UNION ALL SELECT n.profile, n.d, n.dt, list_concat(list_filter(n.near, lambda x: list_contains(g.picked, x)), list_filter(n.all_names, lambda x: NOT (list_contains(g.picked, x) AND list_contains(n.near, x))))[1:10] FROM n JOIN g ON n.profile = g.profile AND n.d = g.d+1)
SELECT profile, dt, generate_subscripts(picked, 1)-1 AS pos, unnest(picked) AS instrument FROM g""")
def _(t):
    pools = t.bars_w().withColumn("profile", F.concat(F.lit("p"), F.col("instrument") % 4))
    ranked = selection.top_n(pools, ["profile", "dt"], "close", "instrument", 30)
    return selection.buffered_membership(ranked, "profile", top_k=10, buffer_k=20)


SIDES = HELD + """, sc AS (SELECT *, shares AS held, shares*0.8 AS available, decision_price AS price, (instrument*37+day(dt)*11) % 100 / 100.0 AS bs, (instrument*53+day(dt)*7) % 100 / 100.0 AS ss FROM held),
ok AS (SELECT *, CASE WHEN code LIKE '688%' OR code LIKE '689%' THEN 200 ELSE 100 END AS lot FROM sc), e AS (SELECT * FROM ok WHERE held >= 2*lot AND available >= lot AND price > 0)"""


def sides(t):
    h = t.held()
    k, d = F.col("instrument"), F.day("dt")
    return h.select("instrument", "dt", "code", F.col("shares").alias("held"), (F.col("shares") * 0.8).alias("available"), F.col("decision_price").alias("price"),
                    ((k * 37 + d * 11) % 100 / 100.0).alias("buy_score"), ((k * 53 + d * 7) % 100 / 100.0).alias("sell_score"))


@query("F4_two_sided_candidates", "dt:d instrument:i direction:s rank:i score:f entry_limit:f volume:f", with_(SIDES, """
b AS (SELECT *, 'buy_first' AS direction, bs AS score FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY bs DESC, instrument) AS r FROM e WHERE bs >= 0.6) WHERE r <= 3),
s AS (SELECT *, 'sell_first' AS direction, ss AS score FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY ss DESC, instrument) AS r FROM e WHERE ss >= 0.6) WHERE r <= 3),
u AS (SELECT *, count(*) OVER (PARTITION BY dt, instrument) AS c FROM (SELECT * FROM b UNION ALL SELECT * FROM s)), z AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY score DESC, instrument) AS rank FROM u WHERE c = 1)""") + """
SELECT dt, instrument, direction, rank, score, price*CASE WHEN direction = 'buy_first' THEN 1-0.006 ELSE 1+0.0075 END AS entry_limit, lot AS volume FROM z WHERE rank <= 4""")
def _(t):
    return selection.two_sided_candidates(sides(t), buy_at=0.6, sell_at=0.6, buy_n=3, sell_n=3, total=4)


@query("F5_one_sided_candidates", "dt:d instrument:i rank:i entry_limit:f", with_(SIDES) + """
SELECT dt, instrument, rank, price*1.0075 AS entry_limit FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY ss DESC, instrument) AS rank FROM e WHERE ss >= 0.5) WHERE rank <= 2""")
def _(t):
    return selection.one_sided_candidates(sides(t), n=2, at_least=0.5)


@query("F6_budgeted_accept", "dt:d instrument:i rank:i accepted:b used:f2", "WITH RECURSIVE " + TR + """,
td AS (SELECT instrument, dt, sum(turnover) AS turnover FROM tr GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY turnover DESC, instrument) AS rank FROM td) WHERE rank <= 6),
g(dt, instrument, rank, accepted, used) AS (SELECT dt, instrument, rank, turnover <= 120000, CASE WHEN turnover <= 120000 THEN turnover ELSE 0 END FROM k WHERE rank = 1
 UNION ALL SELECT k.dt, k.instrument, k.rank, g.used+turnover <= 120000, CASE WHEN g.used+turnover <= 120000 THEN g.used+turnover ELSE g.used END FROM k JOIN g ON k.dt = g.dt AND k.rank = g.rank+1)
SELECT * FROM g""")
def _(t):
    td = trades(t).groupBy("instrument", "dt").agg(F.sum("turnover").alias("turnover"))
    top = selection.top_n(td, ["dt"], "turnover", "instrument", 6)
    return ordered.budgeted_accept(top, keys=["dt"], order=["rank"], cost="turnover", limit=F.lit(120_000.0), id_col="instrument", max_items=6)


@query("F7_prefix_until_share", "dt:d instrument:i pos:i turnover:f2", with_(TR, "td AS (SELECT instrument, dt, sum(turnover) AS turnover FROM tr GROUP BY ALL)", """
k AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY turnover DESC, instrument) AS pos, coalesce(sum(turnover) OVER (PARTITION BY dt ORDER BY turnover DESC, instrument ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(turnover) OVER (PARTITION BY dt) AS tot FROM td)""") + """
SELECT dt, instrument, pos, turnover FROM k WHERE (b < tot*0.4 OR pos = 1) AND pos <= 8""")
def _(t):
    td = trades(t).groupBy("instrument", "dt").agg(F.sum("turnover").alias("turnover"))
    return selection.prefix_until_share(td, ["dt"], "turnover", "instrument", 0.4, 8)


LOT = HELD + """, lp AS (SELECT dt, instrument, decision_price AS price, CASE WHEN code LIKE '688%' THEN 200.0 ELSE 100.0 END AS lot_min, row_number() OVER (PARTITION BY dt ORDER BY visible_volume DESC, instrument) AS rank FROM held)"""


def lots(t):
    h = t.held().select("dt", "instrument", F.col("decision_price").alias("price"), F.when(F.col("code").startswith("688"), 200.0).otherwise(100.0).alias("lot_min"), "visible_volume")
    return selection.top_n(h, ["dt"], "visible_volume", "instrument", 12)


@query("F8_equal_weight_lots", "dt:d instrument:i rank:i shares:f", with_(LOT) + """
SELECT dt, instrument, rank, CASE WHEN floor(200000/price/100)*100 >= lot_min THEN floor(200000/price/100)*100 ELSE 0 END AS shares FROM lp WHERE rank <= 12 AND price > 0""")
def _(t):
    return selection.equal_weight_lots(lots(t), ["dt"], budget=F.lit(2_400_000.0), k=12)


@query("F8_capital_aware_base", "dt:d instrument:i n_names:i base_shares:f", with_(LOT, """
c AS (SELECT *, greatest(lot_min, 100)*price AS m FROM lp WHERE rank <= 12 AND price > 0), w AS (SELECT dt, max(i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY m, rank) AS i FROM c) WHERE m*i <= 2400000+1e-9 GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY rank) AS o FROM c JOIN w USING (dt) WHERE m <= 2400000.0/n+1e-9)""") + """
SELECT dt, instrument, n AS n_names, floor(2400000.0/n/price/100)*100 AS base_shares FROM f WHERE o <= n AND floor(2400000.0/n/price/100)*100 >= lot_min""")
def _(t):
    return selection.capital_aware_lots(lots(t), ["dt"], budget=F.lit(2_400_000.0), k=12)


@query("F8_capital_aware_lots", "dt:d instrument:i n_names:i shares:f", "WITH RECURSIVE " + LOT + """,
c AS (SELECT *, greatest(lot_min, 100)*price AS m FROM lp WHERE rank <= 12 AND price > 0), w AS (SELECT dt, max(i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY m, rank) AS i FROM c) WHERE m*i <= 2400000+1e-9 GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY rank) AS o, 2400000::DOUBLE/n AS ideal FROM c JOIN w USING (dt) WHERE m <= 2400000.0/n+1e-9),
b AS (SELECT *, floor(ideal/price/100)*100 AS base FROM f WHERE o <= n AND floor(ideal/price/100)*100 >= lot_min),
q AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY abs(base*price+100*price-ideal)-abs(base*price-ideal), o) AS j, greatest(0, 2400000::DOUBLE-sum(base*price) OVER (PARTITION BY dt)) AS rest FROM b),
g(dt, instrument, n, base, j, got, rest) AS (SELECT dt, instrument, n, base, j, 100*price <= rest+1e-9, CASE WHEN 100*price <= rest+1e-9 THEN rest-100*price ELSE rest END FROM q WHERE j = 1
 UNION ALL SELECT q.dt, q.instrument, q.n, q.base, q.j, 100*q.price <= g.rest+1e-9, CASE WHEN 100*q.price <= g.rest+1e-9 THEN g.rest-100*q.price ELSE g.rest END FROM q JOIN g ON q.dt = g.dt AND q.j = g.j+1)
SELECT dt, instrument, n AS n_names, base + CASE WHEN got THEN 100 ELSE 0 END AS shares FROM g""")
def _(t):
    return selection.capital_aware_lots(lots(t), ["dt"], budget=F.lit(2_400_000.0), k=12)


@query("F9_topk_union_missing", "instrument:i", with_(BARS_W, X, PRIMARY) + """
SELECT DISTINCT instrument FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY a DESC, instrument) AS rank FROM x) WHERE rank <= 10 AND instrument NOT IN (SELECT instrument FROM prim GROUP BY instrument HAVING max(volume) > 100)""")
def _(t):
    return selection.union_missing(selection.top_n(xw(t), ["dt"], "a", "instrument", 10), t.primary().groupBy("instrument").agg(F.max("volume").alias("most")).where("most > 100"))


@query("F10_stratified_sample", "doc_id:i lang:s", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, doc_id < 20 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE doc_id < 20 OR k <= 100""")
def _(t):
    return selection.stratified_sample(t.raw("documents").select("doc_id", "lang"), "lang", ["doc_id"], 100, F.col("doc_id") < 20)


@query("F11_ordered_output", "l_orderkey:i l_linenumber:i l_partkey:i l_extendedprice:f2", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""")
def _(t):
    return selection.ordered_rows(t.raw("lineitem"), [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 25)


@query("G1_merge_sources", "instrument:i dt:d close:f volume:f source_no:i", with_(PRIMARY, FALLBACK) + """
SELECT instrument, dt, coalesce(p.close, f.close) AS close, coalesce(p.volume, f.volume) AS volume, CAST(p.close IS NOT NULL AS INT) AS source_no FROM prim p FULL JOIN fall f USING (instrument, dt)""")
def _(t):
    return reconcile.merge_sources(t.primary(), t.fallback(), ["instrument", "dt"])


@query("G2_append_strictly_later", "part:i first_dt:d last_dt:d sessions:i strictly_later:b next_session:b missing_sessions:i", with_(SESS, """
p AS (SELECT year(dt) AS part, dt FROM (SELECT CASE WHEN l_shipdate >= TIMESTAMP '1996-11-01' AND l_shipdate < TIMESTAMP '1997-02-01' THEN CAST(l_shipdate AS DATE) - 365 ELSE CAST(l_shipdate AS DATE) END AS dt FROM lineitem)), g AS (SELECT part, min(dt) AS first_dt, max(dt) AS last_dt, count(DISTINCT dt) AS sessions FROM p GROUP BY 1),
j AS (SELECT g.*, a.session_no AS x, b.session_no AS y FROM g LEFT JOIN sess a ON a.dt = first_dt LEFT JOIN sess b ON b.dt = last_dt)""") + """
SELECT *, coalesce(first_dt > lag(last_dt) OVER (ORDER BY part), true) AS strictly_later, coalesce(x = lag(y) OVER (ORDER BY part)+1, true) AS next_session, y-x+1-sessions AS missing_sessions FROM j""")
def _(t):
    day = F.col("l_shipdate").cast("date")
    # One winter is moved a year back, which leaves a hole without leaving out rows.
    moved = F.when(day.between(F.lit("1996-11-01").cast("date"), F.lit("1997-01-31").cast("date")), F.date_sub(day, 365)).otherwise(day)
    parts = t.raw("lineitem").select(moved.alias("dt")).withColumn("part", F.year("dt"))
    return blending.append_report(parts, sessions.calendar(t.dates()))


@query("G2_append_rows", "year:i rows:i", with_(BARS) + "SELECT year(dt) AS year, count(*) AS rows FROM bars GROUP BY 1")
def _(t):
    cut = F.lit("1997-01-01").cast("date")
    out = blending.append_strictly_later(t.bars().where(F.col("dt") < cut), t.bars().where(F.col("dt") >= cut))
    return out.groupBy(F.year("dt").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


@query("G3_symbol_set_algebra", "part:s n:i first:i last:i", with_(PRIMARY, FALLBACK, "a AS (SELECT instrument FROM prim GROUP BY 1 HAVING max(volume) > 120)", "b AS (SELECT instrument FROM fall GROUP BY 1 HAVING max(volume) > 130)") + """
SELECT part, count(*) AS n, min(instrument) AS first, max(instrument) AS last FROM (SELECT 'union' AS part, instrument FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', instrument FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
 UNION ALL SELECT 'a_only', instrument FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_only', instrument FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY 1""")
def _(t):
    most = [x.groupBy("instrument").agg(F.max("volume").alias("most")).where(f"most > {n}") for x, n in ((t.primary(), 120), (t.fallback(), 130))]
    sets = blending.symbol_sets(*most)
    return sets.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("instrument").alias("first"), F.max("instrument").alias("last"))


TWO = f"""s1 AS (SELECT dt, instrument, close/open-1 AS score FROM barsw WHERE volume > 15), s2 AS (SELECT dt, instrument, high/low-1 AS score FROM barsw WHERE volume < 120)"""


def two(t):
    b = t.bars_w()
    return (b.where("volume > 15").select("dt", "instrument", (F.col("close") / F.col("open") - 1).alias("score")),
            b.where("volume < 120").select("dt", "instrument", (F.col("high") / F.col("low") - 1).alias("score")))


@query("G4_rank_blend", "dt:d instrument:i weight:f blend:f", with_(BARS_W, TWO, f"""
j AS (SELECT dt, instrument, s1.score AS a, s2.score AS b FROM s1 JOIN s2 USING (dt, instrument)), r AS (SELECT dt, instrument, {_avg_rank('a', 'dt')}/count(*) OVER (PARTITION BY dt) AS x, {_avg_rank('b', 'dt')}/count(*) OVER (PARTITION BY dt) AS y FROM j)""") + """
SELECT dt, instrument, weight, (1-weight)*x+weight*y AS blend FROM r, (VALUES (0.25), (0.5)) w(weight)""")
def _(t):
    return blending.rank_blend(*two(t), [0.25, 0.5])


@query("G4_blend_gaps", "rank_corr:f dates:i baseline_only:i candidate_only:i", with_(BARS_W, TWO, f"""
j AS (SELECT dt, instrument, s1.score AS a, s2.score AS b FROM s1 JOIN s2 USING (dt, instrument)), r AS (SELECT dt, {_avg_rank('a', 'dt')} AS x, {_avg_rank('b', 'dt')} AS y FROM j),
i AS (SELECT covar_pop(x, y)/nullif(stddev_pop(x)*stddev_pop(y), 0) AS ic FROM r GROUP BY dt HAVING count(*) >= 3)""") + """
SELECT avg(ic) AS rank_corr, count(ic) AS dates, (SELECT count(*) FROM s1 ANTI JOIN s2 USING (dt, instrument)) AS baseline_only, (SELECT count(*) FROM s2 ANTI JOIN s1 USING (dt, instrument)) AS candidate_only FROM i""")
def _(t):
    return blending.blend_gaps(*two(t))


@query("G5_weighted_blend", "dt:d instrument:i score:f r0:f r1:f worst_rank:f mean_rank:f", with_(BARS_W, f"""
s1 AS (SELECT dt, instrument, close/open-1 AS score FROM barsw), s2 AS (SELECT dt, instrument, high/low-1 AS score FROM barsw),
j AS (SELECT dt, instrument, s1.score AS a, s2.score AS b, -s1.score AS na, -s2.score AS nb FROM s1 JOIN s2 USING (dt, instrument)), r AS (SELECT *, {_avg_rank('na', 'dt')} AS r0, {_avg_rank('nb', 'dt')} AS r1 FROM j)""") + """
SELECT dt, instrument, a*0.75+b*0.25 AS score, r0, r1, greatest(r0, r1) AS worst_rank, (r0+r1)/2 AS mean_rank FROM r""")
def _(t):
    b = t.bars_w()
    moves = [b.select("dt", "instrument", (F.col(x) / F.col(y) - 1).alias("score")) for x, y in (("close", "open"), ("high", "low"))]
    return blending.weighted_blend(moves, [3, 1])


@query("G6_assemble_layers", "layer:s fold:i rows:i", with_(BARS) + """
SELECT 'outer' AS layer, year(dt) AS fold, count(*) AS rows FROM bars WHERE volume >= 10 GROUP BY 2 UNION ALL SELECT 'inner', year(dt), count(*) FROM bars WHERE volume < 10 GROUP BY 2""")
def _(t):
    b = t.bars().withColumn("fold", F.year("dt"))
    return blending.assemble_layers({"outer": b.where("volume >= 10"), "inner": b.where("volume < 10")}).groupBy("layer", "fold").agg(F.count(F.lit(1)).alias("rows"))
