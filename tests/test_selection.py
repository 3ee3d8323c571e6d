"""Selection and ordered folds against plain-Python walks."""

import random

from pyspark.sql import functions as F

from tapeloom.operators import ordered, selection


def test_group_cap_equals_greedy_walk(spark):
    rng = random.Random(1)
    ranked, previous, want = [], [], {}
    for case in range(40):
        n = rng.randint(5, 25)
        groups = [rng.choice("abc") for _ in range(n)]
        prev = set(rng.sample(range(n), rng.randint(0, n // 2)))
        ranked += [(case, i, i + 1, groups[i]) for i in range(n)]
        previous += [(case, i) for i in prev]
        order = [i for i in range(n) if i in prev and i < 8] + [i for i in range(n) if not (i in prev and i < 8)]
        count, chosen = {}, []
        for i in order:
            if count.get(groups[i], 0) < 2 and len(chosen) < 5:
                chosen.append(i)
                count[groups[i]] = count.get(groups[i], 0) + 1
        want[case] = chosen
    got = selection.group_capped_top_k(
        spark.createDataFrame(ranked, "case int, instrument int, rank int, grp string"),
        spark.createDataFrame(previous, "case int, instrument int"), ["case"], top_k=5, buffer_k=8, fraction=0.4)
    found = {}
    for r in got.orderBy("case", "pick").collect():
        found.setdefault(r["case"], []).append(r["instrument"])
    assert found == want


def test_buffered_membership_equals_walk(spark):
    rng = random.Random(2)
    rows, want, before = [], [], []
    for day in range(12):
        names = list(range(15))
        rng.shuffle(names)
        rows += [("p", f"2024-01-{day + 1:02d}", name, i + 1) for i, name in enumerate(names)]
        kept = [n for n in names[:6] if n in before]
        before = (kept + [n for n in names if n not in kept])[:3]
        want.append(before)
    df = spark.createDataFrame(rows, "profile string, d string, instrument long, rank int").withColumn("dt", F.col("d").cast("date"))
    got = selection.buffered_membership(df, "profile", top_k=3, buffer_k=6).orderBy("dt", "pos").collect()
    assert [[r["instrument"] for r in got[i:i + 3]] for i in range(0, len(got), 3)] == want


def test_budget_skips_and_goes_on(spark):
    rows = [("d", 1, "a", 60.0), ("d", 2, "b", 50.0), ("d", 3, "c", 40.0), ("d", 4, "e", 1.0)]
    df = spark.createDataFrame(rows, "day string, rank int, instrument string, cost double")
    got = ordered.budgeted_accept(df, keys=["day"], order=["rank"], cost="cost", limit=F.lit(100.0), id_col="instrument", max_items=9)
    assert {r["instrument"]: r["accepted"] for r in got.collect()} == {"a": True, "b": False, "c": True, "e": False}


def _allocate(items, budget, k):
    """Widest affordable count, floor to lots, then one spare lot each by closeness."""
    items = [x for x in items[:k] if x[1] > 0]
    for n in range(len(items), 0, -1):
        fit = [x for x in items if x[1] * x[2] <= budget / n + 1e-9]
        if len(fit) >= n:
            break
    else:
        return {}
    ideal, shares = budget / n, {}
    for name, price, low in fit[:n]:
        v = ideal // price // 100 * 100
        if v >= low:
            shares[name] = (v, price)
    left = budget - sum(v * p for v, p in shares.values())
    tops = sorted((abs(v * p + 100 * p - ideal) - abs(v * p - ideal), i, name) for i, (name, (v, p)) in enumerate(shares.items()))
    out = {n: v for n, (v, _) in shares.items()}
    for _, _, name in tops:
        cost = 100 * shares[name][1]
        if cost <= left + 1e-9:
            out[name] += 100
            left -= cost
    return out


def test_capital_aware_allocation(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for case in range(25):
        items = [(f"s{i}", round(rng.uniform(2, 400), 2), rng.choice([100, 200])) for i in range(rng.randint(2, 9))]
        rows += [(case, n, i + 1, p, float(m)) for i, (n, p, m) in enumerate(items)]
        want[case] = _allocate(items, 60_000.0, 8)
    df = spark.createDataFrame(rows, "case int, instrument string, rank int, price double, lot_min double")
    got = {}
    for r in selection.capital_aware_lots(df, ["case"], budget=F.lit(60_000.0), k=8).collect():
        got.setdefault(r["case"], {})[r["instrument"]] = r["shares"]
    assert got == {c: w for c, w in want.items() if w}


def test_small_raise_keeps_effective_shares(spark):
    rows = [("a", "2024-01-01", 300.0), ("a", "2024-01-02", 350.0), ("a", "2024-01-03", 380.0), ("a", "2024-01-04", 420.0), ("a", "2024-01-05", 100.0)]
    df = spark.createDataFrame(rows, "symbol string, d string, shares double").withColumn("dt", F.col("d").cast("date"))
    got = ordered.effective_targets(df, F.lit(100.0)).orderBy("dt").collect()
    assert [r["effective"] for r in got] == [300.0, 300.0, 300.0, 420.0, 100.0]


def test_blocked_sell_is_kept_or_retried(spark):
    targets = spark.createDataFrame([("a", "2024-01-01", 200.0), ("b", "2024-01-02", 100.0)], "symbol string, d string, shares double").withColumn("dt", F.col("d").cast("date"))
    blocks = spark.createDataFrame([("a", "2024-01-02", "SELL")], "symbol string, d string, side string").withColumn("dt", F.col("d").cast("date"))
    kept = {(r["symbol"], str(r["dt"])): (r["final"], r["reason"]) for r in ordered.carry_blocked_targets(targets, blocks).collect()}
    assert kept["a", "2024-01-02"] == (200.0, "blocked_sell")
    retry = {(r["symbol"], str(r["dt"])): (r["final"], r["reason"]) for r in ordered.carry_blocked_targets(targets, blocks, retry_sells=True).collect()}
    assert retry["a", "2024-01-02"] == (0.0, "retry_blocked_sell")
