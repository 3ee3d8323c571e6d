"""Filters, flags and block lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def restrict_window(df: DataFrame, on: str, start: str, end: str, *, minute: bool = False) -> DataFrame:
    """Daily: closed [start, end]; minute: half-open [start, end + 1 day)."""
    if not minute:
        return df.where(F.col(on).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    kind = df.schema[on].dataType.simpleString()
    stop = F.date_add(F.lit(end).cast("date"), 1)
    return df.where((F.col(on) >= F.lit(start).cast(kind)) & (F.col(on) < stop.cast(kind)))


def approx_match(df: DataFrame, setting: dict[str, float], tol: float = 1e-12) -> DataFrame:
    """Rows of one parameter setting, with a float tolerance."""
    return df.where(reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.lit(v)) <= tol for c, v in setting.items()]))


def select_families(df: DataFrame, families: dict[str, list[str]], chosen: list[str], always: list[str]) -> DataFrame:
    """Keep the columns of the chosen families plus the always-kept ones."""
    wanted = {c for name in chosen for c in families[name]} | set(always)
    return df.select([c for c in df.columns if c in wanted])


def reasons(flags: dict[str, Column], sep: str) -> Column:
    """Joined names of the true flags."""
    return F.concat_ws(sep, *[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def build_blocklist(names: DataFrame, state: DataFrame, as_of: str, allow: DataFrame) -> DataFrame:
    """Blocked instruments with `;`-joined reasons.

    `names`: instrument, name, status, delist_date. `state`: instrument, dt,
    is_st (only the exact date counts). `allow` overrides every reason.
    """
    day = F.lit(as_of).cast("date")
    flagged = state.where((F.col("dt") == day) & F.col("is_st")).select("instrument", F.lit(True).alias("_state")).distinct()
    text = reasons({
        "name": F.upper("name").rlike(r"^(\*ST|ST)"),
        "delisting_text": F.col("name").contains("退"),
        "status": F.lower("status") != "active",
        "delist_date": F.col("delist_date") <= day,
        f"state@{as_of}": F.coalesce("_state", F.lit(False)),
    }, ";")
    return (
        names.join(flagged, "instrument", "full").join(allow.select("instrument"), "instrument", "left_anti")
        .select("instrument", text.alias("reason")).where("reason <> ''")
    )


def factor_risk_flags(df: DataFrame, scale_patterns: list[str]) -> DataFrame:
    """Comma-joined risk reasons per factor and whether it stays in the list.

    Input: factor, same_sign, stable_ic, null_ratio, mean_shift.
    """
    scale = reduce(lambda a, b: a | b, [F.upper("factor").contains(p) for p in scale_patterns])
    flip, weak = ~F.col("same_sign"), F.coalesce("stable_ic", F.lit(0)) <= 0
    text = reasons({
        "scale": scale, "sign_flip": flip, "unstable_ic": weak,
        "null_ratio": F.col("null_ratio") > 0.05, "mean_shift": F.abs("mean_shift") > 0.75,
    }, ",")
    return df.withColumn("reasons", text).withColumn("keep", ~(scale | flip | weak))


def stale_block(panel: DataFrame, rejected: Column, sessions: int) -> DataFrame:
    """Blocked for `sessions` sessions from a rejection, and blocked for good.

    `panel` has instrument, dt and session_no, one row per session.
    """
    w = Window.partitionBy("instrument").orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(rejected, F.col("session_no"))).over(w)
    return panel.withColumn("_last", last).withColumn(
        "blocked", F.coalesce(F.col("session_no") < F.col("_last") + sessions, F.lit(False))
    ).withColumn("persistent", F.col("_last").isNotNull()).drop("_last")
