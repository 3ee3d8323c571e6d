"""Set operations and blends of score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.evaluation import daily_ic
from tapeloom.session import stage
from tapeloom.skew import PER_RANGE, average_ranks

KEYS = ["dt", "instrument"]


def append_report(parts: DataFrame, cal: DataFrame) -> DataFrame:
    """Per part: range, whether it starts after the previous part and on the next
    session, and calendar sessions it lacks. Input: part, dt."""
    spans = parts.groupBy("part").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.count_distinct("dt").alias("sessions"))
    no = F.broadcast(cal)
    spans = spans.join(no.toDF("first_dt", "a"), "first_dt", "left").join(no.toDF("last_dt", "b"), "last_dt", "left")
    w = Window.orderBy("part")
    return spans.withColumns({
        "strictly_later": F.coalesce(F.col("first_dt") > F.lag("last_dt").over(w), F.lit(True)),
        "next_session": F.coalesce(F.col("a") == F.lag("b").over(w) + 1, F.lit(True)),
        "missing_sessions": F.col("b") - F.col("a") + 1 - F.col("sessions")}).drop("a", "b")


def append_strictly_later(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Union of two periods; raises when the later one starts too early."""
    end = earlier.agg(F.max("dt")).scalar()
    early = F.when(F.col("dt") <= end, F.raise_error(F.lit("later part overlaps the earlier one")).cast("boolean")).otherwise(F.lit(True))
    return earlier.unionByName(later.where(early))


def symbol_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union, intersection and differences of two symbol sets, labelled."""
    x, y = a.select("instrument"), b.select("instrument")
    sets = {"union": x.union(y).distinct(), "both": x.intersect(y), "a_only": x.subtract(y), "b_only": y.subtract(x)}
    return reduce(DataFrame.unionByName, [s.withColumn("part", F.lit(n)) for n, s in sets.items()])


def rank_blend(baseline: DataFrame, candidate: DataFrame, weights: list[float], per_range: int = PER_RANGE) -> DataFrame:
    """Per-date percent ranks of two scores and their mixes, long by weight.

    Input: dt, instrument, score on both sides.
    """
    both = stage(baseline.select(*KEYS, F.col("score").alias("a")).join(candidate.select(*KEYS, F.col("score").alias("b")), KEYS), "blend")
    out = average_ranks(both, ["dt"], {"a": "a_rank", "b": "b_rank"}, pct=True, per_range=per_range, staged=True)
    mix = F.array(*[F.struct(F.lit(float(w)).alias("weight"), ((1.0 - w) * F.col("a_rank") + w * F.col("b_rank")).alias("blend")) for w in weights])
    return out.select(*KEYS, "a_rank", "b_rank", F.inline(mix))


def blend_gaps(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Unmatched rows on each side and the mean daily rank correlation."""
    a, b = baseline.select(*KEYS), candidate.select(*KEYS)
    both = baseline.select(*KEYS, F.col("score").alias("a")).join(candidate.select(*KEYS, F.col("score").alias("b")), KEYS)
    ic = daily_ic(both, "a", "b").agg(F.avg("ic").alias("rank_corr"), F.count(F.lit(1)).alias("dates"))
    return ic.withColumn("baseline_only", a.join(b, KEYS, "left_anti").agg(F.count(F.lit(1))).scalar()).withColumn(
        "candidate_only", b.join(a, KEYS, "left_anti").agg(F.count(F.lit(1))).scalar())


def equal_keys(tables: list[DataFrame], same: list[str] | None = None) -> DataFrame:
    """One row per (dt, instrument) with every table's row as `t0`, `t1`, ...

    Blends are defined on tables with the same keys, each once: a repeated key,
    one that a table lacks, or a `same` column (fold, label, edge) that differs
    raises an error.
    """
    marked = [m.select(*KEYS, F.lit(i).alias("_i"), F.struct(*[c for c in m.columns if c not in KEYS]).alias("_row")) for i, m in enumerate(tables)]
    shape = [m.select("_row").schema["_row"].dataType for m in marked]
    wide = [m.select(*KEYS, "_i", *[(F.col("_row") if i == j else F.lit(None).cast(kind)).alias(f"t{j}") for j, kind in enumerate(shape)])
            for i, m in enumerate(marked)]
    out = reduce(DataFrame.unionByName, wide).groupBy(*KEYS).agg(
        *[F.count_if(F.col("_i") == i).alias(f"_n{i}") for i in range(len(tables))], *[F.any_value(f"t{i}", True).alias(f"t{i}") for i in range(len(tables))])
    once = reduce(lambda x, y: x & y, [F.col(f"_n{i}") == 1 for i in range(len(tables))])
    alike = [F.col("t0")[c].eqNullSafe(F.col(f"t{i}")[c]) for c in same or [] for i in range(1, len(tables))]
    key = F.concat_ws(" ", *[F.col(k).cast("string") for k in KEYS])
    checked = F.when(~once, F.raise_error(F.concat(F.lit("key not exactly once in every table: "), key)).cast("boolean"))
    if alike:
        checked = checked.when(~reduce(lambda x, y: x & y, alike), F.raise_error(F.concat(F.lit(f"tables differ in {', '.join(same)}: "), key)).cast("boolean"))
    return out.where(checked.otherwise(F.lit(True))).select(*KEYS, *[f"t{i}" for i in range(len(tables))])


def weighted_blend(models: list[DataFrame], weights: list[float], per_range: int = PER_RANGE) -> DataFrame:
    """Weighted score of n tables with equal keys, and rank consensus per date.

    Each table: dt, instrument, score, and any of fold, label and edge, which
    must then agree (see `equal_keys`). Ranks count from the best score.
    """
    total = float(sum(weights))
    same = [c for c in ("fold", "label", "edge") if all(c in m.columns for m in models)]
    joined = equal_keys([m.select(*KEYS, "score", *same) for m in models], same)
    out = joined.select(*KEYS, *[F.col("t0")[c].alias(c) for c in same], *[F.col(f"t{i}")["score"].alias(f"s{i}") for i in range(len(models))])
    mix = reduce(lambda x, y: x + y, [F.col(f"s{i}") * (w / total) for i, w in enumerate(weights)])
    # Written once: counting the dates' rows would otherwise group all keys a second time.
    out = stage(out, "blend").withColumn("score", mix).withColumns({f"_n{i}": -F.col(f"s{i}") for i in range(len(models))})
    out = average_ranks(out, ["dt"], {f"_n{i}": f"r{i}" for i in range(len(models))}, per_range=per_range, staged=True)
    ranks = [F.col(f"r{i}") for i in range(len(models))]
    return out.withColumn("worst_rank", F.greatest(*ranks)).withColumn(
        "mean_rank", reduce(lambda x, y: x + y, ranks) / len(models)).drop(*[f"_n{i}" for i in range(len(models))])


def assemble_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Union of the layers' fold tables with a layer column."""
    return reduce(DataFrame.unionByName, [df.withColumn("layer", F.lit(n)) for n, df in layers.items()])
