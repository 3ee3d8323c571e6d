"""Instrument spellings, boards and lots as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_symbol(value: Column) -> Column:
    """Any of the five spellings to `sh600000` / `sz000001`; other text fails."""
    text = F.lower(F.trim(value))
    code = F.right(text, F.lit(6))
    dotted = F.right(F.substring_index(text, ".", -1), F.lit(6))
    stem = F.right(F.substring_index(text, ".", 1), F.lit(6))
    return (
        F.when(text.endswith(".xshg"), F.concat(F.lit("sh"), stem))
        .when(text.endswith(".xshe"), F.concat(F.lit("sz"), stem))
        .when(text.startswith("shse."), F.concat(F.lit("sh"), dotted))
        .when(text.startswith("szse."), F.concat(F.lit("sz"), dotted))
        .when(text.rlike("^(sh|sz).{6}"), F.left(text, F.lit(8)))
        .when(code.rlike("^[0-9]+$") & code.rlike("^[69]"), F.concat(F.lit("sh"), code))
        .when(code.rlike("^[0-9]+$"), F.concat(F.lit("sz"), code))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported symbol: "), value)).cast("string"))
    )


def normalize_group_symbol(value: Column) -> Column:
    """The metadata variant: of bare codes only 68* is Shanghai."""
    text = F.upper(F.trim(value))
    code = F.right(F.replace(text, F.lit("."), F.lit("")), F.lit(6))
    return (
        F.when(text == "", text)
        .when(text.rlike("^(SH|SZ).{6}"), F.concat(F.left(text, F.lit(2)), F.right(text, F.lit(6))))
        .when(code.startswith("68"), F.concat(F.lit("SH"), code))
        .otherwise(F.concat(F.lit("SZ"), code))
    )


def vendor_symbol(value: Column) -> Column:
    """Local spelling to the vendor's `600000.XSHG`."""
    local = normalize_symbol(value)
    suffix = F.when(local.startswith("sh"), F.lit(".XSHG")).otherwise(F.lit(".XSHE"))
    return F.concat(F.right(local, F.lit(6)), suffix)


def exchange_symbol(value: Column) -> Column:
    """Local spelling to `SHSE.600000`."""
    local = normalize_symbol(value)
    prefix = F.when(local.startswith("sh"), F.lit("SHSE.")).otherwise(F.lit("SZSE."))
    return F.concat(prefix, F.right(local, F.lit(6)))


def min_lot(code: Column) -> Column:
    """Minimum order: 200 shares for codes 688/689, else 100."""
    return F.when(code.rlike("^68[89]"), F.lit(200.0)).otherwise(F.lit(100.0))


def board(code: Column) -> Column:
    return (
        F.when(code.rlike("^30[01]"), F.lit("chinext"))
        .when(code.rlike("^68[89]"), F.lit("star"))
        .when(code.rlike("^(4|8|92)"), F.lit("beijing"))
        .otherwise(F.lit("main"))
    )


# Daily price-limit ratio per board.
BOARD_LIMITS = {"chinext": 0.20, "star": 0.20, "beijing": 0.30, "main": 0.10}


def board_limit_ratio(code: Column) -> Column:
    name = board(code)
    out = F.lit(BOARD_LIMITS["main"])
    for key in ("chinext", "star", "beijing"):
        out = F.when(name == key, F.lit(BOARD_LIMITS[key])).otherwise(out)
    return out
