"""Columns a stage does not read, carried through it where none of its own names can meet them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN = ("doc_id", "text", "lang", "source", "n_chars")
HELD = "_held"


def set_apart(docs: DataFrame, plain: tuple[str, ...] = PLAIN) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with every other column inside one struct, and what takes them out again.

    The second function gives the columns of `docs` in their order, then those
    that were added; an added column replaces a held one of its name. Without
    other columns both leave their frame as it is.
    """
    names = docs.columns
    other = [c for c in names if c not in plain]
    if not other:
        return docs, lambda out: out
    inside = {c: f"c{k}" for k, c in enumerate(other)}
    held = F.struct(*[F.col(f"`{c}`").alias(k) for c, k in inside.items()]).alias(HELD)

    def restored(out: DataFrame) -> DataFrame:
        made = [c for c in out.columns if c != HELD]
        given = [F.col(c) if c in made else F.col(HELD)[inside[c]].alias(c) for c in names if c in made or c in inside]
        return out.select(*given, *[F.col(c) for c in made if c not in names])

    return docs.select(*[c for c in names if c in plain], held), restored
