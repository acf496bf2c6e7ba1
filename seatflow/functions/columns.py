"""Column expressions shared by the operators (all built-in Spark functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def cents_to_currency(c) -> Column:
    """Whole cents to currency units; the only place a float appears."""
    return (F.col(c) if isinstance(c, str) else c).cast("double") / F.lit(100.0)


def error_list(*checks: tuple[Column, str]) -> Column:
    """``array`` of the names whose failure condition holds, nulls dropped.

    Each check is ``(failed_condition, name)``; a NULL condition counts as
    passed, so every rule must state its own null handling.
    """
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))




def repeatable_id(*cols) -> Column:
    """Deterministic id from key columns (``uuid()`` would differ per retry)."""
    return F.sha2(F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols]), 256)
