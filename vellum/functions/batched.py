"""Plain functions of a value or two as columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.editing import Refused


def batched(function: Callable, returns: str) -> Callable[..., Column]:
    """``function`` over columns; a null first argument gives null.  Structs go as arrays of one."""
    struct = returns.startswith("struct<")
    kind = f"array<{returns}>" if struct else returns

    def over(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def apply(rows: pd.DataFrame) -> pd.Series:
            out = []
            for row in zip(*(rows[c] for c in rows.columns), strict=True):
                value = None if row[0] is None else function(*row)
                out.append([value] if struct and value is not None else value)
            return pd.Series(out, dtype=object)

        made = apply(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))))
        return made[0] if struct else made

    return over


def attempted(function: Callable, *fixed: object, **options: object) -> Callable[..., Column]:
    """An edit over columns as struct(xml, why): what it makes, or why it can't be made."""

    def attempt(*row: object) -> dict:
        try:
            made = function(*row, *fixed, **options)
        except Refused as why:
            return {"xml": None, "why": str(why)}
        return {"xml": made, "why": None}

    return batched(attempt, "struct<xml:string,why:string>")
