"""Printed numbers as columns: what a table's cell says, and which mark its table uses for decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: A sign, digits with commas and spaces as they come, and a decimal point with digits.
_NUMBER = "^[-−+]?\\d[\\d,  ]*(?:\\.\\d+)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def leading_number(text: Column) -> Column:
    """The number a cell starts with, as printed; empty if none.  A comma before a space ends it."""
    shown = F.regexp_extract(F.trim(text), _NUMBER, 0)
    return let(shown, lambda s: F.when(s.rlike("[,  ]"), F.regexp_replace(F.regexp_replace(s, ",[  ].*$", ""), "[,  ]+$", "")).otherwise(s))


def comma_role(shown: Column) -> Column:
    """What the comma of a printed number is: decimal, thousands or ambiguous; null if it has none."""
    core = F.regexp_replace(shown, "^[-−+]+", "")
    commas = F.length(core) - F.length(F.replace(core, F.lit(",")))
    grouped = core.rlike("^[1-9]\\d{0,2},\\d{3}$")
    return (
        F.when(commas == 0, F.lit(None).cast("string"))
        .when(core.contains(".") | (commas > 1), "thousands")
        .when(grouped, "ambiguous")
        .otherwise("decimal")
    )


def parse_number(text: Column, decimal: Column | None = None) -> Column:
    """The value of the number a cell starts with; null if none.

    ``decimal`` is the mark the table uses; it settles numbers that can be read either way, which
    are thousands without it.
    """
    mark = F.lit(None).cast("string") if decimal is None else decimal

    def value(shown: Column) -> Column:
        is_decimal = let(comma_role(shown), lambda role: (role == "decimal") | ((role == "ambiguous") & mark.eqNullSafe(F.lit(","))))
        plain = F.translate(shown, "−  ", "-")
        raw = F.when(~F.contains(shown, F.lit(",")), plain).when(is_decimal, F.replace(plain, F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(",")))
        return F.when(shown != "", raw.try_cast("double"))

    return let(leading_number(text), value)


def mark_vote(text: Column) -> Column:
    """1 if a cell shows a decimal comma, -1 if it shows a point or a comma of thousands, else 0."""

    def vote(shown: Column) -> Column:
        return F.when(~shown.rlike("[,.]"), 0).otherwise(let(comma_role(shown), lambda role: F.when(role == "decimal", 1).when((role == "thousands") | (role.isNull() & shown.contains(".")), -1).otherwise(0)))

    return let(leading_number(text), vote)


def decimal_mark(text: Column, over: WindowSpec | None = None) -> Column:
    """The mark that most of the cells show, null on a tie: an aggregate, or a window function."""
    votes = F.sum(mark_vote(text))
    votes = votes if over is None else votes.over(over)
    return F.when(votes > 0, ",").when(votes < 0, ".")


def decimals(text: Column) -> Column:
    """Digits after the decimal point of a printed number."""
    return F.length(F.regexp_extract(leading_number(text), "\\.(\\d+)$", 1)).cast("long")


def tolerance(places: Column) -> Column:
    """Half of the last printed digit."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -places)


def set_decimals(text: Column, places: int) -> Column:
    """The cell with its number rounded half up to so many places; what follows the number stays."""
    shown = leading_number(text)
    value = F.round(F.translate(shown, "−,", "-").try_cast("decimal(30,10)"), places).cast(f"decimal(30,{places})").cast("string")
    tail = F.substr(F.trim(text), F.length(shown) + 1)
    return F.when((shown != "") & value.isNotNull(), F.concat(value, tail)).otherwise(text)
