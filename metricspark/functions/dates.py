"""Day-first parsing, periods and completed years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricspark.functions.text import trim_ws

# With ``/`` read as ``-``, one format per order of the parts is enough.
_YEAR_FIRST = r"^\d{4}-"
_DAY_FIRST_FORMAT = "d-M-yyyy[ H:mm[:ss]]"
_YEAR_FIRST_FORMAT = "yyyy-M-d[[ ]['T']H:mm[:ss]]"

# Month names of a period label.
MONTH_NAMES = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)


def parse_day_first(c: Column) -> Column:
    """Timestamp from day-first text; anything unreadable is null."""
    text = F.translate(trim_ws(c), "/", "-")
    # Choosing by shape first keeps slow failed parses away from well-formed rows.
    return F.when(
        text.rlike(_YEAR_FIRST), F.try_to_timestamp(text, F.lit(_YEAR_FIRST_FORMAT))
    ).otherwise(F.try_to_timestamp(text, F.lit(_DAY_FIRST_FORMAT)))


def period_of(ts: Column) -> Column:
    """First day of the month, the grouping key when all periods run at once."""
    return F.trunc(ts, "month")


def in_period(ts: Column, start: str, end: str) -> Column:
    """Half-open range of days; unlike ``year(ts) = …`` it reaches the parquet scan.

    The bounds are dates: they fit date and timestamp columns of either kind without a
    cast on the column, which would keep the test out of the scan.
    """
    return (ts >= F.lit(start).cast("date")) & (ts < F.lit(end).cast("date"))


def period_label(period: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return F.concat_ws(" ", F.element_at(names, F.month(period)), F.year(period).cast("string"))


def age_years(birth: Column, service: Column) -> Column:
    """Completed years; a birth after the service date gives 0, a missing date null.

    ``months_between`` is wrong here: a 29 February birthday completes a year only
    on 1 March of a common year.
    """
    before_birthday = (F.month(service) * 100 + F.dayofmonth(service)) < (
        F.month(birth) * 100 + F.dayofmonth(birth)
    )
    years = F.year(service) - F.year(birth) - F.when(before_birthday, 1).otherwise(0)
    return F.when(birth.isNull() | service.isNull(), None).when(birth > service, 0).otherwise(years)
