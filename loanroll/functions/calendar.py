"""Report calendar: month-end keys, closing window and month names.

The reports run for the month before ``as_of``: its last day is the snapshot
key (``fecha_actual``) and the five days after it are the closing window of
the daily table. January wraps to December of the year before (the scripts
index a vector with 0 there). Keys are ``yyyymmdd`` integers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names used in report file names, January first.
MONTH_NAMES_ES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]

CLOSING_WINDOW_DAYS = 5


def date_key(d: dt.date) -> int:
    return d.year * 10000 + d.month * 100 + d.day


def key_to_date(key: int) -> dt.date:
    return dt.date(key // 10000, key // 100 % 100, key % 100)


def previous_month_end(as_of: dt.date) -> dt.date:
    return as_of.replace(day=1) - dt.timedelta(days=1)


def report_month_key(as_of: dt.date) -> int:
    """``fecha_actual``: key of the last day of the month before ``as_of``."""
    return date_key(previous_month_end(as_of))


def closing_window_keys(as_of: dt.date, days: int = CLOSING_WINDOW_DAYS) -> list[int]:
    """``fechas_cierre``: keys of the ``days`` days after the report month end."""
    me = previous_month_end(as_of)
    return [date_key(me + dt.timedelta(days=i)) for i in range(1, days + 1)]


def month_ends_of_year(year: int) -> list[dt.date]:
    """Last day of each month of ``year`` (the scripts' ``end_date`` vector)."""
    out = []
    for m in range(1, 13):
        first_next = dt.date(year + (m == 12), m % 12 + 1, 1)
        out.append(first_next - dt.timedelta(days=1))
    return out


def previous_month_name(as_of: dt.date) -> str:
    return MONTH_NAMES_ES[previous_month_end(as_of).month - 1]


# Column forms -------------------------------------------------------------

def key_of(date_col: Column) -> Column:
    """``yyyymmdd`` int of a date column (arithmetic, no string formatting)."""
    return (F.year(date_col) * 10000 + F.month(date_col) * 100 + F.dayofmonth(date_col)).cast("int")


def date_of_key(key_col: Column) -> Column:
    return F.to_date(key_col.cast("string"), "yyyyMMdd")


def month_end_key(date_col: Column) -> Column:
    return key_of(F.last_day(date_col))


def previous_month_end_col(as_of_col: Column) -> Column:
    return F.date_sub(F.trunc(as_of_col, "month"), 1)


def month_ends_col(year_col: Column) -> Column:
    """the keys of the last day of each of a year's twelve months, as an array."""
    months = F.sequence(F.lit(1), F.lit(12))
    return F.transform(months, lambda m: key_of(F.last_day(F.make_date(year_col.cast("int"), m, F.lit(1)))))


def month_name_col(month_col: Column) -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_NAMES_ES])
    return F.element_at(names, month_col.cast("int"))
