"""Column calendar helpers agree with the Python ones."""

import datetime as dt

from pyspark.sql import functions as F

from loanroll.functions.calendar import (
    closing_window_keys,
    key_of,
    month_ends_of_year,
    month_name_col,
    previous_month_end_col,
    previous_month_name,
    report_month_key,
)


def test_column_and_python_calendars_agree(spark):
    days = [dt.date(2024, m, d) for m in range(1, 13) for d in (1, 15, 28)] + [dt.date(2025, 1, 31)]
    df = spark.createDataFrame([(d,) for d in days], "as_of date")
    me = previous_month_end_col(F.col("as_of"))
    got = df.select(
        "as_of", key_of(me).alias("key"), month_name_col(F.month(me)).alias("name"),
        key_of(F.date_add(me, 1)).alias("first"), key_of(F.date_add(me, 5)).alias("last"),
    ).collect()
    for r in got:
        window = closing_window_keys(r["as_of"])
        assert r["key"] == report_month_key(r["as_of"])
        assert r["name"] == previous_month_name(r["as_of"])
        assert (r["first"], r["last"]) == (window[0], window[-1])


def test_month_ends_of_year():
    ends = month_ends_of_year(2024)
    assert ends[1] == dt.date(2024, 2, 29) and ends[11] == dt.date(2024, 12, 31) and len(ends) == 12
