"""R NA/NaN rules as Spark SQL text (``rnum``) and the report calendar (``calendar``)."""

from loanroll.functions.rnum import (
    div_sql,
    eq_sql,
    ge_sql,
    gt_sql,
    ifelse_sql,
    is_na_sql,
    is_nan_sql,
    le_sql,
    lt_sql,
    sum_na_rm_sql,
)

__all__ = [
    "div_sql", "eq_sql", "ge_sql", "gt_sql", "ifelse_sql", "is_na_sql", "is_nan_sql", "le_sql", "lt_sql", "sum_na_rm_sql",
]
