"""The report inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Sources:
    """The report inputs as lazy DataFrames.

    ``max_loan_rows``: ledger rows of the largest loan, where the load knows
    it; it spares the numbering a search for very large loans.
    """

    ledger_month: DataFrame
    ledger_day: DataFrame
    ltv: DataFrame
    restructuring_mark: DataFrame
    collections: DataFrame
    purchase_tape_raw: DataFrame
    max_loan_rows: int | None = None


TABLES = ("ledger_month", "ledger_day", "ltv", "restructuring_mark", "collections", "purchase_tape_raw")
# Tables that are stored by date: a date predicate reads the folders of those dates only.
PARTITIONED = ("ledger_day", "ltv")
