"""The ledger's stored layout: one table, in folders by period, bucketed by loan.

Numbering, profile and every other per-loan step then need no exchange of the
ledger, as all rows of a loan lie in one bucket; month slices read the folders
of their period. A load writes one file for each bucket and period (a loan with
very many rows is thus spread over its periods while it is written), sorted by
loan and date, and keeps beside the table how many rows the largest loan has,
so that no report has to look for very large loans.

Choose the buckets by size (a bucket of a period is one file: 128 MB to 1 GB),
and ``period="month"`` but for small ledgers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of the folders by period, and what an ``id_fecha`` is divided by.
PERIODS = {"month": ("id_fecha_mes", 100), "year": ("id_fecha_anio", 10_000)}
PERIOD_COLUMNS = tuple(c for c, _ in PERIODS.values())
_LARGEST = "loanroll.max_loan_rows"


def store_ledger(ledger: DataFrame, table: str, buckets: int, period: str = "month", path: str | None = None,
                 dealt: bool = False) -> DataFrame:
    """Write the ledger as the catalog table ``table`` (at ``path``, if given) and return it as :func:`stored_ledger` does.

    ``dealt``: its partitions are the buckets already (any row may lie elsewhere, which costs files only), so it
    is not exchanged.
    """
    column, width = PERIODS[period]
    rows = ledger.withColumn(column, F.expr(f"id_fecha DIV {width}").cast("int"))
    bucket = F.pmod(F.hash("credito"), F.lit(buckets))  # Spark's own bucket of a row
    rows = rows if dealt else rows.repartition(buckets, bucket, F.col(column))
    writer = rows.write.mode("overwrite").format("parquet").partitionBy(column).bucketBy(buckets, "credito").sortBy("credito", "id_fecha")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    spark = ledger.sparkSession
    stored = spark.table(table)
    largest = stored.groupBy("credito").count().agg(F.max("count")).first()[0] or 0
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_LARGEST}' = '{largest}')")
    return stored


def stored_ledger(spark: SparkSession, table: str) -> tuple[DataFrame, int | None]:
    """The stored ledger (with its period column) and the rows of its largest loan, where the load has kept them."""
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    largest = properties.get(_LARGEST)
    return spark.table(table), int(largest) if largest else None


def in_period(ledger: DataFrame, year: int, month: int) -> Column:
    """A condition that holds for a month's folder, where the ledger is stored by period; true elsewhere."""
    found = F.lit(True)
    if "id_fecha_mes" in ledger.columns:
        found = found & (F.col("id_fecha_mes") == year * 100 + month)
    if "id_fecha_anio" in ledger.columns:
        found = found & (F.col("id_fecha_anio") == year)
    return found
