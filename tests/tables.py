"""Folders of the given tables, and small hand-made ledgers."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def ledger_rows(spark, rows):
    """Small ledger from (credito, id_fecha, tipo, capital, interest, arrears, days) tuples."""
    from loanroll.sources.schemas import LEDGER_MONTH

    full = []
    for credito, id_fecha, tipo, cap, inte, mora, days in rows:
        full.append((id_fecha, credito, 20000101, 1000.0, days, cap, inte, 0.0, 0.0, 0.0, 0.0, mora,
                     None, tipo, 0.0))
    return spark.createDataFrame(full, LEDGER_MONTH)
