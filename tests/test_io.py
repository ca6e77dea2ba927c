"""Sources and sinks: csv2 round trip, tape CSV, newest extract, report bundle."""

import math
import os
import time

from loanroll.session import scratch_dir
from loanroll.sources import readers, sinks

NAN, INF = float("nan"), float("inf")


def test_csv2_roundtrip_special_values(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a"), (2, NAN, ""), (3, INF, None), (4, None, "x;y"), (5, -INF, "z"), (6, 1.0e7, "w")],
        "credito long, v double, s string")
    path = sinks.write_csv2(df, scratch_dir(spark, "t-csv2"), key=20010630)
    assert path.endswith("VALORACION_PRUEBA_pd70_total_20010630")
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert "1,5" in text and "NaN" in text and "Inf" in text and "NA" in text
    back = {r["credito"]: r for r in readers.read_csv2(spark, path, df.schema).collect()}
    assert back[1]["v"] == 1.5 and math.isnan(back[2]["v"]) and back[3]["v"] == INF
    assert back[4]["v"] is None and back[5]["v"] == -INF and back[6]["v"] == 1.0e7
    assert back[2]["s"] is None and back[3]["s"] is None and back[4]["s"] == "x;y"


def test_tape_csv_with_preamble(spark):
    folder = scratch_dir(spark, "t-tape")
    os.makedirs(folder)
    with open(os.path.join(folder, "tape.csv"), "w") as fh:
        fh.write("Cartera PM\nCorte noviembre\n\nCredito,Suma de Importe base,Precio de compra\n"
                 "10,\"1234,5\",300.25\n,5,1\n11,0,0\n")
    rows = [tuple(r) for r in readers.read_purchase_tape_csv(spark, folder).collect()]
    assert sorted(rows, key=str) == sorted([(10, 1234.5, 300.25), (None, 5.0, 1.0), (11, 0.0, 0.0)], key=str)


def test_tape_is_cut_by_position(spark):
    """Numbers in the preamble are no loans, ids with a decimal part are; '.' groups digits where a comma is the decimal mark."""
    folder = scratch_dir(spark, "t-tape2")
    os.makedirs(folder)
    with open(os.path.join(folder, "tape.csv"), "w") as fh:
        fh.write("20241130,x,y\n1,2,3\n\nCredito,Suma de Importe base,Precio de compra\n"
                 "10.0,\"1.234,5\",2\n12,\"1.234.567,25\",\"0,5\"\n 13 ,1234.5,n/a\n")
    rows = sorted(tuple(r) for r in readers.read_purchase_tape_csv(spark, folder).collect())
    assert rows == [(10, 1234.5, 2.0), (12, 1234567.25, 0.5), (13, 1234.5, None)]


def test_csv2_grouped_numbers(spark):
    folder = scratch_dir(spark, "t-csv2g")
    os.makedirs(folder)
    with open(os.path.join(folder, "x.csv"), "w") as fh:
        fh.write("credito;v\n1;1.234,5\n2;abc\n3;NA\n4;2,25\n5;7\n")
    got = {r["credito"]: r["v"] for r in readers.read_csv2(spark, folder, spark.createDataFrame([], "credito long, v double").schema).collect()}
    assert got == {1: 1234.5, 2: None, 3: None, 4: 2.25, 5: 7.0}


def test_jdbc_needs_bounds(spark):
    import inspect

    required = [n for n, p in inspect.signature(readers.read_jdbc_table).parameters.items() if p.default is p.empty]
    assert {"partition_column", "bounds"} <= set(required)


def test_newest_extract_is_read(spark):
    folder = scratch_dir(spark, "t-latest")
    old = spark.createDataFrame([(1, 1.0)], "credito long, v double")
    new = spark.createDataFrame([(2, 2.0)], "credito long, v double")
    sinks.write_csv2(old, folder, key=20010531)
    time.sleep(1.1)
    sinks.write_csv2(new, folder, key=20010430)  # newer file, older key: mtime decides
    got = readers.read_latest_csv2(spark, folder, sinks.EXTRACT_PREFIX, old.schema).collect()
    assert [r["credito"] for r in got] == [2]


def test_write_bundle_uses_display_names(spark):
    folder = scratch_dir(spark, "t-bundle")
    df = spark.createDataFrame([(1, 2.0, 3.0)], "credito long, saldo_a_capital double, compra double")
    paths = sinks.write_bundle({"Vigentes_70": df}, folder)
    back = spark.read.parquet(paths["Vigentes_70"])
    assert back.columns == ["Credito", "Saldo a capital", "Compra"]
    counts = {r["hoja"]: r["filas"] for r in sinks.bundle_counts({"a": df, "b": df.limit(0)}).collect()}
    assert counts == {"a": 1, "b": 0}


def test_warehouse_sources_from_stored_tables(spark):
    from tables import SF_SMALL
    from loanroll.plans.registry import fixture_params
    from loanroll.plans.reports import RollReport
    from loanroll.sources.fixtures import staged_sources
    from loanroll.sources.model import TABLES

    staged = staged_sources(spark, SF_SMALL)
    base = scratch_dir(spark, "t-warehouse")
    paths = {}
    for name in TABLES:
        getattr(staged, name).write.parquet(f"{base}/{name}")
        paths[name] = f"{base}/{name}"
    src = readers.warehouse_sources(spark, paths, wide_ledger=True)
    assert "total_deuda" in src.ledger_month.columns
    assert src.ledger_month.filter("total_deuda IS NOT NULL").isEmpty()
    assert RollReport(src, fixture_params()).units.count() == 14
