"""Bundles are published whole; joins that make rows fail before anything is published."""

import os

import pytest
from pyspark.sql import functions as F
from tables import SF_SMALL

from loanroll.plans import run
from loanroll.plans.registry import fixture_params
from loanroll.plans.reports import ValuationReport
from loanroll.session import scratch_dir
from loanroll.sources import readers, sinks
from loanroll.sources.fixtures import staged_sources


def _sheets(spark, n, bad=None):
    fail = F.raise_error(F.lit("broken sheet")).cast("bigint")
    return {f"hoja{i}": spark.range(n + i).select((fail if i == bad else F.col("id")).alias("credito")) for i in range(4)}


def test_a_failing_sheet_leaves_the_former_bundle_whole(spark):
    folder = scratch_dir(spark, "t-publish")
    paths = sinks.write_bundle(_sheets(spark, 3), folder)
    before = {n: spark.read.parquet(p).count() for n, p in paths.items()}
    version = spark.read.parquet(f"{folder}/{sinks.MANIFEST}").first()["version"]
    with pytest.raises(Exception, match="broken sheet"):
        sinks.write_bundle(_sheets(spark, 50, bad=2), folder)
    assert {n: df.count() for n, df in sinks.read_bundle(spark, folder).items()} == before == {f"hoja{i}": 3 + i for i in range(4)}
    assert spark.read.parquet(f"{folder}/{sinks.MANIFEST}").first()["version"] == version
    sinks.write_bundle(_sheets(spark, 50), folder)
    manifest = {r["hoja"]: r["filas"] for r in spark.read.parquet(f"{folder}/{sinks.MANIFEST}").collect()}
    assert manifest == {n: df.count() for n, df in sinks.read_bundle(spark, folder).items()} == {f"hoja{i}": 50 + i for i in range(4)}
    assert sorted(os.listdir(folder)) == sorted([*manifest, sinks.MANIFEST])  # nothing staged is left


def test_a_failing_rename_is_taken_back(spark, monkeypatch):
    folder = scratch_dir(spark, "t-publish2")
    sinks.write_bundle(_sheets(spark, 3), folder)
    moves, move = [], sinks._move

    def flaky(s, source, target):
        moves.append(target)
        if len(moves) == 4:  # the second sheet's new dataset
            raise OSError("no rename")
        move(s, source, target)

    monkeypatch.setattr(sinks, "_move", flaky)
    with pytest.raises(OSError, match="no rename"):
        sinks.write_bundle(_sheets(spark, 50), folder)
    assert {n: df.count() for n, df in sinks.read_bundle(spark, folder).items()} == {f"hoja{i}": 3 + i for i in range(4)}


def test_fan_out_fails_before_publishing(spark):
    src, out = staged_sources(spark, SF_SMALL), scratch_dir(spark, "t-fan")
    with pytest.raises(ValueError, match="fan out"):
        run.write_valuation_report(spark, ValuationReport(src, fixture_params(assert_unique=True)), out)
    assert not os.path.exists(out)
    report = ValuationReport(src, fixture_params())
    run.write_valuation_report(spark, report, out)
    rows = report.check_fan_out()
    assert rows["ltv"][1] > rows["ltv"][0] and rows["daily"][0] == rows["ltv"][1]


def test_unique_sides_pass(spark):
    src, out = staged_sources(spark, SF_SMALL), scratch_dir(spark, "t-fan2")
    one = {n: getattr(src, n).dropDuplicates(["credito"]) for n in ("ltv", "ledger_day", "purchase_tape_raw")}
    tape = one["purchase_tape_raw"].filter("credito IS NOT NULL")
    from dataclasses import replace
    src = replace(src, ltv=one["ltv"].withColumn("id_fecha", F.lit(20010630)), ledger_day=one["ledger_day"], purchase_tape_raw=tape)
    report = ValuationReport(src, fixture_params(assert_unique=True))
    run.write_valuation_report(spark, report, out)
    assert all(a == b for a, b in report.check_fan_out().values())


@pytest.mark.parametrize("split", [8, 64, 4096])
def test_tape_cut_over_small_splits(spark, split):
    """The preamble may reach over several splits of a file, and files are read by several tasks."""
    folder = scratch_dir(spark, "t-tape-splits")
    os.makedirs(folder)
    for k in range(3):
        with open(os.path.join(folder, f"tape{k}.csv"), "w") as f:
            f.write("1,1,1\n\n2,2,2\nCredito,Suma,Precio\n" + "".join(f"{100 * k + i},{i}.5,1\n" for i in range(1, 40)))
    keep = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_purchase_tape_csv(spark, folder)
        got = sorted(r["credito"] for r in rows.collect())
    finally:
        for n, v in keep.items():
            spark.conf.set(n, v)
    assert got == sorted(100 * k + i for k in range(3) for i in range(1, 40))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 0  # the text was read before, once


def test_range_predicates_hold_every_row_once(spark):
    """A third of the rows under one id, some without one: ranges of about equal rows, each row in one range."""
    ids = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(777)).when(F.col("id") % 50 == 1, F.lit(None))
                                   .otherwise(F.col("id") * F.col("id") % 100_000).cast("bigint").alias("k"))
    ranges = readers.split_ranges(ids, "k", 10, width=50)
    sizes = {r["parte"]: r["filas"] for r in ranges.collect()}
    assert sum(sizes.values()) == 6000 and -1 in sizes
    plain = [n for p, n in sizes.items() if p >= 0 and n < 2000]
    assert max(plain) < 2 * 6000 / 10
    conditions = readers.range_predicates(ranges, "k")
    counts = ids.select(*(F.sum(F.when(F.expr(c), 1).otherwise(0)) for c in conditions)).first()
    assert sum(counts) == 6000 and min(counts) > 0
    assert ids.filter(" OR ".join(f"({c})" for c in conditions)).count() == 6000
    assert readers.range_predicates(readers.split_ranges(ids.limit(0), "k", 10), "k") == ["k IS NULL", "k IS NOT NULL"]


def test_fan_out_of_the_older_report(spark):
    from loanroll.plans.reports import ExtractReport

    src, out = staged_sources(spark, SF_SMALL), scratch_dir(spark, "t-fan3")
    with pytest.raises(ValueError, match="fan out"):
        run.write_extract(ExtractReport(src, fixture_params(assert_unique=True)), out)
    assert not os.path.exists(out)
    report = ExtractReport(src, fixture_params())
    run.write_extract(report, out)
    assert set(report.check_fan_out()) == {"daily", "ltv"}
    run.write_extract_report(spark, report, out)
    rows = report.check_fan_out()
    assert set(rows) == {"daily", "ltv", "extract"} and rows["ltv"][1] > rows["ltv"][0]
