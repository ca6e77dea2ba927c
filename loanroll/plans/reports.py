"""End-to-end reports as lazy DataFrame graphs.

* :class:`ValuationReport` - the newest script: rates, valuation, pricing,
  active/inactive split, summaries and lists in one pass.
* :class:`ExtractReport` - the older pair: capital-only rates and the
  direct-LTV factor written as a hand-off extract, then priced by the report.
* :class:`RollReport` - delinquency buckets, share history, roll matrices.

Each attribute is a cached DataFrame so several outputs share one logical
graph; nothing runs until a sink or an action.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loanroll.functions.calendar import closing_window_keys, date_key, previous_month_end, report_month_key
from loanroll.operators import ledger as L
from loanroll.operators import portfolio as P
from loanroll.operators import recovery as R
from loanroll.operators import rolling as RM
from loanroll.operators import state as S
from loanroll.operators import valuation as V
from loanroll.sources.layout import PERIOD_COLUMNS
from loanroll.sources.model import Sources


def last_two_months(as_of: dt.date) -> tuple[tuple[int, int], tuple[int, int]]:
    """The report month and the month before it, as (year, month), older first."""
    end = previous_month_end(as_of)
    before = previous_month_end(end)
    return (before.year, before.month), (end.year, end.month)


@dataclass(frozen=True)
class ReportParams:
    """A run's parameters; the date defaults to today (F14), the roll matrix to the last two closed months."""

    as_of: dt.date = field(default_factory=dt.date.today)
    product: int = 70
    second_product: int = 71                   # the other product of the daily table and the live lists
    min_balance: float = 0.0001
    exposure_baseline: str = "as_written"     # D1: or "initial"
    tie_break: tuple[str, ...] = ()            # 1.5: ledger columns before the declared tie-break
    roll_months: tuple[tuple[int, int], tuple[int, int]] | None = None
    include_over_360: bool = False             # D11
    live_71_source: str = "active"             # D7: or "inactive"
    assert_unique: bool = False                # D4: fail instead of fanning out

    @property
    def months(self) -> tuple[tuple[int, int], tuple[int, int]]:
        return self.roll_months or last_two_months(self.as_of)

    @property
    def report_key(self) -> int:
        return report_month_key(self.as_of)

    @property
    def prior_snapshot_key(self) -> int:
        return date_key(previous_month_end(previous_month_end(self.as_of)))

    @property
    def window_keys(self) -> list[int]:
        return closing_window_keys(self.as_of)


@dataclass
class _Base:
    src: Sources
    params: ReportParams = field(default_factory=ReportParams)
    exclusions: DataFrame | None = None        # P15: loan ids left out of every report
    observed: Observed | None = None           # D4: joins' rows are counted by the passes that write
    state: DataFrame | None = None             # per-loan state to take the profile from, instead of the ledger

    @cached_property
    def ledger(self) -> DataFrame:
        """The monthly ledger in its own columns."""
        return self.stored.drop(*PERIOD_COLUMNS)

    @cached_property
    def stored(self) -> DataFrame:
        """The monthly ledger as it is stored, without excluded loans (left anti join) if given."""
        if self.exclusions is None:
            return self.src.ledger_month
        excluded = self.exclusions.select("credito").distinct()
        return self.src.ledger_month.join(excluded, L.same_loan(self.src.ledger_month, excluded), "left_anti")

    @cached_property
    def ledger_seq(self) -> DataFrame:
        return L.with_sequence(self.ledger, self.params.tie_break, max_loan_rows=self.src.max_loan_rows)

    @cached_property
    def product_rows(self) -> DataFrame:
        """Product rows with ``orden`` (the sequence counts all products first)."""
        return L.product_slice(self.ledger_seq, self.params.product)

    @cached_property
    def profile(self) -> DataFrame:
        if self.state is not None:
            if self.exclusions is None:
                return S.profile(self.state)
            excluded = self.exclusions.select("credito").distinct()
            return S.profile(self.state.join(excluded, L.same_loan(self.state, excluded), "left_anti"))
        return L.loan_profile(self.ledger, self.params.product, tie_break=self.params.tie_break,
                              max_loan_rows=self.src.max_loan_rows)

    @cached_property
    def daily(self) -> DataFrame:
        return V.daily_closing_snapshot(self.src.ledger_day, self.params.window_keys,
                                        (self.params.product, self.params.second_product))

    @cached_property
    def tape(self) -> DataFrame:
        return V.purchase_tape(self.src.purchase_tape_raw)

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        return self.observed.mark(df, name) if self.observed else df

    def check_fan_out(self) -> dict[str, tuple[int, int]]:
        """Rows before and after each join, as the passes that have written them saw them; with ``assert_unique`` a
        join that made rows is looked into (one aggregate per side) and fails the report."""
        seen = self.observed.counts()
        rows = {name: (seen[a], seen[b]) for name, (a, b) in self.FAN_OUT.items() if a in seen and b in seen}
        if self.params.assert_unique and any(b != a for a, b in rows.values()):
            type(self)(self.src, self.params, self.exclusions, state=self.state).require_unique()
        return rows


class Observed:
    """Rows before and after the joins of a report, counted while it is written.

    Each marked frame is observed once; ``counts`` waits for the write that
    reads them. A recomputed task may be counted twice, so counts that differ
    are a suspicion, not a proof.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        self.seen[name] = Observation()
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("filas"))

    def counts(self) -> dict[str, int]:
        return {name: seen.get["filas"] for name, seen in self.seen.items()}


def _require_unique(df: DataFrame, what: str) -> None:
    """D4 option: raise when a per-loan side would fan a left join out."""
    if not L.assert_unique_key(df, ["credito"]).isEmpty():
        raise ValueError(f"{what} holds several rows for some loans; the join would fan out")


class ValuationReport(_Base):
    """Newest script: recovery rates -> valuation -> priced portfolio -> report.

    With ``observed`` the joins' rows are counted by the pass that writes
    ``priced``, and no side is read ahead of it.
    """

    #: The joins that may fan out: rows before, rows after.
    FAN_OUT = {"ltv": ("rates", "ltv"), "daily": ("ltv", "daily"), "valuation": ("tape", "priced")}

    @cached_property
    def base(self) -> DataFrame:
        return L.recovery_base(self.profile)

    @cached_property
    def adjusted(self) -> DataFrame:
        return L.adjusted_recovery_base(self.profile, self.params.exposure_baseline)

    @cached_property
    def rates(self) -> DataFrame:
        return R.all_rates(self.adjusted)

    @cached_property
    def ltv_snapshot(self) -> DataFrame:
        return V.ltv_snapshot(self.src.ltv, self.src.restructuring_mark, self.params.report_key)

    @cached_property
    def valuation(self) -> DataFrame:
        if self.params.assert_unique and not self.observed:
            _require_unique(self.ltv_snapshot, "LTV snapshot")
            _require_unique(self.daily, "daily closing snapshot")
        return V.valuation_table(self.rates, self.ltv_snapshot, self.daily, self.mark)

    def require_unique(self) -> None:
        """Raise for the first side that would fan its join out."""
        _require_unique(self.ltv_snapshot, "LTV snapshot")
        _require_unique(self.daily, "daily closing snapshot")
        _require_unique(self.valued, "valuation")

    @cached_property
    def valued(self) -> DataFrame:
        return V.with_price_factors(self.valuation)

    @cached_property
    def priced(self) -> DataFrame:
        return self.mark(V.priced_portfolio(self.mark(self.tape, "tape"), self.valued), "priced")

    @cached_property
    def active(self) -> DataFrame:
        return P.active_loans(self.priced)

    @cached_property
    def inactive(self) -> DataFrame:
        return P.inactive_loans(self.priced)

    @cached_property
    def summary(self) -> DataFrame:
        return P.portfolio_summary(self.active, self.params.min_balance)

    @cached_property
    def residual(self) -> DataFrame:
        return P.residual_loans(self.inactive, self.params.min_balance)

    @cached_property
    def residual_summary(self) -> DataFrame:
        return P.residual_summary(self.residual)

    @cached_property
    def live_70(self) -> DataFrame:
        return P.live_product_70(self.active, product=self.params.product)

    @cached_property
    def live_71(self) -> DataFrame:
        rows = self.active if self.params.live_71_source == "active" else self.inactive
        return P.live_product_71(rows, self.params.second_product)

    def bundle(self) -> dict[str, DataFrame]:
        """K1: the report's named tables (sheet name -> DataFrame)."""
        return {
            "Cartera": self.tape,
            "Resumen": self.summary,
            "residuo": self.residual,
            "Vigentes_70": self.live_70,
            "Vigentes_71": self.live_71,
        }


class ExtractReport(_Base):
    """Older pair: capital rates + direct-LTV factor -> extract -> priced report.

    The last two rows of a loan may fan its rates out (M4b, as in the script); the joins after that are observed.
    """

    FAN_OUT = {"daily": ("rates", "daily"), "ltv": ("daily", "ltv"), "extract": ("tape", "priced")}

    def require_unique(self) -> None:
        """Raise for the first side that would fan its join out."""
        _require_unique(self.daily, "daily closing snapshot")
        _require_unique(self.ltv_snapshot, "LTV snapshot")
        _require_unique(self.extract, "extract")

    @cached_property
    def capital_base(self) -> DataFrame:
        return L.capital_base_v1(self.profile)

    @cached_property
    def adjusted(self) -> DataFrame:
        return L.adjusted_capital_v1(self.profile, self.params.product)

    @cached_property
    def rates(self) -> DataFrame:
        return R.capital_rate_v1(self.adjusted)

    @cached_property
    def ltv_snapshot(self) -> DataFrame:
        snap = V.ltv_snapshot(self.src.ltv, self.src.restructuring_mark, self.params.report_key,
                              product=self.params.product)
        return snap.filter(F.col("id_fecha") == self.params.report_key)  # P16, redundant

    @cached_property
    def extract(self) -> DataFrame:
        """``VALORACION_FINAl``: the 19-column hand-off extract."""
        with_daily = self.mark(L.left_by_loan(self.mark(self.rates, "rates"), self.daily), "daily")
        t = self.mark(L.left_by_loan(with_daily, self.ltv_snapshot.select(*V.LTV_COLUMNS)), "ltv")
        return t.withColumn("Valoracion_pd",
                            V.price_factor_direct("tasa_recuperacion_anual", "LTV", "Duracion_p70"))

    @cached_property
    def extract_with_mod(self) -> DataFrame:
        """The report's factor on the extract, months = ``Duracion_p10``."""
        return self.extract.withColumn(
            "Valoracion_pd_mod",
            V.price_factor_inverse("tasa_recuperacion_anual", "LTV", "Duracion_p10"))

    @cached_property
    def ltv_change(self) -> DataFrame:
        return P.ltv_change(self.extract, self.src.ltv, self.params.prior_snapshot_key)

    @cached_property
    def priced(self) -> DataFrame:
        # the balance filter comes before the join, so that the rows before it are the tape's that pass it
        tape = self.mark(V.with_balance(self.tape, self.params.min_balance), "tape")
        return self.mark(V.priced_portfolio_v1(tape, self.extract_with_mod, self.params.min_balance), "priced")

    @cached_property
    def active(self) -> DataFrame:
        return P.active_loans(self.priced)

    @cached_property
    def inactive(self) -> DataFrame:
        return P.inactive_loans(self.priced)

    @cached_property
    def summary(self) -> DataFrame:
        # The report's own threshold (0.000001) is void after the 0.0001 tape filter.
        return P.portfolio_summary(self.active, self.params.min_balance, with_capital=False)

    @cached_property
    def residual(self) -> DataFrame:
        return P.residual_loans(self.inactive, self.params.min_balance)

    @cached_property
    def residual_summary(self) -> DataFrame:
        return P.residual_summary(self.residual)

    @cached_property
    def live_70(self) -> DataFrame:
        return P.live_product_70(self.active, keep_all_priced=False, product=self.params.product)

    @cached_property
    def live_71(self) -> DataFrame:
        return P.live_product_71(self.inactive, self.params.second_product)  # as written in the older report (D7)


class RollReport(_Base):
    """Delinquency migration of the product book (no sequence number needed)."""

    @cached_property
    def product_rows(self) -> DataFrame:
        return L.product_slice(self.stored, self.params.product)

    @cached_property
    def bucketed(self) -> DataFrame:
        return RM.with_bucket(self.product_rows)

    @cached_property
    def share_history(self) -> DataFrame:
        return RM.bucket_share_history(self.product_rows, self.params.include_over_360)

    @cached_property
    def one_hot(self) -> DataFrame:
        return RM.bucket_one_hot(self.product_rows, *self.params.months)

    @cached_property
    def one_hot_common(self) -> DataFrame:
        return RM.bucket_one_hot_common(self.product_rows, *self.params.months)

    @cached_property
    def common(self) -> DataFrame:
        return RM.common_loans(self.product_rows, *self.params.months)

    @cached_property
    def units(self) -> DataFrame:
        return RM.roll_matrix_units(self.product_rows, *self.params.months)

    @cached_property
    def share(self) -> DataFrame:
        return RM.roll_matrix_share(self.units)

    @cached_property
    def check(self) -> DataFrame:
        return RM.roll_matrix_check(self.share)

    @cached_property
    def collections_flag(self) -> DataFrame:
        # The script's ledger query carries ``orden``; keep it on these rows.
        sequenced = L.product_slice(self.ledger_seq, self.params.product)
        return RM.collections_flag(sequenced, self.src.collections)
