"""loanroll: loan-portfolio recovery, valuation and roll-rate analytics on PySpark.

Public functions take and return DataFrames; actions run in sinks, in the
staging of sources and where an operator's docstring says so. Layout:

* ``functions``  R-compatible NA/NaN expressions, calendar keys.
* ``sources``    schemas, readers, test-fixture views, sinks.
* ``operators``  ledger profile, recovery rates, valuation, portfolio, roll rates.
* ``plans``      end-to-end reports and the registered query set.
* ``llm``        operators of a training-data pipeline (optional).
"""

from loanroll.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
