"""mercato — a retail lakehouse (bronze → silver → gold → analytics/forecast)
expressed as Spark DataFrame plans.

Sub-packages
  sources/    bronze schemas, driver-table adapter, catalog reads/writes, run records
  functions/  Column-level helpers (surrogate keys, date keys, exact money sums)
  plans/      silver and gold models, the layered run with quality gates
  operators/  filters, joins, aggregates, windows, top-k, incremental merge,
              data-quality checks, forecasting, question queries, SQL screening,
              synthetic order generation
  streaming/  file-stream incremental ingest (availableNow micro-batches)
"""

from mercato.session import get_spark, checkpoint_dir  # noqa: F401
from mercato.lake import Lake  # noqa: F401
