"""Money arithmetic.

Line revenue is a DOUBLE in the gold model.  Sums of doubles depend on the
order rows are added in — which at cluster scale depends on partitioning and
task timing — so two runs (or Spark and any other engine) disagree in the last
bits.  Aggregations here therefore accumulate an exact DECIMAL form of the
same quantity and cast to DOUBLE once, at the end: results are independent of
partitioning and reproducible run to run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Discounts are DOUBLE; twelve places keep 1/3 and float noise, and quantity × price
# × (1 − discount) then types as DECIMAL(37,14), which no type adjustment cuts.
# A discount that does not fit becomes NULL, and so does its line's revenue.
DISCOUNT_DECIMAL = "decimal(14,12)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_revenue(quantity="quantity", unit_price="unit_price", discount="discount") -> Column:
    """quantity × price × (1 − discount), typed DOUBLE (the per-row gold value)."""
    return (_col(quantity) * _col(unit_price) * (F.lit(1) - _col(discount))).cast("double")


def exact_line_revenue(quantity="quantity", unit_price="unit_price", discount="discount") -> Column:
    """The same product as an exact DECIMAL (price is DECIMAL(10,2))."""
    return (_col(quantity) * _col(unit_price).cast("decimal(10,2)")
            * (F.lit(1) - _col(discount).try_cast(DISCOUNT_DECIMAL)))

