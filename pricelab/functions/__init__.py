"""Column-level helpers (pure Spark SQL expressions, no Python UDFs)."""

from pricelab.functions.expressions import (  # noqa: F401
    COMPLETED_STATUSES,
    DROPPED_RAW_COLUMNS,
    ELASTICITY_EDGES,
    ELASTICITY_LABELS,
    bin_label,
    calendar_columns,
    exact_mean,
    exact_sum,
    lenient_double,
    lenient_timestamp,
    nan_to_null,
    normalize_name,
    pct_change,
    snap_zero,
    strip_lower,
)
