"""Structured Streaming: keep the price-demand table current as raw sales files arrive."""

from pricelab.streaming.price_demand import (  # noqa: F401
    compact_price_demand,
    read_price_demand,
    read_raw_stream,
    run_price_demand,
)
