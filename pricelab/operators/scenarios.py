"""Revenue what-if projections under a constant-elasticity demand model.

A scenario parameter list is a handful of Python floats: it becomes a literal
array exploded per baseline row (bounded fan-out, no join).  Baselines are
aggregated per key, so the operators work for any key (category, sku, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.functions import exact_sum, pct_change

# Scenario parameters of the analysis being reproduced.
PRICE_GRID = tuple(float(m) for m in np.linspace(0.90, 1.10, 5))  # 0.90 .. 1.10, 5 points
DISCOUNTS = (0.90, 0.80)       # price multipliers of the promotion scenarios
DEMAND_UPLIFTS = (1.10, 1.20)  # demand multipliers of the peak-demand scenarios


def baseline(fact: DataFrame, key: str = "category") -> DataFrame:
    """Quantity and revenue per key, revenue recomputed as Σ unit_price·qty (exact sum)."""
    return (fact.where(F.col(key).isNotNull())
                .groupBy(key).agg(F.sum("qty").alias("baseline_qty"),
                                  exact_sum(F.col("unit_price") * F.col("qty")).alias("baseline_rev")))


def baseline_from_price_demand(price_demand_df: DataFrame, key: str = "category") -> DataFrame:
    """The same baseline from a (key, unit_price) -> Σqty table: Σ qty and Σ price·Σqty.

    Lets the baseline and the elasticity fit share one pre-aggregation (and its
    shuffle) instead of scanning the fact table twice.
    """
    return price_demand_df.groupBy(key).agg(
        F.sum("qty").alias("baseline_qty"),
        exact_sum(F.col("unit_price") * F.col("qty")).alias("baseline_rev"))


def with_elasticity(base: DataFrame, elasticity_df: DataFrame, key: str = "category") -> DataFrame:
    """Inner join on the key: keys without a fitted elasticity drop out.

    Both inputs are aggregates hash-partitioned on ``key``, so the sort-merge join
    reuses that partitioning (no extra exchange); AQE turns it into a broadcast
    join at run time when one side measures small.
    """
    return base.join(elasticity_df.select(key, "elasticity"), key, "inner")


def _explode_param(values: Sequence[float], name: str) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)


PROMO_SUFFIX, PEAK_SUFFIX = "% discount", "% demand uplift"


def label_text(m: float, suffix: str) -> str:
    """(m - 1) * 100 truncated toward zero, as an integer label: 0.9 -> "-9% discount"."""
    return f"{int((m - 1) * 100)}{suffix}"


def _label(values: Sequence[float], suffix: str) -> Column:
    """The label of the row's multiplier, from the one rule above."""
    out = F.lit(None).cast("string")
    for m in values:
        out = F.when(F.col("multiplier") == F.lit(float(m)), F.lit(label_text(m, suffix))).otherwise(out)
    return out


def price_scenarios(base_el: DataFrame, multipliers: Sequence[float] = PRICE_GRID,
                    key: str = "category") -> DataFrame:
    """Revenue under a price multiplier m: R1 = R0 · m · m^E."""
    grid = base_el.select("*", _explode_param(multipliers, "multiplier"))
    m, e, r0 = F.col("multiplier"), F.col("elasticity"), F.col("baseline_rev")
    r1 = r0 * m * F.pow(m, e)
    return grid.select(
        key,
        ((m - F.lit(1.0)) * F.lit(100.0)).alias("price_change_pct"),
        r0.alias("baseline_revenue"),
        r1.alias("simulated_revenue"),
        pct_change(r1, r0).alias("rev_delta_pct"),
        m.alias("multiplier"),
    )


def promo_scenarios(base_el: DataFrame, discounts: Sequence[float] = DISCOUNTS,
                    key: str = "category") -> DataFrame:
    """Discount m: Q1 = Q0 · m^E and R1 = (R0 / Q0) · m · Q1."""
    grid = base_el.select("*", _explode_param(discounts, "multiplier"))
    m, e = F.col("multiplier"), F.col("elasticity")
    r0, q0 = F.col("baseline_rev"), F.col("baseline_qty")
    q1 = q0 * F.pow(m, e)
    r1 = F.try_divide(r0, q0) * m * q1
    return grid.select(key, _label(discounts, PROMO_SUFFIX).alias("scenario"), r0.alias("baseline_rev"),
                       r1.alias("sim_rev"), pct_change(r1, r0).alias("rev_change_pct"),
                       m.alias("multiplier"))


def peak_scenarios(base_el: DataFrame, uplifts: Sequence[float] = DEMAND_UPLIFTS,
                   key: str = "category") -> DataFrame:
    """Demand uplift u at an unchanged price: R1 = R0 · u (elasticity not used)."""
    grid = base_el.select("*", _explode_param(uplifts, "multiplier"))
    u, r0 = F.col("multiplier"), F.col("baseline_rev")
    r1 = r0 * u
    return grid.select(key, _label(uplifts, PEAK_SUFFIX).alias("scenario"), r0.alias("baseline_rev"),
                       r1.alias("sim_rev"), pct_change(r1, r0).alias("rev_change_pct"),
                       u.alias("multiplier"))


def evaluation(promo: DataFrame, peak: DataFrame) -> DataFrame:
    """All promotion and peak rows in one table (duplicates kept)."""
    return promo.unionByName(peak)


def scenario_labels(discounts: Sequence[float] = DISCOUNTS,
                    uplifts: Sequence[float] = DEMAND_UPLIFTS) -> list[str]:
    """Pivot column names, in sorted text order; derived from the parameters, not the data."""
    labels = [label_text(m, PROMO_SUFFIX) for m in discounts] + [label_text(u, PEAK_SUFFIX) for u in uplifts]
    return sorted(set(labels))


def _round1(c: Column) -> Column:
    # half-to-even to 1 decimal; "+ 0.0" turns -0.0 into 0.0
    return F.bround(c, 1) + F.lit(0.0)


def pivot_evaluation(ev: DataFrame, labels: Sequence[str], key: str = "category") -> DataFrame:
    """key × scenario -> mean % revenue change, rounded to 1 decimal."""
    return ev.groupBy(key).pivot("scenario", list(labels)).agg(_round1(F.avg("rev_change_pct"))).orderBy(key)


def price_step_name(m: float) -> str:
    step = int(round((m - 1) * 100))
    return "pct_0" if step == 0 else (f"pct_m{-step}" if step < 0 else f"pct_p{step}")


def pivot_price_grid(scen: DataFrame, multipliers: Sequence[float] = PRICE_GRID,
                     key: str = "category") -> DataFrame:
    """key × price change -> mean % revenue change, rounded to 1 decimal.

    Columns are named by whole-percent step (``pct_m10 .. pct_p10``) because the
    float percentages themselves carry representation noise.
    """
    steps = [int(round((m - 1) * 100)) for m in multipliers]
    piv = (scen.withColumn("step", F.round(F.col("price_change_pct")).cast("int"))
               .groupBy(key).pivot("step", steps).agg(_round1(F.avg("rev_delta_pct"))))
    return piv.withColumnsRenamed({str(s): price_step_name(m) for s, m in zip(steps, multipliers)}).orderBy(key)
