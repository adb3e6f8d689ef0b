"""Ordered CASE tables kept as data.

A table is a tuple of ``(SQL predicate, label)`` pairs tried in order, and a
default.  A predicate that is NULL does not match, so NULL inputs reach the
default.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CaseTable:
    name: str
    rules: tuple[tuple[str, str | int], ...]
    default: str | int

    def column(self) -> Column:
        (predicate, label), *rest = self.rules
        chain = F.when(F.expr(predicate), F.lit(label))
        for predicate, label in rest:
            chain = chain.when(F.expr(predicate), F.lit(label))
        return chain.otherwise(F.lit(self.default)).alias(self.name)

    def with_rules(self, *rules: tuple[str, str | int]) -> "CaseTable":
        """The same output column with other thresholds."""
        return replace(self, rules=rules)


# Thresholds, labels and product names of the business rules.
STOCKOUT_RISK = CaseTable("stockout_risk_flag", (("weeks_of_stock < 2", 1),), 0)
REVENUE_TIER = CaseTable(
    "revenue_tier",
    (("avg_weekly_revenue >= 50000", "HIGH"), ("avg_weekly_revenue >= 20000", "MID")),
    "LOW",
)
DROUGHT_STRESS = CaseTable("drought_stress_flag", (("precip_mm_7d < 2", 1),), 0)
HIGH_HUMIDITY = CaseTable("high_humidity_flag", (("avg_humidity_pct > 80", 1),), 0)
VISIT_URGENCY = CaseTable(
    "visit_urgency",
    (
        ("stockout_risk_flag = 1 OR rps_score > 0.75D", "URGENT"),
        ("rps_score >= 0.50D", "SOON"),
    ),
    "ROUTINE",
)
RISK_TIER = CaseTable(
    "risk_tier",
    (("drs_score >= 0.65D", "HIGH"), ("drs_score >= 0.35D", "MEDIUM")),
    "LOW",
)
RECOMMENDED_PRODUCT = CaseTable(
    "recommended_product",
    (
        ("fungicide_risk_flag = 1", "Score 250 EC"),
        ("high_incidence_count > 10", "Actara 25 WG"),
        ("drought_stress_flag = 1", "Topik 15 WP"),
    ),
    "Monitor Digital Demand",
)
DEMAND_CATEGORY = CaseTable(
    "demand_category",
    (
        ("trend_slope > ma_4w * 0.20D", "SPIKE"),
        ("trend_slope > 5", "GROWING"),
        ("trend_slope < -5", "DECLINING"),
    ),
    "STABLE",
)
SKU_STOCKOUT = CaseTable(
    "stockout_risk_flag", (("forecasted_qty_w1 > current_stock_qty", 1),), 0
)
