"""Tier thresholds of the three marts, as parameters.

Defaults are the business rules of the marts (``mercadia.fixed``); tests and
the tuned query keys pass other values to reach every branch on synthetic data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercadia import fixed as V


@dataclass(frozen=True)
class SupplierTiers:
    gold_score: float = V.GOLD_MIN_SCORE
    gold_on_time: float = V.GOLD_MIN_ON_TIME
    gold_min_orders: int = V.GOLD_MIN_ORDERS
    regular_score: float = V.REGULAR_MIN_SCORE
    regular_on_time: float = V.REGULAR_MIN_ON_TIME

    def segment(self, score="avg_review_score", on_time="on_time_rate",
                orders="total_orders") -> Column:
        s, r, o = F.col(score), F.col(on_time), F.col(orders)
        return (F.when((s >= self.gold_score) & (r >= self.gold_on_time)
                       & (o >= self.gold_min_orders), F.lit(V.GOLD_PARTNER))
                .when((s >= self.regular_score) & (r >= self.regular_on_time),
                      F.lit(V.REGULAR_OPERATION))
                .otherwise(F.lit(V.OPERATIONAL_RISK)))


@dataclass(frozen=True)
class LogisticsTiers:
    efficient_delay: float = V.EFFICIENT_MAX_DELAYED
    efficient_lead: float = V.EFFICIENT_MAX_LEAD_DAYS
    moderate_delay: float = V.MODERATE_MAX_DELAYED
    moderate_lead: float = V.MODERATE_MAX_LEAD_DAYS

    def tier(self, delay="pct_delayed", lead="avg_lead_time_days") -> Column:
        d, l_ = F.col(delay), F.col(lead)
        return (F.when((d <= self.efficient_delay) & (l_ <= self.efficient_lead),
                       F.lit(V.EFFICIENT_REGION))
                .when((d <= self.moderate_delay) & (l_ <= self.moderate_lead),
                      F.lit(V.MODERATE_DELAY_REGION))
                .otherwise(F.lit(V.HIGH_RISK_REGION)))


@dataclass(frozen=True)
class FinancialTiers:
    high_risk: float = V.HIGH_RISK_MIN_SHARE
    moderate_risk: float = V.MODERATE_RISK_MIN_SHARE

    def tier(self, share="pct_revenue_at_risk") -> Column:
        s = F.col(share)
        return (F.when(s >= self.high_risk, F.lit(V.HIGH_FINANCIAL_RISK))
                .when(s >= self.moderate_risk, F.lit(V.MODERATE_FINANCIAL_RISK))
                .otherwise(F.lit(V.FINANCIALLY_HEALTHY)))
