"""Named business measures over the star schema, sliced by dimension attributes.

A measure is an aggregate evaluated in the filter context given by ``by``
(group-by attributes) and ``where`` (attribute -> allowed values). Each fact
is aggregated in two levels:

1. to ``(dimension keys, order_id)`` grain on the fact itself (partial
   aggregation, before any dimension join, so the join sees order-grain rows);
2. dimension attributes are attached (bounded dimensions broadcast, the others
   joined by key and sized at runtime by AQE), re-aggregated to
   ``(slice, order_id)`` when an item-level attribute is involved, then to the
   slice.

Distinct-order counts (Total / Delayed / Cancelled Orders) are row counts and
flag sums at order grain, so no distinct-aggregate expansion is needed, and the
order-grain average lead time falls out of the same pass. Results of the facts
are joined on the slice with NULL-safe equality (slices are small); without a
slice each fact gives one row, attached as a scalar subquery.

Empty-context conventions: sums and counts are 0 when the slice has fact rows
but none qualify; ratios are NULL when their denominator is 0 or missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.fixed import GOLD_PARTNER, OPERATIONAL_RISK
from mercadia.functions import order_sets
from mercadia.functions.expressions import YEAR_MONTH, quotient, with_region, with_scalars, year_month

if TYPE_CHECKING:
    from mercadia.plans.star import Star


@dataclass(frozen=True)
class Attribute:
    name: str
    dim: str        # dimension providing it
    column: str     # column in that dimension


# attribute name -> column, per dimension; the column's own name where it is unambiguous
COLUMNS = {
    "date": {c: c for c in ("date_key", "full_date", "year", "quarter", "month", "month_name",
                            "day_of_month", "day_name", "day_of_week", "is_weekend")},
    "customer": {"customer_key": "customer_key", "customer_unique_id": "customer_unique_id",
                 "customer_city": "city", "customer_state": "state", "customer_region": "region"},
    "seller": {"seller_key": "seller_key", "seller_city": "city", "seller_state": "state",
               "seller_region": "region", "segment_tier": "segment_tier"},
    "product": {"product_key": "product_key", "category": "category_name_en"},
}
ATTRIBUTES: dict[str, Attribute] = {n: Attribute(n, dim, c) for dim, cols in COLUMNS.items()
                                    for n, c in cols.items()}

# which dimensions each fact reaches, through which key; 'order' marks a key that
# is constant within an order
FACT_KEYS = {
    "orders": {"date": ("date_key", True), "customer": ("customer_key", True),
               "seller": ("seller_key", False), "product": ("product_key", False)},
    "reviews": {"date": ("date_key", True), "seller": ("seller_key", True)},
    "sellers": {"seller": ("seller_key", True)},
}

FINANCIAL = ["total_revenue", "total_freight", "total_orders", "avg_ticket",
             "revenue_at_risk", "pct_revenue_at_risk", "freight_pct_of_revenue"]
LOGISTICS = ["avg_lead_time_days", "delayed_orders", "sla_pct", "delay_rate_pct",
             "cancelled_orders", "cancellation_rate_pct"]
QUALITY = ["avg_review_score", "total_reviews", "avg_response_time_days"]
SELLERS = ["total_sellers", "gold_partners", "pct_gold_partners", "operational_risk_sellers"]
MEASURE_FACT = {**{m: "orders" for m in FINANCIAL + LOGISTICS},
                **{m: "reviews" for m in QUALITY}, **{m: "sellers" for m in SELLERS}}


def _dimension(star: Star, dim: str, need_region: bool) -> DataFrame:
    if dim == "date":
        return star.dim_date  # days of the data's span: broadcast by its measured size
    if dim in ("customer", "seller"):
        d = star.dim_customer if dim == "customer" else star.dim_seller
        # geography's region of a state is the bounded state -> region lookup
        return with_region(d, "state", star.region_lookup) if need_region else d
    if dim == "product":
        return star.dim_product
    raise ValueError(dim)


def _attach(star: Star, rows: DataFrame, fact: str, attrs: Sequence[str]) -> DataFrame:
    """Join the dimensions that provide ``attrs`` onto fact-keyed rows."""
    by_dim: dict[str, list[Attribute]] = {}
    for a in attrs:
        at = ATTRIBUTES[a]
        if at.name != FACT_KEYS[fact][at.dim][0]:       # a key is in the rows already
            by_dim.setdefault(at.dim, []).append(at)
    for dim, ats in by_dim.items():
        key, _ = FACT_KEYS[fact][dim]
        d = _dimension(star, dim, any(a.column == "region" for a in ats))
        dkey = {"date": "date_key", "customer": "customer_key", "seller": "seller_key",
                "product": "product_key"}[dim]
        cols = [F.col(dkey).alias("__dk")] + [F.col(a.column).alias(a.name) for a in ats]
        rows = rows.join(d.select(*cols), F.col(key) == F.col("__dk"), "left").drop("__dk")
    return rows


def _values(v) -> list:
    return list(v) if isinstance(v, (list, tuple, set, frozenset, range)) else [v]


def _filter(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    for a, v in where.items():
        df = df.where(F.col(a).isin(*_values(v)))
    return df


def _restrict(star: Star, rows: DataFrame, fact: str, where: Mapping[str, object]) -> DataFrame:
    """Fact rows in the filter context: each dimension is filtered first and the fact
    semi-joined with its keys. A filter on a key column, and on the year of a fact partitioned by year,
    is applied to the fact itself; any other filter of the calendar reaches the
    months of a fact partitioned by month through the join (dynamic partition pruning)."""
    by_dim: dict[str, dict[str, object]] = {}
    for a, v in where.items():
        dim, column = ATTRIBUTES[a].dim, ATTRIBUTES[a].column
        key = FACT_KEYS[fact][dim][0]
        if column == key:
            rows = rows.where(F.col(key).isin(*_values(v)))
        if column == "year" and "year" in rows.columns:
            rows = rows.where(F.col("year").isin(*_values(v)))
        by_dim.setdefault(dim, {})[a] = v
    for dim, wanted in by_dim.items():
        key = FACT_KEYS[fact][dim][0]
        d = _dimension(star, dim, any(ATTRIBUTES[a].column == "region" for a in wanted))
        for a, v in wanted.items():
            d = d.where(F.col(ATTRIBUTES[a].column).isin(*_values(v)))
        on, wanted_keys = F.col(key) == F.col("__wk"), [F.col(key).alias("__wk")]
        if dim == "date" and YEAR_MONTH in rows.columns:
            on &= F.col(YEAR_MONTH) == F.col("__wm")
            wanted_keys.append(year_month(key).alias("__wm"))
        rows = rows.join(d.select(*wanted_keys), on, "left_semi")
    return rows


def _check_reach(fact: str, attrs: Sequence[str]) -> None:
    for a in attrs:
        if ATTRIBUTES[a].dim not in FACT_KEYS[fact]:
            raise ValueError(f"fact '{fact}' has no relationship to attribute '{a}'")


def _orders_measures(star: Star, by: Sequence[str], where: Mapping[str, object]) -> DataFrame:
    _check_reach("orders", [*by, *where])
    keys = list(dict.fromkeys(FACT_KEYS["orders"][ATTRIBUTES[a].dim][0] for a in by))
    order_level = all(FACT_KEYS["orders"][ATTRIBUTES[a].dim][1] for a in by)
    f = _restrict(star, star.fact_orders, "orders", where)
    if not order_level:  # many keys an order: grouping by them would hardly shrink the rows
        f = _attach(star, f, "orders", by)
        keys = list(by)
    risky = (F.col("is_delayed") == 1) | (F.col("is_cancelled") == 1)
    g = f.groupBy(*keys, "order_id").agg(
        F.sum("price").alias("rev"), F.sum("freight_value").alias("fr"),
        F.sum(F.when(risky, F.col("price")).otherwise(F.lit(0))).alias("risk"),
        F.max("is_delayed").alias("dly"), F.max("is_cancelled").alias("cnc"),
        F.sum("lead_time_days").alias("lsum"), F.count("lead_time_days").alias("lcnt"))
    if order_level:
        g = _attach(star, g, "orders", by)
    g = g.withColumn("olead", quotient("lsum", "lcnt"))
    a = g.groupBy(*by).agg(
        F.sum("rev").alias("total_revenue"), F.sum("fr").alias("total_freight"),
        F.count(F.lit(1)).alias("total_orders"), F.sum("risk").alias("revenue_at_risk"),
        F.sum("dly").alias("delayed_orders"), F.sum("cnc").alias("cancelled_orders"),
        quotient(F.sum("olead"), F.count("olead")).alias("avg_lead_time_days"))
    n = F.col("total_orders")
    return a.select(
        *by, "total_revenue", "total_freight", "total_orders",
        quotient(F.col("total_revenue"), n).alias("avg_ticket"),
        "revenue_at_risk",
        quotient(F.col("revenue_at_risk"), F.col("total_revenue")).alias("pct_revenue_at_risk"),
        quotient(F.col("total_freight"), F.col("total_revenue")).alias("freight_pct_of_revenue"),
        "avg_lead_time_days", "delayed_orders",
        (F.lit(1) - quotient(F.col("delayed_orders"), n)).alias("sla_pct"),
        quotient(F.col("delayed_orders"), n).alias("delay_rate_pct"),
        "cancelled_orders",
        quotient(F.col("cancelled_orders"), n).alias("cancellation_rate_pct"))


def _reviews_measures(star: Star, by: Sequence[str], where: Mapping[str, object]) -> DataFrame:
    _check_reach("reviews", [*by, *where])
    keys = list(dict.fromkeys(FACT_KEYS["reviews"][ATTRIBUTES[a].dim][0] for a in by))
    # partial aggregate per key combination before the dimension joins
    g = _restrict(star, star.fact_reviews, "reviews", where).groupBy(*keys).agg(
        F.sum("review_score").alias("ssum"), F.count("review_score").alias("scnt"),
        F.count(F.lit(1)).alias("n"),
        F.sum("response_time_days").alias("rsum"), F.count("response_time_days").alias("rcnt"))
    g = _attach(star, g, "reviews", by)
    a = g.groupBy(*by).agg(F.sum("ssum").alias("ssum"), F.sum("scnt").alias("scnt"),
                           F.sum("n").alias("total_reviews"),
                           F.sum("rsum").alias("rsum"), F.sum("rcnt").alias("rcnt"))
    return a.select(*by,
                    quotient("ssum", "scnt").alias("avg_review_score"),
                    "total_reviews",
                    quotient("rsum", "rcnt").alias("avg_response_time_days"))


def _seller_measures(star: Star, by: Sequence[str], where: Mapping[str, object]) -> DataFrame:
    """Dimension-level counts: filters and slices of other dimensions do not reach
    them, so their values repeat there (see :func:`measures`)."""
    attrs = list(dict.fromkeys([*by, *where]))
    _check_reach("sellers", attrs)
    s = _dimension(star, "seller", any(ATTRIBUTES[a].column == "region" for a in attrs))
    g = _filter(s.select(F.col("segment_tier").alias("__seg"),
                         *[F.col(ATTRIBUTES[a].column).alias(a) for a in attrs]), where)
    a = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_sellers"),
        F.count_if(F.col("__seg") == GOLD_PARTNER).alias("gold_partners"),
        F.count_if(F.col("__seg") == OPERATIONAL_RISK).alias("operational_risk_sellers"))
    return a.select(*by, "total_sellers", "gold_partners",
                    quotient(F.col("gold_partners"), F.col("total_sellers")).alias("pct_gold_partners"),
                    "operational_risk_sellers")


_BUILDERS = {"orders": _orders_measures, "reviews": _reviews_measures,
             "sellers": _seller_measures}


def measures(star: Star, names: Sequence[str], by: Sequence[str] = (),
             where: Mapping[str, object] | None = None) -> DataFrame:
    """Evaluate measures ``names`` for every combination of ``by`` attributes.

    Facts that a measure needs are aggregated separately and the per-fact
    results are joined on the slice (NULL-safe, full outer). Seller counts are
    taken over the seller attributes of the slice only and repeat along the others. Where
    only order counts are asked of a published star, by attributes that its order sets
    know, these are read instead of the fact.
    """
    where = dict(where or {})
    unknown = [n for n in names if n not in MEASURE_FACT]
    if unknown:
        raise ValueError(f"unknown measures {unknown}")
    strange = [a for a in [*by, *where] if a not in ATTRIBUTES]
    if strange:
        raise ValueError(f"unknown attributes {strange}; known: {sorted(ATTRIBUTES)}")
    facts = list(dict.fromkeys(MEASURE_FACT[n] for n in names))
    own = [b for b in by if ATTRIBUTES[b].dim == "seller"]
    own_where = {a: v for a, v in where.items() if ATTRIBUTES[a].dim == "seller"}
    cells = getattr(star, "order_cells", None)
    of_orders = [n for n in names if MEASURE_FACT[n] == "orders"]
    builders = dict(_BUILDERS)
    if cells is not None and set(of_orders) <= set(order_sets.NAMES) and order_sets.covers([*by, *where]):
        builders["orders"] = lambda s, b, w: order_sets.measures_of(s, cells, b, w)
    parts = [(list(by), builders[f](star, list(by), where)) for f in facts if f != "sellers"]
    if "sellers" in facts:
        if not parts and len(own) < len(by):
            parts.append((list(by), _slices(star, by, where)))
        parts.append((own, _seller_measures(star, own, own_where)))

    def combine(left, right):
        (lby, ldf), (rby, rdf) = left, right
        if not rby:
            return lby, with_scalars(ldf, rdf)  # one row, for every slice
        r = rdf.select(*[F.col(b).alias(f"__r_{b}") for b in rby],
                       *[c for c in rdf.columns if c not in rby])
        cond = [F.col(b).eqNullSafe(F.col(f"__r_{b}")) for b in rby]
        j = ldf.join(r, cond, "full" if len(rby) == len(lby) else "left")
        return lby, j.select(*[F.coalesce(F.col(b), F.col(f"__r_{b}")).alias(b) if b in rby else F.col(b)
                               for b in lby],
                             *[c for c in j.columns if c not in lby and not c.startswith("__r_")])

    return reduce(combine, parts)[1].select(*by, *names)


def _slices(star: Star, by: Sequence[str], where: Mapping[str, object]) -> DataFrame:
    """The values of ``by``: those of their dimension or, of several, those that occur together in
    the orders; only filters of these dimensions apply."""
    dims = list(dict.fromkeys(ATTRIBUTES[b].dim for b in by))
    near = {a: v for a, v in where.items() if ATTRIBUTES[a].dim in dims}
    if len(dims) > 1:
        keys = [FACT_KEYS["orders"][d][0] for d in dims]
        met = _restrict(star, star.fact_orders, "orders", near).select(*keys).distinct()
        return _attach(star, met, "orders", by).select(*by).distinct()
    names = list(dict.fromkeys([*by, *near]))
    d = _dimension(star, dims[0], any(ATTRIBUTES[a].column == "region" for a in names))
    d = d.select(*[F.col(ATTRIBUTES[a].column).alias(a) for a in names])
    return _filter(d, near).select(*by).distinct()
