"""The bundle of base relations every mart and the star schema are built from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """The seven gated base tables plus the state -> macro-region lookup.

    ``region_lookup`` has columns ``(state, region)``, one row per state. It is a
    bounded lookup (a country's states), so joins against it are broadcast.
    """

    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    region_lookup: DataFrame

    def with_(self, **changes) -> "Tables":
        return replace(self, **changes)

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers,
            "sellers": self.sellers,
            "products": self.products,
            "orders": self.orders,
            "order_items": self.items,
            "order_payments": self.payments,
            "order_reviews": self.reviews,
        }


class LazyTables:
    """Same attributes as :class:`Tables`, each built on first access.

    ``builders`` maps every field name of :class:`Tables` to a zero-argument
    function returning the DataFrame; a query that reads three relations never
    plans the other five.
    """

    FIELDS = ("customers", "sellers", "products", "orders", "items", "payments", "reviews",
              "region_lookup")

    def __init__(self, builders: dict):
        missing = set(self.FIELDS) - set(builders)
        if missing:
            raise ValueError(f"missing builders: {sorted(missing)}")
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def materialize(self) -> Tables:
        return Tables(**{f: getattr(self, f) for f in self.FIELDS})

    def with_(self, **changes) -> Tables:
        return self.materialize().with_(**changes)

    def as_dict(self) -> dict[str, DataFrame]:
        return self.materialize().as_dict()
