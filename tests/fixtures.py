"""Hand-made rows in the domain schema (string ids, exact decimals)."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from mercadia.functions.expressions import region_lookup
from mercadia.model import Tables
from mercadia.sources import schemas


def ts(s: str | None):
    return None if s is None else datetime.fromisoformat(s)


def d(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def tables(spark, customers=(), sellers=(), products=(), orders=(), items=(), payments=(),
           reviews=()) -> Tables:
    def mk(rows, schema):
        return spark.createDataFrame(list(rows), schema)
    return Tables(
        customers=mk(customers, schemas.CUSTOMERS),
        sellers=mk(sellers, schemas.SELLERS),
        products=mk(products, schemas.PRODUCTS),
        orders=mk([(o[0], o[1], o[2], ts(o[3]), None, None, ts(o[4]), ts(o[5])) for o in orders],
                  schemas.ORDERS),
        items=mk([(i[0], i[1], i[2], i[3], None, d(i[4]), d(i[5])) for i in items],
                 schemas.ORDER_ITEMS),
        payments=mk(payments, schemas.ORDER_PAYMENTS),
        reviews=mk([(r[0], r[1], r[2], None, ts(r[3]), ts(r[4])) for r in reviews],
                   schemas.ORDER_REVIEWS),
        region_lookup=region_lookup(spark))


def marketplace(spark) -> Tables:
    customers = [("c1", "u1", "01000", "sao paulo", "SP"),
                 ("c2", "u2", "20000", "rio", "RJ"),
                 ("c3", "u3", "69000", "manaus", "AM"),
                 ("c4", "u4", None, None, None),
                 ("c5", "u5", "99999", "nowhere", "XX")]
    sellers = [("s1", "01000", "sao paulo", "SP"),
               ("s2", "20000", "rio", "RJ"),
               ("s3", "80000", "curitiba", "PR"),   # only seen at sellers
               ("s4", "01000", "sao paulo", "SP")]  # no items
    products = [("p1", "beleza_saude", "health_beauty", 100, None, None, None),
                ("p2", "informatica", None, None, None, None, None),   # untranslated
                ("p3", "", None, None, None, None, None),              # blank category
                ("p4", None, None, None, None, None, None)]            # NULL category
    orders = [
        # id, customer, status, purchase, delivered, estimated
        ("o1", "c1", "delivered", "2017-01-02 10:00:00", "2017-01-10 09:00:00", "2017-01-20 00:00:00"),
        ("o2", "c2", "delivered", "2017-01-03 10:00:00", "2017-01-25 12:00:00", "2017-01-23 00:00:00"),
        # delivered the promised day but later that day: late, delay_days 0
        ("o3", "c1", "delivered", "2017-02-01 08:00:00", "2017-02-10 15:00:00", "2017-02-10 00:00:00"),
        ("o4", "c3", "canceled", "2017-03-01 08:00:00", None, "2017-03-20 00:00:00"),
        ("o5", "c3", "cancelled", "2017-03-02 08:00:00", "2017-03-05 00:00:00", "2017-03-20 00:00:00"),
        ("o6", "c2", "delivered", "2017-04-01 08:00:00", None, "2017-04-20 00:00:00"),
        ("o7", "c4", "delivered", "2018-05-01 08:00:00", "2018-05-09 08:00:00", None),
        ("o8", "c5", "delivered", "2018-06-01 08:00:00", "2018-06-05 08:00:00", "2018-06-20 00:00:00"),
        ("o9", "c1", "unavailable", "2018-07-01 08:00:00", None, "2018-07-20 00:00:00"),
    ]
    items = [
        # order, item, product, seller, price, freight
        ("o1", 1, "p1", "s1", 100, 10), ("o1", 2, "p2", "s1", 50, 5),
        ("o2", 1, "p1", "s1", 80, 8), ("o2", 2, "p3", "s2", 20, 2),
        ("o3", 1, "p2", "s2", 0, 1),
        ("o4", 1, "p4", "s3", 40, 4),
        ("o5", 1, "p1", "s3", 60, 6),
        ("o6", 1, "p1", "s2", 30, 3),
        ("o7", 1, "p2", "s1", 70, 7),
        ("o9", 1, "p1", "s2", 10, 1),
    ]
    reviews = [
        ("r1", "o1", 5, "2017-01-11 00:00:00", "2017-01-12 10:00:00"),
        ("r2", "o2", 1, "2017-01-26 00:00:00", "2017-01-26 20:00:00"),
        ("r3", "o2", 3, "2017-01-27 00:00:00", None),       # two reviews of one order
        ("r4", "o3", 4, None, None),
        ("r5", "o8", 2, "2018-06-06 00:00:00", "2018-06-08 00:00:00"),  # order without items
    ]
    return tables(spark, customers, sellers, products, orders, items, (), reviews)
