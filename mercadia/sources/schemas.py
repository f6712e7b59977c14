"""Declared schemas of the seven base tables and their domain rules.

Nothing is inferred: CSV files are read as text in the declared raw column
order and converted explicitly; the typed schemas below are what the gates,
marts and the published star expect.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)


def _st(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CUSTOMERS = _st(("customer_id", S, False), ("customer_unique_id", S, False),
                ("customer_zip_code_prefix", S, True), ("customer_city", S, True),
                ("customer_state", S, True))
SELLERS = _st(("seller_id", S, False), ("seller_zip_code_prefix", S, True),
              ("seller_city", S, True), ("seller_state", S, True))
PRODUCTS = _st(("product_id", S, False), ("product_category_name", S, True),
               ("product_category_name_english", S, True), ("product_weight_g", I, True),
               ("product_length_cm", I, True), ("product_height_cm", I, True),
               ("product_width_cm", I, True))
ORDERS = _st(("order_id", S, False), ("customer_id", S, False), ("order_status", S, False),
             ("order_purchase_timestamp", TS, False), ("order_approved_at", TS, True),
             ("order_delivered_carrier_date", TS, True),
             ("order_delivered_customer_date", TS, True),
             ("order_estimated_delivery_date", TS, True))
ORDER_ITEMS = _st(("order_id", S, False), ("order_item_id", I, False), ("product_id", S, False),
                  ("seller_id", S, False), ("shipping_limit_date", TS, True),
                  ("price", MONEY, False), ("freight_value", MONEY, False))
ORDER_PAYMENTS = _st(("order_id", S, False), ("payment_sequential", I, False),
                     ("payment_type", S, False), ("payment_installments", I, False),
                     ("payment_value", MONEY, False))
ORDER_REVIEWS = _st(("review_id", S, False), ("order_id", S, False), ("review_score", I, False),
                    ("review_comment_title", S, True), ("review_creation_date", TS, True),
                    ("review_answer_timestamp", TS, True))
CATEGORY_TRANSLATION = _st(("product_category_name", S, True),
                           ("product_category_name_english", S, True))

SCHEMAS = {"customers": CUSTOMERS, "sellers": SELLERS, "products": PRODUCTS,
           "orders": ORDERS, "order_items": ORDER_ITEMS, "order_payments": ORDER_PAYMENTS,
           "order_reviews": ORDER_REVIEWS}

PRIMARY_KEYS = {"customers": ["customer_id"], "sellers": ["seller_id"],
                "products": ["product_id"], "orders": ["order_id"],
                "order_items": ["order_id", "order_item_id"],
                "order_payments": ["order_id", "payment_sequential"],
                "order_reviews": ["review_id"]}

# child table -> [(child column, parent table, parent column)]
FOREIGN_KEYS = {"orders": [("customer_id", "customers", "customer_id")],
                "order_items": [("order_id", "orders", "order_id"),
                                ("product_id", "products", "product_id"),
                                ("seller_id", "sellers", "seller_id")],
                "order_payments": [("order_id", "orders", "order_id")],
                "order_reviews": [("order_id", "orders", "order_id")]}

# parents before children
LOAD_ORDER = ["customers", "sellers", "products", "orders", "order_items", "order_payments",
              "order_reviews"]

# --- Fixed values: declared text lengths (characters) ---------------------------------
MAX_LENGTH = {
    "customers": {"customer_id": 32, "customer_unique_id": 32, "customer_zip_code_prefix": 5,
                  "customer_city": 100, "customer_state": 2},
    "sellers": {"seller_id": 32, "seller_zip_code_prefix": 5, "seller_city": 100,
                "seller_state": 2},
    "products": {"product_id": 32, "product_category_name": 100,
                 "product_category_name_english": 100},
    "orders": {"order_id": 32, "customer_id": 32, "order_status": 20},
    "order_items": {"order_id": 32, "product_id": 32, "seller_id": 32},
    "order_payments": {"order_id": 32, "payment_type": 20},
    "order_reviews": {"review_id": 32, "order_id": 32, "review_comment_title": 255},
}

# Raw CSV column order, including columns that are read and then dropped.
RAW_COLUMNS = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix",
                  "customer_city", "customer_state"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "products": ["product_id", "product_category_name", "product_name_lenght",
                 "product_description_lenght", "product_photos_qty", "product_weight_g",
                 "product_length_cm", "product_height_cm", "product_width_cm"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
               "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id",
                    "shipping_limit_date", "price", "freight_value"],
    "order_payments": ["order_id", "payment_sequential", "payment_type",
                       "payment_installments", "payment_value"],
    "order_reviews": ["review_id", "order_id", "review_score", "review_comment_title",
                      "review_comment_message", "review_creation_date",
                      "review_answer_timestamp"],
    "category_translation": ["product_category_name", "product_category_name_english"],
}
# --- end of fixed values

# Tables whose quoted fields may hold line breaks (free review text).
MULTI_LINE = {"order_reviews"}

# Columns where an empty field means NULL; other text keeps an empty string.
BLANK_IS_NULL = {
    "products": ["product_weight_g", "product_length_cm", "product_height_cm",
                 "product_width_cm"],
    "orders": ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["shipping_limit_date"],
    "order_reviews": ["review_comment_title", "review_creation_date",
                      "review_answer_timestamp"],
}
