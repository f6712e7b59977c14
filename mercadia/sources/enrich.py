"""Category enrichment: attach the English category name to products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Left-join products to the translation by the source-language name.

    Replaces any existing English name (the lookup is authoritative; products
    without a match keep NULL). The lookup is made unique per source name first
    (smallest English name wins), so the join can never duplicate a product.
    The lookup comes from a file, so no broadcast is forced: Spark broadcasts
    it when its measured size is under the broadcast threshold.
    """
    lk = (translation.groupBy("product_category_name")
          .agg(F.min("product_category_name_english").alias("__en")))
    base = products.drop("product_category_name_english") \
        if "product_category_name_english" in products.columns else products
    out = base.join(lk, "product_category_name", "left") \
        .withColumnRenamed("__en", "product_category_name_english")
    cols = ["product_id", "product_category_name", "product_category_name_english"]
    rest = [c for c in base.columns if c not in cols]
    return out.select(*cols, *rest)
