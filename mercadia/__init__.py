"""Marketplace analytics on Spark.

Load gated marketplace tables, check their quality, build three decision marts
(supplier performance, regional logistics, category financial health), publish a
star schema and evaluate named business measures by any dimension attribute.
Every public function takes and returns DataFrames.
"""

from mercadia.model import Tables

__all__ = ["Tables"]
