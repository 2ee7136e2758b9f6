"""Maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(m: Column, names: list[str]) -> Column:
    """The value of the first of ``names`` that the map has, whatever the case; keys that differ by case only: the last."""
    low = F.aggregate(F.map_entries(m), F.create_map().cast("map<string,double>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"].cast("double"))))
    return F.coalesce(*[low[n.lower()] for n in names])
