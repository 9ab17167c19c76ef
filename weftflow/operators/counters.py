"""Counters of a job, gathered by Spark while the job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """``counted`` marks a place in a plan; after an action on it, :meth:`values` has the numbers."""

    def __init__(self):
        self.places: list[Observation] = []

    def counted(self, df: DataFrame, name: str, what: Column | None = None) -> DataFrame:
        """Count the rows (or ``what``, an aggregate) that pass here, as ``name``."""
        place = Observation()
        self.places.append(place)
        return df.observe(place, (F.count(F.lit(1)) if what is None else what).alias(name))

    def values(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for place in self.places:
            found |= place.get
        return found
