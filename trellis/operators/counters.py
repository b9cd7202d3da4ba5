"""Counts of what a plan does, taken while it runs for its own sake: no further job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Named counts over frames. `count` returns the frame with its counts observed; once it has been written or collected, `read` has them.

    A frame that one plan reads along several ways is counted once: the ways have the same rows and give the same counts."""

    def __init__(self):
        self._observed: dict[str, Observation] = {}

    def count(self, name: str, rows: DataFrame, **tests: Column) -> DataFrame:
        """`rows`, with the number of all of them and of those that pass each test counted under `name`."""
        if name in self._observed:
            raise ValueError(f"counted already: {name}")
        self._observed[name] = Observation(name)
        return rows.observe(self._observed[name], F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()))

    def read(self, *names: str) -> dict[str, dict[str, int]]:
        """The counts of the given names, or of all. It waits for frames that have not been written yet."""
        return {n: dict(self._observed[n].get) for n in names or self._observed}
