"""Priority queues for work inside one task, and the order that whole tables use instead.

Over a table, "take the least key, ties to the lower index" is ``least``; inside a task that walks
its own rows, ``IndexedQueue`` gives the same order with keys that may change.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least(rows: DataFrame, by: list[str], key: str, index: str) -> DataFrame:
    """The row of the least (key, index) in each group."""
    cols = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct(key, index)).alias("r")).select(*by, "r.*")


class IndexedQueue:
    """Least (key, index) first; a key may be raised or lowered; each item has one entry that counts."""

    def __init__(self):
        self._heap: list[tuple] = []
        self._key: dict = {}

    def __len__(self) -> int:
        return len(self._key)

    def put(self, index, key) -> None:
        """Insert, or change the key of what is there."""
        self._key[index] = key
        heapq.heappush(self._heap, (key, index))

    def take(self):
        """(key, index), or None when empty."""
        while self._heap:
            key, index = heapq.heappop(self._heap)
            if index in self._key and self._key[index] == key:
                del self._key[index]
                return key, index
        return None
