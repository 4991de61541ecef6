"""Receipts of certified decisions, and stores that apply them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.shapes import QueryShape
from .certify import certify_all


class StoreApplicationError(RuntimeError):
    pass


@dataclass
class MemoryStore:
    """Values and receipts in memory. A receipt is checked before anything changes; repairs can't be carried out
    by the store itself, so they count as invalidations."""

    max_receipts: int = 100_000
    entries: dict = field(default_factory=dict)
    receipts: dict = field(default_factory=dict)

    def get(self, key):
        return self.entries.get(key)

    def set(self, key, value) -> None:
        self.entries[key] = value

    def delete(self, key) -> bool:
        return self.entries.pop(key, None) is not None

    def _receipt(self, key, event_id):
        return self.receipts.get((key, event_id))

    def _record(self, key, event_id, receipt) -> None:
        self.receipts[key, event_id] = receipt

    def _full(self) -> bool:
        return len(self.receipts) >= self.max_receipts

    def apply(self, key: str, event_id: str, decision: str, reason: str) -> str:
        """Apply a decision once and answer with the one that took effect."""
        effective, why = ("invalidate", "repair_execution_unavailable") if decision == "repair" else (decision, reason)
        seen = self._receipt(key, event_id)
        if seen is not None:
            if tuple(seen[:2]) != (decision, reason):
                raise StoreApplicationError(f"{key}/{event_id} was decided otherwise before")
            return seen[2]
        if self._full():
            raise StoreApplicationError("no room for receipts")
        if effective in ("invalidate", "unsupported"):
            self.delete(key)
            if self.get(key) is not None:
                raise StoreApplicationError(f"{key} is still there after its deletion")
        self._record(key, event_id, (decision, reason, effective, why))
        return effective


class RedisStore(MemoryStore):
    """The same over a client with get, set and delete; anything but a true acknowledgement raises."""

    def __init__(self, client, prefix: str = "tally", max_receipts: int = 100_000):
        super().__init__(max_receipts)
        self.client, self.prefix, self.written = client, prefix, 0

    def get(self, key):
        raw = self.client.get(f"{self.prefix}:value:{key}")
        return None if raw is None else json.loads(raw)

    def set(self, key, value) -> None:
        if self.client.set(f"{self.prefix}:value:{key}", json.dumps(value, default=str)) is not True:
            raise StoreApplicationError(f"{key} wasn't stored")

    def delete(self, key) -> bool:
        return bool(self.client.delete(f"{self.prefix}:value:{key}"))

    def _receipt(self, key, event_id):
        raw = self.client.get(f"{self.prefix}:cert:{key}:{event_id}")
        return None if raw is None else tuple(json.loads(raw))

    def _record(self, key, event_id, receipt) -> None:
        if self.client.set(f"{self.prefix}:cert:{key}:{event_id}", json.dumps(receipt)) is not True:
            raise StoreApplicationError(f"no receipt for {key}/{event_id}")
        self.written += 1

    def _full(self) -> bool:
        return self.written >= self.max_receipts


def receipts(events: DataFrame, shapes: list[QueryShape]) -> DataFrame:
    """Certificates of every event against every shape, in one pass over the events."""
    return certify_all(events, shapes).drop("cols")


def conflicting(stored: DataFrame) -> DataFrame:
    """Receipts (shape, event_id) that were decided in more than one way."""
    return stored.groupBy("shape", "event_id").agg(F.count_distinct("decision", "reason").alias("ways")).where("ways > 1")


def effective_counts(stored: DataFrame) -> DataFrame:
    """How often each decision took effect for each shape; the store can't repair, so repairs invalidate."""
    effective = F.when(F.col("decision") == "repair", "invalidate").otherwise(F.col("decision"))
    return stored.groupBy("shape", effective.alias("effective")).agg(F.count("*").alias("events"))


def apply_batches(store: MemoryStore):
    """A foreachBatch function that applies a stream's certificates to a store outside Spark, by partitions' order of seq."""

    def run(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("seq").select("shape", "event_id", "decision", "reason").toLocalIterator():
            store.apply(r["shape"], r["event_id"], r["decision"], r["reason"])

    return run
