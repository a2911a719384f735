"""Caches: rows by id, whole results, single values."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..collection import Collection


@dataclass
class PointCache:
    """Rows by id on the driver: the ``size`` last used, each for ``seconds``; a commit to the collection empties it."""

    source: Collection
    size: int = 1000
    seconds: float | None = None
    hits: int = 0
    misses: int = 0
    _rows: OrderedDict = field(default_factory=OrderedDict)

    def __post_init__(self) -> None:
        self.source.listeners.append(lambda _before, _changed: self._rows.clear())

    def get(self, key: Any) -> Row | None:
        found = self._rows.get(key)
        if found is not None and (self.seconds is None or time.monotonic() - found[1] < self.seconds):
            self.hits += 1
            self._rows.move_to_end(key)
            return found[0]
        self.misses += 1
        row = self.source.get(key)
        self._rows[key] = row, time.monotonic()
        self._rows.move_to_end(key)
        while len(self._rows) > self.size:
            self._rows.popitem(last=False)
        return row


@dataclass
class ResultCache:
    """Results of queries by name, persisted in the cluster until a commit to the collection or ``seconds`` pass."""

    source: Collection
    seconds: float | None = None
    _held: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.source.listeners.append(lambda _before, _changed: self.clear())

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self._held.get(name)
        if found is None or self.seconds is not None and time.monotonic() - found[1] >= self.seconds:
            if found is not None:
                found[0].unpersist()
            found = self._held[name] = make().persist(), time.monotonic()
        return found[0]

    def clear(self) -> None:
        for df, _ in self._held.values():
            df.unpersist()
        self._held.clear()


@dataclass
class StoredValue:
    """One named value in a key-value collection (_id, json); ``cached`` reads it once."""

    source: Collection
    name: str
    default: Callable[[], Any]
    cached: bool = False
    _value: Any = None
    _known: bool = False

    def get(self) -> Any:
        if self.cached and self._known:
            return self._value
        row = self.source.stored.where(F.col("_id") == self.name).first()
        self._value, self._known = (self.default() if row is None else json.loads(row["json"])), True
        return self._value

    def set(self, value: Any) -> Any:
        with self.source.transaction() as t:
            t.upsert([(self.name, json.dumps(value))])
        self._value, self._known = value, True
        return value

    def modify(self, f: Callable[[Any], Any]) -> Any:
        return self.set(f(self.get()))

    def clear(self) -> None:
        with self.source.transaction() as t:
            t.delete(self.name)
        self._value, self._known = None, False
