"""Units of distance, in metres."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in each unit.
METRES = {
    "kilometers": 1000.0,
    "meters": 1.0,
    "centimeters": 0.01,
    "millimeters": 0.001,
    "micrometers": 1e-6,
    "nanometers": 1e-9,
    "miles": 1609.344,
    "yards": 0.9144,
    "feet": 0.3048,
    "inches": 0.0254,
    "nautical_miles": 1852.0,
}


@dataclass(frozen=True, order=True)
class Distance:
    meters: float

    @staticmethod
    def of(value: float, unit: str) -> Distance:
        return Distance(value * METRES[unit])

    def to(self, unit: str) -> float:
        return self.meters / METRES[unit]

    def __add__(self, other: Distance) -> Distance:
        return Distance(self.meters + other.meters)

    def __sub__(self, other: Distance) -> Distance:
        return Distance(self.meters - other.meters)

    def __mul__(self, by: float) -> Distance:
        return Distance(self.meters * by)

    def __truediv__(self, by: float) -> Distance:
        return Distance(self.meters / by)


def convert(c: Column, source: str, target: str) -> Column:
    return c * F.lit(METRES[source]) / F.lit(METRES[target])
