"""Functions for SQL texts, as temporary SQL functions that Catalyst inlines (no Python runs)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geo import EARTH

# name: parameters, type, body
FUNCTIONS = {
    "geo_distance": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", f"2 * {EARTH}D * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "geo_within": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, meters DOUBLE", "BOOLEAN", "geo_distance(lat1, lon1, lat2, lon2) <= meters"),
    "in_box": ("lat DOUBLE, lon DOUBLE, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE", "BOOLEAN", "lat BETWEEN south AND north AND lon BETWEEN west AND east"),
    "text_tokens": ("s STRING", "ARRAY<STRING>", "filter(split(lower(s), '\\\\s+'), t -> t <> '')"),
    "has_tokens": ("s STRING, wanted STRING", "BOOLEAN", "size(array_except(text_tokens(wanted), text_tokens(s))) = 0"),
    "finds": ("s STRING, pattern STRING", "BOOLEAN", "rlike(s, pattern)"),
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "vector_dot(a, b) / (sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b)))"),
    "days_apart": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "cast(floor(abs(unix_millis(a) - unix_millis(b)) / 86400000) AS BIGINT)"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
