"""Values as the SQL builder and views understand them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column | str) -> Column:
    """Joined as strings; a null counts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def case(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    out = F
    for condition, value in branches:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def typed_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def position(array: Column, value: Column) -> Column:
    """Place of a value in an array, from 1; null where it isn't in it."""
    return F.nullif(F.array_position(array, value), F.lit(0).cast("long"))


def call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def keyword(c: Column) -> Column:
    """For comparing without regard to case and surrounding blanks."""
    return F.lower(F.trim(c))


def decode(c: Column, kind: str) -> Column:
    """A typed value out of text; lists are split at ``;;``, ``||NULL||`` is null."""
    c = F.when(c == "||NULL||", None).otherwise(c)
    if kind.startswith("array<"):
        return F.when(c.startswith("["), F.from_json(c, kind)).otherwise(F.split(c, ";;").cast(kind))
    if kind.startswith(("struct<", "map<")):
        return F.from_json(c, kind)
    return c.try_cast(kind)


def json_field(c: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(c, path if path.startswith("$") else f"$.{path}").try_cast(kind)


def incrementing_id(n: Column) -> Column:
    """Numbers as 19 digits, which sort as text."""
    return F.lpad(n.cast("string"), 19, "0")


def json_array_has(c: Column, value: Column, kind: str = "string") -> Column:
    """Whether a JSON array in a text column has a value."""
    return F.coalesce(F.array_contains(F.from_json(c, f"array<{kind}>"), value), F.lit(False))
