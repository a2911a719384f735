"""Tokens, overlap and BM25 scores, highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(c: Column, kind: str = "space") -> Column:
    """Lower-cased tokens of a text, between white space or (kind ``alnum``) runs of letters and digits."""
    pattern = r"\s+" if kind == "space" else r"[^\p{L}\p{N}]+"
    return F.filter(F.split(F.lower(c), pattern), lambda t: t != "")


def query_tokens(text: str, kind: str = "space") -> list[str]:
    """The distinct tokens of a query, in their order."""
    found = text.lower().split() if kind == "space" else [t for t in re.split(r"[\W_]+", text.lower()) if t]
    return list(dict.fromkeys(found))


def has_all(token_array: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), token_array)) == 0 if wanted else F.lit(True)


def overlap(token_array: Column, wanted: list[str]) -> Column:
    """How many of the wanted tokens the text has."""
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), token_array)).cast("double")


def highlight(c: Column, wanted: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with each wanted token marked, whole tokens only, whatever their case."""
    if not wanted:
        return c
    words = "|".join(re.escape(t) for t in sorted(wanted, key=len, reverse=True))
    return F.regexp_replace(c, rf"(?i)(?<!\S)({words})(?!\S)", f"{before}$1{after}")


def bm25(df: DataFrame, key: str, text: Column, wanted: list[str], score: str = "score", kind: str = "space") -> DataFrame:
    """(key, score) of the rows with any wanted token.

    Texts are split once a pass and their tokens counted by row, combined before the shuffle; the corpus
    figures are one aggregated row, joined as such. Keys are taken to be unique.
    """
    t = tokens(text, kind)
    each = df.select(F.col(key), F.explode_outer(t).alias("t"))
    counted = each.groupBy(key).agg(F.count("t").alias("n"), *[F.count_if(F.col("t") == w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    figures = counted.agg(F.count("*").alias("rows"), F.avg("n").alias("avg_n"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))])
    parts = F.lit(0.0)
    for i in range(len(wanted)):
        tf, seen = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("rows") - seen + 0.5) / (seen + 0.5))
        parts = parts + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    some = F.greatest(*[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0)) > 0
    return counted.where(some).join(F.broadcast(figures)).select(key, parts.alias(score))  # figures: one row
