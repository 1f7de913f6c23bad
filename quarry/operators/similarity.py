"""Fuzzy search of options for queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def similarity(query: Column, option: Column) -> Column:
    """Of a query within an option the ratio of lengths, else 1 - distance / longer length; in lower case."""
    q, o = F.lower(query), F.lower(option)
    longest = F.greatest(F.length(q), F.length(o))
    return F.when(F.contains(o, q), F.length(q) / F.greatest(F.length(o), F.lit(1))).when(longest > 0, 1 - F.levenshtein(q, o) / longest)


def find_similar(options: DataFrame, column: str, queries: list[str], threshold: float = 0.6) -> DataFrame:
    """A row per query and option that holds it or resembles it. Queries are a list of a caller: each
    option is compared with all of them in place, without a join."""
    rows = options.withColumn("query", F.explode(F.array(*map(F.lit, queries))))
    scored = rows.withColumn("similarity", similarity(F.col("query"), F.col(column)))
    return scored.filter(F.contains(F.lower(column), F.lower("query")) | (F.col("similarity") >= threshold))
